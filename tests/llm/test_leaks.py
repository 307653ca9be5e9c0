import random

from lodestone.llm import leaks

WORDS = "amber basin crate lever hinge spool gate marker funnel tray copies holds lifts sorts skips weighs narrow velvet twin upper brisk faded hollow paper silent early".split()


def passage(seed, n=45):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(i, "read the passage below and answer", passage(i)) for i in range(1, 20)] + [(90, "q", None), (91, "q", ""), (None, "q", passage(99))]


def documents():
    p = passage(3).split()
    whole = " ".join(p)
    changed = " ".join("other" if i % 7 == 3 else w for i, w in enumerate(p))
    two = " ".join(p[:9]) + " something else entirely here " + " ".join(p[25:35])
    back = " ".join(p[25:35]) + " something else entirely here " + " ".join(p[:9])
    marked = "<p>" + "</b> ".join(f"**{w.upper()}**," for w in p) + "</p>"
    return [
        (1, f"Before. {whole}. After.", {3}), (2, f"x {changed} y", {3}), (3, two, {3}), (4, marked, {3}), (5, " ".join(p[:8]), set()), (6, "read the passage below and answer; item 3", set()),
        (7, None, set()), (8, "", set()), (9, f"{whole} and {passage(5)}", {3, 5}), (10, back, set()), (11, "a­m" + "ber " + passage(7) + " zz" * 40_000, {7}), (12, " ".join(p[:16]), {3}),
    ]


def pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.select("doc_id", "item_id").distinct().collect())


def test_both_ways_find_the_same(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t, _ in documents()], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, question string, passage string")
    want = sorted((i, k) for i, _, keys in documents() for k in keys)
    assert pairs(leaks.find_leaks(docs, items)) == want
    assert pairs(leaks.find_leaks(docs, items, block_bytes=3000)) == want
    assert leaks.leaking_pairs(docs.unionByName(docs), items).count() == len(want)


def test_removal_leaves_the_rest(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in documents()], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in leaks.remove_leaks(docs, spark.createDataFrame(ITEMS, "item_id bigint, question string, passage string")).collect()}
    assert out[1] == "Before. . After." and out[7] is None and out[8] == "" and out[5] == dict((i, t) for i, t, _ in documents())[5]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, question string, passage string")
    assert leaks.find_leaks(docs, items).count() == 0
    assert leaks.find_leaks(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), items).count() == 0


def test_blocks_make_no_difference(spark):
    """Random leaks with changes at every third to sixth word, so that some share a single n-gram with their passage."""
    rng = random.Random(5)
    items = [(i, passage(i, rng.choice([12, 30, 60]))) for i in range(40)] + [(3, passage(777)), (41, "一二三四五六七八九十百千万亿兆"), (42, passage(4, 30)[: 20 * 5])]
    docs = []
    for n in range(150):
        words = rng.choice(items)[1].split()
        step, start = rng.choice([3, 4, 6, 99]), rng.choice([0, 1, len(words) // 2])
        body = [rng.choice(["other", "thing", ""]) if i % step == 2 else w for i, w in enumerate(words[start:])]
        docs.append((n, " ".join([*rng.choices(WORDS, k=rng.choice([0, 40])), *body, "end"]), None))
    docs += [(500, "alpha beta gamma QQQ epsilon zeta", None), (501, "前 一二三四五六七八九十百千 后", None), (502, passage(9) + " x " * 3000 + (passage(9) + " ") * 200, None)]
    items.append((60, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, passage string")
    one, many = ({(r.doc_id, r.item_id, tuple(map(tuple, r.spans))) for r in leaks.find_leaks(df, tests, block_bytes=b).collect()} for b in (1 << 20, 4000))
    assert one == many and {(500, 60), (501, 41), (502, 9)} <= {x[:2] for x in one} and len(one) > 60
    (spans,) = [x[2] for x in one if x[:2] == (502, 9)]
    assert len(spans) == 201  # every copy


def test_stretches_inside_longer_ones_of_other_items():
    found = [(1, 0, 10, 0, 10), (2, 0, 10, 0, 10), (3, 0, 6, 2, 8), (4, 0, 6, 8, 14), (1, 0, 5, 9, 14)]
    assert sorted(leaks._outermost(found)) == [(1, 0, 10, 0, 10), (2, 0, 10, 0, 10), (4, 0, 6, 8, 14)]
