import random

import pytest

from lodestone.llm import splitting

SCHEMA = "project_id string, id string, generation bigint, file_hash string, heading string, start_line bigint, content string, piece string"


def make(seed, blank="\n\n"):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randrange(20, 60)):
        kind = rng.random()
        words = " ".join(rng.choice(["alpha", "größe", "中文", "x1"]) for _ in range(rng.randrange(5, 80)))
        parts.append("#" * rng.randrange(1, 8) + " " + words[:30] if kind < 0.2 else f"```\n{words}\n\n# no\n```" if kind < 0.3 else words)
    return blank.join(parts)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text_within_the_limit(seed):
    text = make(seed, "\r\n \r\n" if seed % 3 == 0 else "\n\n") if seed % 4 else "y" * 9000
    whole = splitting.Splitting(text)
    found, pieces = whole.candidates, whole.pieces()
    starts = [0]
    for line in text.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    natural = {starts[i] for i in found}
    done = 0
    for begin, end, first, last, _ in pieces:
        assert begin <= done < end and end - begin <= splitting.LIMIT and done - begin <= splitting.OVERLAP
        if done and done - begin < splitting.OVERLAP:
            assert begin in natural
        assert first == text.count("\n", 0, begin) and last == text.count("\n", 0, end - 1)
        done = end
    assert done == len(text)


def test_boundaries():
    lines = ["\n", "first\n", "\n", "para\n", "## head\n", "#no\n", "    # code\n", "```\n", "\n", "in\n", "```\n", "after\n", " \t\r\n", "~~~ x\n", "\n", "# in\n", "~~~~\n", "#\n", "\n", "```a`b\n", "\n", "```\n", "# open\n"]
    assert splitting.boundaries(lines) == [3, 4, 13, 17, 19, 21]


def test_an_edit_alters_only_neighbouring_pieces():
    changed = []
    for seed in range(20):
        text = "\n\n".join(make(seed + 100 * i) for i in range(3))
        at = len(text) // 2
        edited = text[:at] + " put in here " + text[at:]
        before, after = ({t[a:b] for a, b, *_ in splitting.Splitting(t).pieces()} for t in (text, edited))
        changed.append(len(before - after))
    assert sum(changed) / len(changed) <= 3


def test_rows_of_all_sorts(spark):
    long = make(1) * 4
    rows = [("p", "a", 1, "h", None, 10, long, "x"), ("p", "a", 1, "h", None, 10, long, "x"), ("p", "b", None, None, "T", None, "z" * 3601, "x"), ("p", "c", 1, "h", "", 1, "short", "x"), ("p", "d", 1, "h", "", 1, None, "x"), ("p", "e", 1, "h", "", 1, "", "x"), ("p", None, 1, "h", "", 1, "q" * 4000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = [tuple(r) for r in splitting.boundary_lines(df).collect()]
    assert len(lines) == len(set(lines)) and {k for k, _ in lines} == {"a"}
    assert sorted(n for _, n in lines) == [10 + i for i in splitting.Splitting(long).candidates]
    pieces = splitting.split_oversized(df).collect()
    assert {(r.id, r.piece, len(r.content), r.heading, r.start_line) for r in pieces if r.id in ("b", None)} >= {("b", 1, 3600, "T", 1), (None, 1, 3600, None, 1)}
    (total,) = splitting.coverage(splitting.split_oversized(df)).collect()
    assert tuple(total) == ("p", 3, len(long) + 3601 + 4000, 0, 0, 0)
    assert splitting.boundary_lines(spark.createDataFrame([], SCHEMA)).count() == splitting.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
