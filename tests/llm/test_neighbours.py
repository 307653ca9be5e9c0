import numpy as np
import pytest

from lodestone.llm import neighbours

SCHEMA = "h string, v array<float>, h2 int"


def brute(data, k):
    keep = {}
    for h, v, _ in data:
        if h is not None and v and any(v):
            keep[h] = max(keep.get(h, v), v)
    names = sorted(keep)
    m = np.array([keep[n] for n in names])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    return {n: [(names[j], s[i, j]) for j in np.argsort(-s[i])[:k]] for i, n in enumerate(names)}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    rows = [(f"h{i:04d}", (centres[i % 40] + 0.4 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(1500)]
    hot = [(f"z{i:04d}", (centres[0] + 0.01 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(500)]  # a quarter near one point
    odd = [(None, [1.0] * 64, 1), ("n1", None, 1), ("n2", [], 1), ("n3", [0.0] * 64, 1), ("n4", [1.0, 2.0], 1), ("n5", [float("nan")] * 64, 1)]
    return rows + hot + odd + rows[:20]


def test_recall_against_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 400)
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.nearest(df, "h", "v", 5, cell_rows=100).collect()
    want = brute([d for d in data if d[1] is None or len(d[1]) == 64 and not np.isnan(d[1][0]) or not d[1]], 5)
    found = {}
    for r in got:
        found.setdefault(r.key, {})[r.other] = r.similarity
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    hits = sum(any(abs(s - x) < 1e-3 for x in found[k].values()) if o not in found[k] else True for k, v in want.items() for o, s in v)
    assert hits >= 0.95 * 5 * len(want)


def test_pairs_hold_each_pair_once_and_only_similar_ones(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    pairs = [tuple(r) for r in neighbours.similar_pairs(df, "h", "v", cell_rows=200).collect()]
    want = {tuple(sorted((a, b))) for a, v in brute([d for d in data if d[1] and len(d[1]) == 64 and not np.isnan(d[1][0])], 5).items() for b, s in v if s >= 0.82}
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    rest = {p for p in want if not p[0].startswith("z") and not p[1].startswith("z")}  # among 500 nearly equal ones the five nearest are a matter of rounding
    assert len(rest & set(pairs)) >= 0.95 * len(rest)


def test_few_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), "h", "v").count() == 0
    assert neighbours.nearest(spark.createDataFrame([("a", [1.0, 2.0], 1)], SCHEMA), "h", "v").count() == 0
    two = neighbours.nearest(spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", [1.0, 2.0], 1)], SCHEMA), "h", "v").collect()
    assert sorted((r.key, r.other, round(r.similarity, 3)) for r in two) == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_two_sets_of_centroids(spark, data, monkeypatch):
    monkeypatch.setattr(neighbours, "COARSE_CELLS", 6)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rows = [d for d in data if d[1] and len(d[1]) == 64 and not np.isnan(d[1][0])]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "h", "v", 5, cell_rows=50).collect():
        got.setdefault(r.key, {})[r.other] = r.similarity
    want = brute(rows, 5)
    hits = sum(o in got[k] or any(abs(s - x) < 1e-3 for x in got[k].values()) for k, v in want.items() for o, s in v)
    assert hits >= 0.9 * 5 * len(want)


def test_a_third_of_all_vectors_are_equal(spark):
    rng = np.random.default_rng(3)
    rows = [(f"a{i:03d}", rng.standard_normal(64).tolist(), 1) for i in range(200)] + [(f"b{i:03d}", [1.0] * 64, 1) for i in range(100)] + [("c0", [2.0, 1.0] * 32, 1), ("c1", [4.0, 2.0] * 32, 1)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "h", "v", 3, cell_rows=60).collect():
        got.setdefault(r.key, []).append((r.other, round(r.similarity, 3)))
    assert {len(v) for v in got.values()} == {3} and len(got) == 302
    assert sorted(got["b007"]) == [("b000", 1.0), ("b001", 1.0), ("b002", 1.0)] and sorted(got["b001"])[0] == ("b000", 1.0)
    assert {("c1", 1.0), ("b000", 0.949), ("b001", 0.949)} == set(got["c0"])
    assert neighbours.similar_pairs(spark.createDataFrame(rows, SCHEMA), "h", "v", 3).where("hash_a = 'b000' AND hash_b = 'b001'").count() == 1


def test_measured_recall(spark, data):
    (found,) = neighbours.measured_recall(spark.createDataFrame(data, SCHEMA), "h", "v", 5, share=10).collect()
    assert found.queries > 100 and found.pairs == 5 * found.queries and found.found >= 0.95 * found.pairs
    assert neighbours.measured_recall(spark.createDataFrame([], SCHEMA), "h", "v").collect()[0].queries == 0
