"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

Vectors are scaled to unit length and rotated at random; equal vectors are searched for once. A bounded
sample gives centroids, and beyond COARSE_CELLS cells a second set of them, for what the first leave, so
that cells keep their size while a vector is compared with about the square root of their number. Every
vector is then indexed in the cells of its two nearest centroids c by the signs of its rotated residual (one
bit a dimension), the residual's length and the inner product f of the residual's direction with its code.
A query visits the nearest cells. There its residual is quantised to 4 bits, inner products with all
codes are estimated with AND and popcount, and dividing by f makes the estimate unbiased, with an error
of at most EPSILON * sqrt((1 - f*f) / f*f / (D - 1)) with high probability. Vectors whose upper bound
reaches the k-th best similarity known so far are scored again with the vectors themselves. A cell that
holds very many vectors is parted by the first bits of the codes, and a query visits the parts that its own
signs and the least certain of them lead to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import batch_nearest
from lodestone.session import cut_lineage

#: The centroids are fitted on at most so many rows, whatever the size of the collection.
TRAIN_ROWS = 20_000
#: Rows a cell should hold, and centroids of the first set (1024 x 64 floats are 256 kB). The second set has rows / CELL_ROWS / COARSE_CELLS.
CELL_ROWS, COARSE_CELLS = 1024, 1024
#: Cells a query visits in a collection of PROBE_CELLS cells; with more cells their fourth root more.
PROBES, PROBE_CELLS = 11, 163
#: Cells a row is held in where queries don't visit all: a neighbour beyond the border of a query's cells is mostly held on this side, too. A second home finds more than one more probe, and costs as much shuffle.
HOMES = 2
#: Cells of more rows are parted; parts of such a cell that a query visits; rows of a part that are scanned at a time, and queries.
BLOCK_ROWS, PART_PROBES, BLOCK_QUERIES = 8192, 8, 32_768
EPSILON = 1.9
LEVELS = 4
SEED = 20240


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix over `dim` rounded up to whole 64-bit words; shorter vectors are padded with zeros."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 5, spherical: bool = True) -> np.ndarray:
    """K-means of the bounded sample, by angle or by distance; an emptied cell keeps its centroid."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        shift = 0 if spherical else (centres**2).sum(1) / 2
        nearest = np.concatenate([(part @ centres.T - shift).argmax(1) for part in np.array_split(sample, max(1, len(sample) * cells // 4_000_000))])
        sums = np.zeros((cells, sample.shape[1]), np.float32)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True) if spherical else np.bincount(nearest, minlength=cells)[:, None].astype(np.float32)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres).astype(np.float32)
    return centres


def encode(rotated: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the residuals as words, their lengths and correction scalars."""
    residual = rotated - centres
    length = np.linalg.norm(residual, axis=1)
    bits = np.packbits(residual > 0, axis=1, bitorder="little").view(np.uint64)
    factor = np.abs(residual).sum(1) / np.sqrt(residual.shape[1]) / np.maximum(length, 1e-9)
    return bits, length.astype(np.float32), np.maximum(factor, 1e-3).astype(np.float32)


def quantise(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-bit planes of each residual, with the value of level 0 and of a step."""
    low = residual.min(1, keepdims=True)
    step = np.maximum(residual.max(1, keepdims=True) - low, 1e-9) / (2**LEVELS - 1)
    level = np.rint((residual - low) / step).astype(np.uint8)
    planes = [np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(LEVELS)]
    return np.stack(planes, axis=1), low[:, 0], step[:, 0]


def search_block(
    base: dict[str, np.ndarray], queries: dict[str, np.ndarray], centre: np.ndarray, k: int, min_similarity: float = -2.0
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best others in this block of at least `min_similarity`: (query's id, their ids, their similarities).

    The estimate of a similarity is a matrix of rank four plus the scaled level sums of the popcounts. The k-th best of
    the estimates' column-group maxima picks a first few for exact scoring; after that, all whose upper bound reaches
    the k-th best exact score are scored.
    """
    size, dim = base["vec"].shape
    ones = np.bitwise_count(base["bits"]).sum(1).astype(np.float32)
    error = EPSILON * np.sqrt(np.maximum(1 / base["factor"] ** 2 - 1, 0) / (dim - 1)) * base["length"]
    gain = (base["length"] / base["factor"] / np.sqrt(dim)).astype(np.float32)
    right = np.stack([1 - base["length"] ** 2 / 2, np.ones(size, np.float32), 2 * ones * gain, -gain]).astype(np.float32)
    words = [np.ascontiguousarray(base["bits"][:, w]) for w in range(base["bits"].shape[1])]
    groups = -(-size // 32)
    step_rows = max(8, 131_072 // size)
    for start in range(0, len(queries["id"]), step_rows):
        vec, ids = queries["vec"][start : start + step_rows], queries["id"][start : start + step_rows]
        residual = vec - centre
        reach = np.linalg.norm(residual, axis=1)
        planes, low, step = quantise(residual)
        level = np.zeros((len(ids), size), np.uint16)
        meet, count = np.empty((len(ids), size), np.uint64), np.empty((len(ids), size), np.uint8)
        for j in range(LEVELS):
            for w, word in enumerate(words):
                np.bitwise_and(planes[:, j, w, None], word[None, :], out=meet)
                np.bitwise_count(meet, out=count)
                level += np.left_shift(count, j, dtype=np.uint16)
        left = np.stack([np.ones(len(ids), np.float32), -(reach**2) / 2, low, residual.sum(1)], axis=1).astype(np.float32)
        estimate = level.astype(np.float32)
        estimate *= (2 * step)[:, None]
        estimate *= gain
        estimate += left @ right
        tops = np.full((len(ids), groups * 32), -9, np.float32)
        tops[:, :size] = estimate
        tops = tops.reshape(len(ids), 32, groups).max(1)
        place = min(k, groups) - 1
        floor = -np.partition(-tops, place, axis=1)[:, place]
        known = np.full(len(ids), min_similarity, np.float32)
        for final in (False, True):
            if not final and (size <= k or min_similarity > 0 and np.count_nonzero(estimate + np.outer(reach, error) >= min_similarity) <= 8 * k * len(ids)):
                continue  # there is little to score anyway
            if final:
                estimate += np.outer(reach, error)
                row, col = np.nonzero(estimate >= (known - 1e-4)[:, None])
            else:
                row, col = np.nonzero(estimate >= floor[:, None])
            keep = ids[row] != base["id"][col]
            row, col = row[keep], col[keep]
            if len(row) > estimate.size / 24:  # so many that a matrix product costs less than gathering the chosen pairs
                score = (vec @ base["vec"].T)[row, col]
            else:
                score = np.einsum("nd,nd->n", vec[row], base["vec"][col])
            keep = score >= known[row]
            row, col, score = row[keep], col[keep], score[keep]
            order = np.lexsort((base["id"][col], -score, row))
            row, col, score = row[order], col[order], score[order]
            bound = np.searchsorted(row, np.arange(len(ids) + 1))
            if not final:
                full = np.diff(bound) >= k
                known[full] = np.maximum(known[full], score[bound[:-1][full] + k - 1])
        for i in np.flatnonzero(np.diff(bound)):
            s = slice(bound[i], min(bound[i + 1], bound[i] + k))
            good = score[s] >= min_similarity
            if good.any():
                yield int(ids[i]), base["id"][col[s]][good], score[s][good]


class Cells:
    """Centroids of cells, in one set or in two of which each pair makes a cell."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int) -> None:
        wanted = max(1, round(rows / cell_rows))
        first = min(wanted, COARSE_CELLS, max(1, len(sample)))
        self.first = fit_centroids(sample, first)
        self.second = np.zeros((1, sample.shape[1]), np.float32)
        if wanted > first and len(sample) > 1:
            left = sample - self.first[(sample @ self.first.T).argmax(1)]
            self.second = fit_centroids(left, min(-(-wanted // first), len(sample)), spherical=False)
        self.count = len(self.first) * len(self.second)

    def centre(self, cell: int) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def nearest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        close, width = vectors @ self.first.T, min(probes, len(self.first))
        near = np.argpartition(-close, width - 1, axis=1)[:, :width]
        if len(self.second) > 1:
            size, own = len(self.second), (self.second**2).sum(1)
            left = vectors[:, None, :] - self.first[near]
            far = (left**2).sum(2)[:, :, None] - 2 * left @ self.second.T + own
            cell = (near[:, :, None] * size + np.arange(size)).reshape(len(vectors), -1)
            close, probes = -far.reshape(len(vectors), -1), min(probes, cell.shape[1])
            take = np.argpartition(-close, probes - 1, axis=1)[:, :probes]
            near, close = np.take_along_axis(cell, take, 1), np.take_along_axis(close, take, 1)
        else:
            close = np.take_along_axis(close, near, 1)
        return np.take_along_axis(near, np.argsort(-close, axis=1, kind="stable"), 1)


def parts_of(residuals: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The parts, numbered by the first signs, that each query visits: its own, then those reached by turning the least certain signs."""
    lead = residuals[:, :bits]
    own = (lead > 0) @ (1 << np.arange(bits))
    cost = np.abs(lead)
    masks = np.arange(1 << bits) if bits <= 6 else np.array([0, *(1 << np.arange(bits)), *{(1 << a) | (1 << b) for a in range(bits) for b in range(a)}])
    price = cost @ ((masks[:, None] >> np.arange(bits)) & 1).T
    take = np.argsort(price, axis=1, kind="stable")[:, : min(probes, len(masks))]
    return own[:, None] ^ masks[take]


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, id (a row number), rep (the least id of an equal vector) and the unit vector as bytes of 4-byte floats, one row a key.

    Null keys and null, empty, all-zero and not finite vectors don't count; of several vectors of a key the greatest holds.
    """
    valid = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30))
    one = rows.where(F.col(key).isNotNull() & valid).groupBy(F.col(key).alias("key")).agg(F.max(vector).alias("vector"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["vector"]:
                v = np.asarray(v, np.float64)
                out.append((v / np.linalg.norm(v)).astype(np.float32).tobytes())
            yield pd.DataFrame({"key": batch["key"], "vec": out})

    scaled = cut_lineage(one.mapInPandas(scale, f"key {one.schema['key'].dataType.simpleString()}, vec binary").withColumn("id", F.monotonically_increasing_id()))
    marks = [F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(SEED), "vec").alias("b")]
    twins = cut_lineage(scaled.select("id", *marks).groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if twins.isEmpty():
        return scaled.withColumn("rep", F.col("id"))
    return scaled.select("*", *marks).join(twins, ["a", "b"], "left").select("key", "id", F.coalesce("rep", "id").alias("rep"), "vec")


def nearest(rows: DataFrame, key: str, vector: str, k: int = 5, probes: int = PROBES, cell_rows: int = CELL_ROWS, min_similarity: float = -2.0) -> DataFrame:
    """key, other, similarity: for every key with a vector its k most similar other keys (cosine).

    Only pairs of at least `min_similarity` are given, vectors of another than the commonest length not at all. Equal
    similarities are ordered by an internal row number, those of equal vectors by key. A single vector or none gives no rows; equal vectors under different keys are each other's
    neighbours. Fewer than k others give as many as there are.
    """
    spark = rows.sparkSession
    vectors = unit_vectors(rows, key, vector)
    widths = vectors.groupBy(F.length("vec").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("id") == F.col("rep")).alias("reps")).orderBy(F.desc("n"), "w").limit(1).collect()
    key_type = vectors.schema["key"].dataType.simpleString()
    if not widths:
        return spark.createDataFrame([], f"key {key_type}, other {key_type}, similarity float")
    width, total = widths[0]["w"], widths[0]["reps"]
    vectors = vectors.where(F.length("vec") == width)
    pairs = _search(vectors.where("id = rep").select("id", "vec"), width // 4, total, k, probes, cell_rows, min_similarity)
    names = vectors.select("id", "key")
    if total == widths[0]["n"]:
        return (
            pairs.join(names, "id")
            .select("key", F.col("other").alias("id"), "similarity")
            .join(names.withColumnRenamed("key", "name"), "id")
            .select("key", F.col("name").alias("other"), "similarity")
        )
    # of each set of equal vectors the first k + 1 keys, cut before the shuffle, stand for it among the others
    some = vectors.select("rep", "key").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("n") <= k + 1).select("rep", F.col("key").alias("name"))
    same = pairs.select("id").distinct().select("id", F.col("id").alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    alone = vectors.select(F.col("rep").alias("id")).distinct().join(pairs.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    near = pairs.unionByName(same).unionByName(alone).join(some.withColumnRenamed("rep", "other"), "other").select("id", "name", "similarity")
    first = Window.partitionBy("id").orderBy(F.desc("similarity"), "name")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select(F.col("id").alias("rep"), "name", "similarity")
    best = Window.partitionBy("key").orderBy(F.desc("similarity"), "name")
    return (
        vectors.select("rep", "key").join(near, "rep").where(F.col("key") != F.col("name"))
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("key", F.col("name").alias("other"), "similarity")
    )


_ROW = "cell bigint, block int, salt int, id bigint, half binary, code binary, length float, factor float"


def _search(vectors: DataFrame, dim: int, total: int, k: int, probes: int, cell_rows: int, min_similarity: float) -> DataFrame:
    """id, other, similarity of different vectors (id, vec)."""
    turn = rotation(dim)
    share = min(1.0, 1.2 * TRAIN_ROWS / total)
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").limit(TRAIN_ROWS).collect()
    sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in picked), np.float32).reshape(len(picked), -1) @ turn if picked else np.zeros((1, turn.shape[1]), np.float32)
    cells = Cells(sample, total, cell_rows)
    probes = min(round(probes * max(1.0, cells.count / PROBE_CELLS) ** 0.25), cells.count)
    homes = min(HOMES, probes) if probes < cells.count else 1

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            step = max(1, min(2048, 4_000_000 // (probes * len(cells.second) * 8)))
            for at in range(0, len(whole), step):
                batch = whole.iloc[at : at + step]
                vec = np.frombuffer(b"".join(batch["vec"]), np.float32).reshape(len(batch), -1) @ turn
                near = cells.nearest(vec, probes)
                held = near[:, :homes].ravel()
                bits, length, factor = encode(np.repeat(vec, homes, axis=0), np.stack([cells.centre(c) for c in held]))
                half = vec.astype(np.float16)
                yield pd.DataFrame(
                    {
                        "id": batch["id"].to_numpy(),
                        "near": list(near.astype(np.int64)),
                        "code": [b.tobytes() for b in bits.reshape(len(batch), -1)],
                        "length": list(length.reshape(-1, homes)),
                        "factor": list(factor.reshape(-1, homes)),
                        "half": [h.tobytes() for h in half],
                    }
                )

    indexed = cut_lineage(vectors.mapInPandas(index, "id bigint, near array<bigint>, code binary, length array<float>, factor array<float>, half binary"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("length", "float"), ("factor", "float"))]
    width = turn.shape[1] // 8
    stored = indexed.select(F.posexplode(F.slice("near", 1, homes)).alias("n", "cell"), "id", "half", "code", "length", "factor")
    stored = stored.select("cell", "id", "half", F.expr(f"substring(code, n * {width} + 1, {width})").alias("code"), F.expr("length[n]").alias("length"), F.expr("factor[n]").alias("factor"))
    asked = indexed.select(F.explode("near").alias("cell"), "id", "half", *nothing)
    both = stored.unionByName(asked)
    sizes = indexed.select(F.posexplode("near").alias("place", "cell")).groupBy("cell").agg(F.count_if(F.col("place") < homes).alias("rows"), F.count("*").alias("asked"))
    large = cut_lineage(sizes.where((F.col("rows") > BLOCK_ROWS) | (F.col("asked") > BLOCK_QUERIES)))
    if large.isEmpty():
        placed = both.select("cell", F.lit(0).alias("block"), F.lit(0).alias("salt"), "id", "half", "code", "length", "factor")
    else:
        joined = both.join(large, "cell", "left")
        plain = joined.where("rows IS NULL").select("cell", F.lit(0).alias("block"), F.lit(0).alias("salt"), "id", "half", "code", "length", "factor")
        placed = plain.unionByName(_parted(joined.where("rows IS NOT NULL"), cells))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        half = np.frombuffer(b"".join(group["half"]), np.float16).reshape(len(group), -1).astype(np.float32)
        ids = group["id"].to_numpy()
        is_base = group["code"].notna().to_numpy()
        found: list[tuple[int, bytes]] = []
        if is_base.any():
            base = {
                "id": ids[is_base],
                "vec": half[is_base],
                "bits": np.frombuffer(b"".join(group["code"][is_base]), np.uint64).reshape(int(is_base.sum()), -1),
                "length": group["length"].to_numpy(np.float32)[is_base],
                "factor": group["factor"].to_numpy(np.float32)[is_base],
            }
            queries = {"id": ids[~is_base], "vec": half[~is_base]}
            for key_, others, score in search_block(base, queries, cells.centre(int(group["cell"].iloc[0])), k, min_similarity):
                found.append((key_, others.astype("<i8").tobytes() + score.astype("<f4").tobytes()))
        return pd.DataFrame(found, columns=["id", "best"]).astype({"id": "int64"})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, other, score = [], [], []
            for key_, lists in zip(batch["id"], batch["lists"]):
                o = np.concatenate([np.frombuffer(x[: len(x) // 12 * 8], "<i8") for x in lists])
                s = np.concatenate([np.frombuffer(x[len(x) // 12 * 8 :], "<f4") for x in lists])
                take = np.lexsort((o, -s))
                take = take[np.sort(np.unique(o[take], return_index=True)[1])][:k]
                keys.append(np.full(len(take), key_))
                other.append(o[take])
                score.append(s[take])
            if keys:
                yield pd.DataFrame({"id": np.concatenate(keys), "other": np.concatenate(other), "similarity": np.concatenate(score)})

    lists = placed.groupBy("cell", "block", "salt").applyInPandas(scan, "id bigint, best binary")
    return lists.groupBy("id").agg(F.collect_list("best").alias("lists")).mapInPandas(merge, "id bigint, other bigint, similarity float")


def _parted(joined: DataFrame, cells: Cells) -> DataFrame:
    """Rows and queries of large cells by part and, where a part is large still, by hash: no group holds more than a few BLOCK_ROWS and BLOCK_QUERIES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (cell, rows, asked), some in batch.groupby(["cell", "rows", "asked"], sort=False):
                bits = int(np.ceil(np.log2(max(1.0, rows / BLOCK_ROWS))))
                part = some.drop(columns=["rows", "asked"])
                left = np.frombuffer(b"".join(part["half"]), np.float16).reshape(len(part), -1).astype(np.float32) - cells.centre(int(cell))
                is_base = part["code"].notna().to_numpy()
                visits = parts_of(left, bits, PART_PROBES) if bits else np.zeros((len(part), 1), np.int64)
                salts = max(1, -(-int(asked) * visits.shape[1] // (BLOCK_QUERIES << bits)))
                base, query = part[is_base].assign(block=visits[is_base, 0]), part[~is_base]
                out += [base.assign(salt=n) for n in range(salts)]
                wide = query.iloc[np.repeat(np.arange(len(query)), visits.shape[1])]
                out.append(wide.assign(block=visits[~is_base].ravel(), salt=wide["id"].to_numpy() % salts))
            if out:
                yield pd.concat(out)[["cell", "block", "salt", "id", "half", "code", "length", "factor"]]

    placed = cut_lineage(joined.select("cell", "id", "half", "code", "length", "factor", "rows", "asked").mapInPandas(run, _ROW))
    counted = placed.where("salt = 0 AND code IS NOT NULL").groupBy("cell", "block").agg(F.count("*").alias("held"))
    heavy = cut_lineage(counted.where(F.col("held") > 4 * BLOCK_ROWS).select("cell", "block", F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("slices")))
    if heavy.isEmpty():
        return placed
    cut = placed.join(heavy, ["cell", "block"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    slices = F.explode(F.when(F.col("code").isNotNull(), own).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    return cut.withColumn("slice", slices).select("cell", (F.col("block") + F.col("slice") * (1 << 20)).cast("int").alias("block"), "salt", "id", "half", "code", "length", "factor")


def similar_pairs(rows: DataFrame, key: str, vector: str, k: int = 5, min_similarity: float = 0.82, **options: int) -> DataFrame:
    """hash_a < hash_b: pairs where one is among the k most similar of the other and at least `min_similarity` alike."""
    found = nearest(rows, key, vector, k, min_similarity=min_similarity, **options)
    return found.select(F.least("key", "other").alias("hash_a"), F.greatest("key", "other").alias("hash_b")).distinct()


def measured_recall(rows: DataFrame, key: str, vector: str, k: int = 5, share: int = 50) -> DataFrame:
    """queries, pairs, found: of the keys whose hash is divisible by `share`, and their k nearest by comparing with all vectors, how many `nearest` gives.

    A pair as similar as the k-th true one counts as found.
    """
    numbered = unit_vectors(rows, key, vector).select("id", "key", "vec")

    def floats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "v": [np.frombuffer(v, np.float32) for v in batch["vec"]], "key": batch["key"]})

    plain = cut_lineage(numbered.select("id", "vec", "key").mapInPandas(floats, f"id bigint, v array<float>, key {numbered.schema['key'].dataType.simpleString()}"))
    queries = plain.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
    truth = batch_nearest(plain.select("id", "v"), queries.select("id", "v"), "id", "v", k)
    least = truth.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    given = nearest(rows, key, vector, k).join(queries.select("id", "key"), "key")
    met = given.join(least, "id").where(1 - F.col("similarity") <= F.col("far") + 1e-3).groupBy("id").agg(F.count("*").alias("met"))
    each = least.join(met, "id", "left")
    return each.agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.least("n", F.coalesce("met", F.lit(0)))), F.lit(0)).alias("found"))
