"""Lexical and vector retrieval over units and chunks, as ranked lists of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import cosine_distance, normalized_text, query_tokens
from lodestone.operators.visibility import visible
from lodestone.session import cut_lineage

MOST = 50
CANDIDATE = ["id", "type", "match", "language", "extension", "path", "symbol", "relation", "heading", "file_hash", "start_line", "end_line", "score", "weight", "content"]


def clamp_limit(limit: int) -> int:
    return limit if 0 < limit <= MOST else MOST


def unit_candidates(units: DataFrame) -> DataFrame:
    """Code units as candidates with their search text."""
    return units.select(
        "project_id", "id", F.lit("code").alias("type"), F.lit("full_text").alias("match"), "language", "extension", "path",
        F.coalesce(F.nullif("qualified_name", F.lit("")), "name").alias("symbol"), F.lit("").alias("relation"), F.lit("").alias("heading"),
        "file_hash", "generation", "start_line", "end_line", "weight", F.coalesce("source", F.lit("")).alias("content"),
        F.concat_ws(" ", "search_text", "source").alias("text"),
    )


def chunk_candidates(chunks: DataFrame) -> DataFrame:
    """Document chunks as candidates; all weigh 1."""
    return chunks.select(
        "project_id", "id", F.lit("doc").alias("type"), F.lit("full_text").alias("match"), F.lit("markdown").alias("language"), "extension", "path",
        F.lit("").alias("symbol"), F.lit("").alias("relation"), F.coalesce("heading", F.lit("")).alias("heading"),
        "file_hash", "generation", "start_line", "end_line", F.lit(1.0).alias("weight"), F.coalesce("content", F.lit("")).alias("content"),
        F.concat_ws(" ", "path", "heading", "content").alias("text"), "embedding",
    )


def lexical_score(text: Column, question: str, weight: Column) -> Column:
    """(distinct words of the question that the text holds + 1 if it holds the whole) x weight; the text is normalised first."""
    whole = " ".join(question.lower().split())
    words = sorted(set(whole.split(" ")) - {""})
    held = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    return (held + text.contains(whole).cast("int")).cast("double") * weight if whole else F.lit(0.0) * weight


def matches_any(text: Column, question: str) -> Column:
    """Whether the text shares a token with the question: a whole run of ASCII letters and digits, or a CJK character."""
    tokens = query_tokens(question)
    runs = [t for t in tokens if t.isascii()]
    parts = [rf"(?<![a-z0-9])(?:{'|'.join(runs)})(?![a-z0-9])"] if runs else []
    return F.lower(text).rlike("|".join([*parts, *(t for t in tokens if not t.isascii())])) if tokens else F.lit(False)


#: Keys of best rows that may be sent to every task (about 200 bytes each).
SENT_KEYS = 100_000


def _version(manifest: DataFrame | None) -> list[str]:
    return [] if manifest is None else ["file_hash", "generation"]


def _active(rows: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Rows of active versions; only keys and scores meet the manifest."""
    return rows if manifest is None else visible(rows, manifest)


def _with_content(best: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """The candidates' other columns of the best rows (key, score and place), which are few a project: nothing else of them moves."""
    best = cut_lineage(best)
    wide = candidates.drop("text", "embedding", *[c for c in best.columns if c not in key])
    keys = best.select(*[F.col(c).alias(f"_{c}") for c in key], *[c for c in best.columns if c not in key])
    keys = F.broadcast(keys) if keys.count() <= SENT_KEYS else keys
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return wide.join(keys, same).drop(*[f"_{c}" for c in key]).dropDuplicates(key)


def lexical_search(candidates: DataFrame, question: str, limit: int = MOST, manifest: DataFrame | None = None) -> DataFrame:
    """The best matches of each project, `place` from 1: by score, weight, path, first line and id; with a manifest only those of active versions.

    All matches are ranked before the cut. Rows of null text match nothing; a question without tokens finds nothing;
    repeated rows are one candidate.
    """
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("weight"), "path", "start_line", "id")
    scored = (
        candidates.where(matches_any(F.col("text"), question))
        .withColumn("score", lexical_score(normalized_text(F.col("text")), question, F.coalesce("weight", F.lit(1.0))))
        .select("project_id", "id", "path", "start_line", *_version(manifest), "score", "weight")
    )
    scored = _active(scored, manifest).dropDuplicates(["project_id", "id", "path", "start_line"])
    best = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= clamp_limit(limit))
    return _with_content(best, candidates, ["project_id", "id", "path", "start_line", *_version(manifest)])


def vector_search(candidates: DataFrame, vector: list[float], limit: int = MOST, manifest: DataFrame | None = None) -> DataFrame:
    """The chunks of each project nearest to the vector by exact cosine; score = 1 - distance, ties by id.

    Null, empty and all-zero embeddings and those of another length aren't candidates.
    """
    asked = F.array(*[F.lit(float(x)) for x in vector])
    near = Window.partitionBy("project_id").orderBy("distance", "id")
    scored = candidates.withColumn("distance", cosine_distance(F.col("embedding"), asked)).where("distance IS NOT NULL")
    where = ["path", *_version(manifest)] if manifest is not None else []
    slim = _active(scored.select("project_id", "id", *where, "distance"), manifest).dropDuplicates(["project_id", "id"])
    ranked = _with_content(slim.withColumn("place", F.row_number().over(near)).where(F.col("place") <= clamp_limit(limit)), candidates, ["project_id", "id", *where])
    return ranked.withColumn("score", 1 - F.col("distance")).withColumn("match", F.lit("vector")).drop("distance")


def batch_nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block_rows: int = 20_000) -> DataFrame:
    """query, other, distance, place: the k rows nearest to each stated query by exact cosine, itself left out.

    The rows are spread over blocks of about `block_rows`; a block meets the queries in one matrix product and keeps k a
    query before anything is shuffled by query. Distances are rounded to 9 digits, ties ordered by key. Vectors that are
    null, empty, all zero or of another length than the commonest don't count.
    """
    import numpy as np
    import pandas as pd

    def usable(df: DataFrame) -> DataFrame:
        return df.where((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull()))

    size = usable(rows).groupBy(F.size(vector).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if size is None:
        return rows.sparkSession.createDataFrame([], "query bigint, other bigint, distance double, place int")
    blocks = max(1, -(-size["n"] // block_rows))
    base = usable(rows).where(F.size(vector) == size["w"]).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    asked = usable(queries).where(F.size(vector) == size["w"]).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "other": [], "distance": []}).astype({"query": "int64", "other": "int64"})
        a, b = (np.stack(x["v"]).astype(np.float64) for x in (left, right))
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        ids, parts = left["id"].to_numpy(), []
        for i in range(0, len(b), 256):
            far = np.round(1 - b[i : i + 256] @ a.T, 9) + 0.0
            asked_ids = right["id"].to_numpy()[i : i + 256]
            far[asked_ids[:, None] == ids[None, :]] = np.inf
            for q, row in zip(asked_ids, far):
                least = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                near = np.flatnonzero((row <= least) & np.isfinite(row))
                near = near[np.lexsort((ids[near], row[near]))][:k]
                parts.append(pd.DataFrame({"query": q, "other": ids[near], "distance": row[near]}))
        return pd.concat(parts)

    pairs = base.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(meet, "query bigint, other bigint, distance double")
    best = Window.partitionBy("query").orderBy("distance", "other")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
