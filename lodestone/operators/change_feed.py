"""Current state of a table from a feed of inserts, updates and deletes.

Newest first: the version axis is cut into batches, and the batches are taken from the newest to the
oldest. A batch gives the images (or tombstones) of keys that no newer batch has resolved; the oldest
batch is the base, whose untouched rows are appended last. Late, repeated and out-of-order rows need
no care, since a row's batch depends on its version alone, never on its place in the feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import canonical_hash, canonical_path
from lodestone.session import cut_lineage

#: Batches the version axis is cut into. Each costs one anti-join of compacted rows.
BATCHES = 4


def version_bounds(feed: DataFrame, version: str, batches: int) -> list[int]:
    """Lowest version of every batch but the oldest, newest first; found by one pass over the version column."""
    cuts = [1 - (i + 1) / batches for i in range(batches - 1)]
    row = feed.agg(F.percentile_approx(version, F.array(*map(F.lit, cuts)), 10_000).alias("q")).first()
    return sorted({int(v) for v in (row.q or [])}, reverse=True)


def resolve_newest_first(
    feed: DataFrame,
    keys: list[str],
    version: str,
    tie_break: list[str],
    payload: list[str],
    deleted: str,
    batches: int = BATCHES,
) -> DataFrame:
    """Live rows of `feed`: columns keys, version and payload.

    Of a key's rows the highest version holds, within it the highest values of `tie_break` in order
    (null is lowest), then the row that is no delete, then the highest payload, so that equal rows and
    ties give one defined row. Rows with a null key or version don't count. A null `deleted` counts as
    false. An empty feed gives an empty table. Other columns of the feed are ignored.

    Each batch is first compacted to one row a key with a map-side combine, so a key holding a third of
    the feed sends one row from each map task; anti-joins then see at most one row a key and batch.
    """
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, version]])
    rows = feed.where(valid).select(
        *keys,
        F.struct(
            F.col(version).alias("version"),
            *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(tie_break)],
            (~F.coalesce(F.col(deleted), F.lit(False))).alias("live"),
            *[F.col(c).alias(f"value_{i}") for i, c in enumerate(payload)],
        ).alias("image"),
    )
    bounds = version_bounds(rows.select(F.col("image.version").alias("v")), "v", batches)
    batch = reduce(lambda c, i: c.when(F.col("image.version") >= bounds[i], F.lit(i)), range(len(bounds)), F).otherwise(F.lit(len(bounds))) if bounds else F.lit(0)
    images = cut_lineage(rows.groupBy(*keys, batch.alias("batch")).agg(F.max("image").alias("image")))
    resolved: list[DataFrame] = []
    for i in range(len(bounds) + 1):
        current = images.where(F.col("batch") == i)
        if i:
            known = images.where(F.col("batch") < i).select(*keys)
            current = current.join(known, keys, "left_anti")
        resolved.append(current)
    return (
        reduce(DataFrame.unionByName, resolved)
        .where("image.live")
        .select(*keys, F.col("image.version").alias(version), *[F.col(f"image.value_{i}").alias(c) for i, c in enumerate(payload)])
    )


def current_files(files: DataFrame, batches: int = BATCHES, path: Column | None = None) -> DataFrame:
    """Paths that exist now: project_id, path (canonical), generation, file_hash (canonical or null).

    Null or blank paths and null generations don't count; a null project is a project of its own.
    """
    canonical = F.nullif(canonical_path(F.col("path") if path is None else path), F.lit(""))
    feed = files.select(
        F.struct(F.col("project_id").alias("id")).alias("project"),
        canonical.alias("path"),
        "generation",
        "activated_at",
        canonical_hash(F.col("file_hash")).alias("file_hash"),
        "deleted",
    )
    live = resolve_newest_first(feed, ["project", "path"], "generation", ["activated_at"], ["file_hash"], "deleted", batches)
    return live.select(F.col("project.id").alias("project_id"), "path", "generation", "file_hash")
