"""The versioned manifest and what it makes visible.

Relations only grow: a row of code units, edges or chunks counts while its project, path, hash and
generation are those of the newest manifest row of the path and that row is no tombstone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import canonical_hash, canonical_path

VERSION = ["project_id", "path", "file_hash", "generation"]
FINISHED = ["ready", "degraded"]


def snapshot(files: DataFrame, *extra: str) -> DataFrame:
    """Newest row of each path: project_id, path, generation, file_hash, deleted and `extra` columns.

    One aggregate with a map-side combine; the tuple orders by generation, then activated_at, then a live row before a
    deleted one, then the hash, so that ties give one defined row. Rows without path or generation don't count.
    """
    image = F.struct(
        "generation",
        "activated_at",
        (~F.coalesce(F.col("deleted"), F.lit(False))).alias("live"),
        canonical_hash(F.col("file_hash")).alias("file_hash"),
        *extra,
    )
    keyed = files.where("path IS NOT NULL AND generation IS NOT NULL").select("project_id", canonical_path(F.col("path")).alias("path"), image.alias("image"))
    newest = keyed.where("path <> ''").groupBy("project_id", "path").agg(F.max("image").alias("image"))
    return newest.select("project_id", "path", "image.generation", "image.file_hash", (~F.col("image.live")).alias("deleted"), *[f"image.{c}" for c in extra])


def active(files: DataFrame, *extra: str) -> DataFrame:
    """Paths that exist: tombstones are dropped after the newest row is known, never before."""
    return snapshot(files, *extra).where(~F.col("deleted")).drop("deleted")


def visible(derived: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of `derived` whose version is the active one; all columns, repeated rows included."""
    return derived.join(manifest.select(*VERSION), VERSION, "left_semi")


def obsolete(derived: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of `derived` that no active version holds; they may be removed. Null keys match nothing, so such rows are obsolete."""
    return derived.join(manifest.select(*VERSION), VERSION, "left_anti")


def next_generation(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """project_id and 1 + the greatest generation in any of the tables (each with its generation column); none counts as 0."""
    highest = [t.groupBy("project_id").agg(F.coalesce(F.max(c), F.lit(0)).alias("g")) for t, c in tables]
    return reduce(DataFrame.unionByName, highest).groupBy("project_id").agg((F.max("g") + 1).alias("next_generation"))


def reusable_embeddings(chunks: DataFrame, dim: int) -> DataFrame:
    """chunk_hash, id, generation, embedding: the newest embedding of each content, from versions past and present."""
    held = chunks.where((F.size("embedding") == dim) & F.col("chunk_hash").isNotNull())
    return held.groupBy("chunk_hash").agg(F.max(F.struct("generation", "id", "embedding")).alias("s")).select("chunk_hash", "s.id", "s.generation", "s.embedding")


def pending_embeddings(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Distinct project_id and path of active chunks without an embedding."""
    lacking = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return visible(chunks.where(lacking), manifest).select("project_id", "path").distinct()


def run_snapshots(runs: DataFrame, *columns: str) -> DataFrame:
    """The newest progress row of every run. Columns: project_id, run_id, updated_at and `columns`; maps can't break ties and are left out."""
    return runs.groupBy("project_id", "run_id").agg(F.max(F.struct("updated_at", *columns)).alias("s")).select("project_id", "run_id", "s.*")


def run_history(runs: DataFrame, limit: int = 50, *columns: str) -> DataFrame:
    """Newest runs of every project first, `place` from 1, at most `limit` of each; equal times are ordered by run_id."""
    from pyspark.sql import Window

    newest_first = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), "run_id")
    return run_snapshots(runs, *columns).withColumn("place", F.row_number().over(newest_first)).where(F.col("place") <= limit)


def latest_finished_run(runs: DataFrame, *columns: str) -> DataFrame:
    """Of each project the newest row in a finished state, which is asked for before recency."""
    done = runs.where(F.col("state").isin(FINISHED))
    return done.groupBy("project_id").agg(F.max(F.struct("updated_at", "run_id", "state", "target_generation", *columns)).alias("s")).select("project_id", "s.*")


def under(path: Column, scope: Column) -> Column:
    """Whether the path is the scope or lies under it."""
    return (path == scope) | path.startswith(F.concat(F.rtrim(scope, F.lit("/")), F.lit("/")))


def expand_scopes(manifest: DataFrame, scopes: DataFrame) -> DataFrame:
    """project_id and path of what each (project_id, scope) covers; a scope that covers nothing is kept as it is.

    A path is met by its own prefixes, so the match is an equi-join and no comparison of all with all.
    """
    wanted = scopes.select("project_id", "scope", F.regexp_replace("scope", "/+$", "").alias("prefix")).distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    reach = manifest.select("project_id", "path", F.explode(prefixes).alias("prefix"))
    found = wanted.join(reach, ["project_id", "prefix"], "left")
    return found.select("project_id", F.coalesce("path", "scope").alias("path")).distinct()


def pending_in_scope(runs: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """project_id and path still pending after the newest run of each project, under the scopes if any are given."""
    newest = runs.groupBy("project_id").agg(F.max(F.struct("updated_at", "run_id", "pending")).alias("s"))
    pending = newest.select("project_id", F.explode("s.pending").alias("path")).distinct()
    if scopes is None:
        return pending
    reach = pending.select("project_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("prefix"))
    return reach.join(scopes.select("project_id", F.regexp_replace("scope", "/+$", "").alias("prefix")), ["project_id", "prefix"], "left_semi").select("project_id", "path").distinct()


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, path, status ("new", "changed", "same" or "deleted") of two manifests; only another hash is a change.

    A hash that is null on one side is a change, on both sides none.
    """
    a = old.select("project_id", "path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("in_old"))
    b = new.select("project_id", "path", F.col("file_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same")
        .otherwise("changed")
    )
    return a.join(b, ["project_id", "path"], "full_outer").select("project_id", "path", status.alias("status"))
