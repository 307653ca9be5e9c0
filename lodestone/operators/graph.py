"""Dependency graph of code units: neighbours, impact, closures and affected files, as joins of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

DIRECTIONS = {"downstream", "upstream", "both"}


def preferred_units(units: DataFrame) -> DataFrame:
    """One row an id of a project: the highest generation, then the smallest path, name, kind and lines."""
    order = Window.partitionBy("project_id", "id").orderBy(F.desc("generation"), "path", "name", "kind", "start_line", "end_line")
    return units.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row for (source, relation, target, path, first line), the first in order of the rest; edges with an empty end are dropped.

    Numbers order as decimal strings here.
    """
    key = ["project_id", "source_id", "relation", "target_id", "path", "start_line"]
    order = Window.partitionBy(*key).orderBy(F.col("end_line").cast("string"), "resolution", "file_hash", F.col("generation").cast("string"))
    whole = edges.where("coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''")
    return whole.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """project_id, node, next and the edge that leads there."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {sorted(DIRECTIONS)}")
    down = edges.select("project_id", F.col("source_id").alias("node"), F.col("target_id").alias("next"), "relation", "path", "start_line")
    up = edges.select("project_id", F.col("target_id").alias("node"), F.col("source_id").alias("next"), "relation", "path", "start_line")
    return {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]


def neighbours(edges: DataFrame, origins: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """project_id, origin, id, distance, relation, path: nodes within `depth` (1 or 2) of each (project_id, origin).

    The walk passes through nodes that no unit has; the origin itself is left out. The first reach gives relation and
    path: least distance, then the smallest node before, relation, path and line. Another depth gives nothing.
    """
    if depth not in (1, 2):
        return origins.select("project_id", "origin", F.lit("").alias("id"), F.lit(0).alias("distance"), F.lit("").alias("relation"), F.lit("").alias("path")).where("false")
    steps = _steps(edges, direction)
    start = origins.select("project_id", "origin").distinct().withColumn("node", F.col("origin"))

    def reach(front: DataFrame, distance: int) -> DataFrame:
        return (
            front.join(steps, ["project_id", "node"])
            .where("next <> origin")
            .groupBy("project_id", "origin", F.col("next").alias("id"))
            .agg(F.min(F.struct(F.lit(distance).alias("distance"), "node", "relation", "path", F.col("start_line").cast("string").alias("line"))).alias("s"))
        )

    first = reach(start, 1)
    found = first
    if depth == 2:
        second = reach(first.select("project_id", "origin", F.col("id").alias("node")), 2)
        found = first.unionByName(second).groupBy("project_id", "origin", "id").agg(F.min("s").alias("s"))
    return found.select("project_id", "origin", "id", "s.distance", "s.relation", "s.path")


def impact(units: DataFrame, edges: DataFrame, origins: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """Neighbours that are known units, as candidates; match is graph_distance_1 or _2."""
    near = neighbours(edges, origins, depth, direction).withColumnRenamed("path", "edge_path")
    known = preferred_units(units).select("project_id", "id", F.col("kind").alias("type"), F.coalesce(F.nullif("qualified_name", F.lit("")), "name").alias("symbol"), "path", "start_line", "end_line", "weight")
    return near.join(known, ["project_id", "id"]).select(
        "project_id", "origin", "id", "type", F.concat(F.lit("graph_distance_"), F.col("distance").cast("string")).alias("match"), "distance", "relation", "symbol", "path", "start_line", "end_line", "weight", "edge_path",
    )


def resolve_names(units: DataFrame, terms: DataFrame) -> DataFrame:
    """project_id, term, tier ("id", "path", "name", "ambiguous path", "ambiguous name" or "unknown"), id: what each (project_id, term) names.

    An id first, then a path that owns exactly one unit, then a short name that exactly one unit has.
    """
    known = preferred_units(units)

    def tier(column: str, label: str) -> DataFrame:
        held = known.where(f"coalesce({column}, '') <> ''").groupBy("project_id", F.col(column).alias("term"))
        return held.agg(F.count("*").alias(f"{label}_n"), F.min("id").alias(f"{label}_id"))

    asked = terms.select("project_id", "term").distinct()
    for column, label in (("id", "id"), ("path", "path"), ("name", "name")):
        asked = asked.join(tier(column, label), ["project_id", "term"], "left")
    name = (
        F.when(F.col("id_n") > 0, "id").when(F.col("path_n") == 1, "path").when(F.col("path_n") > 1, "ambiguous path")
        .when(F.col("name_n") == 1, "name").when(F.col("name_n") > 1, "ambiguous name").otherwise("unknown")
    )
    found = F.when(name == "id", F.col("id_id")).when(name == "path", F.col("path_id")).when(name == "name", F.col("name_id"))
    return asked.select("project_id", "term", name.alias("tier"), found.alias("id"))


#: Rounds of a closure after which what was found is put together.
TOGETHER = 8


def reverse_closure(links: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """group, node: the seeds and everything that depends on them, through (group, node, depends_on), cycles included.

    Each round joins and writes only the nodes that are new. Null ends are ignored. It ends when nothing is new; a chain of
    more than `rounds`, if given, is an error, never a part of the closure.
    """
    back = links.where("node IS NOT NULL AND depends_on IS NOT NULL").select("group", "node", "depends_on").distinct()
    known = cut_lineage(seeds.select("group", "node").where("node IS NOT NULL").distinct())
    back = cut_lineage(back)
    front, done = known, 0
    while True:
        reached = front.withColumnRenamed("node", "depends_on").join(back, ["group", "depends_on"]).select("group", "node").distinct()
        front = cut_lineage(reached.join(known, ["group", "node"], "left_anti"))
        if front.isEmpty():
            return known
        done += 1
        if rounds is not None and done > rounds:
            raise ValueError(f"the closure isn't complete after {rounds} rounds")
        known = known.unionByName(front)
        if done % TOGETHER == 0:
            known = cut_lineage(known)


def path_imports(edges: DataFrame, units: DataFrame) -> DataFrame:
    """group (project), node (importing path), depends_on (imported path) by edges between units of different files."""
    owner = preferred_units(units).select("project_id", F.col("id").alias("target_id"), F.col("path").alias("depends_on"))
    linked = unique_edges(edges).join(owner, ["project_id", "target_id"])
    return linked.where("path <> depends_on").select(F.col("project_id").alias("group"), F.col("path").alias("node"), "depends_on").distinct()


def affected_files(changes: DataFrame, links: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """group, node: files that must be parsed again for `changes` (group, node, body_only).

    A change of the body alone concerns its file only; any other, or an unknown one, also all files that depend on it.
    A scope (group, node, scope_node) of a resolution file replaces the file by the files it names.
    """
    flags = changes.groupBy("group", "node").agg(F.min(F.coalesce("body_only", F.lit(False))).alias("body_only"))
    named = None
    if scopes is not None:
        named = flags.join(scopes, ["group", "node"]).select("group", F.col("scope_node").alias("node")).distinct()
        flags = flags.join(scopes.select("group", "node").distinct(), ["group", "node"], "left_anti")
    parts = [flags.select("group", "node"), reverse_closure(links, flags.where("NOT body_only").select("group", "node"))]
    return reduce(DataFrame.unionByName, [*parts, *([named] if named is not None else [])]).distinct()
