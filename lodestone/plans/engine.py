"""The engine: a folder of append-only Parquet relations, kept fresh from a source tree and asked questions.

A refresh writes derived rows first and the manifest last, so that a version becomes visible only when
all of it is there; readers need no lock. Embedding and text generation are callables that the user
gives; without them there is no vector list and no summary.
"""

from __future__ import annotations

import math
import os
import subprocess
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import dir_name, token_estimate
from lodestone.operators import code, graph, markdown, ranking, search, visibility
from lodestone.operators.evidence import evidence
from lodestone.session import cut_lineage, side_by_side
from lodestone.sources import git, project
from lodestone.sources.suite import Question, Settings

PARSER_VERSION = "3"
EMBED_BATCH, EXPANSION = 16, 6
#: Languages that rows are derived from; files of others are listed and counted as skipped.
DERIVED = ["go", "typescript", "javascript", "markdown"]
Embedder = Callable[[list[str]], list[list[float]]]

#: Schemas of the stored relations.
SCHEMAS = {
    "files": "project_id STRING, path STRING, kind STRING, language STRING, extension STRING, size BIGINT, mtime_ns BIGINT, file_hash STRING, parser_version STRING, generation BIGINT, weight DOUBLE, deleted BOOLEAN, activated_at TIMESTAMP",
    "code_units": "project_id STRING, id STRING, name STRING, qualified_name STRING, kind STRING, language STRING, extension STRING, path STRING, start_line BIGINT, end_line BIGINT, source STRING, search_text STRING, file_hash STRING, generation BIGINT, weight DOUBLE",
    "code_edges": "project_id STRING, source_id STRING, target_id STRING, relation STRING, path STRING, start_line BIGINT, end_line BIGINT, resolution STRING, file_hash STRING, generation BIGINT",
    "code_facts": "project_id STRING, path STRING, fact STRING, kind STRING, owner STRING, name STRING, target STRING, exported BOOLEAN, start_line BIGINT, end_line BIGINT, file_hash STRING, generation BIGINT",
    "doc_chunks": "project_id STRING, id STRING, path STRING, extension STRING, heading STRING, start_line BIGINT, end_line BIGINT, content STRING, search_text STRING, tags ARRAY<STRING>, links ARRAY<STRING>, chunk_hash STRING, file_hash STRING, generation BIGINT, embedding ARRAY<FLOAT>",
    "index_runs": "project_id STRING, run_id STRING, mode STRING, state STRING, started_at TIMESTAMP, finished_at TIMESTAMP, changed BIGINT, deleted BIGINT, skipped BIGINT, failed BIGINT, warnings ARRAY<STRING>, error STRING, start_generation BIGINT, target_generation BIGINT, git_head STRING, pending ARRAY<STRING>, updated_at TIMESTAMP",
}


@dataclass(frozen=True)
class SyncResult:
    run_id: str
    mode: str
    state: str
    generation: int
    changed: int
    deleted: int
    skipped: int = 0
    failed: int = 0
    warnings: tuple[str, ...] = ()


class Engine:
    """`root` is the source tree, `store` the folder of the relations; both must be reachable from all executors."""

    def __init__(self, spark: SparkSession, root: str, store: str, settings: Settings | None = None, embedder: Embedder | None = None) -> None:
        self.spark, self.root, self.store = spark, os.path.realpath(root), store
        self.settings, self.embedder = settings or Settings(), embedder
        self.project_id = __import__("hashlib").sha256(self.root.encode()).hexdigest()
        self._one_run = threading.Lock()

    # storage
    def read(self, name: str) -> DataFrame:
        """A relation of this project; empty before its first write."""
        folder = f"{self.store}/{name}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(folder) if there else self.spark.createDataFrame([], SCHEMAS[name])
        return rows.where(F.col("project_id") == self.project_id)

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("append").partitionBy("project_id").parquet(f"{self.store}/{name}")

    def manifest(self) -> DataFrame:
        return visibility.active(self.read("files"), "parser_version", "language", "extension", "size", "mtime_ns")

    # refresh
    def sync(self, mode: str | None = None) -> SyncResult:
        """Bring the relations up to date with the tree. One run at a time; a second caller waits for it and then runs.

        Without a mode the first run, and one after a change of the parser, is full, every other a delta.
        """
        if mode is None:
            mode = "full" if self.manifest().agg(F.coalesce(F.max(F.col("parser_version") != PARSER_VERSION), F.lit(True)).alias("other")).first()["other"] else "delta"
        if mode not in ("delta", "full"):
            raise ValueError("mode must be delta or full")
        with self._one_run:
            return self._sync(mode)

    def _sync(self, mode: str) -> SyncResult:
        started, run_id = datetime.now(UTC), str(uuid.uuid4())
        current = visibility.next_generation([*((self.read(t), "generation") for t in ("files", "code_units", "code_edges", "code_facts", "doc_chunks")), (self.read("index_runs"), "target_generation")]).first()
        generation = current["next_generation"] if current else 1
        head, dirty, warnings = self._git()
        try:
            counts, pending = self._write(mode, generation, dirty)
        except Exception as e:
            self._record(run_id, mode, "failed", started, {}, generation, str(e)[:2000], head, warnings, None)
            raise
        if self.embedder is not None:
            lacking = visibility.pending_embeddings(self.read("doc_chunks"), self.manifest()).select("path")
            pending = lacking if pending is None else pending.unionByName(lacking)
        waiting = pending is not None and not pending.isEmpty()
        state = "degraded" if waiting or warnings or counts.get("failed") else "ready"
        self._record(run_id, mode, state, started, counts, generation, None, head, warnings, pending if waiting else None)
        return SyncResult(run_id, mode, state, generation, counts.get("changed", 0), counts.get("deleted", 0), counts.get("skipped", 0), counts.get("failed", 0), tuple(warnings))

    def _git(self) -> tuple[str | None, list[str] | None, list[str]]:
        """HEAD, the paths that git calls changed since the last run, and warnings; None where there is no git or it can't tell, so that all files are read."""
        if not os.path.exists(os.path.join(self.root, ".git")):
            return None, None, []
        last = visibility.latest_finished_run(self.read("index_runs"), "git_head").first()
        try:
            return *git.changed_since(self.root, last["git_head"] if last else None), []
        except (OSError, subprocess.SubprocessError, ValueError) as e:
            return None, None, [f"git: {e}"[:500]]

    def _found(self, mode: str, dirty: list[str] | None) -> DataFrame:
        """The files of the tree as the policy judges them. With git only those are read that are new, dirty, of another size or time, or lack embeddings."""
        s = self.settings
        policy = {"dirs": s.exclude_dirs, "names": s.exclude_names, "prefixes": s.exclude_paths, "include_tests": s.include_tests}
        listed = project.scan(self.spark, self.root).drop("content")
        read = cut_lineage(listed.where(project.refusal(F.col("path"), **policy).isNull()))
        held = self.manifest().where(F.col("parser_version") == PARSER_VERSION).select("path", "size", "mtime_ns", F.col("file_hash").alias("known"))
        if dirty is not None and mode == "delta":
            changed = self.spark.createDataFrame([(p,) for p in dirty], "path string").unionByName(self._waiting())
            same = cut_lineage(read.join(held, ["path", "size", "mtime_ns"]).join(changed, "path", "left_anti"))
            read = read.join(same, "path", "left_anti")
        else:
            same = read.limit(0).withColumn("known", F.lit(None).cast("string"))
        fresh = project.discover(project.read_files(self.spark, self.root, read), s.max_file_bytes, **policy)
        kind = project.file_kind(F.col("path"))
        as_known = same.select("path", "size", "mtime_ns", F.lit(None).cast("binary").alias("content"), kind["kind"].alias("kind"), kind["language"].alias("language"), kind["extension"].alias("extension"), F.col("known").alias("file_hash"), F.lit(None).cast("string").alias("reason"))
        return fresh.unionByName(as_known)

    def _waiting(self) -> DataFrame:
        """Paths that the last runs left without embeddings or changed under."""
        pending = visibility.pending_in_scope(self.read("index_runs")).select("path")
        return pending if self.embedder is None else pending.unionByName(visibility.pending_embeddings(self.read("doc_chunks"), self.manifest()).select("path"))

    def _write(self, mode: str, generation: int, dirty: list[str] | None) -> tuple[dict[str, int], DataFrame | None]:
        found = self._found(mode, dirty)
        plan = cut_lineage(project.plan_changes(found, self.manifest(), PARSER_VERSION, dirty=self._waiting(), full=mode == "full"))
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return {}, None
        stamp = [F.lit(self.project_id).alias("project_id"), F.lit(generation).cast("bigint").alias("generation")]
        inputs = cut_lineage(found.where("reason IS NULL").join(plan.where("action = 'changed'"), "path", "left_semi").select("*", *stamp, F.decode("content", "UTF-8").alias("source")))
        kept = cut_lineage(self.manifest().join(plan, "path", "left_anti"))
        facts = cut_lineage(self._facts(inputs, kept))
        edges = cut_lineage(self._edges(facts, kept.select("project_id", "path").unionByName(inputs.select("project_id", "path"))))
        affected = kept.join(self._affected(facts, edges, kept), "path", "left_semi").select("path", "file_hash")
        again = project.discover(project.read_files(self.spark, self.root, affected), self.settings.max_file_bytes, include_tests=True)
        again = again.where("reason IS NULL").join(affected, ["path", "file_hash"], "left_semi").select("*", *stamp, F.decode("content", "UTF-8").alias("source"))
        self._write_documents(inputs)
        inputs = cut_lineage(inputs.unionByName(again.select(*inputs.columns)))
        self._write_code(inputs, facts, edges)
        tombstones = plan.where("action = 'deleted'").select("path", F.lit(True).alias("deleted"))
        head = [F.lit(PARSER_VERSION).alias("parser_version"), F.lit(1.0).alias("weight"), F.current_timestamp().alias("activated_at")]
        live = inputs.select("project_id", "path", "kind", "language", "extension", "size", "mtime_ns", "file_hash", "generation", F.lit(False).alias("deleted"), *head)
        gone = tombstones.select(*stamp, "path", "deleted", *head)
        now = project.scan(self.spark, self.root).select("path", "size", "mtime_ns")  # a listing; no content is read
        stable = cut_lineage(live.join(now, ["path", "size", "mtime_ns"], "left_semi"))  # what was written to meanwhile isn't announced
        self.append("files", stable.unionByName(gone, allowMissingColumns=True))  # always the last write
        counts["skipped"] = inputs.where(~F.coalesce(F.col("language").isin(*DERIVED), F.lit(False))).count()
        counts["failed"] = facts.where("fact = 'warning'").count()
        return counts, live.join(stable, "path", "left_anti").select("path")

    def _facts(self, inputs: DataFrame, kept: DataFrame) -> DataFrame:
        """Source facts of the whole tree: changed files are parsed, those of the kept ones are stored."""
        columns = ["project_id", "path", *(c.split(" ")[0] for c in code.FACTS.split(", "))]
        fresh = code.source_facts(inputs.where("kind = 'code'"))
        return fresh.select(*columns).unionByName(visibility.visible(self.read("code_facts"), kept).select(*columns))

    def _edges(self, facts: DataFrame, paths: DataFrame) -> DataFrame:
        """All edges of the tree: calls, contains, imports, heritage and implemented interfaces, resolved over all of its facts."""
        file_id = lambda path: F.concat(F.lit("file:"), F.sha2(path, 256))
        columns = ["project_id", "source_id", "target_id", "relation", "path", "start_line", "end_line", "resolution"]
        declared = code.declared_units(facts)
        by_name = declared.select("project_id", "path", "caller", F.col("id").alias("source_id")).dropDuplicates(["project_id", "path", "caller"])
        found, go, known = facts.where("fact = 'import'"), F.col("path").endswith(".go"), paths.distinct()
        modules, packages = code.module_targets(found.where(~go), known, settings=self._settings(known)), code.package_targets(found.where(go), known)
        calls = code.call_edges(facts, modules).join(by_name, ["project_id", "path", "caller"]).select("project_id", "source_id", F.coalesce("target", F.concat(F.lit("name:"), "callee")).alias("target_id"), F.lit("calls").alias("relation"), "path", "start_line", F.col("start_line").alias("end_line"), "resolution")
        contains = declared.select("project_id", file_id(F.col("path")).alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("relation"), "path", "start_line", "end_line", F.lit("local").alias("resolution"))
        outside, first = F.concat(F.lit("external:"), "specifier"), F.lit(1).cast("bigint")
        imports = modules.withColumn("target_id", file_id(F.col("target"))).unionByName(packages.withColumn("target_id", code.package_id(F.col("target"))))
        imports = imports.select("project_id", file_id(F.col("path")).alias("source_id"), F.when(F.col("target").isNotNull(), F.col("target_id")).otherwise(outside).alias("target_id"), F.lit("imports").alias("relation"), "path", first.alias("start_line"), first.alias("end_line"), "resolution")
        heritage = code.heritage_edges(facts, modules.unionByName(packages)).withColumn("target_id", F.coalesce("target", F.concat(F.lit("name:"), "name"))).select(*columns)
        types = declared.where(go & F.col("kind").isin("type", "interface")).select("project_id", "id", "path", "start_line", "end_line", F.concat_ws("#", dir_name(F.col("path")), "name").alias("_name"))
        met = code.implements(facts).join(types.withColumnRenamed("_name", "type").withColumnRenamed("id", "source_id"), ["project_id", "type"])
        wanted = types.select("project_id", F.col("id").alias("target_id"), F.col("_name").alias("interface")).distinct()
        implemented = met.join(wanted, ["project_id", "interface"]).select("project_id", "source_id", "target_id", F.lit("implements").alias("relation"), "path", "start_line", "end_line", F.lit("local").alias("resolution"))
        return reduce(DataFrame.unionByName, [x.select(*columns) for x in (calls, contains, imports, heritage, implemented)])

    def _settings(self, paths: DataFrame) -> DataFrame:
        """project_id, path, source of the files that say what script imports mean."""
        named = paths.where(F.element_at(F.split("path", "/"), -1).isin(project.RESOLUTION["typescript"]))
        read = project.read_files(self.spark, self.root, named)
        return cut_lineage(read.where(F.col("size") <= code.SETTING_BYTES).select(F.lit(self.project_id).alias("project_id"), "path", F.decode("content", "UTF-8").alias("source")))

    def _affected(self, facts: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
        """path: kept files whose edges or package unit are others than the stored ones, because files they depend on have changed."""
        paths = kept.select("project_id", "path")
        packages = code.package_units(facts).select("project_id", "path", code.package_id(F.col("package")).alias("id"), "name")
        now = [edges.join(paths, ["project_id", "path"], "left_semi"), packages.join(paths, ["project_id", "path"], "left_semi")]
        held = [visibility.visible(self.read("code_edges"), kept), visibility.visible(self.read("code_units").where("kind = 'package'"), kept)]
        differ = []
        for new, old in zip(now, held):
            old = old.select(*new.columns)
            differ += [new.subtract(old).select("path"), old.subtract(new).select("path")]
        return cut_lineage(reduce(DataFrame.unionByName, differ).distinct())

    def _write_code(self, inputs: DataFrame, facts: DataFrame, edges: DataFrame) -> None:
        """Units, facts and edges of the input files, of the facts and edges of the whole tree."""
        files = inputs.where(F.col("language").isin("go", "typescript", "javascript") & (F.col("kind") == "code"))
        version = inputs.select("path", "file_hash", "generation", "language", "extension", F.col("source").alias("_text"))
        columns = ["project_id", "id", "name", "qualified_name", "kind", "path", "start_line", "end_line"]
        packages = code.package_units(facts).join(facts.where("fact = 'package'").select("project_id", "path", "start_line", "end_line"), ["project_id", "path"])
        packages = packages.select("project_id", code.package_id(F.col("package")).alias("id"), "name", F.col("package").alias("qualified_name"), F.lit("package").alias("kind"), "path", "start_line", "end_line")
        units = code.declared_units(facts).select(*columns).unionByName(packages).join(version, "path")
        lines = F.split("_text", "\n")
        part = F.array_join(F.slice(lines, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
        whole = inputs.join(files.select("path"), "path", "left_semi").select(
            "project_id", F.concat(F.lit("file:"), F.sha2("path", 256)).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("qualified_name"), F.lit("file").alias("kind"),
            "language", "extension", "path", F.lit(1).cast("bigint").alias("start_line"), F.size(F.split("source", "\n")).cast("bigint").alias("end_line"), "source", "file_hash", "generation",
        )
        parts = units.select("project_id", "id", "name", "qualified_name", "kind", "language", "extension", "path", "start_line", "end_line", part.alias("source"), "file_hash", "generation")
        rows = whole.unionByName(parts).withColumn("weight", ranking.source_weight(F.col("path"), F.lit(0.0)))
        self.append("code_units", rows.withColumn("search_text", F.concat_ws(" ", "path", "name", "qualified_name", "source")))
        stamps = version.select("path", "file_hash", "generation")
        self.append("code_facts", facts.join(stamps, "path"))
        self.append("code_edges", edges.join(stamps, "path"))

    def _write_documents(self, inputs: DataFrame) -> None:
        docs = inputs.where("language = 'markdown'")
        chunks = markdown.parse_markdown(docs.select("project_id", "path", "source"), "path", "source", ["project_id"]).where("error IS NULL")
        chunks = cut_lineage(chunks.join(docs.select("path", "file_hash", "generation", "extension"), "path"))
        held = visibility.reusable_embeddings(self.read("doc_chunks"), self.settings.dim).select("chunk_hash", "embedding")
        if self.embedder is not None:
            fresh = chunks.select("chunk_hash", "content").dropDuplicates(["chunk_hash"]).join(held, "chunk_hash", "left_anti")
            held = held.unionByName(embed(fresh, self.embedder, self.settings.dim, strict=False))
        self.append("doc_chunks", chunks.join(held, "chunk_hash", "left"))

    def _record(self, run_id: str, mode: str, state: str, started: datetime, counts: dict[str, int], generation: int, error: str | None, head: str | None, warnings: list[str], pending: DataFrame | None) -> None:
        now = datetime.now(UTC)
        row = (self.project_id, run_id, mode, state, started, now, *(counts.get(k, 0) for k in ("changed", "deleted", "skipped", "failed")), warnings, error, generation - 1, generation, head, [], now)
        record = self.spark.createDataFrame([row], SCHEMAS["index_runs"])
        if pending is not None:
            record = record.drop("pending").crossJoin(pending.agg(F.sort_array(F.collect_set("path")).alias("pending")))  # one row and one row
        self.append("index_runs", record)

    def cleanup(self) -> None:
        """Rewrite the derived relations of this project without obsolete rows, each into a new folder that then takes the place by renaming.

        A job that fails leaves the relation as it was. A folder that was put aside is removed once the new one is in its place.
        """
        manifest, files = cut_lineage(self.manifest()), self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in ("code_units", "code_edges", "code_facts", "doc_chunks"):
            columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
            mark = uuid.uuid4().hex
            new, old, live = f"{self.store}/_new_{mark}", path(f"{self.store}/_old_{mark}"), path(f"{self.store}/{name}/project_id={self.project_id}")
            if not files.exists(live):
                continue
            visibility.visible(self.read(name), manifest).select(*columns).drop("project_id").write.parquet(new)
            if not (files.rename(live, old) and files.rename(path(new), live)):
                raise OSError(f"{name} couldn't be put in place; its rows are in {old} and {new}")
            files.delete(old, True)

    def purge(self) -> None:
        """Remove all rows of this project, the manifest first, so that nothing is visible from then on."""
        with self._one_run:
            for name in ("files", "code_units", "code_edges", "code_facts", "doc_chunks", "index_runs"):
                self._files().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}/project_id={self.project_id}"), True)

    def _files(self):  # noqa: ANN202  the file system of the store
        context = self.spark.sparkContext
        return context._jvm.org.apache.hadoop.fs.Path(self.store).getFileSystem(context._jsc.hadoopConfiguration())

    # questions
    def candidates(self, question: str, paths: list[str] | None = None, terms: list[str] | None = None) -> DataFrame:
        """Ranked, diversified and budgeted candidates: code, documents, vectors and graph, fused."""
        self.warnings: list[str] = []
        manifest = cut_lineage(self.manifest())
        if paths:
            scopes = self.spark.createDataFrame([(self.project_id, p) for p in paths], "project_id string, scope string")
            manifest = manifest.join(visibility.expand_scopes(manifest, scopes), ["project_id", "path"], "left_semi")
        terms = [*ranking.question_terms(question), *(terms or [])]
        asked = " ".join([question, *terms])
        units, chunks = visibility.visible(self.read("code_units"), manifest), search.chunk_candidates(self.read("doc_chunks"))
        texts = [search.unit_candidates(self.read("code_units")), chunks]
        lists = side_by_side(self.spark, *[lambda t=t: search.lexical_search(t, asked, manifest=manifest) for t in texts])
        if self.embedder is not None:
            try:
                lists.append(search.vector_search(chunks, self.embedder([question])[0], manifest=manifest))
            except Exception as e:  # noqa: BLE001  the other lists still hold
                self.warnings.append(f"vector search: {e}"[:500])
        rows = [x.select("project_id", *search.CANDIDATE, "place", F.lit(n).alias("list")) for n, x in enumerate(lists, 1)]
        if terms:
            rows.append(self._graph_list(units, manifest, terms).withColumn("list", F.lit(4)))
        fused = ranking.fuse(reduce(DataFrame.unionByName, rows), ranking.IDENTITY)
        marked = fused.withColumn("match", ranking.exact_match(terms, F.col("match"))).withColumn("score", ranking.boosted(terms))
        order = ranking.diversify(ranking.ranked(marked, ["project_id"]), ["project_id"])
        kept = ranking.within_budget(order.withColumn("tokens", token_estimate(F.col("content"))), ["project_id"], "tokens")
        return ranking.label_citations(kept, ["project_id"])

    def _graph_list(self, units: DataFrame, manifest: DataFrame, terms: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(self.project_id, t) for t in terms], "project_id string, term string")
        origins = graph.resolve_names(units, asked).where("id IS NOT NULL").select("project_id", F.col("id").alias("origin"))
        edges = graph.unique_edges(visibility.visible(self.read("code_edges"), manifest))
        near = graph.impact(units, edges, origins, self.settings.graph_depth).groupBy("project_id", "id").agg(F.min(F.struct("distance", "match", "relation")).alias("g"))
        rows = near.join(search.unit_candidates(graph.preferred_units(units)).drop("match", "relation", "text"), ["project_id", "id"])
        listed = rows.select("project_id", "id", "type", F.col("g.match").alias("match"), "language", "extension", "path", "symbol", F.col("g.relation").alias("relation"), "heading", "file_hash", "start_line", "end_line", F.lit(0.0).alias("score"), "weight", "content")
        return ranking.ranked(listed, ["project_id"]).where(F.col("place") <= search.MOST)

    def search_context(
        self, question: str, paths: list[str] | None = None, max_tokens: int = 0, generate: Callable[[str], str] | None = None, expand: Callable[[str], list[str]] | None = None
    ) -> dict:
        """Evidence for a question within a budget of tokens, with a summary if `generate` is given. The tree is brought up to date first.

        If recall is weak and `expand` is given, its terms, at most six safe ones, are asked for in one further round. The
        summary keeps no marker of evidence that isn't given out.
        """
        if not question.strip():
            raise ValueError("a question is required")
        result = self.sync()
        budget = self.settings.max_tokens if not max_tokens else min(max(max_tokens, 256), 12_000)
        found = cut_lineage(self.candidates(question, paths))
        if expand is not None:
            weak = ranking.weak_recall(found, ["project_id"]).first()
            terms = list(dict.fromkeys(t.strip() for t in expand(question) if ranking.safe_term(t.strip())))[:EXPANSION] if weak is None or weak["weak"] else []
            if terms:
                found = cut_lineage(self.candidates(question, paths, terms))
        files = project.scan(self.spark, self.root).join(self.manifest().select("path", "file_hash"), "path")
        rows = evidence(found, files).orderBy("place").collect()  # at most the candidates' budget of 12,000 tokens
        summary, cited = ranking.keep_citations(generate(question), {r["label"] for r in rows}) if generate else ("", [])
        used, kept = math.ceil(len(summary) / 4), []
        if used > budget:
            summary, used = "", 0
        for r in rows:
            if cited and r["label"] not in cited:
                continue
            cost = (len(r["snippet"] or r["quote"] or "") + 3) // 4
            if used + cost <= budget:
                used += cost
                kept.append({k: r[k] for k in ("label", "type", "path", "symbol", "heading", "start_line", "end_line", "snippet", "quote", "match", "score")})
        summary, _ = ranking.keep_citations(summary, {k["label"] for k in kept})
        return {
            "question": question, "summary": summary, "evidence": kept, "used_tokens": used, "truncated": len(kept) < len(rows), "generation": result.generation,
            "state": result.state, "warnings": [*result.warnings, *self.warnings],
        }

    def impact(self, symbol: str | None = None, path: str | None = None, direction: str = "both", depth: int = 2) -> DataFrame:
        """Units near a symbol or path, exactly one of which must be given; an unknown or ambiguous one is an error."""
        if bool(symbol) == bool(path) or direction not in graph.DIRECTIONS or depth not in (1, 2):
            raise ValueError("give a symbol or a path, a direction and a depth of 1 or 2")
        self.sync()
        manifest = self.manifest()
        units = visibility.visible(self.read("code_units"), manifest)
        named = graph.resolve_names(units, self.spark.createDataFrame([(self.project_id, symbol or path)], "project_id string, term string")).first()
        if named["id"] is None:
            raise ValueError(f"{named['tier']}: {symbol or path}")
        origin = self.spark.createDataFrame([(self.project_id, named["id"])], "project_id string, origin string")
        return graph.impact(units, graph.unique_edges(visibility.visible(self.read("code_edges"), manifest)), origin, depth, direction)

    def status(self) -> dict:
        """The latest run and what is visible."""
        run = visibility.run_history(self.read("index_runs"), 1, "state", "mode", "changed", "deleted").first()
        return {"project_id": self.project_id, "files": self.manifest().count(), "last_run": run.asDict() if run else None}

    def benchmark(self, suite: list[Question], retrievals: int = 30) -> dict:
        """One full refresh, a delta without changes, warm retrievals that cycle through the suite, nearest-rank 95th percentile, stale evidence and budget violations."""
        began = time.perf_counter()
        self.sync("full")
        full, took = time.perf_counter() - began, []
        began = time.perf_counter()
        self.sync("delta")
        delta = time.perf_counter() - began
        for i in range(retrievals):
            began = time.perf_counter()
            self.candidates(suite[i % len(suite)].question).collect()
            took.append(time.perf_counter() - began)
        answers = [(q, self.search_context(q.question, max_tokens=q.max_tokens)) for q in suite]
        over = sum(a["used_tokens"] > (q.max_tokens or self.settings.max_tokens) for q, a in answers)
        stale = sum(not self._fresh(e) for _, a in answers for e in a["evidence"])
        return {"full_index_s": full, "delta_s": delta, "warm_p95_s": sorted(took)[math.ceil(0.95 * len(took)) - 1], "stale_evidence": stale, "budget_violations": over}

    def _fresh(self, item: dict) -> bool:
        """Whether an item of evidence is what the file holds now."""
        try:
            with open(os.path.join(self.root, item["path"]), encoding="utf-8", errors="replace", newline="") as file:
                lines = file.read().replace("\r\n", "\n").split("\n")
        except OSError:
            return False
        return "\n".join(lines[item["start_line"] - 1 : item["end_line"]]) == (item["snippet"] or item["quote"] or "")


def embed(chunks: DataFrame, embedder: Embedder, dim: int, strict: bool = True) -> DataFrame:
    """chunk_hash, embedding of distinct contents, in batches of EMBED_BATCH; a wrong count or length is an error. If not `strict`, a batch that fails has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), EMBED_BATCH):
                part = batch.iloc[i : i + EMBED_BATCH]
                try:
                    vectors = embedder(list(part["content"]))
                    if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                        raise ValueError("the embedder gave a wrong number of vectors or dimensions")
                except Exception:
                    if strict:
                        raise
                    continue
                yield pd.DataFrame({"chunk_hash": part["chunk_hash"], "embedding": vectors})

    return chunks.select("chunk_hash", "content").mapInPandas(run, "chunk_hash string, embedding array<float>")
