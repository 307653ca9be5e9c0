"""Queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import code, graph, markdown, ranking, search, visibility
from lodestone.operators.change_feed import current_files
from lodestone.session import cut_lineage, side_by_side
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


#: The manifest in SQL, put before the statements that need it.
_MANIFEST = r"""
    WITH canonical AS (
        SELECT project_id, array_to_string(list_filter(string_split(replace(path, '\', '/'), '/'), lambda p: p <> '' AND p <> '.'), '/') AS path,
               generation, activated_at, coalesce(deleted, false) AS deleted, nullif(regexp_extract(lower(trim(file_hash)), '([0-9a-f]{64})$', 1), '') AS file_hash, size
        FROM files WHERE path IS NOT NULL AND generation IS NOT NULL
    ), newest AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY generation DESC, activated_at DESC NULLS LAST, deleted, file_hash DESC NULLS LAST, size DESC NULLS LAST) AS r
            FROM canonical WHERE path <> ''
        ) WHERE r = 1
    ), active AS (
        SELECT project_id, path, generation, file_hash FROM newest WHERE NOT deleted
    )
"""
_JOINED = "JOIN active a ON a.project_id = d.project_id AND a.path = d.path AND a.file_hash = d.file_hash AND a.generation = d.generation"
_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = r"[a-z0-9]+|[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
#: The question of the search queries.
QUESTION = "open session snapshot"


def _norm(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '{_SPACE}', ' ', 'g')))"


@query(_MANIFEST + "SELECT project_id, path, generation, file_hash FROM active")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of each project that exist now, by newest-first resolution of the change feed."""
    return current_files(table(spark, folder, "files"))


@query(_MANIFEST + "SELECT project_id, path, generation, file_hash, size FROM newest WHERE NOT deleted")
def active_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The same by one aggregate, with the size of the file."""
    return visibility.active(table(spark, folder, "files"), "size")


@query(
    _MANIFEST
    + """, early AS (SELECT project_id, path FROM canonical WHERE path <> '' AND NOT deleted GROUP BY ALL)
    SELECT project_id, count(*) AS without_tombstones, count(a.path) AS active FROM early e LEFT JOIN active a USING (project_id, path) GROUP BY project_id"""
)
def tombstone_order(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that a filter before the newest row is known would leave, against those that exist."""
    files = table(spark, folder, "files")
    early = visibility.snapshot(files.where(~F.coalesce("deleted", F.lit(False)))).select("project_id", "path")
    there = visibility.active(files).select("project_id", "path", F.lit(1).alias("there"))
    return early.join(there, ["project_id", "path"], "left").groupBy("project_id").agg(F.count("*").alias("without_tombstones"), F.count("there").alias("active"))


def _visible_sql(name: str, columns: str) -> str:
    return f"{_MANIFEST} SELECT {columns} FROM {name} d {_JOINED}"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return visibility.active(table(spark, folder, "files"))


@query(_visible_sql("code_units", "d.project_id, d.id, d.path, d.kind, d.generation, d.start_line"))
def visible_units(spark: SparkSession, folder: str) -> DataFrame:
    """Code units of active file versions."""
    return visibility.visible(table(spark, folder, "code_units"), _manifest(spark, folder)).select("project_id", "id", "path", "kind", "generation", "start_line")


@query(_visible_sql("code_edges", "d.project_id, d.source_id, d.target_id, d.relation, d.path"))
def visible_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of active file versions."""
    return visibility.visible(table(spark, folder, "code_edges"), _manifest(spark, folder)).select("project_id", "source_id", "target_id", "relation", "path")


@query(_visible_sql("doc_chunks", "d.project_id, d.id, d.path, d.chunk_hash, d.start_line, d.end_line"))
def visible_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Document chunks of active file versions."""
    return visibility.visible(table(spark, folder, "doc_chunks"), _manifest(spark, folder)).select("project_id", "id", "path", "chunk_hash", "start_line", "end_line")


@query(_MANIFEST + "SELECT d.project_id, d.id, d.path, d.generation FROM code_units d WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.project_id = d.project_id AND a.path = d.path AND a.file_hash = d.file_hash AND a.generation = d.generation)")
def obsolete_units(spark: SparkSession, folder: str) -> DataFrame:
    """Code units of file versions that are no longer active."""
    return visibility.obsolete(table(spark, folder, "code_units"), _manifest(spark, folder)).select("project_id", "id", "path", "generation")


@query(
    """SELECT project_id, 1 + max(g) AS next_generation FROM (
        SELECT project_id, coalesce(generation, 0) AS g FROM files UNION ALL SELECT project_id, coalesce(generation, 0) FROM code_units UNION ALL
        SELECT project_id, coalesce(generation, 0) FROM code_edges UNION ALL SELECT project_id, coalesce(generation, 0) FROM doc_chunks UNION ALL
        SELECT project_id, coalesce(target_generation, 0) FROM index_runs) GROUP BY project_id"""
)
def next_generation(spark: SparkSession, folder: str) -> DataFrame:
    """The generation that the next run of each project writes."""
    tables = [(table(spark, folder, t), "generation") for t in ("files", "code_units", "code_edges", "doc_chunks")]
    return visibility.next_generation([*tables, (table(spark, folder, "index_runs"), "target_generation")])


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY project_id, run_id ORDER BY updated_at DESC, state DESC, mode DESC, changed DESC NULLS LAST) AS r FROM index_runs)
    SELECT project_id, run_id, updated_at, state, mode, changed, place FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, run_id) AS place FROM s WHERE r = 1) WHERE place <= 50"""
)
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 50 runs of each project, each by its newest progress row."""
    return visibility.run_history(table(spark, folder, "index_runs"), 50, "state", "mode", "changed")


@query(
    """SELECT project_id, updated_at, run_id, state, target_generation FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, run_id DESC, state DESC, target_generation DESC NULLS LAST) AS r
        FROM index_runs WHERE state IN ('ready', 'degraded')) WHERE r = 1"""
)
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The latest finished run of each project."""
    return visibility.latest_finished_run(table(spark, folder, "index_runs"))


@query(
    """SELECT project_id, mode, count(*) AS runs, quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms FROM (
        SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) // 1000 AS ms, row_number() OVER (PARTITION BY project_id, run_id ORDER BY updated_at DESC, finished_at DESC NULLS LAST, started_at DESC NULLS LAST, mode DESC) AS r FROM index_runs
    ) WHERE r = 1 AND ms IS NOT NULL GROUP BY project_id, mode"""
)
def run_duration_p95(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank 95th percentile of run durations."""
    runs = visibility.run_snapshots(table(spark, folder, "index_runs"), "finished_at", "started_at", "mode")
    ms = F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)
    timed = runs.withColumn("ms", ms).where("ms IS NOT NULL")
    return timed.groupBy("project_id", "mode").agg(F.count("*").alias("runs"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").cast("bigint").alias("p95_ms"), F.max("ms").alias("max_ms"))


@query(
    """SELECT project_id, phase_name, count(*) AS rows_with, sum(ms)::BIGINT AS total_ms FROM (
        SELECT project_id, unnest(map_keys(phase_timings)) AS phase_name, unnest(map_values(phase_timings)) AS ms FROM index_runs) GROUP BY ALL"""
)
def phase_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds by phase, from the map of every progress row."""
    rows = table(spark, folder, "index_runs").select("project_id", F.explode("phase_timings").alias("phase_name", "ms"))
    return rows.groupBy("project_id", "phase_name").agg(F.count("*").alias("rows_with"), F.sum("ms").alias("total_ms"))


@query(
    """SELECT chunk_hash, generation, id, dims FROM (
        SELECT chunk_hash, generation, id, len(embedding) AS dims, row_number() OVER (PARTITION BY chunk_hash ORDER BY generation DESC NULLS LAST, id DESC NULLS LAST) AS r
        FROM doc_chunks WHERE len(embedding) = 64 AND chunk_hash IS NOT NULL) WHERE r = 1"""
)
def embedding_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding that a refresh would take over for each content."""
    found = visibility.reusable_embeddings(table(spark, folder, "doc_chunks"), 64)
    return found.select("chunk_hash", "generation", "id", F.size("embedding").cast("bigint").alias("dims"))


@query(f"{_MANIFEST} SELECT DISTINCT d.project_id, d.path FROM doc_chunks d {_JOINED} WHERE d.embedding IS NULL OR len(d.embedding) = 0")
def embedding_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Active paths with chunks that still need an embedding."""
    return visibility.pending_embeddings(table(spark, folder, "doc_chunks"), _manifest(spark, folder))


@query(
    _MANIFEST
    + """, top AS (SELECT project_id, max(generation) AS g FROM canonical GROUP BY 1), old AS (
        SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.project_id, path ORDER BY generation DESC, activated_at DESC NULLS LAST, deleted, file_hash DESC NULLS LAST) AS r
        FROM canonical c JOIN top t ON t.project_id = c.project_id WHERE path <> '' AND generation * 2 <= g) WHERE r = 1 AND NOT deleted)
    SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.path, n.path) AS path,
        CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.file_hash IS NOT DISTINCT FROM n.file_hash THEN 'same' ELSE 'changed' END AS status
    FROM old o FULL JOIN active n ON o.project_id = n.project_id AND o.path = n.path"""
)
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between the first half of each project's generations and now."""
    files = table(spark, folder, "files")
    top = files.where("path IS NOT NULL AND generation IS NOT NULL").groupBy("project_id").agg(F.max("generation").alias("_g"))
    early = files.join(top, "project_id").where("generation * 2 <= _g")
    return visibility.manifest_diff(visibility.active(early), visibility.active(files))


_SCOPES = "SELECT DISTINCT project_id, string_split(path, '/')[1] AS scope FROM code_units WHERE path IS NOT NULL"


@query(
    f"""{_MANIFEST}, scopes AS ({_SCOPES})
    SELECT DISTINCT s.project_id, coalesce(a.path, s.scope) AS path FROM scopes s
    LEFT JOIN active a ON a.project_id = s.project_id AND (a.path = s.scope OR starts_with(a.path, s.scope || '/'))"""
)
def path_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Active paths under the top directories that hold code; a scope without any stays itself."""
    scopes = table(spark, folder, "code_units").where("path IS NOT NULL").select("project_id", F.split("path", "/")[0].alias("scope"))
    return visibility.expand_scopes(_manifest(spark, folder), scopes)


@query(
    """SELECT DISTINCT project_id, path FROM (SELECT project_id, unnest(pending) AS path FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, run_id DESC, pending DESC NULLS LAST) AS r FROM index_runs) WHERE r = 1)"""
)
def pending_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that the newest run of each project left pending."""
    return visibility.pending_in_scope(table(spark, folder, "index_runs"))


def _lexical_ctes(name: str, source: str, text: str, weight: str, symbol: str, heading: str, content: str) -> str:
    """Statements that end in the ranked list `name`."""
    words = sorted(set(QUESTION.split()))
    held = " + ".join(f"contains(n, '{w}')::INT" for w in words)
    tokens = ", ".join(f"'{t}'" for t in scalars.query_tokens(QUESTION))
    return f"""{name}_texts AS (
        SELECT DISTINCT ON (d.project_id, d.id, d.path, d.start_line) d.project_id, d.id, d.path, d.start_line, {weight} AS weight, {symbol} AS symbol, {heading} AS heading, {content} AS content, {text} AS t FROM {source} d {_JOINED}
    ), {name}_matched AS (
        SELECT *, {_norm('t')} AS n FROM {name}_texts WHERE list_has_any(regexp_extract_all(lower(t), '{_TOKENS}'), [{tokens}])
    ), {name}_scored AS (
        SELECT *, ({held} + contains(n, '{QUESTION}')::INT)::DOUBLE * weight AS score FROM {name}_matched
    ), {name} AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, weight DESC, path, start_line, id) AS place FROM {name}_scored) WHERE place <= 50)"""


_CODE_CTES = _lexical_ctes("code", "code_units", "concat_ws(' ', d.search_text, d.source)", "coalesce(d.weight, 1.0)", "coalesce(nullif(d.qualified_name, ''), d.name)", "''", "coalesce(d.source, '')")
_DOCS_CTES = _lexical_ctes("docs", "doc_chunks", "concat_ws(' ', d.path, d.heading, d.content)", "1.0::DOUBLE", "''", "coalesce(d.heading, '')", "coalesce(d.content, '')")


_RANKED = ["project_id", "id", "path", "start_line", "score", "weight", "place"]


def _code_list(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    return search.lexical_search(search.unit_candidates(table(spark, folder, "code_units")), QUESTION, manifest=manifest or _manifest(spark, folder))


def _docs_list(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    return search.lexical_search(search.chunk_candidates(table(spark, folder, "doc_chunks")), QUESTION, manifest=manifest or _manifest(spark, folder))


@query(f"{_MANIFEST}, {_CODE_CTES} SELECT project_id, id, path, start_line, score, weight, place FROM code")
def lexical_code_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 units of each project that match the question best."""
    return _code_list(spark, folder).select(*_RANKED)


@query(f"{_MANIFEST}, {_DOCS_CTES} SELECT project_id, id, path, start_line, score, weight, place FROM docs")
def lexical_docs_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 chunks of each project that match the question best."""
    return _docs_list(spark, folder).select(*_RANKED)


#: A fixed direction that the vector queries ask for: +1 and -1 in turn.
VECTOR = [1.0 if i % 2 == 0 else -1.0 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"


def _vector_list(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    return search.vector_search(search.chunk_candidates(table(spark, folder, "doc_chunks")), VECTOR, manifest=manifest or _manifest(spark, folder))


_VECTOR_CTES = f"""vectors AS (
        SELECT DISTINCT ON (d.project_id, d.id) d.project_id, d.id, d.path, d.start_line, coalesce(d.heading, '') AS heading, coalesce(d.content, '') AS content, d.embedding::DOUBLE[] AS v FROM doc_chunks d {_JOINED}
        WHERE len(d.embedding) = 64 AND list_aggregate(list_transform(d.embedding, lambda x: abs(x)), 'sum') > 0
    ), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY distance, id) AS place FROM (
        SELECT *, list_cosine_distance(v, {_VECTOR_SQL}) AS distance FROM vectors)) WHERE place <= 50)"""


@query(f"{_MANIFEST}, {_VECTOR_CTES} SELECT project_id, id, path, round(1 - distance, 6) + 0 AS score FROM near")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 chunks of each project nearest to a direction."""
    return _vector_list(spark, folder).select("project_id", "id", "path", (F.round("score", 6) + 0).alias("score"))


@query(
    """SELECT query, other, distance, place FROM (
        SELECT q.vec_id AS query, r.vec_id AS other, round(list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) + 0 AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9), r.vec_id) AS place
        FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 10"""
)
def vector_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings")
    return search.batch_nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """Code, documents and vectors, as lists 1, 2 and 3. The manifest is made once."""
    manifest = cut_lineage(_manifest(spark, folder))
    lists = side_by_side(spark, *[lambda make=make: make(spark, folder, manifest) for make in (_code_list, _docs_list, _vector_list)])
    rows = [x.select("project_id", *search.CANDIDATE, "place", F.lit(n).alias("list")) for n, x in enumerate(lists, 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_KEY = ranking.IDENTITY
_TERMS = ranking.question_terms("Where does open_session use SnapshotService and 'session'?")


_TERMS_SQL = "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in _TERMS) + ")"
_RRF = f"""{_MANIFEST}, {_CODE_CTES}, {_DOCS_CTES}, {_VECTOR_CTES}, lists AS (
        SELECT project_id, 'code' AS type, id, path, start_line, 'full_text' AS match, symbol, heading, weight, content, place, 1 AS list FROM code UNION ALL
        SELECT project_id, 'doc', id, path, start_line, 'full_text', symbol, heading, weight, content, place, 2 FROM docs UNION ALL
        SELECT project_id, 'doc', id, path, start_line, 'vector', '', heading, 1.0, content, place, 3 FROM near
    ), rrf AS (
        SELECT project_id, type, id, path, start_line, arg_min(match, list) AS match, arg_min(symbol, list) AS symbol, arg_min(heading, list) AS heading, arg_min(weight, list) AS weight,
            arg_min(content, list) AS content, sum(1.0::DOUBLE / (60 + place) ORDER BY list) AS score FROM lists GROUP BY ALL
    )"""
_BOOSTED = f"""{_RRF}, marked AS (
        SELECT * REPLACE (CASE WHEN path IN {_TERMS_SQL} OR string_split(path, '/')[-1] IN {_TERMS_SQL} THEN 'exact_path'
            WHEN symbol IN {_TERMS_SQL} OR {" OR ".join(f"ends_with(symbol, '.{t}')" for t in _TERMS)} THEN 'exact_symbol' ELSE match END AS match) FROM rrf
    ), boosted AS (
        SELECT * REPLACE (round((score + greatest(CASE match WHEN 'exact_path' THEN 2.0 WHEN 'exact_symbol' THEN 1.5 ELSE 0.0 END, CASE WHEN {" OR ".join(f"contains(lower(heading), '{t.lower()}')" for t in _TERMS)} THEN 0.5 ELSE 0.0 END)::DOUBLE)
            * (CASE WHEN weight > 0 THEN weight WHEN ends_with(lower(path), '.d.ts') THEN 0.5 WHEN regexp_matches(lower(string_split(path, '/')[-1]), '_test\\.|\\.test\\.|\\.spec\\.') THEN 0.6 ELSE 1.0 END)::DOUBLE, 12) AS score) FROM marked
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, path, start_line, id) AS place FROM boosted)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    fused = ranking.fuse(_lists(spark, folder), _KEY)
    marked = fused.withColumn("match", ranking.exact_match(_TERMS, F.col("match")))
    return marked.withColumn("score", F.round(ranking.boosted(_TERMS), 12))


@query(f"{_RRF} SELECT project_id, type, id, path, start_line, match, round(score, 12) AS score FROM rrf")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal rank fusion of the three lists."""
    return ranking.fuse(_lists(spark, folder), _KEY).select(*_KEY, "match", F.round("score", 12).alias("score"))


@query(f"{_BOOSTED} SELECT project_id, type, id, path, start_line, match, score, place FROM ranked")
def boosted_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Fused candidates with exact matches marked and boosted, in order."""
    return ranking.ranked(_fused(spark, folder), ["project_id"]).select(*_KEY, "match", "score", "place")


@query(
    _BOOSTED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, late AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY place) > 3 AND coalesce(path, '') <> '' AS held FROM ranked),
    ordered AS (SELECT * EXCLUDE (place, held), (length(content) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY project_id ORDER BY held, place) AS place FROM late),
    fold AS (SELECT project_id, 0::BIGINT AS place, 0::BIGINT AS used, false AS kept FROM (SELECT DISTINCT project_id FROM ordered)
        UNION ALL SELECT f.project_id, o.place, CASE WHEN f.used + o.tokens <= 12000 THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens <= 12000
        FROM fold f JOIN ordered o ON o.project_id = f.project_id AND o.place = f.place + 1)
    SELECT o.project_id, type, id, path, start_line, symbol, heading, match, score, o.place, tokens,
        CASE WHEN type = 'doc' THEN 'D' ELSE 'C' END || row_number() OVER (PARTITION BY o.project_id, type ORDER BY o.place) AS label
    FROM ordered o JOIN fold f ON f.project_id = o.project_id AND f.place = o.place WHERE f.kept"""
)
def retrieved(spark: SparkSession, folder: str) -> DataFrame:
    """The whole retrieval: fused, boosted, diversified, cut to the token budget and labelled for citation."""
    order = ranking.diversify(ranking.ranked(_fused(spark, folder), ["project_id"]), ["project_id"])
    order = order.withColumn("tokens", scalars.token_estimate(F.col("content")))
    kept = ranking.within_budget(order, ["project_id"], "tokens")
    return ranking.label_citations(kept, ["project_id"]).select(*_KEY, "symbol", "heading", "match", "score", "place", "tokens", "label")


@query(
    f"""{_BOOSTED} SELECT project_id, NOT bool_or(match IN ('exact_path', 'exact_symbol')) AND count(*) FILTER (score > 0.02) < 5 AS weak FROM boosted GROUP BY project_id"""
)
def weak_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Projects in which the question should be expanded once."""
    return ranking.weak_recall(_fused(spark, folder), ["project_id"])


@query(
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY late, doc_id) AS place FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source, repo_path ORDER BY doc_id) > 3 AND coalesce(repo_path, '') <> '' AS late FROM documents)"""
)
def diversify(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source in order, those beyond three of a path behind all others."""
    docs = table(spark, folder, "documents").select("source", "doc_id", F.col("repo_path").alias("path"), F.col("doc_id").alias("place"))
    return ranking.diversify_table(docs, ["source"]).select("source", "doc_id", "place")


@query(
    """WITH RECURSIVE items AS (SELECT suite, item_id, max_tokens, row_number() OVER (PARTITION BY suite ORDER BY item_id) AS place,
            (length(passage) + 3) // 4 AS tokens FROM eval_items),
        fold AS (SELECT suite, 0::BIGINT AS place, 0::BIGINT AS used, false AS kept, NULL::BIGINT AS item_id FROM (SELECT DISTINCT suite FROM items)
            UNION ALL SELECT f.suite, i.place, CASE WHEN f.used + i.tokens <= 1000 THEN f.used + i.tokens ELSE f.used END, f.used + i.tokens <= 1000, i.item_id
            FROM fold f JOIN items i ON i.suite = f.suite AND i.place = f.place + 1)
    SELECT suite, item_id FROM fold WHERE kept"""
)
def greedy_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Test items of each suite that fit into 1000 tokens when taken in order; one too large is skipped."""
    items = table(spark, folder, "eval_items").withColumn("tokens", scalars.token_estimate(F.col("passage")))
    ordered = items.withColumn("place", F.row_number().over(Window.partitionBy("suite").orderBy("item_id")))
    return ranking.within_budget(ordered, ["suite"], "tokens", 1000).select("suite", "item_id")


_EDGES = """edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_id, relation, target_id, path, start_line
        ORDER BY end_line::VARCHAR NULLS FIRST, resolution NULLS FIRST, file_hash NULLS FIRST, generation::VARCHAR NULLS FIRST) AS r FROM code_edges
        WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> '') WHERE r = 1)"""
_UNITS = """units AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY generation DESC, path NULLS FIRST, name NULLS FIRST, kind NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST) AS r
        FROM code_units) WHERE r = 1)"""


@query(f"WITH {_EDGES} SELECT project_id, source_id, relation, target_id, path, start_line, end_line, resolution FROM edges")
def edge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Edges once for each key."""
    return graph.unique_edges(table(spark, folder, "code_edges")).select("project_id", "source_id", "relation", "target_id", "path", "start_line", "end_line", "resolution")


@query(f"WITH {_UNITS} SELECT project_id, id, path, name, generation FROM units")
def unit_preferred(spark: SparkSession, folder: str) -> DataFrame:
    """One row for every unit id."""
    return graph.preferred_units(table(spark, folder, "code_units")).select("project_id", "id", "path", "name", "generation")


def _origins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "code_units").where("start_line % 50 = 0").select("project_id", F.col("id").alias("origin")).distinct()


_STEPS = f"""{_EDGES}, steps AS (SELECT project_id, source_id AS node, target_id AS next FROM edges UNION SELECT project_id, target_id, source_id FROM edges),
    origins AS (SELECT DISTINCT project_id, id AS origin FROM code_units WHERE start_line % 50 = 0),
    one AS (SELECT DISTINCT o.project_id, origin, next AS id FROM origins o JOIN steps s ON s.project_id = o.project_id AND s.node = origin WHERE next <> origin)"""


@query(f"WITH {_STEPS} SELECT project_id, origin, id, 1 AS distance FROM one")
def graph_neighbors_d1(spark: SparkSession, folder: str) -> DataFrame:
    """Direct neighbours of every unit whose first line is divisible by 50."""
    return graph.neighbours(graph.unique_edges(table(spark, folder, "code_edges")), _origins(spark, folder), 1).select("project_id", "origin", "id", "distance")


@query(
    f"""WITH {_STEPS}, two AS (SELECT DISTINCT o.project_id, origin, next AS id FROM one o JOIN steps s ON s.project_id = o.project_id AND s.node = o.id WHERE next <> origin)
    SELECT project_id, origin, id, min(distance) AS distance FROM (SELECT *, 1 AS distance FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL"""
)
def graph_neighbors_d2(spark: SparkSession, folder: str) -> DataFrame:
    """The same within two steps."""
    return graph.neighbours(graph.unique_edges(table(spark, folder, "code_edges")), _origins(spark, folder), 2).select("project_id", "origin", "id", "distance")


@query(
    f"""WITH {_EDGES}, steps AS (SELECT project_id, source_id AS node, target_id AS next, relation, path, start_line::VARCHAR AS line FROM edges UNION ALL SELECT project_id, target_id, source_id, relation, path, start_line::VARCHAR FROM edges),
    origins AS (SELECT DISTINCT project_id, id AS origin FROM code_units WHERE start_line % 50 = 0),
    one AS (SELECT o.project_id, origin, 1 AS distance, s.* EXCLUDE (project_id) FROM origins o JOIN steps s ON s.project_id = o.project_id AND s.node = origin WHERE next <> origin),
    two AS (SELECT o.project_id, origin, 2 AS distance, s.* EXCLUDE (project_id) FROM (SELECT DISTINCT project_id, origin, next AS id FROM one) o JOIN steps s ON s.project_id = o.project_id AND s.node = o.id WHERE s.next <> origin)
    SELECT project_id, origin, next AS id, distance, relation, path FROM (SELECT *, row_number() OVER (PARTITION BY project_id, origin, next
        ORDER BY distance, node, relation NULLS FIRST, path NULLS FIRST, line NULLS FIRST) AS r FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) WHERE r = 1"""
)
def graph_first_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the relation and path of the edge that reaches each first."""
    return graph.neighbours(graph.unique_edges(table(spark, folder, "code_edges")), _origins(spark, folder), 2)


@query(
    f"""WITH {_UNITS}, {_EDGES}, origins AS (SELECT DISTINCT project_id, id AS origin FROM code_units WHERE start_line % 50 = 0),
    one AS (SELECT e.project_id, origin, target_id AS id FROM origins o JOIN edges e ON e.project_id = o.project_id AND e.source_id = origin WHERE target_id <> origin),
    two AS (SELECT o.project_id, origin, e.target_id AS id FROM one o JOIN edges e ON e.project_id = o.project_id AND e.source_id = o.id WHERE e.target_id <> origin)
    SELECT r.project_id, origin, r.id, 'graph_distance_' || min(d) AS match, any_value(u.path) AS path FROM (SELECT *, 1 AS d FROM one UNION ALL SELECT *, 2 FROM two) r
    JOIN units u ON u.project_id = r.project_id AND u.id = r.id GROUP BY r.project_id, origin, r.id"""
)
def impact_downstream(spark: SparkSession, folder: str) -> DataFrame:
    """Known units that those units reach in two steps."""
    found = graph.impact(table(spark, folder, "code_units"), graph.unique_edges(table(spark, folder, "code_edges")), _origins(spark, folder), 2, "downstream")
    return found.select("project_id", "origin", "id", "match", "path")


@query(f"""WITH {_UNITS}, n AS (SELECT project_id, name AS term, count(*) AS n, min(id) AS i FROM units WHERE coalesce(name, '') <> '' GROUP BY 1, 2), p AS (SELECT project_id, path AS term, count(*) AS n, min(id) AS i FROM units WHERE coalesce(path, '') <> '' GROUP BY 1, 2)
    SELECT n.project_id, n.term, CASE WHEN p.n = 1 THEN 'path' WHEN p.n > 1 THEN 'ambiguous path' WHEN n.n = 1 THEN 'name' ELSE 'ambiguous name' END AS tier,
        CASE WHEN p.n = 1 THEN p.i WHEN p.n IS NULL AND n.n = 1 THEN n.i END AS id FROM n LEFT JOIN p USING (project_id, term) WHERE n.term NOT IN (SELECT id FROM units)""")
def ambiguous_names(spark: SparkSession, folder: str) -> DataFrame:
    """What every short name resolves to."""
    units = table(spark, folder, "code_units")
    return graph.resolve_names(units, units.where("coalesce(name, '') <> ''").select("project_id", F.col("name").alias("term")))


_LINKS = f"""{_UNITS}, {_EDGES}, links AS (SELECT DISTINCT e.project_id, e.path AS node, u.path AS depends_on FROM edges e JOIN units u ON u.project_id = e.project_id AND u.id = e.target_id WHERE e.path <> u.path),
    top AS (SELECT project_id, max(generation) AS g FROM code_units GROUP BY 1), changed AS (SELECT DISTINCT c.project_id, path AS node FROM code_units c JOIN top t ON t.project_id = c.project_id WHERE path IS NOT NULL AND generation = g)"""


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "code_units")
    top = units.groupBy("project_id").agg(F.max("generation").alias("_g"))
    return units.join(top, "project_id").where("path IS NOT NULL AND generation = _g").select(F.col("project_id").alias("group"), F.col("path").alias("node")).distinct()


@query(
    f"""WITH RECURSIVE {_LINKS}, closure AS (SELECT project_id, node FROM changed UNION SELECT l.project_id, l.node FROM closure c JOIN links l ON l.project_id = c.project_id AND l.depends_on = c.node)
    SELECT project_id, node AS path FROM closure"""
)
def reverse_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Files that depend, over any number of steps, on those of each project's newest generation."""
    links = graph.path_imports(table(spark, folder, "code_edges"), table(spark, folder, "code_units"))
    return graph.reverse_closure(links, _changed(spark, folder)).select(F.col("group").alias("project_id"), F.col("node").alias("path"))


@query(
    f"""WITH RECURSIVE {_LINKS}, surface AS (SELECT project_id, node FROM changed WHERE node NOT LIKE '%.go'),
    closure AS (SELECT project_id, node FROM surface UNION SELECT l.project_id, l.node FROM closure c JOIN links l ON l.project_id = c.project_id AND l.depends_on = c.node)
    SELECT project_id, node AS path FROM closure UNION SELECT project_id, node FROM changed"""
)
def affected(spark: SparkSession, folder: str) -> DataFrame:
    """Files to parse again if the Go files of the newest generation changed in their bodies alone."""
    links = graph.path_imports(table(spark, folder, "code_edges"), table(spark, folder, "code_units"))
    changes = _changed(spark, folder).withColumn("body_only", F.col("node").endswith(".go"))
    return graph.affected_files(changes, links).select(F.col("group").alias("project_id"), F.col("node").alias("path"))


@query(
    f"""SELECT doc_id, {_norm('text')} AS normalized, sha256({_norm('text')}) AS id, length(text) AS code_points, (length(text) + 3) // 4 AS tokens FROM documents WHERE text IS NOT NULL"""
)
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form, its hash, code points and estimated tokens of every document."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    plain = scalars.normalized_text(F.col("text"))
    return docs.select("doc_id", plain.alias("normalized"), F.sha2(plain, 256).alias("id"), F.char_length("text").cast("bigint").alias("code_points"), scalars.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\[\] \t\r\n]+)\]', 1)) AS marker FROM documents""")
def citation_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Names in single square brackets of every document."""
    return table(spark, folder, "documents").select("doc_id", F.explode(ranking.citation_markers(F.col("text"))).alias("marker"))


@query()
def md_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Heading-aware chunks of every document, parsed as Markdown."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("repo_path", F.lit("")).alias("repo_path"), "text")
    return markdown.parse_markdown(docs, "repo_path", "text", ["doc_id"])


@query(
    f"""{_MANIFEST}, whole AS (SELECT DISTINCT ON (d.project_id, d.path) d.project_id, d.path, d.source FROM code_units d {_JOINED} WHERE d.kind = 'file' AND d.source IS NOT NULL ORDER BY d.project_id, d.path, d.id),
    part AS (SELECT DISTINCT d.project_id, d.id, d.path, d.start_line, d.end_line, d.source FROM code_units d {_JOINED} WHERE d.kind <> 'file')
    SELECT p.project_id, p.id, p.start_line, p.end_line, coalesce(rtrim(array_to_string(string_split(replace(w.source, chr(13) || chr(10), chr(10)), chr(10))[p.start_line:p.end_line], chr(10)), chr(10)) = rtrim(replace(p.source, chr(13) || chr(10), chr(10)), chr(10)), false) AS fresh
    FROM part p JOIN whole w ON w.project_id = p.project_id AND w.path = p.path"""
)
def evidence_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each active unit's text is what its lines of the active file hold now."""
    from lodestone.operators.evidence import evidence_freshness

    return evidence_freshness(visibility.visible(table(spark, folder, "code_units"), _manifest(spark, folder)))


@query(
    f"""WITH {_EDGES}, need AS (SELECT project_id, min(source_id) AS pattern FROM edges WHERE relation = 'calls' GROUP BY 1),
    wanted AS (SELECT DISTINCT n.project_id, e.target_id FROM need n JOIN edges e ON e.project_id = n.project_id AND e.source_id = n.pattern AND e.relation = 'calls')
    SELECT e.project_id, e.source_id AS id FROM (SELECT DISTINCT project_id, source_id, target_id FROM edges WHERE relation = 'calls') e JOIN wanted w ON w.project_id = e.project_id AND w.target_id = e.target_id
    GROUP BY e.project_id, e.source_id HAVING count(*) = (SELECT count(*) FROM wanted x WHERE x.project_id = e.project_id)"""
)
def implements_division(spark: SparkSession, folder: str) -> DataFrame:
    """Units that call all that the first caller of their project calls: a relational division."""
    calls = graph.unique_edges(table(spark, folder, "code_edges")).where("relation = 'calls'").select("project_id", "source_id", "target_id").distinct()
    first = calls.groupBy("project_id").agg(F.min("source_id").alias("source_id"))
    wanted = calls.join(first, ["project_id", "source_id"], "left_semi").select("project_id", F.col("target_id").alias("member"))
    return code.holds_all(calls.select("project_id", F.col("source_id").alias("id"), F.col("target_id").alias("member")), wanted, ["project_id"])


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    return table(spark, folder, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    units = visibility.visible(table(spark, folder, "code_units").where("kind = 'file'"), _manifest(spark, folder))
    return code.source_facts(units.dropDuplicates(["project_id", "path"]))


@query()
def code_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Units that the active Go and script files declare."""
    return code.overloads(_facts(spark, folder)).select("project_id", "id", "kind", "qualified_name", "path", "ordinal", "start_line", "end_line")


@query()
def code_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in active files, resolved by name, those of scripts through imports and re-exports as well."""
    facts = cut_lineage(_facts(spark, folder))
    modules = code.module_targets(facts.where("fact = 'import'").where(~F.col("path").endswith(".go")), _manifest(spark, folder))
    return code.call_edges(facts, modules)


@query()
def code_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of active files with the file or package they mean."""
    found = _facts(spark, folder).where("fact = 'import'")
    files = _manifest(spark, folder)
    go = F.col("path").endswith(".go")
    return code.package_targets(found.where(go), files).unionByName(code.module_targets(found.where(~go), files))


@query()
def code_implements(spark: SparkSession, folder: str) -> DataFrame:
    """Go types and the interfaces whose methods they have."""
    return code.implements(_facts(spark, folder))
