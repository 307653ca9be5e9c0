"""Core operators against literal tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import change_feed, code, graph, markdown, ranking, search, visibility
from lodestone.operators.evidence import evidence_freshness, line_slice
from lodestone.sources import git, project, suite

H = {c: c * 64 for c in "abcdef"}
FILES = "project_id string, path string, generation bigint, activated_at timestamp, file_hash string, deleted boolean"


def at(n):
    return datetime(2026, 1, 1, 0, 0, n)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# change feed and visibility


def brute(feed):
    best = {}
    for project_id, path, generation, when, digest, deleted in feed:
        if path is None or generation is None:
            continue
        path = "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))
        if not path:
            continue
        key = (generation, when is not None, when or at(0), not deleted, digest is not None, digest or "")
        if (project_id, path) not in best or key > best[project_id, path][0]:
            best[project_id, path] = (key, (project_id, path, generation, digest))
    return sorted((v for k, v in best.values() if k[3]), key=str)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_change_feed_equals_brute_force(spark, batches):
    rng = random.Random(batches)
    feed = []
    for _ in range(400):
        path = None if rng.random() < 0.03 else rng.choice(["a.md", "./a.md", "x\\b.go", "x//b.go", "x/./b.go", "hot", "c", ".", ""])
        generation = None if rng.random() < 0.03 else rng.randrange(1, 30)
        feed.append((rng.choice(["p", "q", None]), path, generation, rng.choice([None, at(1), at(2), at(3)]), rng.choice([None, *H.values()]), rng.choice([True, False, False, None])))
    feed += feed[:50]
    df = spark.createDataFrame(feed, FILES).withColumn("extra", F.lit(1)).repartition(3)
    assert sorted(map(tuple, change_feed.current_files(df, batches).collect()), key=str) == brute(feed)


def test_change_feed_of_an_empty_table(spark):
    assert change_feed.current_files(spark.createDataFrame([], FILES)).count() == 0


def test_visibility_needs_hash_and_generation(spark):
    derived = spark.createDataFrame([("p", "a.md", H["a"], 1, "old"), ("p", "a.md", H["b"], 2, "same"), ("p", "a.md", H["b"], 3, "new")], "project_id string, path string, file_hash string, generation bigint, id string")
    log = [("p", "a.md", 3, at(1), H["b"], False)]
    manifest = visibility.active(spark.createDataFrame(log, FILES))
    assert rows(visibility.visible(derived, manifest), "id") == [("new",)]
    assert rows(visibility.obsolete(derived, manifest), "id") == [("old",), ("same",)]
    log.append(("p", "a.md", 4, at(2), None, True))
    assert visibility.visible(derived, visibility.active(spark.createDataFrame(log, FILES))).count() == 0


def test_scopes_keep_what_covers_nothing(spark):
    manifest = spark.createDataFrame([("p", "docs/api.md"), ("p", "src/api.ts"), ("p", "docsx/a.md")], "project_id string, path string")
    scopes = spark.createDataFrame([("p", "docs"), ("p", "none/"), ("p", "src/api.ts")], "project_id string, scope string")
    assert rows(visibility.expand_scopes(manifest, scopes)) == [("p", "docs/api.md"), ("p", "none/"), ("p", "src/api.ts")]


def test_manifest_diff(spark):
    s = "project_id string, path string, file_hash string"
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "1"), ("p", "c", None)], s)
    new = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", None), ("p", "d", "1")], s)
    assert rows(visibility.manifest_diff(old, new), "path", "status") == [("a", "same"), ("b", "changed"), ("c", "same"), ("d", "new")]
    assert rows(visibility.manifest_diff(new, old), "path", "status")[-1] == ("d", "deleted")


def test_embedding_reuse_takes_the_newest(spark):
    chunks = spark.createDataFrame([("h", "i1", 1, [1.0, 2.0]), ("h", "i2", 2, [3.0, 4.0]), ("h", "i3", 9, []), ("g", "i4", 1, None)], "chunk_hash string, id string, generation bigint, embedding array<float>")
    assert rows(visibility.reusable_embeddings(chunks, 2), "chunk_hash", "id") == [("h", "i2")]


# scalars


def test_paths_and_hashes(spark):
    df = spark.createDataFrame([("./a\\b//c",), ("a/../b",), ("",), (None,)], "p string").select(scalars.canonical_path(F.col("p")))
    assert [r[0] for r in df.collect()] == ["a/b/c", "b", "", None]
    df = spark.createDataFrame([(" " + "A" * 64,), ("sha256:" + "b" * 64,), ("zz",), (None,)], "h string").select(scalars.canonical_hash(F.col("h")))
    assert [r[0] for r in df.collect()] == ["a" * 64, "b" * 64, None, None]


def test_text_functions(spark):
    r = spark.createDataFrame([("  A \u0085 b\n C ",)], "t string").select(scalars.normalized_text(F.col("t")), scalars.token_estimate(F.lit("abcde")), scalars.text_tokens(F.lit("Ab-1 中文")), scalars.is_uuid4(F.lit("0b0e1f9e-3d5a-4c1e-9a3b-0123456789ab"))).first()
    assert tuple(r) == ("a b c", 2, ["ab", "1", "中", "文"], True)


# search and ranking


def test_lexical_ranking(spark):
    cols = "project_id string, id string, path string, start_line bigint, weight double, text string"
    found = search.lexical_search(spark.createDataFrame([("p", "1", "a", 1, 1.0, "needle only"), ("p", "2", "b", 1, 2.0, "Needle  phrase"), ("p", "3", "c", 1, 1.0, None)], cols), "needle phrase", 1)
    assert rows(found, "id", "score") == [("2", 6.0)]


def test_vector_search_skips_unusable_vectors(spark):
    cols = "project_id string, id string, embedding array<float>"
    df = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("p", "b", [0.0, 1.0]), ("p", "c", [0.0, 0.0]), ("p", "d", None), ("p", "e", []), ("p", "f", [1.0])], cols)
    assert rows(search.vector_search(df, [1.0, 0.1]), "id", "place") == [("a", 1), ("b", 2)]


def test_batch_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [0.0] * 4)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = search.batch_nearest(df, df.where("vec_id % 5 = 0"), "vec_id", "embedding", 3, block_rows=7)

    def cos(a, b):
        return round(1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 9) + 0.0

    usable = [(i, v) for i, v in data if v and any(v)]
    want = [(q, o, n) for q, v in usable if q % 5 == 0 for n, (_, o) in enumerate(sorted((cos(v, w), o) for o, w in usable if o != q)[:3], 1)]
    assert rows(got, "query", "other", "place") == sorted(want)


def test_question_terms_and_safe_terms():
    terms = ranking.question_terms("Where is 'src/a b.ts' used by crm.UserService.GetUser, user_id and src/http.tsx in the API Guide?")
    for t in ("src/a b.ts", "crm.UserService.GetUser", "UserService", "GetUser", "user_id", "src/http.tsx", "API Guide"):
        assert t in terms
    assert ranking.question_terms("Handle") == ["Handle"] and "Handle" in ranking.question_terms("Where is Handle called?") and "Session" in ranking.question_terms("why does Session fail")
    assert ranking.question_terms("the plain words of it, 1.5 times, a-b") == [] and ranking.question_terms("see My_Guide Two-Part") == ["My_Guide Two-Part", "My_Guide", "Two", "Part"]
    assert ranking.safe_term("customer handler") and not ranking.safe_term("../secret") and not ranking.safe_term("x; rm") and not ranking.safe_term("x")


CAND = "project_id string, id string, type string, path string, start_line bigint, match string, heading string, symbol string, weight double, list int, place int, score double"


def test_fusion_boost_and_exact_symbol(spark):
    data = [("p", "C1", "code", "a", 1, "", "", "S", 1.0, 1, 2, 0.0), ("p", "C2", "code", "b", 1, "full_text", "", "T", 1.0, 1, 1, 0.0), ("p", "C1", "code", "a", 1, "vector", "", "S", 1.0, 2, 1, 0.0), ("p", "C2", "code", "b", 1, "vector", "", "T", 1.0, 2, 2, 0.0)]
    fused = ranking.fuse(spark.createDataFrame(data, CAND), ["project_id", "id"])
    assert {r.id: r.match for r in fused.collect()} == {"C1": "vector", "C2": "full_text"}
    assert all(abs(r.score - (1 / 61 + 1 / 62)) < 1e-15 for r in fused.collect())
    marked = fused.withColumn("match", ranking.exact_match(["S"], F.col("match"))).withColumn("score", ranking.boosted(["S"]))
    assert ranking.ranked(marked, ["project_id"]).where("place = 1").first().id == "C1"


def test_source_weights(spark):
    want = {"a.go": 1.0, "a_test.go": 0.6, "a.d.ts": 0.5, "tests/foo.go": 1.0, "foo_test.py": 0.6, "a.test.py": 0.6, "X.SPEC.tsx": 0.6, "a_test.d.ts": 0.5}
    df = spark.createDataFrame([(p, 0.0) for p in want] + [("a.ts", 2.0), ("n.go", None)], "path string, weight double")
    assert [r[0] for r in df.select(ranking.source_weight(F.col("path"), F.col("weight"))).collect()] == [*want.values(), 2.0, 1.0]


def test_weights_distances_and_the_fourth_of_a_file(spark):
    names = [("prod", "prod.go", "", 1.0), ("test", "prod_test.go", "", 0.6), ("decl", "types.d.ts", "", 0.5), ("near", "near.go", "graph_distance_1", 1.0), ("far", "far.go", "graph_distance_2", 1.0)]
    names += [(f"same{i}", "same.go", "", 1.0) for i in range(1, 5)] + [("other", "other.go", "", 1.0)]
    df = spark.createDataFrame([("p", i, "code", p, 1, m, "", "", w, 1, n, 0.0) for n, (i, p, m, w) in enumerate(names, 1)], CAND)
    scored = ranking.fuse(df, ["project_id", "id"]).withColumn("score", ranking.boosted([]))
    order = {r.id: (r.place, r.score) for r in ranking.diversify(ranking.ranked(scored, ["project_id"]), ["project_id"]).collect()}
    assert order["prod"][1] > order["test"][1] > order["decl"][1] and order["near"][1] > order["far"][1] and order["other"][0] < order["same4"][0]


def test_places_of_large_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "s", None]), i, rng.choice(["a", "b", "", None]) if i % 3 else f"f{i % 40}") for i in range(600)]
    df = spark.createDataFrame(data, "source string, place bigint, path string").repartition(4)
    small = {(r.source, r.path, r._1): r.place for r in ranking.diversify(df.withColumn("_1", F.col("place")), ["source"]).collect()}
    large = {(r.source, r.path, r._1): r.place for r in ranking.diversify_table(df.withColumn("_1", F.col("place")), ["source"]).collect()}
    assert small == large and len(large) == 600
    assert ranking.diversify_table(df.limit(0), ["source"]).count() == 0


def test_diversify_holds_back_the_fourth_of_a_path(spark):
    df = spark.createDataFrame([("p", "x", i) for i in range(1, 5)] + [("p", "y", 5)] + [("p", "", i) for i in range(6, 11)], "project_id string, path string, place int")
    out = ranking.diversify(df, ["project_id"]).orderBy("place").collect()
    assert [r.path for r in out] == ["x", "x", "x", "y", "", "", "", "", "", "x"]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("p", 1, 6000), ("p", 2, 6001), ("p", 3, 6000), ("q", 1, 12001)], "g string, place int, tokens bigint")
    assert rows(ranking.within_budget(df, ["g"], "tokens"), "g", "place") == [("p", 1), ("p", 3)]


def test_citations(spark):
    assert ranking.keep_citations("Use [C1], ignore [X9].", {"C1"}) == ("Use [C1], ignore .", ["C1"])
    df = spark.createDataFrame([("p", "doc", 1), ("p", "code", 2), ("p", "doc", 3)], "g string, type string, place int")
    assert rows(ranking.label_citations(df, ["g"]), "place", "label") == [(1, "D1"), (2, "C1"), (3, "D2")]


# graph

EDGES = "project_id string, source_id string, target_id string, relation string, path string, start_line bigint, end_line bigint, resolution string, file_hash string, generation bigint"
UNITS = "project_id string, id string, name string, qualified_name string, kind string, path string, start_line bigint, end_line bigint, generation bigint, weight double"


def edge(source, target, path="x.go", line=1, relation="calls"):
    return ("p", source, target, relation, path, line, line, "local", "h", 1)


def unit(key, name=None, path=None, generation=1):
    return ("p", key, name or key, "", "function", path or f"{key}.go", 1, 2, generation, 1.0)


def test_neighbours_least_distance_and_first_reach(spark):
    data = [edge("A", "C", "a", 3), edge("A", "B", "a", 2), edge("A", "B", "a", 2), edge("B", "A", "b", 1), edge("B", "D", "b.go", 2), edge("C", "D", "c", 2), edge("D", "E", "d", 2), edge("A", ""), edge(None, "Z")]
    edges = graph.unique_edges(spark.createDataFrame(data, EDGES))
    origin = spark.createDataFrame([("p", "A")], "project_id string, origin string")
    assert rows(graph.neighbours(edges, origin, 2, "downstream"), "id", "distance", "path") == [("B", 1, "a"), ("C", 1, "a"), ("D", 2, "b.go")]
    assert rows(graph.neighbours(edges, origin, 1, "upstream"), "id") == [("B",)]
    assert graph.neighbours(edges, origin, 3).count() == graph.neighbours(edges, origin, 0).count() == 0


def test_walk_passes_through_unknown_nodes(spark):
    edges = graph.unique_edges(spark.createDataFrame([edge("A", "missing"), edge("missing", "B")], EDGES))
    units = spark.createDataFrame([unit("A"), unit("B"), unit("B", path="old.go", generation=0)], UNITS)
    found = graph.impact(units, edges, spark.createDataFrame([("p", "A")], "project_id string, origin string"), 2, "downstream")
    assert rows(found, "id", "match", "path") == [("B", "graph_distance_2", "B.go")]


def test_resolve_names(spark):
    units = spark.createDataFrame([unit("1", "f", "a.go"), unit("2", "g", "b.go"), unit("3", "g", "c.go"), unit("4", "h", "c.go")], UNITS)
    asked = spark.createDataFrame([("p", t) for t in ("1", "a.go", "c.go", "f", "g", "zz")], "project_id string, term string")
    assert rows(graph.resolve_names(units, asked).na.fill(""), "term", "tier", "id") == [("1", "id", "1"), ("a.go", "path", "1"), ("c.go", "ambiguous path", ""), ("f", "name", "1"), ("g", "ambiguous name", ""), ("zz", "unknown", "")]


def test_affected_files_with_cycles(spark):
    links = spark.createDataFrame([("p", "client", "api"), ("p", "page", "client"), ("p", "api", "page")], "group string, node string, depends_on string")
    s = "group string, node string, body_only boolean"
    assert rows(graph.affected_files(spark.createDataFrame([("p", "api", True)], s), links), "node") == [("api",)]
    assert rows(graph.affected_files(spark.createDataFrame([("p", "api", None), ("p", "removed", False)], s), links), "node") == [("api",), ("client",), ("page",), ("removed",)]
    scopes = spark.createDataFrame([("p", "tsconfig.json", "only")], "group string, node string, scope_node string")
    assert rows(graph.affected_files(spark.createDataFrame([("p", "tsconfig.json", None)], s), links, scopes), "node") == [("only",)]


# Markdown


def parse(text):
    return list(markdown.document_chunks(text))


def test_headings_fences_tags_and_links():
    text = "---\ntags: [platform]\naliases: Start\n---\nOverview\n===\n\nSee [[a/b|c]] and #Roadmap.\n```\n# no heading [[x]]\n```\n\nDatabase\n---\n\nText.\n"
    first, second = parse(text)
    assert (first["heading"], first["start_line"], first["end_line"], first["tags"], first["links"], first["aliases"]) == ("Overview", 7, 12, ["platform", "roadmap"], ["a/b"], ["Start"])
    assert (second["heading"], second["start_line"]) == ("Overview > Database", 15)


def test_a_closure_is_whole_or_an_error(spark):
    links = spark.createDataFrame([("g", f"n{i + 1:02d}", f"n{i:02d}") for i in range(20)] + [("g", None, "n00")], "group string, node string, depends_on string")
    seeds = spark.createDataFrame([("g", "n00")], "group string, node string")
    assert graph.reverse_closure(links, seeds).count() == 21
    with pytest.raises(ValueError):
        graph.reverse_closure(links, seeds, rounds=5)


def test_long_sections_overlap_by_a_paragraph():
    text = "".join(c * 1200 + "\n\n" for c in "abcde")
    got = parse(text)
    assert len(got) == 4 and all((len(c["content"]) + 3) // 4 <= 900 for c in got)
    assert got[0]["content"][-10:].strip() == got[1]["content"][:9] == "b" * 9


def test_broken_frontmatter_and_line_ends(spark):
    with pytest.raises(ValueError):
        parse("---\ntags: [a\n---\n")
    assert parse("---\ntags: [a]\nno end\n")[0]["content"].startswith("---")
    assert parse("x\n---\ntags: [api]\n---\ntext\n")[-1]["heading"].endswith("tags: [api]")
    crlf = parse("# T\r\nExact quote.\r\n")[0]
    assert (crlf["start_line"], crlf["end_line"], crlf["content"]) == (2, 2, "Exact quote.\r\n")
    df = spark.createDataFrame([("a.md", "# T\nExact quote.\n"), ("b.md", "---\ntags: [a\n---\n"), ("c.md", None), ("d.md", "")], "path string, content string")
    out = {r.path: r for r in markdown.parse_markdown(df).collect()}
    assert set(out) == {"a.md", "b.md"} and out["a.md"].chunk_hash.startswith("89e84f75") and out["b.md"].error and out["b.md"].content is None


# evidence, source facts, listing, git, suites


def test_line_slice(spark):
    r = spark.range(1).select(line_slice(F.lit("a\r\nb\nc"), F.lit(2), F.lit(3)), line_slice(F.lit("a"), F.lit(2), F.lit(3))).first()
    assert tuple(r) == ("b\nc", None)


def test_evidence_freshness(spark):
    s = "project_id string, path string, id string, kind string, start_line bigint, end_line bigint, source string"
    df = spark.createDataFrame([("p", "a", "f", "file", 1, 3, "x\ny\nz\n"), ("p", "a", "u", "function", 2, 2, "y\n"), ("p", "a", "v", "function", 1, 2, "old"), ("p", "a", "w", "function", 9, 9, None)], s)
    assert rows(evidence_freshness(df), "id", "fresh") == [("u", True), ("v", False), ("w", False)]


GO = 'package customer\n\nimport (\n\t"strings"\n\t"example.com/shared/model"\n)\n\ntype Creator interface {\n\tCreate(name string) error\n}\n\ntype Service struct {\n\tMetadata\n\tname string\n}\n\nfunc (s *Service) Create(name string) error {\n\treturn save(strings.TrimSpace(name)) // call(x)\n}\n\nfunc save(n string) error { return nil }\n'
TS = 'import { b } from "./service";\nimport React from "react";\nexport class Controller extends Service implements API {\n  run(x: string): void {\n    helper(x);\n  }\n}\nexport function helper(x) { return "call(y)" }\nconst view = (p) => helper(p);\n'


def test_source_facts_and_resolution(spark):
    s = "project_id string, path string, language string, source string"
    files = spark.createDataFrame([("p", "service/customer/c.go", "go", GO), ("p", "src/api.ts", "typescript", TS), ("p", "src/service.tsx", "typescript", ""), ("p", "shared/model/m.go", "go", "package model\n"), ("p", "x.py", "python", "def f(): pass")], s)
    facts = code.source_facts(files).persist()
    assert rows(code.declared_units(facts), "kind", "qualified_name") == [("class", "Controller"), ("function", "helper"), ("function", "save"), ("function", "view"), ("interface", "Creator"), ("method", "Controller.run"), ("method", "Service.Create"), ("type", "Service")]
    assert rows(facts.where("fact = 'heritage'"), "kind", "owner", "name") == [("embeds", "Service", "Metadata"), ("extends", "Controller", "Service"), ("implements", "Controller", "API")]
    assert rows(code.implements(facts), "type", "interface") == [("service/customer#Service", "service/customer#Creator")]
    imports = facts.where("fact = 'import'")
    assert rows(code.package_targets(imports.where("path LIKE '%.go'"), files).na.fill(""), "specifier", "target", "resolution") == [("example.com/shared/model", "shared/model", "local"), ("strings", "", "external")]
    assert rows(code.module_targets(imports.where("path LIKE '%.ts'"), files).na.fill(""), "specifier", "target", "resolution") == [("./service", "src/service.tsx", "local"), ("react", "", "external")]
    calls = rows(code.call_edges(facts), "caller", "callee", "resolution")
    assert ("Service.Create", "save", "local") in calls and ("Service.Create", "TrimSpace", "unresolved") in calls and ("Controller.run", "helper", "local") in calls
    assert not [c for c in calls if c[1] == "call"]


def test_alias_is_most_specific_and_final(spark):
    s = "project_id string, path string"
    files = spark.createDataFrame([("p", "src/feature/index.ts"), ("p", "src/a.ts")], s)
    imports = spark.createDataFrame([("p", "m.ts", "@app/a"), ("p", "m.ts", "@feature"), ("p", "m.ts", "@app/none")], s + ", target string")
    got = code.module_targets(imports, files, [("@app/*", "src/*"), ("@feature", "src/feature")])
    assert rows(got.na.fill(""), "specifier", "target") == [("@app/a", "src/a.ts"), ("@app/none", ""), ("@feature", "src/feature/index.ts")]


def test_settings_of_scripts_lead_to_modules(spark):
    s = "project_id string, path string"
    names = ["src/feature/index.ts", "src/a.ts", "lib/b.js", "src/pkg/entry.js", "src/bad/index.ts", "src/nest/main/index.js", "shared/c.ts", "src/.hidden.ts"]
    files = spark.createDataFrame([("p", n) for n in names] + [("q", "src/a.ts"), ("s", "src/a.ts")], s)
    options = '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["gone/*", "src/*"], "@feature": ["src/feature"], "@*": ["lib/*"], "@x*y*": ["src/*"]}}}'
    rows_ = [
        ("p", "tsconfig.json", options), ("p", "jsconfig.json", '{"compilerOptions": {"paths": {"@app/*": ["lib/*"]}}}'),
        ("p", "src/pkg/package.json", '{"main": "./none.js", "module": "./entry", "exports": {".": {"import": "./other"}}}'),
        ("p", "src/bad/package.json", '{"main": "../a.ts"}'), ("p", "src/nest/package.json", '{"exports": "./main"}'), ("p", "lib/package.json", "{"),
        ("q", "tsconfig.json", "not json"), ("q", "package.json", None), ("r", "tsconfig.json", '{"compilerOptions": {"baseUrl": "../up", "paths": {"@a": ["x"]}}}'),
        ("s", "jsconfig.json", '{"compilerOptions": {"paths": {"~/*": ["./src/*"]}}}'),
    ]
    settings = spark.createDataFrame(rows_, s + ", source string")
    asked = ["@app/a", "@feature", "@app/none", "@b", "shared/c", "react", "./src/pkg", "./src/bad", "./src/nest", "./src/a.js", "/src/a"]
    imports = spark.createDataFrame([("p", "m.ts", x) for x in asked] + [("q", "m.ts", "@app/a"), ("q", "m.ts", "./src/a"), ("s", "m.ts", "~/a")], s + ", target string")
    got = {(r.project_id, r.specifier): (r.target, r.resolution) for r in code.module_targets(imports, files, settings=settings).collect()}
    want = {"@app/a": "src/a.ts", "@feature": "src/feature/index.ts", "@b": "lib/b.js", "shared/c": "shared/c.ts", "./src/pkg": "src/pkg/entry.js", "./src/bad": "src/bad/index.ts", "./src/nest": "src/nest/main/index.js", "./src/a.js": "src/a.ts"}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "p" and v[0]} == want
    assert got["p", "@app/none"] == (None, "external") and got["p", "react"] == (None, "external") and got["p", "/src/a"] == (None, "unresolved")
    assert got["q", "@app/a"] == (None, "external") and got["q", "./src/a"] == got["s", "~/a"] == ("src/a.ts", "local")
    assert not code.module_rules(settings.where("project_id IN ('q', 'r')")).count()


def test_division_needs_every_member(spark):
    m = spark.createDataFrame([("p", "t", "a"), ("p", "t", "b"), ("p", "u", "a"), ("q", "t", "a")], "g string, id string, member string")
    assert rows(code.holds_all(m, spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "g string, member string"), ["g"])) == [("p", "t")]


def test_discovery_policy(spark):
    names = ["a.go", "a_test.go", "node_modules/x.js", "b.min.js", ".env", "c.bin", "go.mod", "gen.go", "nul.md", "big.md", "docs/x.md", "../x.md"]
    body = {"gen.go": b"// Code generated by x DO NOT EDIT.\n", "nul.md": b"a\x00b", "big.md": b"x" * 200}
    df = spark.createDataFrame([(n, len(body.get(n, b"x")), 0, bytearray(body.get(n, b"x"))) for n in names], "path string, size bigint, mtime_ns bigint, content binary")
    got = {r.path: (r.reason, r.kind, r.language) for r in project.discover(df, max_bytes=100, prefixes=("docs",)).collect()}
    assert got["a.go"] == (None, "code", "go") and got["go.mod"] == (None, "resolution", "go")
    want = {"a_test.go": "test file", "node_modules/x.js": "excluded directory", "b.min.js": "excluded path or secret name", ".env": "excluded path or secret name", "c.bin": "unsupported extension", "gen.go": "generated Go source", "nul.md": "contains NUL byte", "big.md": "file exceeds size limit", "docs/x.md": "excluded configured path", "../x.md": "path escapes the project"}
    assert {n: got[n][0] for n in want} == want


def test_git_outputs():
    status = "# branch.head main\0" + "1 .M N... 100644 100644 100644 aaa bbb src/a b.go\0" + "2 R. N... 100644 100644 100644 aaa bbb R100 new.go\0old.go\0? extra.md\0! ignored\0"
    assert git.status_changes(status) == [("extra.md", None), ("new.go", "old.go"), ("src/a b.go", None)]
    assert git.diff_changes("M\0a.go\0R100\0old\0new\0C75\0x\0y\0") == [("a.go", None), ("new", "old"), ("x", None), ("y", None)]
    with pytest.raises(ValueError):
        git.status_changes("2 R. N... 1 1 1 a b R100 new.go\0")
    with pytest.raises(ValueError):
        git.safe_path("../x")


def test_suites_and_settings():
    assert suite.read_suite('[{"question": "q", "max_tokens": 256}]')[0].max_tokens == 256
    for bad in ("[]", '[{"question": " "}]', '[{"question": "q", "other": 1}]', '[{"question": "q", "max_tokens": 5}]'):
        with pytest.raises(ValueError):
            suite.read_suite(bad)
    assert suite.Settings.from_yaml("graph_depth: 1\n").graph_depth == 1
    with pytest.raises(ValueError):
        suite.Settings(graph_depth=3)


def test_rows_of_nothing(spark):
    empty = spark.createDataFrame([], CAND)
    assert ranking.fuse(empty, ["project_id", "id"]).count() == 0
    assert graph.unique_edges(spark.createDataFrame([], EDGES)).count() == 0
    assert Row is not None


def test_inits_and_one_line_interfaces(spark):
    text = "package m\n\ntype Store interface { Create() error; Close() error }\n\ntype Half struct{}\n\nfunc (h Half) Create() error { return nil }\n\ntype Full struct{}\n\nfunc (f *Full) Create() error { return nil }\n\nfunc (f *Full) Close() error { return nil }\n"
    two = "package m\n\nfunc init() { initOne() }\n\nfunc init() { initTwo() }\n\nfunc initOne() {}\n\nfunc initTwo() {}\n"
    files = spark.createDataFrame([("p", "m/a.go", "go", text), ("p", "m/b.go", "go", two), ("p", "m/c.go", "go", two.replace("initOne() {}", "x() {}").replace("initTwo() {}", "y() {}"))], "project_id string, path string, language string, source string")
    facts = code.source_facts(files)
    assert rows(code.implements(facts), "type", "interface") == [("m#Full", "m#Store")]
    inits = code.declared_units(facts).where("name = 'init'").collect()
    assert len(inits) == len({r.id for r in inits}) == 4 and {r.caller for r in inits} == {"init#1", "init#2"}
    names = {r.id: r.name for r in code.declared_units(facts).collect()}
    calls = code.call_edges(facts).where("path = 'm/b.go'").collect()
    assert {(r.caller, names.get(r.target)) for r in calls} == {("init#1", "initOne"), ("init#2", "initTwo")}


def test_a_file_that_breaks_the_parser_is_a_warning(spark, monkeypatch):
    text = spark.createDataFrame([("p", "a.go", "go", "package a\n"), ("p", "b.ts", "typescript", None)], "project_id string, path string, language string, source string")
    assert [r.fact for r in code.source_facts(text).collect()] == ["package"]


def test_calls_through_imports_and_re_exports(spark):
    files = {
        "a.ts": 'import { helper as h, twice, Own } from "./index";\nimport * as lib from "./lib";\nimport make from "./make";\nconst { old } = require("./old");\nexport function run() {\n  h();\n  twice();\n  lib.deep();\n  make();\n  old();\n  Own();\n}\n',
        "index.ts": 'export { inner as helper } from "./lib";\nexport * from "./left";\nexport * from "./right";\nimport { inner } from "./lib";\nexport { inner as Own };\n// export { inner as ghost }\n',
        "lib.ts": 'export function inner() {\n}\nexport function deep() {\n}\nexport * from "./index";\n', "left.ts": "export function twice() {\n}\n", "right.ts": "export function twice() {\n}\n",
        "make.ts": "export default function build() {\n}\n", "old.js": "function gone() {\n}\nmodule.exports = { old: gone };\n",
    }
    df = spark.createDataFrame([("p", p, "typescript", s) for p, s in files.items()], "project_id string, path string, language string, source string")
    facts = code.source_facts(df)
    modules = code.module_targets(facts.where("fact = 'import'"), df)
    names = {r.id: f"{r.path}:{r.name}" for r in code.declared_units(facts).collect()}
    got = {r.callee: names.get(r.target) for r in code.call_edges(facts, modules).where("path = 'a.ts'").collect()}
    assert got == {"h": "lib.ts:inner", "twice": None, "deep": "lib.ts:deep", "make": "make.ts:build", "old": "old.js:gone", "Own": "lib.ts:inner"}
    assert not code.exported_units(facts, modules).where("name = 'ghost'").count()
