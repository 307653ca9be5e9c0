"""The engine end to end: an edited file never gives its old text."""

import hashlib

import pytest

from lodestone.plans.engine import Engine
from lodestone.sources.suite import Question
from lodestone.streaming.activation import activate, current


def embedder(texts):
    return [[float(b) - 127 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def test_refresh_search_and_impact(spark, tmp_path):
    from lodestone.sources.suite import Settings

    root, store = tmp_path / "tree", tmp_path / "store"
    (root / "pkg").mkdir(parents=True)
    (root / "README.md").write_text("# Guide\n\nThe zebra handler opens a session.\n")
    (root / "pkg" / "a.go").write_text("package pkg\n\nfunc OpenZebra() error { return helper() }\n\nfunc helper() error { return nil }\n")
    engine = Engine(spark, str(root), str(store), Settings(dim=8), embedder)
    first = engine.sync("full")
    assert (first.state, first.generation, first.changed, first.deleted) == ("ready", 1, 2, 0)
    assert engine.sync().changed == 0
    found = engine.search_context("Where does OpenZebra open a session?")
    assert any(e["symbol"] == "OpenZebra" and "helper()" in e["snippet"] for e in found["evidence"]) and found["used_tokens"] <= 3500
    assert [r.symbol for r in engine.impact(symbol="OpenZebra", direction="downstream").collect()] == ["helper"]
    (root / "README.md").write_text("# Guide\n\nThe walrus handler opens a session.\n")
    (root / "pkg" / "a.go").unlink()
    again = engine.sync()
    assert (again.changed, again.deleted) == (1, 1)
    texts = [e["quote"] or e["snippet"] for e in engine.search_context("session handler")["evidence"]]
    assert texts and all("zebra" not in t.lower() for t in texts) and any("walrus" in t for t in texts)
    engine.cleanup()
    assert engine.read("code_units").count() == 0 and engine.status()["files"] == 1
    with pytest.raises(ValueError):
        engine.impact(symbol="x", path="y")
    report = engine.benchmark([Question("session handler")], retrievals=2)
    assert report["budget_violations"] == 0


def test_announcements_as_a_stream(spark, tmp_path):
    schema = "project_id string, path string, generation bigint, activated_at timestamp, file_hash string, deleted boolean"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("p", "a", 2, None, "b" * 64, False), ("p", "b", 1, None, "a" * 64, False)], schema).write.parquet(source)
    for extra in ([], [("p", "a", 1, None, "a" * 64, False), ("p", "b", 2, None, None, True)]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(source)
        activate(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.path, r.generation) for r in current(spark.read.parquet(log)).collect()] == [("a", 2)]


def test_delta_gives_the_edges_of_a_full_refresh(spark, tmp_path):
    from lodestone.operators import visibility

    root, store = tmp_path / "tree", tmp_path / "store"
    (root / "pkg").mkdir(parents=True)
    (root / "app").mkdir()
    a, b = root / "pkg" / "a.go", root / "pkg" / "b.go"
    a.write_text("package pkg\n\ntype Saver interface {\n\tSave(n string) error\n}\n\nfunc Open() error { return helper() }\n")
    b.write_text("package pkg\n\nfunc helper() error { return nil }\n")
    (root / "app" / "m.go").write_text('package app\n\nimport "x.org/m/pkg"\n\ntype Disk struct {\n\tpkg.Base\n}\n\nfunc (d *Disk) Save(n string) error { return nil }\n')
    (root / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"#ui/*": ["app/*"]}}}')
    (root / "app" / "v.ts").write_text('import { Base } from "#ui/base";\nexport class View extends Base {\n}\n')
    engine = Engine(spark, str(root), str(store))
    engine.sync("full")

    def edges(e):
        names = {r.id: r.qualified_name for r in visibility.visible(e.read("code_units"), e.manifest()).collect()}
        rows = visibility.visible(e.read("code_edges"), e.manifest()).where("relation <> 'contains'").collect()
        return sorted((names.get(r.source_id), r.relation, names.get(r.target_id, r.target_id), r.path, r.resolution) for r in rows)

    first = edges(engine)
    assert ("app/m.go", "imports", "pkg", "app/m.go", "local") in first and ("Disk", "implements", "Saver", "app/m.go", "local") in first
    assert ("Disk", "embeds", "name:Base", "app/m.go", "unresolved") in first and ("View", "extends", "name:Base", "app/v.ts", "unresolved") in first
    a.write_text(a.read_text() + "\ntype Base struct {\n\tn int\n}\n")  # the call from a.go to b.go stays, the embedded type of m.go is new
    (root / "app" / "base.ts").write_text("export class Base {\n}\n")
    assert engine.sync().changed == 2
    assert [r.symbol for r in engine.impact(symbol="Open", direction="downstream").collect()] == ["helper"]
    again = edges(engine)
    assert ("Disk", "embeds", "Base", "app/m.go", "local") in again and ("View", "extends", "Base", "app/v.ts", "local") in again
    for n, change in enumerate((lambda: b.write_text("package pkg\n\nfunc other() error { return nil }\n"), a.unlink)):
        change()
        engine.sync()
        whole = Engine(spark, str(root), str(tmp_path / f"whole{n}"))
        whole.sync("full")
        assert edges(engine) == edges(whole)


def test_git_pending_embeddings_and_purge(spark, tmp_path):
    import os
    import subprocess

    from lodestone.sources.suite import Settings

    root, store, flag = tmp_path / "tree", tmp_path / "store", tmp_path / "works"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    def fails_at_first(texts):
        if not os.path.exists(flag):
            raise OSError("no server")
        return embedder(texts)

    run("init", "-q")
    (root / "a.md").write_text("# One\n\nThe heron waits.\n")
    (root / "b[1].md").write_text("# Two\n\nThe crane stands.\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    engine = Engine(spark, str(root), str(store), Settings(dim=8), fails_at_first)
    first = engine.sync()
    assert (first.mode, first.state, first.changed) == ("full", "degraded", 2)
    assert [sorted(r.pending) for r in engine.read("index_runs").collect()] == [["a.md", "b[1].md"]]
    flag.write_text("")
    again = engine.sync()
    assert (again.mode, again.state, again.changed) == ("delta", "ready", 2)
    assert engine.sync().changed == 0
    (root / "a.md").write_text("# One\n\nThe ibis waits.\n")
    run("commit", "-qam", "y")
    assert engine.sync().changed == 1
    found = engine.search_context("where does the ibis wait", expand=lambda q: ["ibis bird", "../x"])
    assert any("ibis" in e["quote"] for e in found["evidence"]) and found["state"] == "ready" and not found["warnings"]
    engine.purge()
    assert engine.manifest().count() == engine.read("doc_chunks").count() == 0
