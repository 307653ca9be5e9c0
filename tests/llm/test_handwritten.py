import random

from lodestone.llm import handwritten

SCHEMA = "project_id string, path string, language string, kind string, source string, reason string"
VERBS, NOUNS = "open load store merge split route".split(), "ledger parcel session badge cursor quota".split()


def plain(seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(VERBS) + rng.choice(NOUNS).title() + rng.choice(["", "Count", "Item"])
    return "\n".join(f"export function {name()}({name()}, {name()}) {{\n  const {name()} = await {name()}({name()});\n  return {name()};\n}}" for _ in range(6))


def minified(seed):
    rng = random.Random(seed)
    v = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    return ";".join(f"function {v()}({v()},{v()}){{return {v()}>{v()}?{v()}({rng.randrange(99)}):{v()}}}" for _ in range(30))


def test_each_kind(spark):
    third = plain(900)
    rows = [("p", f"src/f{i}.ts", "typescript", "file", plain(i), "x") for i in range(60)]
    cases = [
        ("src/min.ts", minified(1), "minified"), ("src/a.min.js", "x", "minified"), ("src/blob.ts", 'const data = "' + "Ab9/" * 300 + '";', "data"), ("src/nums.ts", "const x = [\n" + "  [1.25, -3.5],\n" * 60 + "]", "data"),
        ("src/g.ts", "/* @generated by tool */\n" + plain(700), "generated"), ("src/h.pb.go", plain(701), "generated"), ("src/de.ts", "// Dieser Code wurde von tool erzeugt und wird überschrieben.\n" + plain(702), "generated"),
        ("node_modules/lib/i.js", plain(703), "vendored"), ("lib/own.ts", "// Copied from lib 4.9.4 (upstream), do not patch here.\n" + third, "vendored"), ("src/util/copy.ts", "\n" + third.replace("  ", "\t") + "\n", "copy"), ("vendor/x.org/a.go", None, "vendored"),
    ]
    clean = [
        ("internal/vendor/a.ts", plain(800)), ("src/dist/b.ts", plain(801)), ("src/banner.ts", 'const banner = "// Code generated by tool. DO NOT EDIT.";\n' + plain(802)), ("src/kept.ts", "// The tables below were once generated, they are kept by hand now.\n" + plain(803)),
        ("src/vendor_min.ts", "// see the vendor roster\n" + plain(804)), ("src/steps.ts", "const steps = [" + "3, 59, " * 120 + "1];\n" + plain(805)), ("src/empty.ts", ""), ("src/null.ts", None),
    ]
    rows += [("p", p, "typescript", "file", s, "x") for p, s, _ in cases] + [("p", p, "typescript", "file", s, "x") for p, s in clean] + [("q", "a/twin.ts", "typescript", "file", plain(0), "x"), ("p", None, "typescript", "file", "x", "x"), (None, "src/m.ts", None, "file", minified(2), "x")]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = {(r.project_id, r.path): r.reason for r in handwritten.judge(df).collect()}
    assert {p: got.get(("p", p)) for p, *_ in cases} == {p: r for p, _, r in cases}
    assert set(got) - {("p", p) for p, *_ in cases} <= {(None, "src/m.ts")}
    assert handwritten.not_handwritten(df).count() == len(got)
    kept = handwritten.handwritten_units(df)
    assert kept.columns == df.columns and kept.where("path = 'src/min.ts'").count() == 0 and kept.where("path = 'src/kept.ts'").count() == 1


def test_no_rows(spark):
    assert handwritten.not_handwritten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marks_below_a_long_licence_and_languages_without_a_model():
    from lodestone.llm import handwritten as h

    for licence in ("// Licence text.\n" * 25, "/*\n" + " Licence text.\n" * 25 + "*/\n", "// " + "Licence text. " * 40 + "\n"):
        assert h.judge_head(licence + "\n// Code generated by stringer. DO NOT EDIT.\npackage a\n") == "generated"
    assert h.judge_head("package a\n" * 25 + "// Code generated by stringer. DO NOT EDIT.\n") is None
    names = "first_cat second_dog third_bird fourth_fish blue_sky green_leaf red_rose old_house new_road deep_lake tall_tree cold_wind warm_fire wide_field long_river soft_sand hard_rock dark_cave late_night early_dawn".split()
    assert h.judge_names("\n".join(names), "cobol", h.Models([])) is None
    assert h.judge_names(plain(1), "ada", h.Models([("go", "gram", 5, 9)])) is None


def test_the_models_decide_where_paths_and_headers_say_nothing(spark):
    rng = random.Random(4)
    made = "\n".join(f"  get{a}{b}Value() {{ return this.field{a}{b}; }}" for a in ("Left", "Right") for b in range(20))
    foreign = "\n".join(f"  let {rng.choice(VERBS)}_{rng.choice(NOUNS)}_{rng.choice(NOUNS)} = {rng.choice(NOUNS)}_{rng.choice(VERBS)};" for _ in range(60))
    rows = [("p", f"src/f{i}.ts", "typescript", "file", plain(i) + plain(i + 500), "x") for i in range(80)]
    rows += [("p", f"src/g{i}.py", "python", "file", plain(i).replace("function", "def"), "x") for i in range(40)]
    rows += [("p", "src/one.ts", "typescript", "file", made, "x"), ("p", "src/two.ts", "typescript", "file", foreign, "x"), ("p", "src/three.ts", "typescript", "file", minified(5), "x")]
    found = {r.path: r.reason for r in handwritten.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"src/one.ts": "generated", "src/two.ts": "vendored", "src/three.ts": "minified"}


def test_languages_beyond_the_first_share_a_model(spark, monkeypatch):
    monkeypatch.setattr(handwritten, "OWN_MODELS", 1)
    rows = [("p", f"src/f{i}.ts", "typescript", "file", plain(i) + plain(i + 500), "x") for i in range(60)] + [("p", f"lib/f{i}.x", f"l{i % 3}", "file", plain(i), "x") for i in range(30)]
    rows += [("p", "lib/odd.x", "l1", "file", minified(5), "x"), ("p", "lib/part.x", "l1", "function", minified(6), "x"), ("p", "src/f1.ts", "typescript", "function", minified(7), "x")]
    assert {r.path: r.reason for r in handwritten.judge(spark.createDataFrame(rows, SCHEMA)).collect()} == {"lib/odd.x": "minified", "lib/part.x": "minified"}
