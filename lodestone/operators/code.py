"""Facts of Go and JS/TS sources, and their resolution by joins.

Python finds declarations, imports, heritage and calls of one file at a time, in text whose comments and
literals are blanked; everything that needs other files (packages, module targets, who implements what,
who calls whom) is a join. There is no type checker, so edges carry a `fidelity`: "exact" for what syntax
settles, "name" for what was matched by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import base_name, canonical_path, dir_name, stable_id
from lodestone.session import cut_lineage

FACTS = "fact string, kind string, owner string, name string, target string, exported boolean, start_line bigint, end_line bigint"
SCRIPTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)
_GO_IMPORT = re.compile(r"^import\s+(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", re.M)
_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?\s*([\w.]+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", re.M)
_GO_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface|\S+)", re.M)
_JS_FUNC = re.compile(r"^[ \t]*(export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)|^[ \t]*(export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", re.M)
_JS_CLASS = re.compile(r"^[ \t]*(export\s+(?:default\s+)?)?(?:abstract\s+)?(class|interface)\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:<[^>{]*>)?(?:\s+implements\s+([\w.,\s]+))?", re.M)
_JS_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(\w+)\s*\([^)]*\)\s*(?::[^{;]+)?\{", re.M)
_JS_IMPORT = re.compile(r"(?:^|\n)\s*(?:import|export)\s[^;'\"\n]*?from\s*['\"]([^'\"]+)['\"]|\bimport\s*['\"]([^'\"]+)['\"]|\b(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)")
_JS_BINDING = re.compile(r"\bimport\s+(?:type\s+)?(?:(?P<default>\w+)\s*,?\s*)?(?:\{(?P<named>[^}]*)\}|\*\s*as\s+(?P<space>\w+))?\s*from\s*['\"](?P<spec>[^'\"]+)['\"]")
_JS_REQUIRED = re.compile(r"\b(?:const|let|var)\s+(?:(?P<space>\w+)|\{(?P<named>[^}]*)\})\s*=\s*require\(\s*['\"](?P<spec>[^'\"]+)['\"]\s*\)")
_JS_EXPORT = re.compile(r"\bexport\s+(?:type\s+)?(?:\{(?P<named>[^}]*)\}|\*(?:\s*as\s+(?P<space>\w+))?)(?:\s*from\s*['\"](?P<spec>[^'\"]+)['\"])?")
_JS_DEFAULT = re.compile(r"\bexport\s+default\s+(?:async\s+)?(?:(?:abstract\s+)?(?:function\s*\*?|class|interface)\s+)?(\w+)")
_JS_COMMON = re.compile(r"(?<![\w.])(?:module\.)?exports\.(?P<name>\w+)\s*=\s*(?P<local>\w+)\s*(?:;|\n|$)|(?<![\w.])module\.exports\s*=\s*\{(?P<named>[^}]*)\}")
_CALL = re.compile(r"(?<![\w.])((?:\w+\.)?\w+)\s*\(")
#: Fixed: words before a parenthesis that are no calls.
_NO_CALL = set("if for while switch catch func function return typeof await new range defer go select case else do with super import constructor".split())


def blanked(text: str) -> str:
    """The text with comments and literals as blanks; lines and offsets stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _block_end(text: str, start: int) -> int:
    """Offset behind the block that opens at or after `start`; the line's end if none opens on it."""
    opening, line_end = text.find("{", start), text.find("\n", start)
    if opening < 0 or 0 <= line_end < opening and text[start:line_end].rstrip().endswith((";", ")")):
        return len(text) if line_end < 0 else line_end
    depth = 0
    for m in re.finditer(r"[{}]", text[opening:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return opening + m.end()
    return len(text)


def _calls(plain: str, spans: list[tuple[int, int, str]], line: object) -> Iterator[tuple]:
    for begin, end, caller in spans:
        body = plain.find("{", begin, end)
        for m in _CALL.finditer(plain, body if body >= 0 else begin, end):
            if m[1] not in _NO_CALL and m[1].split(".")[0] not in _NO_CALL:
                yield ("call", "calls", caller, m[1].split(".")[-1], m[1], None, line(m.start()), line(m.start()))


def go_facts(text: str) -> Iterator[tuple]:
    plain = blanked(text)
    line = lambda at: plain.count("\n", 0, at) + 1
    if m := re.search(r"^package\s+(\w+)", plain, re.M):
        yield ("package", "package", "", m[1], "", None, line(m.start()), line(m.start()))
    for m in _GO_IMPORT.finditer(text):
        for spec in re.findall(r"\"([^\"]+)\"", m[0]):
            yield ("import", "imports", "", spec.rsplit("/", 1)[-1], spec, None, line(m.start()), line(m.end()))
    spans, inits = [], 0
    for m in _GO_FUNC.finditer(plain):
        end = _block_end(plain, m.end())
        owner = (m[1] or "").split(".")[-1]
        inits += m[2] == "init" and not owner
        ordinal = f"#{inits}" if m[2] == "init" and not owner else ""  # a file may have several
        spans.append((m.start(), end, f"{owner}.{m[2]}" if owner else m[2] + ordinal))
        yield ("decl", "method" if owner else "function", owner, m[2], ordinal, m[2][0].isupper(), line(m.start()), line(max(m.start(), end - 1)))
    for m in _GO_TYPE.finditer(plain):
        kind = "interface" if m[2].startswith("interface") else "type"
        end = _block_end(plain, m.end() - 1) if m[2].startswith(("struct", "interface")) else m.end()
        yield ("decl", kind, "", m[1], "", m[1][0].isupper(), line(m.start()), line(max(m.start(), end - 1)))
        body = plain[plain.find("{", m.start(), end) + 1 : max(m.start(), end - 1)] if m[2].startswith(("struct", "interface")) else ""
        for inner in re.split(r"[\n;]", body):
            if kind == "interface" and (x := re.match(r"\s*(\w+)\s*\(", inner)):
                yield ("member", "interface", m[1], x[1], "", None, line(m.start()), line(m.start()))
            elif x := re.match(r"\s*\*?((?:\w+\.)?\w+)\s*$", inner):
                yield ("heritage", "embeds", m[1], x[1].split(".")[-1], x[1], None, line(m.start()), line(m.start()))
    yield from _calls(plain, spans, line)


def _named(clause: str | None, mark: str) -> Iterator[tuple[str, str]]:
    """(first, second) name of each item "a", "a as b" or "a: b" of a clause in braces."""
    for item in (clause or "").split(","):
        names = re.split(mark, item.strip().removeprefix("type "))
        if re.fullmatch(r"\w+", names[0]) and re.fullmatch(r"\w+", names[-1]):
            yield names[0], names[-1]


def _module_facts(text: str, line: object) -> Iterator[tuple]:
    """Names that a script binds by imports (kind "named" or "namespace", owner the imported name) and gives out: kind "local" (owner its own name),
    "from" (owner the other module's name) or "star"."""
    for pattern in (_JS_BINDING, _JS_REQUIRED):
        for m in pattern.finditer(text):
            at, got = line(m.start()), m.groupdict()
            if got.get("default"):
                yield ("binding", "named", "default", got["default"], m["spec"], None, at, at)
            if got["space"]:
                yield ("binding", "namespace", "*", got["space"], m["spec"], None, at, at)
            for theirs, own in _named(got["named"], r"\s+as\s+|\s*:\s*"):
                yield ("binding", "named", theirs, own, m["spec"], None, at, at)
    for m in _JS_EXPORT.finditer(text):
        at, spec = line(m.start()), m["spec"] or ""
        if m["named"] is None and spec:
            yield ("export", "from" if m["space"] else "star", "*", m["space"] or "*", spec, None, at, at)
        for own, given in _named(m["named"], r"\s+as\s+"):
            yield ("export", "from" if spec else "local", own, given, spec, None, at, at)
    for m in _JS_DEFAULT.finditer(text):
        yield ("export", "local", m[1], "default", "", None, line(m.start()), line(m.start()))
    for m in _JS_COMMON.finditer(text):
        for given, own in [(m["name"], m["local"])] if m["name"] else _named(m["named"], r"\s*:\s*"):
            yield ("export", "local", own, given, "", None, line(m.start()), line(m.start()))


def script_facts(text: str) -> Iterator[tuple]:
    plain = blanked(text)
    line = lambda at: plain.count("\n", 0, at) + 1
    yield from _module_facts(re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S), line)
    for m in _JS_IMPORT.finditer(text):
        spec = m[1] or m[2] or m[3]
        yield ("import", "imports", "", spec.rsplit("/", 1)[-1], spec, None, line(m.start() + 1), line(m.end()))
    spans = []
    for m in _JS_FUNC.finditer(plain):
        name, end = m[2] or m[4], _block_end(plain, m.end())
        spans.append((m.start(), end, name))
        component = name[0].isupper() and re.search(r"<[A-Za-z/>]", plain[m.start() : end])
        yield ("decl", "component" if component else "function", "", name, "", bool(m[1] or m[3]), line(m.start()), line(max(m.start(), end - 1)))
    for m in _JS_CLASS.finditer(plain):
        end = _block_end(plain, m.end())
        kind = "component" if m[4] and m[4].split(".")[-1] == "Component" else m[2]
        yield ("decl", kind, "", m[3], "", bool(m[1]), line(m.start()), line(max(m.start(), end - 1)))
        for relation, names in (("extends", m[4]), ("implements", m[5])):
            for target in filter(None, re.split(r"[\s,]+", names or "")):
                yield ("heritage", relation, m[3], target.split(".")[-1], target, None, line(m.start()), line(m.start()))
        body = plain.find("{", m.start(), end)
        for x in _JS_METHOD.finditer(plain, body + 1, end) if body >= 0 else ():
            if x[1] not in _NO_CALL or x[1] == "constructor":
                stop = _block_end(plain, x.end() - 1)
                spans.append((x.start(), stop, f"{m[3]}.{x[1]}"))
                yield ("decl", "method", m[3], x[1], "", None, line(x.start() + 1), line(max(x.start(), stop - 1)))
    yield from _calls(plain, spans, line)


def source_facts(files: DataFrame) -> DataFrame:
    """project_id, path and FACTS of files (project_id, path, language, source); other languages and null sources have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, path, language, text in batch.itertuples(index=False, name=None):
                try:
                    out += [(project, path, *f) for f in (go_facts(text) if language == "go" else script_facts(text))]
                except Exception as e:  # noqa: BLE001  one file that can't be read mustn't end the run
                    out.append((project, path, "warning", "parse", "", type(e).__name__, str(e)[:500], None, 1, 1))
            columns = ["project_id", "path", *(c.split(" ")[0] for c in FACTS.split(", "))]
            yield pd.DataFrame(out, columns=columns)

    some = files.where(F.col("language").isin("go", "typescript", "javascript") & F.col("source").isNotNull() & F.col("path").isNotNull())
    return some.select("project_id", "path", "language", "source").mapInPandas(run, f"project_id string, path string, {FACTS}")


def declared_units(facts: DataFrame) -> DataFrame:
    """Units of all declarations with their stable ids: Go by package directory, scripts by path. Each `init` of a file has an id of its own, and
    `caller` is how calls from the unit name it."""
    go = F.col("path").endswith(".go")
    qualified = F.when(F.col("owner") != "", F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))
    unit_id = F.when(go & (F.col("target") != ""), stable_id("go:", F.col("path"), F.col("kind"), F.col("owner"), F.concat(qualified, "target"))).when(go, stable_id("go:", dir_name(F.col("path")), F.col("kind"), F.col("owner"), qualified)).otherwise(stable_id("js:", F.col("path"), F.col("kind"), F.col("owner"), F.col("name")))
    return facts.where("fact = 'decl'").select("project_id", unit_id.alias("id"), "name", qualified.alias("qualified_name"), F.concat(qualified, F.coalesce("target", F.lit(""))).alias("caller"), "kind", "owner", "path", "exported", "start_line", "end_line")


def holds_all(members: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """group and id of those in `members` (group, id, member) that have every member of `wanted` (group, member): relational division.

    A group that wants nothing is met by none; null members count on neither side.
    """
    need = wanted.where("member IS NOT NULL").distinct()
    count = need.groupBy(*group).agg(F.count("*").alias("_need"))
    held = members.join(need, [*group, "member"]).select(*group, "id", "member").distinct().groupBy(*group, "id").agg(F.count("*").alias("_held"))
    return held.join(count, group).where("_held = _need").select(*group, "id")


def implements(facts: DataFrame) -> DataFrame:
    """project_id, type, interface, fidelity: types whose methods, by name, include all of an interface's; Go only."""
    go = facts.where(F.col("path").endswith(".go"))
    wanted = go.where("fact = 'member'").select("project_id", F.concat_ws("#", dir_name(F.col("path")), "owner").alias("interface"), F.col("name").alias("member")).distinct()
    methods = go.where("fact = 'decl' AND kind = 'method'").select("project_id", F.concat_ws("#", dir_name(F.col("path")), "owner").alias("id"), F.col("name").alias("member")).distinct()
    need = wanted.groupBy("project_id", "interface").agg(F.count("*").alias("_need"))
    held = methods.join(wanted, ["project_id", "member"]).groupBy("project_id", "interface", "id").agg(F.count("*").alias("_held"))
    return held.join(need, ["project_id", "interface"]).where("_held = _need").select("project_id", F.col("id").alias("type"), "interface", F.lit("name").alias("fidelity"))


#: Settings of scripts are read from files of at most so many bytes.
SETTING_BYTES = 1024 * 1024


def _one_json(text: Column, schema: str) -> Column:
    """`text` as a JSON object, or null where it is too long or anything else."""
    return F.from_json(F.when(F.octet_length(text) <= SETTING_BYTES, text), schema, {"mode": "PERMISSIVE"})


def module_rules(settings: DataFrame) -> DataFrame:
    """project_id, pattern, head, tail, exact, base, targets: what the compiler's settings at a project's root say of specifiers.

    `settings` holds project_id, path, source. tsconfig.json comes before jsconfig.json. A base folder is a rule of the empty
    pattern, for what no other rule meets. Unreadable settings, patterns with two "*" and a base outside of the project give none.
    """
    read = settings.where("path IN ('tsconfig.json', 'jsconfig.json')").select(
        "project_id", F.col("path").alias("_file"), _one_json(F.col("source"), "compilerOptions struct<baseUrl string, paths map<string, array<string>>>")["compilerOptions"].alias("o")
    )
    first = read.groupBy("project_id").agg(F.max_by("o", "_file").alias("o")).select("project_id", F.coalesce("o.baseUrl", F.lit("")).alias("base"), "o.paths")
    first = first.where(~F.col("base").rlike(r"^/|(^|/)\.\.(/|$)"))
    listed = first.select("project_id", "base", F.explode("paths").alias("pattern", "targets")).where("pattern <> '' AND length(pattern) - length(replace(pattern, '*', '')) <= 1")
    based = first.where("base <> ''").select("project_id", "base", F.lit("").alias("pattern"), F.array(F.lit("*")).alias("targets"))
    head = F.substring_index("pattern", "*", 1)
    tail = F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise("")
    exact = (F.col("pattern") != "") & ~F.contains("pattern", F.lit("*"))
    return listed.unionByName(based).select("project_id", "pattern", head.alias("head"), tail.alias("tail"), exact.alias("exact"), "base", "targets")


def package_entries(settings: DataFrame) -> DataFrame:
    """project_id, folder, n, place: where the package.json of a folder says that the package begins, in the order in which to try.

    The order is exports, if that is a text (conditions aren't read), module, main, types. Targets outside of their package
    give none, nor do unreadable files.
    """
    folder = dir_name(F.col("path"))
    read = settings.where(base_name(F.col("path")) == "package.json").select(
        "project_id", folder.alias("folder"), _one_json(F.col("source"), "main string, module string, types string, exports string").alias("p")
    )
    given = F.array("p.exports", "p.module", "p.main", "p.types")
    each = read.select("project_id", "folder", F.posexplode(given).alias("n", "target")).where("target <> ''")
    each = each.where(~F.col("target").rlike(r"^[/{\[]|(^|[/\\])\.\.([/\\]|$)"))
    return each.select("project_id", "folder", "n", canonical_path(F.concat_ws("/", "folder", "target")).alias("place"))


def _rule_stems(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, path, specifier, c, stem: the places that the most specific rule for a specifier names, in its order.

    Rules are met by equality with the specifier's own beginnings, so that a project with many of both doesn't pair them all.
    """
    names = asked.select("project_id", "specifier").distinct()
    heads = names.select("project_id", "specifier", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda n: F.substring(F.col("specifier"), F.lit(1), n))).alias("head"))
    fits = F.when(F.col("exact"), F.col("head") == F.col("specifier")).otherwise(F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.length("head") + F.length("tail")))
    rank = F.struct(F.when(F.col("exact"), 0).when(F.col("pattern") != "", 1).otherwise(2), -F.length("head"), "pattern")
    best = heads.join(rules, ["project_id", "head"]).where(fits).groupBy("project_id", "specifier").agg(F.min_by(F.struct("head", "tail", "base", "targets"), rank).alias("r"))
    inner = F.substring(F.col("specifier"), F.length("r.head") + 1, F.length("specifier") - F.length("r.head") - F.length("r.tail"))
    stems = best.select("project_id", "specifier", inner.alias("inner"), "r.base", F.posexplode("r.targets").alias("c", "to"))
    stems = stems.select("project_id", "specifier", "c", F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), F.replace("to", F.lit("*"), F.col("inner"))).alias("stem"))
    return asked.join(stems, ["project_id", "specifier"]).where(~F.col("stem").rlike(r"^/|(^|/)node_modules(/|$)")).select("project_id", "path", "specifier", "c", canonical_path(F.col("stem")).alias("stem"))


def module_targets(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None, settings: DataFrame | None = None) -> DataFrame:
    """project_id, path, specifier, target, resolution of script imports: relative ones and those that a rule meets.

    Rules come from `settings` (project_id, path, source of tsconfig.json, jsconfig.json and package.json files) and `aliases`
    (pattern with one "*", replacement), which hold for all projects. Of the places a specifier may mean (as written, with each
    extension, as what the folder's package.json names, as a directory's index) the first that exists holds. What isn't
    found is external if it names a package, else unresolved. The most specific rule alone is tried.
    """
    relative = F.col("specifier").startswith("./") | F.col("specifier").startswith("../") | F.col("specifier").isin(".", "..")
    asked = imports.select("project_id", "path", F.col("target").alias("specifier")).distinct()
    stems = asked.where(relative).select("project_id", "path", "specifier", F.lit(0).alias("c"), canonical_path(F.concat_ws("/", dir_name(F.col("path")), "specifier")).alias("stem"))
    outer = asked.where(~relative & ~F.col("specifier").startswith("/"))
    parts = [(a, a.split("*")[0], a.partition("*")[2], "*" not in a, "", [r]) for a, r in aliases or []]
    if parts:
        names = ["pattern", "head", "tail", "exact", "base"]
        given = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p)], F.array(*map(F.lit, p[5])).alias("targets")) for p in parts])
        stems = stems.unionByName(_rule_stems(outer, outer.select("project_id").distinct().select("project_id", F.inline(given))))
    if settings is not None:
        stems = stems.unionByName(_rule_stems(outer, module_rules(settings)))

    def ways(stem: Column) -> list[Column]:
        written = F.regexp_replace(stem, r"\.(js|jsx|mjs|cjs)$", "")
        return [stem, *[F.concat(stem, F.lit(e)) for e in [".d.ts", *SCRIPTS]], *[F.concat(written, F.lit(e)) for e in SCRIPTS]]

    def index(stem: Column) -> list[Column]:
        return [F.concat_ws("/", F.when(stem != "", stem), F.lit(f"index{e}")) for e in SCRIPTS]

    key = ["project_id", "path", "specifier"]
    places = stems.select(*key, F.posexplode(F.array(*ways(F.col("stem")))).alias("w", "place"), "c", F.lit(0).alias("step"), F.lit(0).alias("n"))
    places = places.unionByName(stems.select(*key, F.posexplode(F.array(*index(F.col("stem")))).alias("w", "place"), "c", F.lit(2).alias("step"), F.lit(0).alias("n")))
    if settings is not None:
        named = stems.join(package_entries(settings).withColumnRenamed("folder", "stem"), ["project_id", "stem"])
        places = places.unionByName(named.select(*key, F.posexplode(F.array(*ways(F.col("place")), *index(F.col("place")))).alias("w", "to"), "c", F.lit(1).alias("step"), "n").withColumnRenamed("to", "place"))
    there = files.select("project_id", F.col("path").alias("place")).distinct()
    first = places.join(there, ["project_id", "place"]).groupBy(*key).agg(F.min_by("place", F.struct("c", "step", "n", "w")).alias("target"))
    found = asked.join(first, key, "left")
    outside = ~(relative | F.col("specifier").startswith("/"))
    return found.withColumn("resolution", F.when(F.col("target").isNotNull(), "local").when(outside, "external").otherwise("unresolved"))


def package_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, path, specifier, target (directory), resolution of Go imports: the longest directory of Go files that ends the import path."""
    folders = files.where(F.col("path").endswith(".go")).select("project_id", dir_name(F.col("path")).alias("folder")).distinct()
    asked = imports.select("project_id", "path", F.col("target").alias("specifier")).distinct()
    parts = F.split("specifier", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    places = asked.select("project_id", "path", "specifier", F.posexplode(suffixes).alias("priority", "folder"))
    first = places.join(folders, ["project_id", "folder"]).groupBy("project_id", "path", "specifier").agg(F.min(F.struct("priority", "folder")).alias("s"))
    found = asked.join(first.select("project_id", "path", "specifier", F.col("s.folder").alias("target")), ["project_id", "path", "specifier"], "left")
    return found.withColumn("resolution", F.when(F.col("target").isNotNull(), "local").otherwise("external"))


def exported_units(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """project_id, path, name, id: what each name that a script module gives out means, through re-exports and cycles of them.

    Explicit exports come before those of a star; a name that several modules give through stars, or that means several
    units, means nothing. `modules` is what `module_targets` gives.
    """
    key = ["project_id", "path", "name"]
    scripts = facts.where(~F.col("path").endswith(".go"))
    own = declared_units(scripts).where("owner = ''").select("project_id", "path", F.col("name").alias("local"), "id", "exported").distinct()
    there = modules.where("target IS NOT NULL").select("project_id", "path", F.col("specifier").alias("spec"), F.col("target").alias("to_path"))
    given = scripts.where("fact = 'export'").select("project_id", "path", "kind", F.col("owner").alias("local"), "name", F.col("target").alias("spec")).distinct()
    bound = scripts.where("fact = 'binding' AND kind = 'named'").select("project_id", "path", F.col("name").alias("local"), F.col("owner").alias("to_name"), F.col("target").alias("spec")).distinct()
    listed = given.where("kind = 'local'").select("project_id", "path", "local", "name")
    direct = own.where("exported").select("project_id", "path", F.col("local").alias("name"), "id").unionByName(listed.join(own, ["project_id", "path", "local"]).select(*key, "id"))
    onward = given.where("kind = 'from'").select(*key, "spec", F.col("local").alias("to_name")).unionByName(listed.join(bound, ["project_id", "path", "local"]).select(*key, "spec", "to_name"))
    onward = cut_lineage(onward.join(there, ["project_id", "path", "spec"]).select(*key, "to_path", "to_name").distinct())
    stars = cut_lineage(given.where("kind = 'star'").join(there, ["project_id", "path", "spec"]).select("project_id", "path", "to_path").distinct())
    known = cut_lineage(direct.distinct())
    explicit = known.select(*key).unionByName(given.where("kind <> 'star'").select(*key)).distinct()
    front = known if not (onward.isEmpty() and stars.isEmpty()) else known.limit(0)
    while not front.isEmpty():
        reached = front.select("project_id", F.col("path").alias("to_path"), F.col("name").alias("to_name"), "id")
        through = onward.join(reached, ["project_id", "to_path", "to_name"]).select(*key, "id")
        by_star = stars.join(reached.where("to_name <> 'default'"), ["project_id", "to_path"]).select("project_id", "path", F.col("to_name").alias("name"), "id").join(explicit, key, "left_anti")
        front = cut_lineage(through.unionByName(by_star).distinct().join(known, [*key, "id"], "left_anti"))
        known = known.unionByName(front)
    return known.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select(*key, "id")


def imported_calls(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """project_id, path, whole, id: what calls of script files mean through the file's imports, `whole` being the name or "namespace.name" as written."""
    there = modules.where("target IS NOT NULL").select("project_id", "path", F.col("specifier").alias("spec"), F.col("target").alias("to_path"))
    bound = facts.where("fact = 'binding'").select("project_id", "path", "kind", F.col("owner").alias("to_name"), F.col("name").alias("local"), F.col("target").alias("spec")).distinct().join(there, ["project_id", "path", "spec"])
    calls = facts.where("fact = 'call'").where(~F.col("path").endswith(".go")).select("project_id", "path", F.col("target").alias("whole"), F.substring_index("target", ".", 1).alias("local"), F.col("name").alias("last")).distinct()
    met = calls.join(bound, ["project_id", "path", "local"]).where((F.col("kind") == "namespace") == F.contains("whole", F.lit(".")))
    met = met.select("project_id", "path", "whole", "to_path", F.when(F.col("kind") == "namespace", F.col("last")).otherwise(F.col("to_name")).alias("to_name"))
    means = exported_units(facts, modules).select("project_id", F.col("path").alias("to_path"), F.col("name").alias("to_name"), "id")
    found = met.join(means, ["project_id", "to_path", "to_name"]).groupBy("project_id", "path", "whole").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return found.where("n = 1").select("project_id", "path", "whole", "id")


def call_edges(facts: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """project_id, path, caller, callee, target, resolution, fidelity of calls: in the same file first, then, for Go, in the same package, for
    scripts by what they import if `modules` (of `module_targets`) is given.

    A name that several declarations have within that reach stays unresolved.
    """
    area = F.when(F.col("path").endswith(".go"), dir_name(F.col("path"))).otherwise(F.col("path"))
    units = declared_units(facts).withColumn("area", area)
    calls = facts.where("fact = 'call'").select("project_id", "path", F.col("owner").alias("caller"), F.col("name").alias("callee"), F.col("target").alias("whole"), "start_line").withColumn("area", area).distinct()
    near = units.groupBy("project_id", "area", F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("target"))
    joined = calls.join(near, ["project_id", "area", "callee"], "left").withColumn("target", F.when(F.col("n") == 1, F.col("target")))
    if modules is not None:
        joined = joined.join(imported_calls(facts, modules), ["project_id", "path", "whole"], "left").withColumn("target", F.coalesce("target", "id"))
    found = F.when(F.col("target").isNotNull(), "local").otherwise("unresolved").alias("resolution")
    return joined.select("project_id", "path", "caller", "callee", "start_line", "target", found, F.lit("name").alias("fidelity")).distinct()


def heritage_edges(facts: DataFrame, imported: DataFrame) -> DataFrame:
    """project_id, path, source_id, relation, name, target, resolution, start_line, end_line of embeds, extends and implements clauses.

    A name without qualifier is looked for where calls are, then, as all others, in what the file imports (project_id, path,
    specifier, target): for Go in the package whose path ends in the qualifier. The nearest place that has exactly one type of the name holds.
    """
    area = F.when(F.col("path").endswith(".go"), dir_name(F.col("path"))).otherwise(F.col("path"))
    types = declared_units(facts).where("kind IN ('type', 'interface', 'class', 'component')").withColumn("area", area)
    key = ["project_id", "path", "owner", "relation", "name", "qualifier", "start_line", "end_line"]
    asked = facts.where("fact = 'heritage'").withColumn("qualifier", F.when(F.contains("target", F.lit(".")), F.substring_index("target", ".", 1)).otherwise("")).withColumnRenamed("kind", "relation").select(*key).distinct()
    outside = imported.where("target IS NOT NULL").select("project_id", "path", F.element_at(F.split("specifier", "/"), -1).alias("last"), F.col("target").alias("area")).distinct()
    told = ~F.col("path").endswith(".go") | (F.col("qualifier") == F.col("last"))
    places = asked.where("qualifier = ''").select(*key, area.alias("area"), F.lit(0).alias("far")).unionByName(asked.join(outside, ["project_id", "path"]).where(told).select(*key, "area", F.lit(1).alias("far")))
    held = types.select("project_id", "area", "name", F.col("id").alias("target")).distinct()
    near = places.join(held, ["project_id", "area", "name"]).groupBy(*key, "far").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1")
    first = near.groupBy(*key).agg(F.min(F.struct("far", "target")).alias("s")).select(*key, F.col("s.target").alias("target"))
    sources = types.select("project_id", "path", F.col("name").alias("owner"), F.col("id").alias("source_id")).distinct()
    found = asked.join(first, key, "left").join(sources, ["project_id", "path", "owner"])
    return found.select("project_id", "path", "source_id", "relation", "name", "target", F.when(F.col("target").isNotNull(), "local").otherwise("unresolved").alias("resolution"), "start_line", "end_line")


def package_id(package: Column) -> Column:
    return stable_id("go:", package, F.lit("package"), F.lit(""), package)


def package_units(facts: DataFrame) -> DataFrame:
    """project_id, package (directory), name, path: the package unit of each Go directory, on its smallest path."""
    packages = facts.where("fact = 'package'")
    return packages.groupBy("project_id", dir_name(F.col("path")).alias("package")).agg(F.min(F.struct("path", "name")).alias("s")).select("project_id", "package", "s.name", "s.path")


def overloads(facts: DataFrame) -> DataFrame:
    """Declarations with `ordinal` from 1 among those of one path, kind, owner and name, in order of lines."""
    same = Window.partitionBy("project_id", "path", "kind", "owner", "name").orderBy("start_line", "end_line")
    return declared_units(facts).withColumn("ordinal", F.row_number().over(same)).withColumn("file", base_name(F.col("path")))
