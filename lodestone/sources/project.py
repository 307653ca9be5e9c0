"""Listing of a source tree: which files are taken, and why others aren't, as column expressions over a file scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import base_name

MAX_BYTES = 2 * 1024 * 1024
HEAD_BYTES = 8192

#: Kind and language by extension.
EXTENSIONS = {
    ".adoc": ("document", "asciidoc"), ".bash": ("code", "bash"), ".c": ("code", "c"), ".cc": ("code", "cpp"), ".cjs": ("code", "javascript"),
    ".cpp": ("code", "cpp"), ".cs": ("code", "csharp"), ".css": ("code", "css"), ".go": ("code", "go"), ".h": ("code", "c"), ".hpp": ("code", "cpp"),
    ".html": ("code", "html"), ".java": ("code", "java"), ".js": ("code", "javascript"), ".json": ("document", "json"), ".jsx": ("code", "javascript"),
    ".kt": ("code", "kotlin"), ".kts": ("code", "kotlin"), ".lua": ("code", "lua"), ".m": ("code", "objective-c"), ".md": ("document", "markdown"),
    ".mdx": ("document", "markdown"), ".mjs": ("code", "javascript"), ".mm": ("code", "objective-cpp"), ".php": ("code", "php"), ".py": ("code", "python"),
    ".rb": ("code", "ruby"), ".rs": ("code", "rust"), ".rst": ("document", "rst"), ".scala": ("code", "scala"), ".sh": ("code", "shell"), ".sql": ("code", "sql"),
    ".swift": ("code", "swift"), ".toml": ("document", "toml"), ".ts": ("code", "typescript"), ".tsx": ("code", "typescript"), ".txt": ("document", "text"),
    ".xml": ("document", "xml"), ".yaml": ("document", "yaml"), ".yml": ("document", "yaml"), ".zsh": ("code", "shell"),
}
#: Files that settle how others are resolved, and names that are never read.
RESOLUTION = {"go": ["go.mod", "go.sum", "go.work"], "typescript": ["jsconfig.json", "package.json", "tsconfig.json"]}
SKIPPED_DIRS = ".cache .git .hg .idea .mypy_cache .next .nuxt .parcel-cache .pytest_cache .ruff_cache .svn .turbo .vscode __pycache__ build coverage dist node_modules out target vendor".split()
SKIPPED_FILES = r"\.min\.[mc]?js$|\.map$"
SECRET_FILES = r"^\.env(\..*)?$|^id_(rsa|ed25519)$|^credentials(\..*)?$|\.(pem|key|p12)$"
TEST_FILES = r"_test\.go$|\.(test|spec)\.[jt]sx?$|^test_"
GENERATED_GO = r"(?m)^// Code generated .* DO NOT EDIT\.$"


def file_kind(path: Column) -> Column:
    """struct(kind, language, extension); kind is null for extensions that aren't supported."""
    base, suffix = base_name(path), F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))
    known = F.create_map(*[F.lit(x) for e, (k, lang) in EXTENSIONS.items() for x in (e, f"{k} {lang}")])
    pair = F.coalesce(*[F.when(base.isin(names), F.lit(f"resolution {lang}")) for lang, names in RESOLUTION.items()], F.try_element_at(known, suffix))
    return F.struct(F.split(pair, " ")[0].alias("kind"), F.split(pair, " ")[1].alias("language"), suffix.alias("extension"))


def refusal(path: Column, dirs: tuple[str, ...] = (), names: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), include_tests: bool = False) -> Column:
    """The first reason a path isn't taken, or null: fixed names, directories, configured names and paths, tests, extension."""
    base, parents = base_name(path), F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    below = F.lit(False)
    for p in prefixes:
        below = below | (path == p) | path.startswith(f"{p}/")
    return (
        F.when(path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "path escapes the project")
        .when(base.isin(SKIPPED_DIRS) | base.rlike(SKIPPED_FILES) | base.rlike(SECRET_FILES), "excluded path or secret name")
        .when(F.exists(parents, lambda p: p.isin([*SKIPPED_DIRS, *dirs])), "excluded directory")
        .when(base.isin(list(names)) if names else F.lit(False), "excluded file name")
        .when(below, "excluded configured path")
        .when(F.lit(not include_tests) & base.rlike(TEST_FILES), "test file")
        .when(file_kind(path)["kind"].isNull(), "unsupported extension")
    )


#: Files that are read by their names; more are read by a scan of the whole tree.
NAMED_FILES = 2000


def scan(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """path (relative to the root), size, mtime_ns, content of all files under the root, or of those named. Contents are read only if they are used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if names is not None and not names:
        return spark.createDataFrame([], "path string, size bigint, mtime_ns bigint, content binary")
    base = root.rstrip("/")
    files = reader.load(root if names is None else [re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{base}/{n}") for n in names])
    path = F.regexp_replace("path", f"^file:/*{re.escape(base.lstrip('/'))}/", "")
    return files.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """`scan` of the files in `paths` (path): few are read by name, many by a scan."""
    some = [r["path"] for r in paths.select("path").distinct().limit(NAMED_FILES + 1).collect()]
    if len(some) <= NAMED_FILES:
        return scan(spark, root, some)
    return scan(spark, root).join(paths.select("path").distinct(), "path", "left_semi")


def discover(files: DataFrame, max_bytes: int = MAX_BYTES, **policy: object) -> DataFrame:
    """path, size, mtime_ns, content, kind, language, extension, file_hash, reason; reason is null for files that are taken.

    Names are judged before sizes, and sizes before contents. A hash is made of taken files only.
    """
    head = F.substring(F.col("content"), 1, HEAD_BYTES)
    reason = (
        F.when(refusal(F.col("path"), **policy).isNotNull(), refusal(F.col("path"), **policy))
        .when(F.col("size") > max_bytes, "file exceeds size limit")
        .when(F.contains(head, F.lit(b"\x00")), "contains NUL byte")
        .when(F.lower("path").endswith(".go") & F.decode(head, "UTF-8").rlike(GENERATED_GO), "generated Go source")
    )
    judged = files.withColumn("reason", reason)
    return judged.select("path", "size", "mtime_ns", "content", file_kind(F.col("path")).alias("k"), F.when(F.col("reason").isNull(), F.sha2("content", 256)).alias("file_hash"), "reason").select(
        "path", "size", "mtime_ns", "content", "k.kind", "k.language", "k.extension", "file_hash", "reason"
    )


def plan_changes(found: DataFrame, manifest: DataFrame, parser_version: str, dirty: DataFrame | None = None, full: bool = False) -> DataFrame:
    """path, action ("changed" or "deleted") from taken files and the manifest (path, file_hash, parser_version).

    A file is changed if it is new, its hash or its parser version differs, or all are wanted; other metadata don't matter.
    """
    old = manifest.select("path", F.col("file_hash").alias("_hash"), F.col("parser_version").alias("_parser"), F.lit(True).alias("_old"))
    new = found.where("reason IS NULL").select("path", "file_hash", F.lit(True).alias("_new"))
    both = new.join(old, "path", "full_outer")
    differs = F.col("_old").isNull() | ~F.col("file_hash").eqNullSafe(F.col("_hash")) | ~F.col("_parser").eqNullSafe(F.lit(parser_version)) | F.lit(full)
    action = F.when(F.col("_new").isNull(), "deleted").when(differs, "changed")
    planned = both.select("path", action.alias("action")).where("action IS NOT NULL")
    return planned if dirty is None else planned.unionByName(new.join(dirty.select("path"), "path", "left_semi").select("path", F.lit("changed").alias("action"))).distinct()
