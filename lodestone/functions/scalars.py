"""Scalar expressions. All stay inside the JVM; Java's regular expressions get explicit classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(path: Column) -> Column:
    """Project-relative path with forward slashes and without empty, "." and resolvable ".." segments.

    Null stays null; a path of nothing but such segments becomes the empty string.
    """
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ),
    )
    return F.array_join(F.when(F.array_contains(parts, ".."), up).otherwise(parts), "/")


def canonical_hash(value: Column) -> Column:
    """SHA-256 as 64 lower-case hex digits: spelling with blanks, capitals or an algorithm prefix is undone; anything else gives null."""
    digits = F.regexp_replace(F.lower(F.trim(value)), r"^sha-?256[:=]\s*", "")
    return F.when(digits.rlike(r"^[0-9a-f]{64}$"), digits)


def normalized_text(text: Column) -> Column:
    """Unicode white space collapsed to single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """Directory of a path; "." at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Suffix from the last dot of the base name, with ".d.ts" kept whole."""
    return F.when(path.endswith(".d.ts"), F.lit(".d.ts")).otherwise(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def token_estimate(text: Column) -> Column:
    """(code points + 3) div 4."""
    return F.floor((F.char_length(text) + 3) / 4).cast("bigint")


def stable_id(prefix: str, *parts: Column) -> Column:
    """`prefix:` and the SHA-256 of the parts joined by NUL; a null part counts as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(joined, 256))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query, in the tokenizer of `text_tokens`."""
    import re

    return sorted(set(re.findall(r"[a-z0-9]+|[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]", (text or "").lower())))


def text_tokens(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, and each CJK code point alone."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af])"), 1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, empty, of another length or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.lit(1.0) - dot(a, b) / norm)


def is_uuid4(value: Column) -> Column:
    return F.lower(value).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_object_id(value: Column) -> Column:
    return value.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")


def clamp_tokens(value: Column, default: int = 3500, low: int = 256, high: int = 12000) -> Column:
    """Budget in tokens: 0 or null means the default, everything else is clamped."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))
