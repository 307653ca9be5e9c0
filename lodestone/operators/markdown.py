"""Markdown documents to heading-aware chunks.

Python handles one document at a time (lines, fences, headings, pieces); identity, hashes, search text
and everything across documents are DataFrame expressions. Offsets are code points throughout: tags and
links are attributed to the piece that holds them whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import token_estimate

#: Sections up to so many tokens stay whole, others are cut into pieces of at most PIECE_TOKENS.
SECTION_TOKENS, PIECE_TOKENS = 1200, 900

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*))?$", re.S)
_ATX_TAIL = re.compile(r"[ \t]+#+[ \t]*$")
_SETEXT = re.compile(r"[ \t]*(=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})(.*)$", re.S)
_TAG = re.compile(r"(?<![A-Za-z0-9_/-])#([A-Za-z0-9_][A-Za-z0-9_/-]*)")
_LINK = re.compile(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]")


def split_lines(text: str) -> list[str]:
    """Lines with their "\\n"; no empty last line."""
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def flush_left(line: str) -> str | None:
    """The line without its end and indent; None if it is indented by a tab or more than three blanks."""
    bare = line.removesuffix("\n").removesuffix("\r")
    rest = bare.lstrip(" ")
    return None if len(bare) - len(rest) > 3 or rest.startswith("\t") else rest


def fence_of(line: str) -> tuple[str, int, bool] | None:
    """Mark, length and whether nothing follows, of a line that may open or close a fence."""
    rest = flush_left(line)
    if rest is None or rest[:1] not in "`~" or not (m := _FENCE.match(rest)):
        return None
    return m[1][0], len(m[1]), not m[2].strip()


def fence_states(lines: list[str]) -> list[str]:
    """Of each line: "text" outside fences, "open", "body" or "close". An unclosed fence runs to the end."""
    states, within = [], None
    for line in lines:
        found = fence_of(line)
        if within is None:
            states.append("open" if found else "text")
            within = found
        elif found and found[0] == within[0] and found[1] >= within[1] and found[2]:
            states.append("close")
            within = None
        else:
            states.append("body")
    return states


def atx_heading(line: str) -> tuple[int, str] | None:
    """Level and text of an ATX heading; closing marks need a blank before them."""
    rest = flush_left(line)
    m = _ATX.match(rest) if rest else None
    if not m:
        return None
    text = (m[2] or "").strip()
    return len(m[1]), _ATX_TAIL.sub("", text).strip()


@dataclass
class Section:
    heading: str
    first: int  # number of its first line, from 0
    lines: list[str]
    states: list[str]


def _frontmatter(lines: list[str]) -> tuple[int, list[str], list[str]]:
    """Lines it takes, tags and aliases; YAML that can't be read raises ValueError."""
    plain = [x.removesuffix("\n").removesuffix("\r") for x in lines]
    if not plain or plain[0] != "---" or "---" not in plain[1:]:
        return 0, [], []
    import yaml

    end = plain.index("---", 1)
    try:
        values = yaml.safe_load("".join(lines[1:end])) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"frontmatter: {e}") from e
    if not isinstance(values, dict):
        raise ValueError("frontmatter: no mapping")

    def strings(x: object) -> list[str]:
        return [x] if isinstance(x, str) else [y for y in x if isinstance(y, str)] if isinstance(x, list) else []

    return end + 1, _tags(strings(values.get("tags"))), _first_seen(strings(values.get("aliases")))


def _first_seen(values: list[str]) -> list[str]:
    return [v for v in dict.fromkeys(x.strip() for x in values) if v]


def _tags(values: list[str]) -> list[str]:
    return _first_seen([x.removeprefix("#").strip().lower() for x in values])


def sections(lines: list[str], first: int = 0) -> Iterator[Section]:
    """The text between headings; heading lines belong to none."""
    states = fence_states(lines[first:])
    path: dict[int, str] = {}
    name, begin, i = "", first, first
    while i < len(lines):
        taken = 0
        if states[i - first] == "text":
            if found := atx_heading(lines[i]):
                taken, (level, title) = 1, found
            elif i + 1 < len(lines) and (flush_left(lines[i]) or "").strip() and states[i + 1 - first] == "text" and (below := flush_left(lines[i + 1])) is not None and (m := _SETEXT.match(below)):
                taken, level, title = 2, 1 if m[1][0] == "=" else 2, lines[i].strip()
        if taken:
            if begin < i:
                yield Section(name, begin, lines[begin:i], states[begin - first : i - first])
            path = {k: v for k, v in path.items() if k < level} | {level: title}
            name = " > ".join(v for _, v in sorted(path.items()) if v)
            i += taken
            begin = i
        else:
            i += 1
    if begin < len(lines):
        yield Section(name, begin, lines[begin:], states[begin - first :])


def _tokens(n: int) -> int:
    return (n + 3) // 4


def pieces(lines: list[str]) -> list[tuple[int, int]]:
    """Code point ranges of a section's pieces: whole, or runs of paragraphs that overlap by one, or windows of a huge one."""
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line))
    if _tokens(ends[-1]) <= SECTION_TOKENS:
        return [(0, ends[-1])]
    paragraphs, start = [], None
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            start = i if start is None else start
        elif start is not None:
            paragraphs.append((ends[start], ends[i]))
            start = None
    out, at, window = [], 0, PIECE_TOKENS * 4
    while at < len(paragraphs):
        begin, end = paragraphs[at]
        if _tokens(end - begin) > PIECE_TOKENS:
            out += [(x, min(x + window, end)) for x in range(begin, end, window)]
            at += 1
            continue
        last = at
        while last + 1 < len(paragraphs) and _tokens(paragraphs[last + 1][1] - begin) <= PIECE_TOKENS:
            last += 1
        out.append((begin, paragraphs[last][1]))
        if last == len(paragraphs) - 1:
            break
        at = last if last > at else at + 1
    return out


def _marks(section: Section) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    tags, links, at = [], [], 0
    for line, state in zip(section.lines, section.states):
        if state == "text":
            tags += [(at + m.start(), at + m.end(), m[1]) for m in _TAG.finditer(line)]
            links += [(at + m.start(), at + m.end(), m[1].strip()) for m in _LINK.finditer(line)]
        at += len(line)
    return tags, links


def document_chunks(text: str) -> Iterator[dict]:
    """Chunks of one document; ValueError if its frontmatter can't be read."""
    lines = split_lines(text)
    first, tags, aliases = _frontmatter(lines)
    for section in sections(lines, first):
        source = "".join(section.lines)
        in_tags, in_links = _marks(section)
        for begin, end in pieces(section.lines):
            content = source[begin:end]
            if not content.strip():
                continue
            yield {
                "heading": section.heading,
                "start_line": section.first + 1 + source.count("\n", 0, begin),
                "end_line": section.first + 1 + source.count("\n", 0, end - 1),
                "content": content,
                "tags": _tags([*tags, *(v for a, b, v in in_tags if begin <= a and b <= end)]),
                "links": _first_seen([v for a, b, v in in_links if begin <= a and b <= end]),
                "aliases": aliases,
            }


_SCHEMA = "heading string, start_line bigint, end_line bigint, content string, tags array<string>, links array<string>, aliases array<string>, error string"


def parse_markdown(documents: DataFrame, path: str = "path", text: str = "content", key: list[str] | None = None) -> DataFrame:
    """Chunks of Markdown documents: key columns, path, id, heading, start_line, end_line, content, tags, links, search_text, chunk_hash, error.

    A null or empty text has no chunks. A document whose frontmatter can't be read gives one row with `error` and null content.
    """
    keys = key or []
    names = [*keys, "path"]
    given = documents.select(*keys, F.col(path).alias("path"), F.col(text).alias("_text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_text")

    columns = [*names, "heading", "start_line", "end_line", "content", "tags", "links", "aliases", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                head = dict.fromkeys(columns) | dict(zip(names, row[:-1]))
                try:
                    out += [head | chunk for chunk in document_chunks(row[-1] or "")]
                except ValueError as e:
                    out.append(head | {"error": str(e)})
            frame = pd.DataFrame(out, columns=columns, dtype=object)
            yield frame.astype({"start_line": "Int64", "end_line": "Int64"})

    parsed = given.mapInPandas(run, f"{types}, {_SCHEMA}")
    identity = F.sha2(F.concat_ws("\0", "path", "heading", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "content"), 256)
    search = F.trim(F.concat_ws("\n", "heading", F.array_join("aliases", " "), F.array_join("tags", " "), "content"))
    there = F.col("content").isNotNull()
    return parsed.select(
        *names,
        F.when(there, identity).alias("id"),
        "heading", "start_line", "end_line", "content", "tags", "links",
        F.when(there, F.regexp_replace(search, r"^\s+|\s+$", "")).alias("search_text"),
        F.when(there, F.sha2("content", 256)).alias("chunk_hash"),
        token_estimate(F.col("content")).alias("tokens"),
        "error",
    )
