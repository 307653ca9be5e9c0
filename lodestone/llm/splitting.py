"""Oversized chunks cut into pieces at natural boundaries.

Landmarks are positions where a rolling hash of the last WINDOW code points has its low bits zero, so
they depend on nothing but the text just before them. From a piece's start, the first landmark between
the minimum and the maximum size is the target, and the cut snaps to the natural boundary nearest to it.
An edit therefore moves only the cuts near it: soon a landmark and boundary are met that were cut at before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.markdown import atx_heading, fence_states

#: Code points a piece may have, at least has before its cut where the text goes on, and repeats of the one before.
LIMIT, LEAST, OVERLAP = 3600, 900, 200
#: Code points under the rolling hash, and its low bits that are zero at a landmark (one position in 2 ** BITS).
WINDOW, BITS = 32, 10
_FACTOR = 0x9E3779B97F4A7C15


def landmarks(text: str) -> np.ndarray:
    """Positions p, ascending, at which the hash of text[p - WINDOW : p] has BITS low bits of its upper half zero."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < WINDOW:
        return np.empty(0, np.int64)
    rolled = np.zeros(len(points) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            rolled = rolled * np.uint64(_FACTOR) + points[i : i + len(rolled)]
        mixed = (rolled * np.uint64(_FACTOR)) >> np.uint64(32)
    return np.flatnonzero((mixed & np.uint64(2**BITS - 1)) == 0) + WINDOW


def boundaries(lines: list[str]) -> list[int]:
    """Numbers, from 0, of the lines at which a piece may begin."""
    states = fence_states(lines)
    found, seen, after_blank = [], False, False
    for i, (line, state) in enumerate(zip(lines, states)):
        blank = not line.strip(" \t\r\n")
        outside = state in ("text", "open")
        if not blank:
            if seen and outside and (after_blank or state == "text" and atx_heading(line)):
                found.append(i)
            seen = True
        after_blank = blank and outside
    return found


def _nearest(places: np.ndarray, low: int, high: int, target: int) -> int | None:
    """The place in low..high nearest to the target, the lower of two."""
    a, b = np.searchsorted(places, [low, high + 1])
    if a == b:
        return None
    i = int(np.searchsorted(places[a:b], target)) + a
    near = [int(places[j]) for j in (i - 1, i) if a <= j < b]
    return min(near, key=lambda p: (abs(p - target), p))


def cut_points(text: str, natural: np.ndarray, starts: np.ndarray, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of the pieces. Where no natural boundary is within reach, a line's start, else a blank, else the landmark itself is cut at."""
    marks, out, begin, done = landmarks(text), [], 0, 0
    blanks: np.ndarray | None = None
    while len(text) - begin > limit:
        low, high = min(done + least, begin + limit), begin + limit
        i = int(np.searchsorted(marks, low))
        target = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut = _nearest(natural, low, high, target)
        if cut is None:
            cut = _nearest(natural, done + 1, low, low)
        if cut is None:
            cut = _nearest(starts, low, high, target)
        if cut is None:
            if blanks is None:
                blanks = np.array([m.end() for m in re.finditer(r"\s+", text)], np.int64)
            cut = _nearest(blanks, low, high, target)
        cut = target if cut is None else cut
        out.append((begin, cut))
        inside = natural[(natural >= max(cut - overlap, begin + 1)) & (natural < cut)]
        begin, done = int(inside[0]) if len(inside) else max(cut - overlap, begin + 1), cut
    out.append((begin, len(text)))
    return out


def _heading(lines: list[str], states: list[str]) -> list[str]:
    """Of each line the headings of the content in effect there, its own included."""
    path: dict[int, str] = {}
    name, out = "", []
    for line, state in zip(lines, states):
        if state == "text" and (found := atx_heading(line)):
            path = {k: v for k, v in path.items() if k < found[0]} | {found[0]: found[1]}
            name = " > ".join(v for _, v in sorted(path.items()) if v)
        out.append(name)
    return out


class Splitting:
    """A text on its way to pieces: first the candidates, the natural boundaries that cuts snap to, then, if asked for, the pieces."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.lines])])[:-1].astype(np.int64)
        self.candidates = boundaries(self.lines)

    def pieces(self) -> list[tuple[int, int, int, int, str]]:
        """Of each piece its range, first and last line (all from 0) and heading within the text."""
        headings = _heading(self.lines, fence_states(self.lines))
        out = []
        for begin, end in cut_points(self.text, self.starts[self.candidates], self.starts[1:]):
            first, last = (int(np.searchsorted(self.starts, p, "right")) - 1 for p in (begin, end - 1))
            out.append((begin, end, first, last, headings[first]))
        return out


def _over(rows: DataFrame, keys: list[str], schema: str, run) -> DataFrame:  # noqa: ANN001
    """`run` over the rows whose content exceeds the limit; shorter, empty and null contents give nothing."""
    return rows.where(F.char_length("content") > LIMIT).select(*keys).mapInPandas(run, schema)


def boundary_lines(chunks: DataFrame) -> DataFrame:
    """id, line_no: the lines, counted from the row's start_line, at which a piece of an oversized chunk may begin: the candidates
    that content-defined chunking snaps its landmarks to. Which of them are cut at depends on the landmarks and is in `split_oversized`.

    Repeated rows of an id give its lines once; a null start_line counts as 1, a null id as an id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, numbers = [], []
            for key, start, text in zip(batch["id"], batch["start_line"].fillna(1), batch["content"]):
                found = Splitting(text).candidates
                ids += [key] * len(found)
                numbers += [int(start) + i for i in found]
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "line_no": pd.Series(numbers, dtype="int64")})

    return _over(chunks, ["id", "start_line", "content"], "id string, line_no bigint", run).distinct()


def split_oversized(chunks: DataFrame) -> DataFrame:
    """Pieces of every row whose content exceeds LIMIT: the row's project_id, id, generation and file_hash, piece (from 1),
    heading, start_line, end_line, begin (offset in code points) and content.

    Pieces cover the content and none exceeds LIMIT; each repeats the last OVERLAP code points of the one before, or
    begins at the first natural boundary among them. A piece's heading is the row's, extended by the headings inside
    the content; a null heading counts as none. A null start_line counts as 1. Repeated rows give repeated pieces.
    """
    names = ["project_id", "id", "generation", "file_hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *head, heading, start, text in batch.itertuples(index=False, name=None):
                start = 1 if pd.isna(start) else int(start)
                for n, (begin, end, first, last, inner) in enumerate(Splitting(text).pieces(), 1):
                    name = " > ".join(x for x in (heading, inner) if x) or None
                    out.append((*head, n, name, start + first, start + last, begin, text[begin:end]))
            frame = pd.DataFrame(out, columns=[*names, "piece", "heading", "start_line", "end_line", "begin", "content"])
            yield frame.astype({"generation": "Int64"})

    schema = "project_id string, id string, generation bigint, file_hash string, piece int, heading string, start_line bigint, end_line bigint, begin int, content string"
    return _over(chunks, [*names, "heading", "start_line", "content"], schema, run)


def coverage(pieces: DataFrame) -> DataFrame:
    """project_id, chunks, code_points (covered), over_limit, gaps, long_overlaps (pieces that break a rule) of the pieces of `split_oversized`; repeated rows count once."""
    size = F.char_length("content")
    once = pieces.select("project_id", "id", "piece", "begin", (F.col("begin") + size).alias("end"), size.alias("size")).distinct()
    before = F.lag("end").over(Window.partitionBy("project_id", "id").orderBy("piece"))
    marked = once.withColumn("before", F.coalesce(before, F.lit(0)))
    chunks = marked.groupBy("project_id", "id").agg(
        F.max("end").alias("n"), F.count_if(F.col("size") > LIMIT).alias("over"), F.count_if(F.col("begin") > F.col("before")).alias("gaps"), F.count_if(F.col("before") - F.col("begin") > OVERLAP).alias("long")
    )
    return chunks.groupBy("project_id").agg(
        F.count("*").alias("chunks"), F.sum("n").alias("code_points"), F.sum("over").alias("over_limit"), F.sum("gaps").alias("gaps"), F.sum("long").alias("long_overlaps")
    )
