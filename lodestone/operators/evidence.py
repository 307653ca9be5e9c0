"""Exact line ranges of current files as evidence, and whether evidence is still what the file holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text, from 1, with "\\n" between them; null if the range isn't within the text."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    valid = (first >= 1) & (last >= first) & (first <= F.size(lines))
    return F.when(valid, F.array_join(F.slice(lines, F.when(valid, first).otherwise(1).cast("int"), F.when(valid, last - first + 1).otherwise(0).cast("int")), "\n"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n+$", "")


def evidence_freshness(units: DataFrame) -> DataFrame:
    """project_id, id, start_line, end_line, fresh: whether each unit's text equals its lines of the file's own unit.

    Files without a unit of kind `file` or with a null source of it give no rows; a null text is never fresh; repeated rows count once.
    """
    key = ["project_id", "path"]
    files = units.where("kind = 'file' AND source IS NOT NULL").groupBy(*key).agg(F.min(F.struct("id", "source")).alias("f")).select(*key, F.col("f.source").alias("file_text"))
    parts = units.where("kind <> 'file'").select(*key, "id", "start_line", "end_line", "source").distinct()
    now = _trimmed(line_slice(F.col("file_text"), F.col("start_line"), F.col("end_line")))
    return parts.join(files, key).select("project_id", "id", "start_line", "end_line", F.coalesce(now == _trimmed(F.col("source")), F.lit(False)).alias("fresh"))


def evidence(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with `snippet` (code) or `quote` (documents) cut from the current bytes: files has path, file_hash and content.

    A candidate whose file is gone, has another hash or no such lines is left out.
    """
    text = F.decode("bytes", "UTF-8")
    held = files.select("path", "file_hash", F.col("content").alias("bytes")).where(F.sha2("bytes", 256) == F.col("file_hash"))
    cut = candidates.drop("content").join(held, ["path", "file_hash"]).withColumn("cut", line_slice(text, F.col("start_line"), F.col("end_line"))).where("cut IS NOT NULL")
    is_doc = F.col("type") == "doc"
    return cut.withColumn("snippet", F.when(~is_doc, F.col("cut"))).withColumn("quote", F.when(is_doc, F.col("cut"))).drop("cut", "bytes")
