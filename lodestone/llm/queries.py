"""Queries of the numbered problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import credentials, handwritten, leaks, neighbours, splitting, subjects, tokens
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunk hashes of which one is among the five most similar of the other."""
    return neighbours.similar_pairs(table(spark, folder, "doc_chunks").select("chunk_hash", "embedding"), "chunk_hash", "embedding")


@query()
def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar chunk hashes of every chunk hash."""
    return neighbours.nearest(table(spark, folder, "doc_chunks").select("chunk_hash", "embedding"), "chunk_hash", "embedding")


@query(
    """WITH v AS (SELECT chunk_hash FROM doc_chunks WHERE chunk_hash IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0 GROUP BY 1)
    SELECT true AS asked_enough, true AS found_enough WHERE (SELECT count(*) FROM v) > 0"""
)
def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether at least 95 in 100 of the true five nearest are found, measured on a fiftieth of all hashes as queries against all vectors."""
    found = neighbours.measured_recall(table(spark, folder, "doc_chunks").select("chunk_hash", "embedding"), "chunk_hash", "embedding")
    return found.select((F.col("queries") > 0).alias("asked_enough"), (F.col("found") >= 0.95 * F.col("pairs")).alias("found_enough"))


@query()
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as decoded from its ids."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, folder, "documents").select("doc_id", "text")))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines at which a piece of an oversized chunk may begin."""
    return splitting.boundary_lines(table(spark, folder, "doc_chunks"))


@query()
def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return splitting.split_oversized(table(spark, folder, "doc_chunks"))


@query(
    """SELECT project_id, count(*) AS chunks, sum(n)::BIGINT AS code_points, 0::BIGINT AS over_limit, 0::BIGINT AS gaps, 0::BIGINT AS long_overlaps FROM (
        SELECT DISTINCT project_id, id, length(content) AS n FROM doc_chunks WHERE length(content) > 3600) GROUP BY project_id"""
)
def p3_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of oversized chunks cover, and how many break a rule: none may."""
    return splitting.coverage(splitting.split_oversized(table(spark, folder, "doc_chunks")))


@query()
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a test passage, with the item given away."""
    return leaks.leaking_pairs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query()
def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the leaking spans."""
    return leaks.remove_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.texts(table(spark, folder, "code_units"), table(spark, folder, "doc_chunks"))


@query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines on which a credential begins."""
    return credentials.credential_lines(_texts(spark, folder))


@query()
def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its credentials masked."""
    return credentials.redact_credentials(_texts(spark, folder))


@query()
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are generated, minified, third-party copies or data."""
    return handwritten.not_handwritten(table(spark, folder, "code_units"))


@query()
def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many files are left out for which reason, by project."""
    found = handwritten.judge(table(spark, folder, "code_units"))
    return found.groupBy("project_id", "reason").agg(F.countDistinct("path").alias("files"))


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the subjects they are about."""
    found = subjects.subjects_of_documents(table(spark, folder, "documents"), table(spark, folder, "subjects"), table(spark, folder, "subject_labels"))
    return found.select("doc_id", "subject")


@query()
def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and their shares added up, by subject."""
    found = subjects.subjects_of_documents(table(spark, folder, "documents"), table(spark, folder, "subjects"), table(spark, folder, "subject_labels"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 3).alias("weight"))


@query()
def p8_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The foremost terms of every topic and the subject it was taken for."""
    return subjects.topic_terms(table(spark, folder, "documents"), table(spark, folder, "subjects"), table(spark, folder, "subject_labels"))
