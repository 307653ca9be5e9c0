"""Fusion of ranked lists, boosts, diversification, budgets and citations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import base_name
from lodestone.session import cut_lineage

#: Fixed values of the ranking.
RRF_K, PER_PATH, CANDIDATE_TOKENS = 60, 3, 12_000
STRONG, ENOUGH = 0.02, 5
#: What makes two rows of lists the same candidate.
IDENTITY = ["project_id", "type", "id", "path", "start_line"]

_QUOTED = re.compile(r"[\"'`]([^\"'`]+)[\"'`]")
_TITLE = re.compile(r"(?<![A-Za-z0-9_-])[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)+")
_TOKEN = re.compile(r"[A-Za-z0-9_./-]+")
_UNSAFE = re.compile(r"[\\/;|&$<>`\"'(){}\[\]*?!#~\x00-\x1f\x7f-\x9f]|\.\.")


def question_terms(question: str) -> list[str]:
    """Terms of a question worth an exact look-up, in order of appearance: quoted strings, runs of capitalised words, tokens
    that are dotted, slashed, underscored or have a capital, and the parts of dotted ones that would do by themselves."""
    found = [m[1].strip() for m in _QUOTED.finditer(question)] + [m[0] for m in _TITLE.finditer(question)]
    for m in _TOKEN.finditer(question):
        whole = m[0].strip("./-")
        for token in [whole] if "/" in whole else re.split(r"-+", whole):
            named = "/" in token or all(re.match(r"[A-Za-z_]", p) for p in token.split("."))
            parts = [] if "/" in token else token.split(".")
            if named and re.search(r"[A-Z_./]", token):
                found.append(token)
            if len(parts) > 1 or not named:
                found += [p for p in parts if re.search(r"[A-Z_]", p)]
    return list(dict.fromkeys(t for t in found if t))


def safe_term(term: str) -> bool:
    """2 to 80 code points without characters of shells, paths or control."""
    return 2 <= len(term) <= 80 and not _UNSAFE.search(term)


def source_weight(path: Column, weight: Column) -> Column:
    """The stored weight if positive, else 0.5 for type declarations, 0.6 for files named as tests and 1 for everything else."""
    test = F.lower(base_name(path)).rlike(r"_test\.|\.test\.|\.spec\.")
    return F.when(weight > 0, weight).when(F.lower(path).endswith(".d.ts"), 0.5).when(test, 0.6).otherwise(1.0)


def exact_match(terms: list[str], match: Column) -> Column:
    """exact_path if the path or its base is a term, else exact_symbol if the symbol is one or ends in ".term", else `match`."""
    if not terms:
        return match
    by_path = F.col("path").isin(terms) | base_name(F.col("path")).isin(terms)
    by_symbol = F.col("symbol").isin(terms)
    for t in terms:
        by_symbol = by_symbol | F.col("symbol").endswith(f".{t}")
    return F.when(by_path, "exact_path").when(by_symbol, "exact_symbol").otherwise(match)


def boosted(terms: list[str]) -> Column:
    """Score plus the greatest boost of path 2, symbol 1.5 and heading 0.5, plus 1 at graph distance 1; times the source's
    weight, times 0.75 at graph distance 2."""
    heading = F.lit(False)
    for t in terms:
        heading = heading | F.lower("heading").contains(t.lower())
    boost = F.greatest(
        F.when(F.col("match") == "exact_path", 2.0).otherwise(0.0),
        F.when(F.col("match") == "exact_symbol", 1.5).otherwise(0.0),
        F.when(heading, 0.5).otherwise(0.0),
    )
    near = F.when(F.col("match") == "graph_distance_1", 1.0).otherwise(0.0)
    far = F.when(F.col("match") == "graph_distance_2", 0.75).otherwise(1.0)
    return (F.col("score") + boost + near) * source_weight(F.col("path"), F.col("weight")) * far


def fuse(lists: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: the row of the first list that holds it (`list`, then `place`), its score the sum of 1 / (60 + place)
    over the lists in their order, so that the sum is the same every time; an empty match is filled by a later list's."""
    part = (1.0 / (RRF_K + F.col("place"))).alias("part")
    rest = [c for c in lists.columns if c not in (*key, "list", "place", "score", "match")]
    grouped = lists.groupBy(*key).agg(
        F.min(F.struct("list", "place", *rest)).alias("first"),
        F.array_sort(F.collect_list(F.struct("list", "place", part))).alias("parts"),
        F.min(F.when(F.col("match") != "", F.struct("list", "place", "match"))).alias("m"),
    )
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"])
    return grouped.select(*key, *[F.col(f"first.{c}") for c in rest], F.coalesce("m.match", F.lit("")).alias("match"), score.alias("score"))


def ranked(candidates: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """`place` from 1 within the group: by score, path, first line and id."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), "path", "start_line", "id")
    return candidates.withColumn("place", F.row_number().over(order))


def diversify(candidates: DataFrame, group: list[str], per_path: int = PER_PATH) -> DataFrame:
    """Candidates beyond `per_path` of one path go behind all others, in their order; an empty path is never held back."""
    nth = F.row_number().over(Window.partitionBy(*group, "path").orderBy("place"))
    late = (F.coalesce("path", F.lit("")) != "") & (F.col("_nth") > per_path)
    again = F.row_number().over(Window.partitionBy(*group).orderBy("_late", "place"))
    return candidates.withColumn("_nth", nth).withColumn("_late", late).withColumn("place", again).drop("_nth", "_late")


def placed_by_range(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`place` from 1 within the group by `order`, without bringing a group into one task: rows are spread by range, and each
    range's places begin behind those of the ranges before it. Equal rows of `order` are placed in an order of no meaning."""
    spread = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(*group, "_part").agg(F.count("*").alias("_n"))  # a row a group and range
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = (F.col("_part") == F.col("_p")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return spread.join(starts, same).withColumn("place", inside + F.col("_before")).select(*[c for c in rows.columns if c != "place"], "place")


def diversify_table(rows: DataFrame, group: list[str], per_path: int = PER_PATH) -> DataFrame:
    """`diversify` for groups of any size: the first of each path are found with a limit before the shuffle, and places are given by range."""
    first = Window.partitionBy(*group, "path").orderBy("place")
    early = rows.where("coalesce(path, '') <> ''").select(*group, "path", "place").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= per_path)
    early = early.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("place").alias("_place"))
    same = (F.col("place") == F.col("_place")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    marked = rows.join(early, same, "left").withColumn("_late", (F.coalesce("path", F.lit("")) != "") & F.col("_place").isNull()).withColumn("_old", F.col("place"))
    return placed_by_range(marked.select(*rows.columns, "_late", "_old"), group, ["_late", "_old"]).drop("_late", "_old")


def within_budget(candidates: DataFrame, group: list[str], tokens: str, budget: int | str = CANDIDATE_TOKENS) -> DataFrame:
    """Those that still fit when taken in order of `place`; one too large is skipped and smaller later ones may enter.

    The fold needs a group's (place, tokens) in one row, and groups are ranked lists cut before this.
    """
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["tokens"]
        return F.when(used <= limit, F.struct(used.alias("used"), F.array_append(acc["kept"], x["place"]).alias("kept"))).otherwise(acc)

    ordered = F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col(tokens).cast("bigint").alias("tokens"))))
    limits = [F.first(budget).alias(budget)] if isinstance(budget, str) else []
    kept = candidates.groupBy(*group).agg(ordered.alias("_all"), *limits).select(*group, F.explode(F.aggregate("_all", start, step)["kept"]).alias("place"))
    return candidates.join(kept, [*group, "place"], "left_semi")


def label_citations(candidates: DataFrame, group: list[str]) -> DataFrame:
    """`label`: D1, D2, ... for documents and C1, C2, ... for code, in order of `place`."""
    kind = F.when(F.col("type") == "doc", "D").otherwise("C")
    return candidates.withColumn("label", F.concat(kind, F.row_number().over(Window.partitionBy(*group, kind).orderBy("place")).cast("string")))


def weak_recall(candidates: DataFrame, group: list[str]) -> DataFrame:
    """`weak` of each group: false if any match is exact, else whether fewer than five scores exceed the threshold."""
    exact = F.max(F.col("match").isin("exact_path", "exact_symbol"))
    return candidates.groupBy(*group).agg((~exact & (F.count_if(F.col("score") > STRONG) < ENOUGH)).alias("weak"))


def citation_markers(text: Column) -> Column:
    """Names in square brackets without blanks or brackets inside, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\] \t\r\n]+)\]"), 1)


def keep_citations(summary: str, allowed: set[str]) -> tuple[str, list[str]]:
    """The summary without markers of other names, and the names it cites, first-seen."""
    cited: list[str] = []

    def one(m: re.Match) -> str:
        if m[1] in allowed:
            if m[1] not in cited:
                cited.append(m[1])
            return m[0]
        return ""

    return re.sub(r"\[([^\[\] \t\r\n]+)\]", one, summary).strip(), cited
