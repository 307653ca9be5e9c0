"""Files that nobody wrote by hand: generated, minified, third-party copies and data saved as code.

Identifier models are trained on the whole table, one for each language: counts of character trigrams of
each file's distinct identifiers, how many different trigrams a file of its size has, and the styles of
its names. A file whose names are unlikely under its language's model (mean bits a character) has mangled
names; names that repeat templates, so that they have few different trigrams for the language, are
generated; names in another style than nearly all of the language's are foreign. A file that is long but
has hardly any names besides its literals is data. Paths and header comments are judged as well, and texts
that equal a third-party file but for comments and white space are its copies.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

#: Times the mean bits a character of the language's names, above which a file's names count as mangled, and the names it must have for that.
MANGLED_TIMES, LEAST_NAMES = 1.5, 20
#: Share of a text's characters in names below which a text of at least so many characters is data.
DATA_SHARE, DATA_CHARS = 0.06, 300
#: Part of the language's mean diversity below which names are generated (the mean is of distinct trigrams over all trigrams to the power GROWTH, at
#: which their number grows with a text), and share of names in a style that is otherwise rarer than RARE_STYLE.
LOW_DIVERSITY, GROWTH = 0.45, 0.75
FOREIGN_SHARE, RARE_STYLE = 0.9, 0.05
#: The languages with most names have a model of their own, all others one together. A model is 31 ** 3 numbers of 4 bytes, so all are at most 8 MB.
OWN_MODELS = 64
HEAD_LINES = 20
#: Keys of files that may be sent to every task; more are met by a shuffle.
SENT_KEYS = 200_000
#: Names a task remembers before it settles or forgets them.
CACHED_NAMES = 200_000

#: Fixed words of directory and file names that mark third-party, generated and bundled files.
THIRD_PARTY = re.compile(r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|Pods|bower_components|node_modules|site-packages|jspm_packages|Carthage/Checkouts)/|^(?:deps|vendor|vendored|external|externals)/|(?:^|/)vendor/[\w-]+\.[\w.-]+/")
GENERATED_NAME = re.compile(r"(?:\.pb(?:\.gw)?\.go|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:cc|h)|_grpc_pb\.js|_pb\.(?:js|d\.ts)|\.(?:gen|generated|g|designer)\.\w+|_gen\.go|_generated\.\w+|_mock\.go|_string\.go|(?:^|/)zz_generated[\w.]*)$")
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle)\.(?:js|mjs|cjs|css)$")
GENERATED_HEAD = re.compile(
    r"(?i)(?:code |automatically |auto[- ]?|machine[- ])generated\b|\bgenerated (?:by|from|code|file)\b|@generated\b|machine written by|(?:was|is) (?:auto)?generated|autogenerated|\bproduced by\b.*\b(?:lost|overwritten|next run)"
    r"|wurde von \S+ (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|fue generado|generado autom|généré (?:par|automatiquement)|自动生成|\bdo not edit\b(?!.*\bhere\b)"
)
NOT_GENERATED = re.compile(r"(?i)\bonce generated\b|kept by hand|not generated|no longer generated|hand[- ]written|isn't generated")
VENDORED_HEAD = re.compile(r"(?i)\b(?:copied|vendored|taken|imported|adapted) (?:\w+ )?from\b.*(?:\bupstream\b|\d+\.\d+|https?:)|\bfrom the upstream release\b|\(c\) the \S+ contributors\b|\b\S+ (?:project )?authors\. all rights reserved|\bdo not patch here\b")
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!include|define|!\[)|/?\*|--|<!--|\"\"\"|''')")
_STRINGS = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/|^\s*#[^\n]*", re.S | re.M)
_NUMBERS = re.compile(r"(?<![A-Za-z_$])(?:0[xX][0-9a-fA-F_]+|\d[\w.]*)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
#: Signs of trigrams: 0 and 1 for the ends.
SIGNS = 31
_SIGN = {"_": 2, "$": 2} | {c: 3 for c in "0123456789"} | {chr(97 + i): 4 + i for i in range(26)}
#: Fixed: words of the languages themselves, which say nothing of naming.
_KEYWORDS = set(
    "abstract and as assert async await bool boolean break byte case catch chan char class const continue def default defer del delete do elif else enum err error except export extends false final finally float for "
    "from func function go goto if implements import in instanceof int interface is lambda let long map match module namespace new nil none None not null number of or package pass private protected public raise range "
    "return select self static string struct super switch this throw true True False try type typeof undefined use var void while with yield".split()
)


def names_of(text: str) -> tuple[list[str], int]:
    """Identifiers outside comments, literals and keywords, in order, and how many characters they have together."""
    code = _NUMBERS.sub(" ", _COMMENTS.sub(" ", _STRINGS.sub('""', text)))
    names = [n for n in _NAME.findall(code) if n not in _KEYWORDS]
    return names, sum(map(len, names))


@lru_cache(maxsize=CACHED_NAMES)
def trigrams(name: str) -> tuple[int, ...]:
    """Numbers below SIGNS ** 3 of the trigrams of a name: letters, one sign for all digits, one for "_" and "$", the ends, and one for everything else."""
    signs = [0, 0, *(_SIGN.get(c, SIGNS - 1) for c in name.lower()), 1]
    return tuple(a * SIGNS * SIGNS + b * SIGNS + c for a, b, c in zip(signs, signs[1:], signs[2:]))


def diversity(names: set[str]) -> float:
    """Different trigrams of the names, for their number; about the same for texts of all lengths."""
    grams = [g for n in names for g in trigrams(n)]
    return len(set(grams)) / len(grams) ** GROWTH


STYLES = ["upper", "snake", "camel", "pascal"]


def style_of(name: str) -> str:
    bare = name.strip("_$").rstrip("0123456789")
    if len(bare) < 4:
        return ""
    if "_" in bare:
        return "upper" if bare.isupper() else "snake"
    if bare[0].islower():
        return "camel" if not bare.islower() else ""
    return "upper" if bare.isupper() else "pascal"


def train(files: DataFrame) -> DataFrame:
    """language, kind ("gram", "style" or "file"), key, n: counts over the distinct identifiers of every file, and files with their diversities added up (in thousandths).

    Each task adds up its own counts before the shuffle, so that a language holding most files sends no more than its alphabet allows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = Counter(), Counter()

        def settle() -> None:
            for (language, name), n in seen.items():
                for g in trigrams(name):
                    total[language, "gram", g] += n
                if style := style_of(name):
                    total[language, "style", STYLES.index(style)] += n
            seen.clear()

        for batch in batches:
            for language, text in zip(batch["language"], batch["text"]):
                names = set(names_of(text)[0])
                seen.update((language, name) for name in names)
                if len(names) >= LEAST_NAMES:
                    total[language, "file", 0] += 1
                    total[language, "file", 1] += round(1000 * diversity(names))
                if len(seen) > CACHED_NAMES:
                    settle()
        settle()
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["language", "kind", "key", "n"])

    counted = files.select(F.coalesce("language", F.lit("")).alias("language"), "text").mapInPandas(count, "language string, kind string, key int, n bigint")
    return counted.groupBy("language", "kind", "key").agg(F.sum("n").alias("n"))


class Models:
    """Trigram models, mean diversities and style shares by language; None stands for all languages without a model of their own."""

    def __init__(self, rows: Iterable[tuple[str | None, str, int, int]]) -> None:
        counts: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(SIGNS**3, np.float64))
        styles: dict[str | None, Counter] = defaultdict(Counter)
        files: dict[str | None, Counter] = defaultdict(Counter)
        for language, kind, key, n in rows:
            if kind == "gram":
                counts[language][key] += n
            else:
                (styles if kind == "style" else files)[language][key] += n
        self.styles = {lang: {STYLES[s]: n / max(1, sum(c.values())) for s, n in c.items()} for lang, c in styles.items()}
        self.diversity = {lang: c[1] / 1000 / max(1, c[0]) for lang, c in files.items()}
        self.bits_of: dict[str | None, np.ndarray] = {}
        self.mean: dict[str | None, float] = {}
        self.known: dict[tuple[str | None, str], float] = {}
        for language, n in counts.items():
            start = np.repeat(n.reshape(-1, SIGNS).sum(1), SIGNS)
            bits = -np.log2((n + 0.05) / (start + 0.05 * SIGNS))  # add-0.05 smoothing
            self.bits_of[language], self.mean[language] = bits.astype(np.float32), float((bits * n).sum() / max(1, n.sum()))

    def own(self, language: str) -> str | None:
        return language if language in self.bits_of else None

    def bits(self, language: str | None, name: str) -> float:
        """Mean bits a character of the name."""
        if (known := self.known.get((language, name))) is not None:
            return known
        if len(self.known) > CACHED_NAMES:
            self.known.clear()
        found = self.known[language, name] = float(self.bits_of[language][list(trigrams(name))].mean())
        return found


def judge_path(path: str) -> str | None:
    if THIRD_PARTY.search(path):
        return "vendored"
    if MINIFIED_NAME.search(path):
        return "minified"
    return "generated" if GENERATED_NAME.search(path) else None


def judge_head(text: str) -> str | None:
    """What comments among the first lines, or in the whole block of comments that the text begins with, say; strings and code that mention such things say nothing."""
    at, n, leading, inside = 0, 0, True, False
    while at <= len(text) and (n < HEAD_LINES or leading):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at, n = (end if end >= 0 else len(text)) + 1, n + 1
        comment = inside or _COMMENT_LINE.match(line)
        leading = leading and bool(comment or not line.strip())
        opened = inside or line.lstrip().startswith("/*")
        inside = opened and "*/" not in line
        if comment and len(line) >= 400 and opened:
            line = line.split("*/")[0]  # code may follow
        if comment and not NOT_GENERATED.search(line):
            if VENDORED_HEAD.search(line):
                return "vendored"
            if GENERATED_HEAD.search(line):
                return "generated"
    return None


def judge_names(text: str, language: str, models: Models) -> str | None:
    """By the names alone. Languages that no model knows are judged as data or not at all."""
    names, size = names_of(text)
    if len(text) >= DATA_CHARS and size < DATA_SHARE * len(text):
        return "data"
    language = models.own(language)
    if len(names) < LEAST_NAMES or language not in models.bits_of:
        return None
    counts = Counter(names)
    if len(counts) >= LEAST_NAMES and diversity(set(counts)) < LOW_DIVERSITY * models.diversity.get(language, 0.0):
        return "generated"
    styles = Counter(s for n in counts if (s := style_of(n)))
    usual = models.styles.get(language, {}) if language is not None else {s: 1 for s in STYLES}  # of several languages nothing is foreign
    foreign = sum(n for s, n in styles.items() if usual.get(s, 0) < RARE_STYLE)
    if sum(styles.values()) >= LEAST_NAMES and foreign > FOREIGN_SHARE * sum(styles.values()):
        return "vendored"
    mangled = sum(models.bits(language, n) * k for n, k in counts.items()) / len(names)
    if mangled > MANGLED_TIMES * models.mean[language]:
        return "minified"
    return None


def fingerprint(text: str) -> str | None:
    """Hash of a text without comment lines and white space; None if hardly anything is left."""
    bare = "".join("".join(line.split()) for line in text.split("\n") if not _COMMENT_LINE.match(line))
    return hashlib.md5(bare.encode("utf-8", "surrogatepass")).hexdigest() if len(bare) >= 40 else None


def file_texts(units: DataFrame) -> DataFrame:
    """project_id, path, language, text: rows of kind `file`; of files without one, their other units."""
    some = units.where("path IS NOT NULL").select("project_id", "path", "language", F.coalesce("source", F.lit("")).alias("text"), (F.col("kind") == "file").alias("whole"))
    whole = some.where("whole")
    key = ["project_id", "path"]
    parts = some.where("NOT coalesce(whole, false)")
    lacking = cut_lineage(parts.select(*key).distinct().join(whole.where("text <> ''").select(*key).distinct(), key, "left_anti"))  # keys alone; no text moves
    if lacking.count() <= SENT_KEYS:
        lacking = F.broadcast(lacking)
    same = parts["path"].eqNullSafe(lacking["path"]) & parts["project_id"].eqNullSafe(lacking["project_id"])
    return whole.unionByName(parts.join(lacking, same, "left_semi")).select(*key, "language", "text")


def judge(units: DataFrame) -> DataFrame:
    """project_id, path, reason ("generated", "minified", "vendored", "data" or "copy") of each text of a file that isn't hand-written.

    Null and empty sources are judged by path alone; rows with a null path don't count, a null project_id is kept but has no
    copies; repeated rows and older versions give repeated rows. Other columns are ignored, and an empty table gives none.
    """
    texts = file_texts(units)
    counted = cut_lineage(train(texts.where("text <> ''")))
    top = [r["language"] for r in counted.groupBy("language").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language").limit(OWN_MODELS).collect()]
    name = F.when(F.col("language").isin(top), F.col("language")) if top else F.lit(None).cast("string")
    rows = counted.groupBy(name.alias("language"), "kind", "key").agg(F.sum("n").alias("n")).toArrow()  # at most a model's numbers a language
    sent = units.sparkSession.sparkContext.broadcast(Models(zip(*(rows[c].to_pylist() for c in ("language", "kind", "key", "n")))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = sent.value
        for batch in batches:
            out = []
            for project, path, language, text in batch.itertuples(index=False, name=None):
                reason = judge_path(path) or (text and (judge_head(text) or judge_names(text, language or "", models))) or None
                print_ = fingerprint(text) if text and (reason in (None, "vendored")) else None
                if reason or print_:
                    out.append((project, path, reason, print_))
            yield pd.DataFrame(out, columns=["project_id", "path", "reason", "print"])

    judged = cut_lineage(texts.mapInPandas(run, "project_id string, path string, reason string, print string"))
    originals = judged.where("reason = 'vendored' AND print IS NOT NULL").select("print").distinct()
    plain = judged.where("reason IS NULL").select("project_id", "path", "print").distinct()
    copies = plain.join(originals, "print").select("project_id", "path", F.lit("copy").alias("reason"))
    return judged.where("reason IS NOT NULL").select("project_id", "path", "reason").unionByName(copies)


def not_handwritten(units: DataFrame) -> DataFrame:
    """project_id, path of the files that nobody of the project wrote by hand, once each."""
    return judge(units).select("project_id", "path").distinct()


def handwritten_units(units: DataFrame) -> DataFrame:
    """The rows of `units` in hand-written files, all columns as they are."""
    flagged = not_handwritten(units)
    return units.join(flagged, (units["path"] == flagged["path"]) & units["project_id"].eqNullSafe(flagged["project_id"]), "left_anti")
