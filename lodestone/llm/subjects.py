"""Subject areas of documents by latent Dirichlet topic models.

Every word of a document, and every hand label it has, is a term; terms are numbered by a hash, so a
model has a fixed size and no term is left out. A model per language (all kept in one table, since a
term's number depends on its language) has a topic for each subject, which starts from what is unusually
frequent in the documents with its label, and background topics, which start from all documents. It is
then fitted by expectation maximisation over the whole corpus: tasks estimate each document's topic
proportions and add up its terms by topic, the sums are the next model. After the fit the topics are
inspected: a topic is the subject's whose label stands out among its terms, or background.

A document's topic proportions, estimated from its text alone, divide its words among the topics. A
sentence bears the subjects whose topics hold at least BEARING of its words (and nearly as many as the
foremost), and a document is about the subjects of at least SHARE of its subject-bearing sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

#: Share of a document's subject-bearing sentences that a subject needs.
SHARE = 0.25
#: Numbers that terms are hashed to. With 12 subjects the table of a fit is at most 2 ** 18 x 20 numbers of 4 bytes (21 MB), whatever the corpus.
SLOTS = 2**18
#: Topics besides the subjects' own, passes over all documents, and rounds of estimating a document's proportions while fitting and at last.
BACKGROUND, PASSES, FITTING, INNER = 8, 4, 3, 5
#: Priors of a document's proportions (subjects', background's) and of a topic's terms.
PRIOR_SUBJECT, PRIOR_BACKGROUND, PRIOR_TERM = 0.02, 1.0, 0.01
#: Times a label counts as a word of its document, and times the expected frequency that a subject's first terms must exceed.
LABEL_TIMES, UNUSUAL = 6, 2.0
#: Share of a topic's label words that makes it a subject's.
TOPIC_SHARE = 0.5
#: Words of a subject's topics that a sentence needs, and the part of the foremost subject's words that a second one needs.
BEARING, NEARLY = 1.25, 0.6
#: Numbers of a row of sums, documents reduced at a time, and terms a task remembers the numbers of.
CHUNK, BLOCK_DOCS, CACHED_TERMS = 4096, 1000, 500_000
LANGUAGES = ["en", "de", "es", "zh"]

#: Fixed: frequent words of the languages, by which a text's language is told.
STOPWORDS = {
    "de": set("der die das und nicht wird ist den mit diese dieser zu auf ein eine wenn fehlt von im für dem des werden sind sich bei nach".split()),
    "es": set("el la los las no se de que y en una un con para si antes este esta esta por del al cada su más como".split()),
    "en": set("the and of is a to in for this that not are be with it on by as was from or we".split()),
}
_CODE = re.compile(r"`[^`\n]*`|\w+://\S+|\[\[[^\]\n]*\]\]|<[^<>\n]{1,200}>|&\w+;")
#: Words, names and numbers, and ends of sentences.
_TOKEN = re.compile(r"\w+|[.!?](?=\s)|[\n\r]|[。！？；]")
_HAN = re.compile(r"[㐀-鿿]")
_HIDDEN = re.compile("[­​-‏⁠﻿\x00-\x08\x0b-\x1f]")


def sentences_of(text: str) -> tuple[str, list[list[str]]]:
    """Language and sentences of words, without code, names with digits or underscores, and numbers; Han text gives its pairs of characters.

    The language is "zh" by script, else the one whose frequent words are most; English where none are.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    tokens = _TOKEN.findall(_CODE.sub(" ", _HIDDEN.sub("", text).lower()))
    han = 0 if text.isascii() else len(_HAN.findall(text))
    if han * 5 > len(re.sub(r"\s", "", text)):
        language = "zh"
    else:
        language = max(("en", "de", "es"), key=lambda x: sum(map(STOPWORDS[x].__contains__, tokens)))
    out: list[list[str]] = []
    sentence: list[str] = []
    for t in tokens:
        if t.isalpha():
            if han and _HAN.match(t):
                sentence += [t[i : i + 2] for i in range(len(t) - 1)]
            elif len(t) > 2:
                sentence.append(t)
        elif sentence and not (t[0].isalnum() or t[0] == "_"):
            out.append(sentence)
            sentence = []
    if sentence:
        out.append(sentence)
    return language, out


class _Numbers(dict):
    """Numbers of one language's terms, with those met lately remembered."""

    def __init__(self, language: str) -> None:
        import xxhash

        self.language, self.hash = language, xxhash.xxh3_64_intdigest

    def __missing__(self, term: str) -> int:
        if len(self) > CACHED_TERMS:
            self.clear()
        n = self[term] = self.hash(f"{self.language} {term}") % SLOTS
        return n


def encode(documents: DataFrame, given: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, language (its number), terms (numbers, sentence by sentence), sizes (terms of each sentence), marks (subjects given by hand, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {language: _Numbers(language) for language in LANGUAGES}
        for batch in batches:
            languages, terms, sizes, ends, parts = [], [], [], [0], [0]
            for text in batch["text"].to_pylist():
                language, sentences = sentences_of(text)
                languages.append(LANGUAGES.index(language))
                terms += map(numbers[language].__getitem__, chain.from_iterable(sentences))
                sizes += map(len, sentences)
                ends.append(len(terms))
                parts.append(len(sizes))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.array(values, np.int32))) for at, values in ((ends, terms), (parts, sizes))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(languages, pa.int32()), *lists], ["doc_id", "language", "terms", "sizes"])

    place = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")).cast("int") - 1
    marks = given.groupBy("doc_id").agg(F.sort_array(F.collect_set(place)).alias("marks"))
    coded = documents.where("trim(text) <> ''").select("doc_id", "text").mapInArrow(run, "doc_id bigint, language int, terms array<int>, sizes array<int>")
    return coded.where("size(terms) > 0").join(marks, "doc_id", "left")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each row, without a copy; a null row has none."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Sums:
    """Sums of rows of numbers by term, given out in sparse chunks, so that tasks add up before the shuffle."""

    def __init__(self, rows: int, width: int) -> None:
        self.sums = np.zeros((rows, width), np.float32)

    def add(self, terms: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(terms, kind="stable")
        some, first = np.unique(terms[order], return_index=True)
        if len(some):
            self.sums[some] += np.add.reduceat(values[order], first, axis=0)

    def rows(self) -> pd.DataFrame:
        out = []
        for at in range(0, len(self.sums), CHUNK):
            part = self.sums[at : at + CHUNK]
            some = np.flatnonzero(part.any(1))
            if len(some):
                out.append((at // CHUNK, (at + some).astype("<i4").tobytes(), part[some].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "terms", "sums"])


_CHUNKS = "chunk int, terms binary, sums binary"
_ARROW = pa.schema([("chunk", pa.int32()), ("terms", pa.binary()), ("sums", pa.binary())])


def _add_up(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """All sums as one table. A task holds no more than the table while its parts stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _Sums(rows, width)
        for batch in batches:
            for terms, sums in zip(batch["terms"], batch["sums"]):
                total.sums[np.frombuffer(terms, "<i4")] += np.frombuffer(sums, np.float32).reshape(-1, width)
        yield total.rows()

    out = np.zeros((rows, width), np.float32)
    for r in parts.repartition("chunk").mapInPandas(run, _CHUNKS).collect():  # rows x width numbers at most
        out[np.frombuffer(r["terms"], "<i4")] = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
    return out


@dataclass
class Model:
    """Weights of the terms (SLOTS, then languages x subjects label words) in the topics (subjects' first, then background), and their sums by language."""

    weights: np.ndarray
    totals: np.ndarray
    subjects: list[str]

    def label_term(self, language: int, subject: int | np.ndarray) -> int | np.ndarray:
        return SLOTS + language * len(self.subjects) + subject

    @cached_property
    def prior(self) -> np.ndarray:
        return np.r_[np.full(len(self.subjects), PRIOR_SUBJECT), np.full(BACKGROUND, PRIOR_BACKGROUND)].astype(np.float32)

    @cached_property
    def start(self) -> np.ndarray:
        return self.prior / self.prior.sum()

    def proportions(self, language: int, terms: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Topic proportions of a document, and its terms' shares in the topics."""
        prior = self.prior
        likely = self.weights[terms] / self.totals[language]
        theta = self.start
        for _ in range(rounds):
            theta = prior + theta * ((1 / (likely @ theta)) @ likely)
            theta /= theta.sum()
        shares = likely * theta
        return theta, shares / shares.sum(1, keepdims=True)

    def subject_of_topics(self) -> np.ndarray:
        """Languages x topics x subjects, 1 where the subject's label stands out among the topic's terms; other topics are background."""
        size = len(self.subjects)
        out = np.zeros((len(LANGUAGES), self.weights.shape[1], size), np.float32)
        for language in range(len(LANGUAGES)):
            held = self.weights[[self.label_term(language, s) for s in range(size)]] - PRIOR_TERM
            share = held / np.maximum(held.sum(1, keepdims=True), 1e-9)  # of the label, by topic
            best, standing = share.argmax(0), share.max(0) / np.maximum(share.sum(0), 1e-9)
            for t in np.flatnonzero((standing >= TOPIC_SHARE) & (held.sum(0) > 0.5)):
                out[language, t, best[t]] = 1
        return out


def _model(sums: np.ndarray, language_of_term: np.ndarray, subjects: list[str]) -> Model:
    """The model of sums of terms by topic; every term that the corpus has gets the prior's weight in each topic."""
    weights = (sums + PRIOR_TERM).astype(np.float32)
    totals = np.stack([weights[language_of_term == n].sum(0) for n in range(len(LANGUAGES))]) + np.float32(PRIOR_TERM)
    return Model(weights, totals.astype(np.float32), subjects)


def _labelled(encoded: DataFrame, subjects: list[str]) -> np.ndarray:
    """Terms x (languages, then subjects): in how many documents of the language, and of those with the label, a term is, counted with repeats."""
    size, width = len(subjects), len(LANGUAGES) + len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(SLOTS, width)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(at, BLOCK_DOCS)
                terms = _lists(batch["terms"])
                head = np.zeros((len(terms), width), np.float32)
                head[np.arange(len(terms)), batch["language"].to_numpy()] = 1
                for i, marks in enumerate(_lists(batch["marks"])):
                    if len(marks):
                        head[i, len(LANGUAGES) + marks] = 1 / len(marks)
                total.add(np.concatenate(terms), np.repeat(head, [len(t) for t in terms], axis=0))
        yield pa.RecordBatch.from_pandas(total.rows(), _ARROW)

    found = _add_up(encoded.select("language", "terms", "marks").mapInArrow(run, _CHUNKS), SLOTS, width)
    return found if size else found[:, : len(LANGUAGES)]


def _first_model(encoded: DataFrame, subjects: list[str]) -> tuple[Model, np.ndarray]:
    """The model that fitting starts from, and the language that each term is of (of two that share a number, the one that has it more often)."""
    size, languages = len(subjects), len(LANGUAGES)
    counts = _labelled(encoded, subjects)
    everywhere, labelled = counts[:, :languages], counts[:, languages:]
    language = np.where(everywhere.sum(1) > 0, everywhere.argmax(1), -1)
    rows = SLOTS + languages * size
    sums = np.zeros((rows, size + BACKGROUND), np.float32)
    spread = np.random.default_rng(7).uniform(0.5, 1.5, (SLOTS, BACKGROUND))
    sums[:SLOTS, size:] = everywhere.sum(1, keepdims=True) * spread
    for n in range(languages):
        own = language == n
        here, common = labelled[own], everywhere[own, n]
        expected = common[:, None] / max(common.sum(), 1) * here.sum(0)
        sums[:SLOTS, :size][own] = np.maximum(here - UNUSUAL * expected, 0)
        for s in range(size):
            if here[:, s].any():
                sums[SLOTS + n * size + s, s] = LABEL_TIMES
    language = np.r_[language, np.repeat(np.arange(languages), size)]
    return _model(sums, language, subjects), language


def fit_topics(encoded: DataFrame, subjects: list[str], passes: int = PASSES) -> Model:
    """Expectation maximisation over all documents, with their labels as words."""
    spark = encoded.sparkSession
    model, language_of_term = _first_model(encoded, subjects)
    rows, width, size = *model.weights.shape, len(subjects)
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((model.weights, model.totals))  # at most SLOTS and a few rows, see SLOTS

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            now, total = Model(*sent.value, subjects), _Sums(rows, width)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_DOCS):
                    batch, terms, shares = whole.slice(at, BLOCK_DOCS), [], []
                    for language, words, marks in zip(batch["language"].to_pylist(), _lists(batch["terms"]), _lists(batch["marks"])):
                        if len(marks):
                            words = np.r_[words, np.repeat(now.label_term(language, marks), LABEL_TIMES)]
                        terms.append(words)
                        shares.append(now.proportions(language, words, FITTING)[1])
                    total.add(np.concatenate(terms), np.concatenate(shares))
            yield pa.RecordBatch.from_pandas(total.rows(), _ARROW)

        sums = _add_up(encoded.select("language", "terms", "marks").mapInArrow(run, _CHUNKS), rows, width)
        sent.destroy()
        model = _model(sums, language_of_term, subjects)
    return model


def assign(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, share: subjects that hold at least SHARE of a document's subject-bearing sentences, by its topic proportions."""
    subjects = model.subjects
    sent = encoded.sparkSession.sparkContext.broadcast((model.weights, model.totals, model.subject_of_topics()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, totals, meaning = sent.value
        now = Model(weights, totals, subjects)
        for batch in batches:
            out: list[tuple[int, str, float]] = []
            for key, language, terms, sizes in zip(batch["doc_id"].to_pylist(), batch["language"].to_pylist(), _lists(batch["terms"]), _lists(batch["sizes"])):
                shares = now.proportions(language, terms, INNER)[1] @ meaning[language]
                held = np.add.reduceat(shares, np.cumsum(sizes) - sizes, axis=0)
                about = (held >= BEARING) & (held >= NEARLY * held.max(1, keepdims=True))
                count = about.sum(0)
                if count.any():
                    bearing = int(about.any(1).sum())
                    out += [(key, subjects[s], count[s] / bearing) for s in np.flatnonzero((count > 0) & (count >= SHARE * bearing - 1e-9))]
            keys, names, parts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(parts, pa.float64())], ["doc_id", "subject", "share"])

    return encoded.select("doc_id", "language", "terms", "sizes").mapInArrow(run, "doc_id bigint, subject string, share double")


def _subject_names(subjects: DataFrame) -> list[str]:
    """The subjects; their number sets the size of the model, so more than it is made for are an error and not left out."""
    rows = subjects.where("trim(subject) <> ''").select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects; raise MOST_SUBJECTS if the drivers and tasks have room for the table of the fit")
    return [r["subject"] for r in rows]


#: Subjects a fit is made for: a table of 2 ** 18 x 264 numbers of 4 bytes is 277 MB.
MOST_SUBJECTS = 256


def _fitted(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model] | None:
    names = _subject_names(subjects)
    plain = subjects.select(F.lower(F.trim("subject")).alias("l"), F.col("subject").alias("name")).distinct()
    given = labels.select("doc_id", F.lower(F.trim("subject")).alias("l")).join(plain, "l").select("doc_id", F.col("name").alias("subject")).distinct()
    if not names or given.isEmpty():
        return None
    encoded = cut_lineage(encode(documents, given, names))
    return encoded, fit_topics(encoded, names)


def subjects_of_documents(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, subject, share of every subject a document is about: none, one or more rows a document.

    Null, empty and blank texts have none. Labels are matched to subjects without regard to case and blanks, others are
    left out; some may be wrong. Without documents, subjects or labels there are no rows, and a subject without a label in
    a language has none there. Rows of a repeated doc_id are judged one by one and give a subject once.
    """
    fitted = _fitted(documents, subjects, labels)
    if fitted is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")
    return assign(*fitted).groupBy("doc_id", "subject").agg(F.max("share").alias("share"))


def topic_terms(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = 12) -> DataFrame:
    """language, topic (from 0), subject (null for background), place, term, weight: the terms of greatest weight of each topic, for inspection.

    A number's term is the commonest of those that share it; numbers that no text has don't occur.
    """
    spark: SparkSession = documents.sparkSession
    schema = "language string, topic int, subject string, place int, term string, weight double"
    fitted = _fitted(documents, subjects, labels)
    if fitted is None:
        return spark.createDataFrame([], schema)
    encoded, model = fitted
    meaning, listed = model.subject_of_topics(), []
    counts = _labelled(encoded, model.subjects)[:, : len(LANGUAGES)]
    for n, language in enumerate(LANGUAGES):
        own = np.flatnonzero((counts.argmax(1) == n) & (counts.sum(1) > 0))
        for t in range(model.weights.shape[1]) if len(own) else ():
            subject = model.subjects[int(meaning[n, t].argmax())] if meaning[n, t].any() else None
            top = own[np.argsort(-model.weights[own, t], kind="stable")[:most]]
            listed += [(language, t, subject, place, int(x), float(model.weights[x, t])) for place, x in enumerate(top, 1)]
    wanted = {(r[0], r[4]) for r in listed}  # topics x most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, total = {language: _Numbers(language) for language in LANGUAGES}, Counter()
        for batch in batches:
            for text in batch["text"]:
                language, sentences = sentences_of(text)
                for s in sentences:
                    total.update((language, x, term) for term in s if (language, x := numbers[language][term]) in wanted)
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["language", "number", "term", "n"])

    counted = documents.where("trim(text) <> ''").select("text").mapInPandas(count, "language string, number int, term string, n bigint")
    named = counted.groupBy("language", "number", "term").agg(F.sum("n").alias("n")).groupBy("language", "number").agg(F.max(F.struct("n", "term")).alias("s"))
    rows = spark.createDataFrame(listed, "language string, topic int, subject string, place int, number int, weight double")
    return rows.join(named.select("language", "number", F.col("s.term").alias("term")), ["language", "number"]).select("language", "topic", "subject", "place", "term", "weight")
