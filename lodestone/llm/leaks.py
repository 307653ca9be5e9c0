"""Evaluation passages inside training documents.

The normalised n-grams of the passages are hashed to 8-byte numbers; sorted, they go to every task as
arrays whose size in bytes is checked, in as many blocks of items as that takes. Documents are scanned
window by window; each hit is verified and extended word by word in both directions, over single
changed, missing or added words, to a stretch. A document leaks an item if the one or two best stretches
that keep the passage's order hold at least SHARE of the passage's words. A stretch inside a longer
stretch of another item doesn't count: it is that item's text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

#: Words of an n-gram, share of the passage a leak holds, and the fewest words of a stretch.
NGRAM, SHARE, STRETCH = 3, 1 / 3, 5
#: Bytes of a block of items in every task (words, n-grams, places and items, 32 bytes a word); more items are scanned for block after block.
BLOCK_BYTES, WORD_BYTES = 64 << 20, 32
#: Words a task remembers the numbers of.
CACHED_WORDS = 200_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,7});|[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
_SOME_HAN = re.compile(r"[\u3400-\u9fff]")
_RUN = re.compile(r"[^\W_](?:\0*[^\W_])*")
_HAN_RUN = re.compile(r"[\u3400-\u9fff]|(?:(?![\u3400-\u9fff])[^\W_])(?:\0*(?![\u3400-\u9fff])[^\W_])*")
_HAN = re.compile(r"[\u3400-\u9fff]|[^\u3400-\u9fff]+")


def words_of(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in compatibility form and lower case, without markup and punctuation, and their places in the text. Each Han character is a word."""
    if not text:
        return [], []
    blank = _MARKUP.sub(lambda m: ("" if len(m[0]) == 1 else " ") + "\0" * (len(m[0]) - (len(m[0]) > 1)), text)
    words, places = [], []
    if "\0" not in blank and blank.isascii():
        for m in _WORD.finditer(blank):
            words.append(m[0].lower())
            places.append(m.span())
        return words, places
    for m in (_HAN_RUN if _SOME_HAN.search(blank) else _RUN).finditer(blank):
        word = unicodedata.normalize("NFKC", m[0].replace("\0", "")).casefold()
        parts = [x for part in _WORD.findall(word) for x in _HAN.findall(part)]
        words += parts
        places += [m.span()] * len(parts)
    return words, places


def plain_words(text: str | None) -> list[str]:
    """The words alone, which is quicker for plain text."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(_MARKUP.sub(" ", text).lower())
    if not unicodedata.is_normalized("NFKC", text):
        return words_of(text)[0]
    words = _WORD.findall(_MARKUP.sub(lambda m: "" if len(m[0]) == 1 else " ", text).casefold())
    return [x for w in words for x in _HAN.findall(w)] if _SOME_HAN.search(text) else words


class _Hashes:
    """Numbers of words, with those met lately remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _grams(numbers: np.ndarray) -> np.ndarray:
    """A number for each window of NGRAM words."""
    size = len(numbers) - NGRAM + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(NGRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + size]
    return out


Stretch = tuple[int, int, int, int, int]


class Passages:
    """A block of passages, ready for scanning: item ids, where each begins among all words, the words, and the sorted n-grams with their places."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        import xxhash

        hashes = _Hashes()
        numbers = [hashes.of(words_of(text)[0]) for _, text in items]
        self.keys = np.array([k for k, _ in items], np.int64)
        self.marks = [xxhash.xxh3_64_intdigest(f"{k} {text}") >> 1 for k, text in items]  # tells passages apart, whatever block they are in
        self.begins = np.cumsum([0, *map(len, numbers)])
        self.words = np.concatenate([np.empty(0, np.uint64), *numbers])
        grams = np.concatenate([np.empty(0, np.uint64), *map(_grams, numbers)])
        places = np.concatenate([np.empty(0, np.int32), *[b + np.arange(max(0, len(n) - NGRAM + 1), dtype=np.int32) for b, n in zip(self.begins, numbers)]]).astype(np.int32)
        order = np.argsort(grams, kind="stable")
        self.grams, self.places = grams[order], places[order]
        self.item_of = (np.searchsorted(self.begins, self.places, "right") - 1).astype(np.int32)

    def size(self, key_at: int) -> int:
        return int(self.begins[key_at + 1] - self.begins[key_at])

    def stretches(self, numbers: np.ndarray) -> list[Stretch]:
        """(index of the item, begin and end in the passage, begin and end in the document) of all maximal stretches."""
        grams = _grams(numbers)
        low = np.searchsorted(self.grams, grams)
        hits = np.flatnonzero(self.grams[np.minimum(low, len(self.grams) - 1)] == grams) if len(self.grams) else ()
        if not len(hits):
            return []
        high = np.searchsorted(self.grams, grams, "right")
        words, found = numbers.tolist(), []
        active: dict[int, list[tuple[int, int, int, int]]] = {}
        begins = self.begins.tolist() if len(self.begins) < 10_000 else self.begins
        texts: dict[int, list[int]] = {}
        for j in hits.tolist():
            for place, item in zip(self.places[low[j] : high[j]].tolist(), self.item_of[low[j] : high[j]].tolist()):
                i = place - begins[item]
                running = active.get(item)
                if running is None:
                    running = active[item] = []
                elif running:
                    if any(a <= i < b and c <= j < d for a, b, c, d in running):
                        continue
                    running = active[item] = [x for x in running if x[3] > j]  # stretches that are past can't cover what follows
                if item not in texts:
                    texts[item] = self.words[begins[item] : begins[item + 1]].tolist()
                text = texts[item]
                if text[i : i + NGRAM] != words[j : j + NGRAM]:
                    continue
                b, d = _extend(text, words, i + NGRAM, j + NGRAM, 1)
                a, c = _extend(text, words, i - 1, j - 1, -1)
                a, c = a + 1, c + 1
                running.append((a, b, c, d))
                if b - a >= STRETCH:
                    found.append((item, a, b, c, d))
        return found


def _outermost(found: list[Stretch]) -> list[Stretch]:
    """Without stretches that lie in a longer one of another item; one pass in order of place, with the two furthest ends so far of different items."""
    order = sorted(found, key=lambda s: (s[3], -s[4]))
    kept, first, second, at = [], (-1, None), (-1, None), 0
    while at < len(order):
        same = at
        while same < len(order) and order[same][3:] == order[at][3:]:
            same += 1
        group = order[at:same]
        kept += [s for s in group if (second if first[1] == s[0] else first)[0] < s[4]]
        for s in group:
            if s[0] == first[1]:
                first = max(first, (s[4], s[0]))
            elif s[4] > first[0]:
                first, second = (s[4], s[0]), first
            elif s[4] > second[0]:
                second = (s[4], s[0])
        at = same
    return kept


def decide(found: list[Stretch], sizes: dict[int, int], share: float = SHARE) -> dict[int, list[tuple[int, int]]]:
    """Items given away, of the stretches (item, ...) and the items' words, with the ranges of the document's words that do."""
    own: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for item, *rest in _outermost(found):
        own[item].append(tuple(rest))
    out = {}
    for item, parts in own.items():
        need = share * sizes[item] - 1e-9
        # of equal parts of the passage the first can be followed by most, the last can follow most
        first, last = {}, {}
        for p in sorted(parts, key=lambda p: p[3]):
            first.setdefault(p[:2], p)
        for p in sorted(parts, key=lambda p: p[2]):
            last[p[:2]] = p
        best, chosen = max(((p[1] - p[0], [p[2:]]) for p in first.values()), key=lambda x: x[0])
        for p in first.values():
            for q in last.values():
                held = q[1] - max(p[1], q[0]) + p[1] - p[0]
                if p[0] < q[0] and p[3] <= q[2] and p[1] <= q[0] + 2 and held > best:
                    best, chosen = held, [p[2:], q[2:]]
        if best >= need:
            out[item] = sorted({*chosen, *(p[2:] for p in parts if p[1] - p[0] >= need)})
    return out


def _extend(text: list[int], words: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """First places, in the passage and in the document, that the stretch doesn't reach in direction `step`."""

    def same(x: int, y: int, n: int) -> bool:
        return all(0 <= x + k * step < len(text) and 0 <= y + k * step < len(words) and text[x + k * step] == words[y + k * step] for k in range(n))

    n, m = len(text), len(words)
    while True:
        while 0 <= i < n and 0 <= j < m and text[i] == words[j]:
            i, j = i + step, j + step
        if same(i + step, j + step, 2):  # a word was changed
            i, j = i + step, j + step
        elif same(i, j + step, 2):  # a word was put in
            j += step
        elif same(i + step, j, 2):  # a word was left out
            i += step
        elif same(i, j + 2 * step, 3):
            j += 2 * step
        else:
            return i, j


_SCHEMA = "doc_id bigint, item_id bigint, spans array<array<int>>"
_STRETCHES = "doc_id bigint, row bigint, item_id bigint, passage bigint, size int, stretch array<int>, places array<int>"


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Passages]:
    """All items in blocks of at most `block_bytes`, an item with more words alone: counted first, then fetched block by block."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "n": [len(plain_words(t)) for t in batch["passage"]]})

    most = max(1, block_bytes // WORD_BYTES)
    counted = items.mapInPandas(count, "item_id bigint, n bigint")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = -(-2 * total // most) if total > most else 1  # half full in the mean, so that none exceeds the bound by chance
    for n in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == n)
        held, size = [], 0
        for r in some.toLocalIterator():
            words = len(plain_words(r["passage"]))
            if held and size + words > most:
                yield Passages(held)
                held, size = [], 0
            held.append((r["item_id"], r["passage"]))
            size += words
        if held:
            yield Passages(held)


def _scan(documents: DataFrame, passages: Passages, whole: bool, share: float) -> DataFrame:
    """Of each document its leaks if the block is the whole, else its stretches."""
    sent = documents.sparkSession.sparkContext.broadcast(passages)  # at most a block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, hashes = sent.value, _Hashes()
        for batch in batches:
            out = []
            for key, row, text in batch.itertuples(index=False, name=None):
                found = block.stretches(hashes.of(plain_words(text)))
                if not found:
                    continue
                places = words_of(text)[1]
                if whole:
                    for item, ranges in decide(found, {s[0]: block.size(s[0]) for s in found}, share).items():
                        out.append((key, int(block.keys[item]), [[places[a][0], places[b - 1][1]] for a, b in ranges]))
                else:
                    out += [(key, row, int(block.keys[s[0]]), block.marks[s[0]], block.size(s[0]), list(s[1:]), [places[s[3]][0], places[s[4] - 1][1]]) for s in found]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "spans"] if whole else ["doc_id", "row", "item_id", "passage", "size", "stretch", "places"])

    return documents.mapInPandas(run, _SCHEMA if whole else _STRETCHES)


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, spans: documents that hold an item's passage, wholly or partly, and where (offsets in code points).

    Null and empty texts and passages leak nothing; passages of fewer than NGRAM words aren't found; rows with a null
    id don't count. Repeated rows of an item count once. Rows of documents that are repeated give their pairs once each.
    """
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    tests = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").distinct()
    blocks = _blocks(tests, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    if second is None:
        return _scan(docs, first, True, share)
    docs = cut_lineage(docs)  # the row numbers must be the same for every block
    found = cut_lineage(_scan(docs, first, False, share)).unionByName(cut_lineage(_scan(docs, second, False, share)))
    for block in blocks:
        found = found.unionByName(cut_lineage(_scan(docs, block, False, share)))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, rows in zip(batch["doc_id"], batch["rows"]):
                stretches, item_of = [(r["passage"], *map(int, r["stretch"])) for r in rows], {r["passage"]: r["item_id"] for r in rows}
                places = {(c, d): list(map(int, r["places"])) for (*_, c, d), r in zip(stretches, rows)}
                for passage, ranges in decide(stretches, {r["passage"]: r["size"] for r in rows}, share).items():
                    out.append((key, item_of[passage], [places[x] for x in ranges]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "spans"])

    gathered = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "passage", "size", "stretch", "places")).alias("rows"))  # the stretches of one document
    return gathered.select("doc_id", "rows").mapInPandas(settle, _SCHEMA)


def leaking_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak, once."""
    return find_leaks(documents, items).select("doc_id", "item_id").distinct()


def remove_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text: all documents with the leaking spans taken out, everything else unchanged; null stays null."""
    spans = find_leaks(documents, items).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch["text"], batch["spans"]):
                if cuts is not None and text is not None:
                    kept, at = [], 0
                    for a, b in sorted(tuple(c) for c in cuts):
                        kept.append(text[at : max(a, at)])
                        at = max(at, b)
                    text = "".join(kept) + text[at:]
                out.append(text)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": pd.Series(out, dtype=object)})

    return documents.select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(splice, "doc_id bigint, text string")
