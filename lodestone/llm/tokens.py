"""Encoding of a corpus with a public byte-level BPE vocabulary, each distinct word once.

Texts are split once into pre-tokens with their positions. Within blocks of documents each distinct word is
listed once and a position holds its place in that list, so that the commonest word is one row a block and
not one row an occurrence. The distinct words of all blocks are encoded once each, their ids joined back to
the blocks' lists, and every block put together by position. Positions are written once and move once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

#: Folder of the vocabulary files; they are read where the tasks run and never copied.
VOCABULARIES = "/opt/tokenizers"
#: The fixed pattern that cuts a text into pre-tokens, as published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block of documents holds at most so many documents and, but for a single longer one, code points.
BLOCK_DOCS, BLOCK_CHARS = 2000, 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _blocks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows within the limits of a block."""
    chars = batch["text"].str.len().fillna(0).to_numpy(np.int64)
    start, held = 0, 0
    for i, n in enumerate(chars):
        if i > start and (held + n > BLOCK_CHARS or i - start >= BLOCK_DOCS):
            yield batch.iloc[start:i]
            start, held = i, 0
        held += n
    if start < len(batch):
        yield batch.iloc[start:]


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """block, docs (the block's keys), counts (pre-tokens of each document), words (the block's distinct ones), at (of each position through the whole block the place of its word).

    Null and empty texts have no pre-tokens.
    """
    key_type = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        from pyspark import TaskContext

        pattern = regex.compile(PATTERN)
        name = TaskContext.get().partitionId() << 32  # the same again if the task is repeated
        for batch in batches:
            for block in _blocks(batch):
                name += 1
                place: dict[str, int] = {}
                counts, at = [], []
                for value in block["text"]:
                    words = pattern.findall(value) if value else []
                    at += [place.setdefault(w, len(place)) for w in words]
                    counts.append(len(words))
                positions = np.array(at, "<u2" if len(place) < 65_536 else "<u4").tobytes()
                yield pd.DataFrame({"block": name, "docs": [list(block["key"])], "counts": [np.array(counts, "<i4").tobytes()], "words": [list(place)], "at": [positions]})

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(
        split, f"block bigint, docs array<{key_type}>, counts binary, words array<string>, at binary"
    )


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """word, ids (bytes of 4-byte integers) of distinct words; text that looks like a special token is ordinary text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        codec = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [np.array(codec.encode_ordinary(w), "<i4").tobytes() for w in batch["word"]]})

    return words.mapInPandas(encode, "word string, ids binary")


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """key and ids of every document; an empty and a null text both give an empty list.

    Every row gives one row, also rows with a null or repeated key; other columns are ignored, and an empty table gives none.
    """
    blocks = cut_lineage(postings(documents, key, text))  # read twice, split once
    listed = blocks.select("block", F.posexplode("words").alias("place", "word"))
    words = encode_words(listed.select("word").distinct(), vocabulary)
    found = listed.join(words, "word").groupBy("block").agg(F.collect_list(F.struct("place", "ids")).alias("ids"))  # the distinct words of one block
    key_type = documents.schema[key].dataType.simpleString()

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, counts, at, ids in batch.itertuples(index=False, name=None):
                cuts = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i4"))])
                flat = np.empty(0, np.int32)
                if cuts[-1]:
                    word_of = np.frombuffer(at, "<u2" if len(ids) < 65_536 else "<u4").astype(np.int64)
                    pool = np.frombuffer(b"".join(x["ids"] for x in ids), "<i4")
                    sizes = np.array([len(x["ids"]) // 4 for x in ids], np.int64)
                    turn = np.empty(len(ids), np.int64)
                    turn[[x["place"] for x in ids]] = np.arange(len(ids))
                    begins = (np.cumsum(sizes) - sizes)[turn]
                    each = sizes[turn][word_of]
                    ends = np.cumsum(each)
                    flat = pool[np.repeat(begins[word_of] - (ends - each), each) + np.arange(int(ends[-1]))]
                    cuts = np.concatenate([[0], ends])[cuts]
                out = pd.DataFrame({"key": pd.Series(list(docs), dtype=object), "ids": [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]})
                yield out if out["key"].isna().any() else out.infer_objects()

    whole = blocks.select("block", "docs", "counts", "at").join(found, "block", "left").select("docs", "counts", "at", "ids")
    ids = whole.mapInPandas(assemble, f"key {key_type}, ids array<int>")
    return ids.select(F.col("key").alias(key), "ids")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """key and text of every row of ids, by joining the table of token bytes; a null list gives an empty text.

    Bytes that are not UTF-8 become U+FFFD; ids outside the vocabulary are an error.
    """
    spark = encoded.sparkSession
    ranks = read_ranks(vocabulary)  # one row a token of the vocabulary
    table = spark.createDataFrame(pd.DataFrame({"token": list(ranks.values()), "bytes": list(ranks)}), "token int, bytes binary")
    numbered = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    tokens = numbered.select("row", F.posexplode("ids").alias("at", "token")).join(F.broadcast(table), "token", "left")
    known = F.when(F.col("bytes").isNotNull(), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("no such token: "), F.col("token").cast("string"))).cast("binary"))
    texts = tokens.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.hex(known).alias("bytes")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["bytes"]), ""))
    return numbered.select("row", "key").join(texts, "row", "left").select(
        F.col("key").alias(key), F.coalesce(F.decode(whole, "UTF-8"), F.lit("")).alias("text")
    )
