import os
import random

import pytest
import tiktoken

from lodestone.llm import tokens

VOCABULARY = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def texts():
    rng = random.Random(4)
    odd = [None, "", "   ", "it's WE'LL they'd", "a  b \n\n c\t", "größe 中文 🙂 नमस्ते", "<|endoftext|> x", "\x00\x1f", "x" * 5000, "'" * 7, "    y"]
    return odd + ["".join(rng.choice("ab '\n\t1é中.,!-_<|>") for _ in range(rng.randrange(200))) for _ in range(200)] + ["the cat sat. " * 3000]


def test_ids_equal_the_tokenizer_of_whole_texts_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 7)
    codec = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(VOCABULARY), special_tokens={})
    data = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string").repartition(3)
    encoded = tokens.encode_corpus(df)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: codec.encode_ordinary(t or "") for i, t, _ in data}
    assert {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()} == {i: t or "" for i, t, _ in data}


def test_null_and_repeated_keys_and_no_rows(spark):
    s = "doc_id bigint, text string"
    got = tokens.encode_corpus(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], s)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in got) == [(False, 1, 1), (False, 1, 1), (True, 0, 1)]
    assert tokens.encode_corpus(spark.createDataFrame([], s)).count() == 0
