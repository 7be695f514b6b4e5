"""The encoder and decoder against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer as Library

from shelfmark.llm import bpe
from shelfmark.llm.bpe import Tokenizer, decode, default_path, encode, token_digests
from shelfmark.llm.common import BATCH_BYTES, BATCH_CONF, table


@pytest.fixture(scope="module")
def library():
    return Library.from_file(default_path())


def cases():
    rng = random.Random(5)
    yield from ["", " ", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d  x  y \u0085z", "it's I'LL they've\n\n\n  tab\t\tx  ", "日本語 🙂🙂 é"]
    yield from ["ab" * 700, "a" * 3000, "٣٤٥ ½ Ⅷ", "​﻿ zero"]
    for _ in range(400):
        yield "".join(rng.choice("ab é\n'st<>|0") for _ in range(rng.randint(1, 80)))
        yield "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x3000, 0x30FF), rng.randint(0x1F600, 0x1F640)])) for _ in range(30))


def test_encoder_and_decoder_equal_the_library(library):
    own = Tokenizer(default_path()).prepare()
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), np.int32)
        assert got.tolist() == want, text
        assert own.decode(got.astype(np.int64)).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_decoder_replaces_broken_bytes(library):
    own = Tokenizer(default_path()).prepare()
    for ids in ([50256, 160, 160, 10], [255], list(range(0, 256))):
        assert own.decode(np.array(ids)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_digests_of_table(spark, small, library):
    docs = table(spark, small, "documents")
    got = {r.doc_id: r for r in token_digests(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "a b", 7), (2, "a b", 7), (2, "a b", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0, tuple(r.ids), r.decoded) for r in decode(encode(frame)).collect()))
    assert got == [(0, (64, 275), "a b"), (1, (), ""), (1, (), ""), (2, (64, 275), "a b"), (2, (64, 275), "a b")]
    assert decode(encode(frame.where("false"))).count() == 0
    assert decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == ""


def test_words_of_the_older_generation_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    tokenizer = bpe.Tokenizer(bpe.default_path()).prepare()
    asked, plain = [], tokenizer.word_ids
    tokenizer.word_ids = lambda word: asked.append(word) or plain(word)
    first = [tokenizer.encode(t) for t in ("one two three four", "one five", "six one")]
    assert asked.count("one") == 1 and asked.count(" one") == 1 and len(tokenizer.cache) <= 3 + 2
    assert first == [b"".join(map(plain, words)) for words in (["one", " two", " three", " four"], ["one", " five"], ["six", " one"])]


def test_batches_of_long_texts_are_bounded_and_the_decoder_needs_only_bytes(spark):
    """24 MB of text in one partition come as batches of a few MiB, and give the same digests as one by one."""
    before = spark.conf.get(BATCH_CONF)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' '), 1300) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        got = token_digests(docs)
        largest = docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
        assert largest <= 2 * BATCH_BYTES
        rows = got.groupBy("n_tokens", "ids_sha256", "decoded_sha256").count().collect()
        texts = {hashlib.sha256((f"word{i} " * 1300).encode()).hexdigest() for i in range(7)}
        assert {r.decoded_sha256 for r in rows} == texts and sum(r["count"] for r in rows) == 3000
    finally:
        spark.conf.set(BATCH_CONF, before)
    assert not hasattr(Tokenizer(default_path()).bytes_of, "pairs")
