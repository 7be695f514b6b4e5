"""Removed bytes against a brute-force search over all strings; suffix arrays against sorting."""

import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm.common import table
from shelfmark.llm.suffix_dedup import op1_suffix_dedup, remove_repeats
from shelfmark.llm.suffixes import common_prefixes, suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([10, 25, 60, 150]))) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [rng.choice([rng.choice(shared), "".join(rng.choice("abcdé ") for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    return texts + ["a" * 90, "", None, "ab" * 50, texts[0], texts[0], "x" * 19, "y" * 20, "z" * 21, "日本語" * 20]


@pytest.mark.parametrize("sizes", [{}, {"crowd": 2, "shard_bytes": 400}, {"crowd": 3, "shard_bytes": 1}])
def test_spans_equal_brute_force(spark, sizes):
    texts = corpus(3)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = {r["__sm_doc"]: r for r in remove_repeats(frame, length=20, gram=5, **sizes).collect()}
    for i, (size, spans, kept) in enumerate(brute(texts, 20)):
        assert (rows[i].n_bytes, [tuple(s) for s in rows[i].spans], bytes(rows[i].kept)) == (size, spans, kept), texts[i]


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "0123456789" * 4 + "ä"
    frame = spark.createDataFrame([(None, text), (0, text), (0, text), (None, None), (5, "short")], "doc_id long, text string")
    rows = sorted((str(r["__sm_doc"]), r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeats(frame, length=20, gram=5).collect())
    assert rows == [("0", 42, 1, b""), ("0", 42, 1, b""), ("5", 5, 0, b"short"), ("None", 0, 0, b""), ("None", 42, 1, b"")]
    assert remove_repeats(frame.where("false")).count() == 0


def test_query_equals_brute_force_on_table(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op1_suffix_dedup(spark, small).collect()}
    for doc, (size, spans, _) in zip(docs, brute([d.text for d in docs], 200), strict=True):
        row = got[doc.doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (size, sum(b - a for a, b in spans), len(spans))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for size in (1, 2, 50, 400):
        depth = 16
        seq = np.concatenate([rng.integers(0, 3, size), np.zeros(2 * depth + 16, np.int64)])
        places = np.flatnonzero(seq)

        def upto(p, seq=seq, depth=depth):
            piece = seq[p : p + depth]
            stop = np.flatnonzero(piece == 0)
            return tuple(piece[: stop[0]] if len(stop) else piece)

        order = suffix_array(seq, places, seq[places], 1, depth)
        assert [upto(p) for p in order] == sorted(upto(p) for p in places)
        shared = common_prefixes(seq, order, depth)
        for i in range(1, len(order)):
            a, b = upto(order[i - 1]), upto(order[i])
            want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[i] == want
