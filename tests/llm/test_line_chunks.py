"""Chunks and removals against a plain version."""

import hashlib
import random

import pytest

from shelfmark.llm import line_chunks
from shelfmark.llm.common import KEY, row_key
from shelfmark.llm.line_chunks import deduped_documents, line_dedup


def chunks(text):
    out, current, seen = [], [], [0, 0]
    for line in (text or "").split("\n"):
        value = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        current.append(line)
        if (value + 31 * seen[-1] + 961 * seen[-2]) % 4 == 0:
            out.append(current)
            current = []
        seen.append(value)
    return out + [current] if current else out


def brute(rows):
    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for i, chunk in enumerate(chunks(text)):
            first.setdefault("\n".join(chunk), (doc, i))
    kept = {}
    for doc, text in rows:
        stay = []
        for i, chunk in enumerate(chunks(text)):
            joined = "\n".join(chunk)
            if len(chunk) < 2 or not joined.strip(" \n\r\t") or first[joined] == (doc, i):
                stay.append(joined)
        kept[doc] = "\n".join(stay)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_version(spark, seed):
    rng = random.Random(seed)
    lines = [f"line {i}" for i in range(60)] + ["", " "]
    passage = [rng.choice(lines) for _ in range(30)]
    rows = []
    for doc in range(80):
        own = [rng.choice(lines) + rng.choice(["", "", str(rng.random())]) for _ in range(rng.randrange(12))]
        at = rng.randrange(len(own) + 1)
        rows.append((doc, "\n".join(own[:at] + (passage if rng.random() < 0.4 else []) + own[at:])))
    rows += [(100, "\n" * 9), (101, "\n" * 9), (102, ""), (103, "one")]
    got = {r.doc_id: r.text for r in deduped_documents(spark.createDataFrame([(*r, "de", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == brute(rows)
    assert sum(len(t) for t in got.values()) < 0.7 * sum(len(t) for _, t in rows)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = "\n".join(f"row {i}" for i in range(40))
    frame = spark.createDataFrame([(None, text, 1), (3, text, 1), (3, text, 1), (4, None, 1), (5, "x\n" + text, 1)], "doc_id long, text string, n_lines int")
    keys = frame.select("doc_id", "text", *row_key()).distinct()
    got = {(r.doc_id, r.text): r for r in keys.join(line_dedup(frame), KEY).collect()}
    assert len(got) == 4 and line_dedup(frame).count() == 4
    # A null id sorts as 0, before 3.
    assert got[None, text].n_removed_chunks == 0 and got[3, text].n_removed_lines > 20 and got[5, "x\n" + text].n_removed_lines > 20
    assert got[4, None].n_lines == 1 and got[4, None]["__sm_kept"] == ""
    assert line_dedup(frame.where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 10])
def test_repeated_chunks_are_found_without_a_shuffle_of_whole_texts(spark, monkeypatch, few):
    rows = [(i, "\n".join([f"own {i}", *[f"row {k}" for k in range(40)]])) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real, plans = line_chunks.stored, []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(line_chunks, "stored", kept)
    monkeypatch.setattr(line_chunks, "FEW", few, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["__sm_id"]: r["__sm_kept"] for r in line_dedup(frame).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows)
    assert not any("hashpartitioning(__sm_id" in plan and "__sm_text" in plan for plan in plans)
