"""Every stage of the pipeline on its own input, against SQL, the library or all pairs."""

import hashlib

import duckdb
from tokenizers import Tokenizer as Library

import corpus_pipeline
from shelfmark.llm.bpe import default_path
from shelfmark.llm.common import DOCUMENT, table
from shelfmark.llm.line_chunks import DEDUPED_SQL
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute as brute_classes


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, small):
    docs = table(spark, small, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]

    good = stages["quality"](spark, docs, small).cache()
    assert tuple(good.columns) == DOCUMENT
    labels = {r.doc_id: r for r in table(spark, small, "labels").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    right = [(r.quality == 1 and r.toxic == 0) == (i in kept) for i, r in labels.items()]
    assert sum(right) > 0.7 * len(right)  # only 87 labels teach it here; tests/llm/test_quality.py holds out more

    lines = stages["line_dedup"](spark, good, small).cache()
    assert tuple(lines.columns) == DOCUMENT
    pandas = good.toPandas()
    duck = duckdb.connect()
    duck.register("given", pandas)
    want = dict(duck.execute(f"WITH {DEDUPED_SQL.format(documents='given')} SELECT doc_id, text FROM deduped").fetchall())
    got = rows_of(lines)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.source == s for r, s in zip(map(got.get, pandas.doc_id), pandas.source, strict=True))

    near = stages["near_dedup"](spark, lines, small).cache()
    classes, closest = brute_classes(sorted((i, r.text) for i, r in got.items()))
    assert closest > 1e-4
    assert set(rows_of(near)) == {i for i, c in classes.items() if i == c}

    clean = stages["decontamination"](spark, near, small).cache()
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not brute_hits(r.text, items)[1]}

    library = Library.from_file(default_path())
    tokens = rows_of(stages["bpe"](spark, clean, small))
    assert len(tokens) == clean.count()
    for r in clean.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        own = tokens[r.doc_id]
        assert (own.n_tokens, own.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert own.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_gives_the_stages_rows(spark, small):
    docs = table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, docs.collect()))
