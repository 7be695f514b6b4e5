"""Matches against a brute-force search over word windows."""

import re

import pytest

from shelfmark.llm.decontaminate import benchmark_hits, decontaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = [f"w{i}" for i in range(40)]
DOCS = [
    (1, " ".join(BASE)), (2, "X " + " ".join(BASE[5:16]).upper() + ", y"), (3, " ".join(BASE[:9])), (4, None), (5, ""), (6, "..."),
    (None, " ".join(BASE[3:14])), (7, "kurz ÄÖ und so"), (8, "w1 w1 " * 40), (8, "w1 w1 " * 40), (9, " ".join(BASE[:12]) + " w99 " + " ".join(BASE[:12])),
]
ITEMS = [(10, " ".join(BASE[4:20])), (2, "W1"), (30, "ÄÖ und"), (None, " ".join(BASE[:11])), (50, None), (60, "!"), (70, "w1 " * 12), (10, "so")]


def brute(text, items):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, names = set(), set()
    for name, item in items:
        own = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in item or ""))
        size = min(10, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    hit |= set(range(i, i + size))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_hits_equal_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = benchmark_hits(docs, items, block_bytes=block_bytes).collect()
    got = sorted((str(r["__sm_doc"]), r.n_words, sum(h.stop - h.start for h in r.hits), r["items"]) for r in rows)
    assert got == sorted((str(i), *brute(t, ITEMS)) for i, t in DOCS)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "q " + " ".join(BASE[6:30]))], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(BASE[4:20]))], "item_id long, text string")
    assert [tuple(m) for m in benchmark_hits(docs, items).first().matches] == [("10", 1, 14)]


def test_filter_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, hits string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = decontaminated(docs, items)
    assert kept.columns == ["doc_id", "text", "hits"]
    clean = [i for i, t in DOCS if not brute(t, ITEMS[:1])[1]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert benchmark_hits(docs.where("false"), items).count() == 0
    assert all(not r.hits for r in benchmark_hits(docs, items.where("false")).collect())
