"""Counts and verdicts against a plain version."""

import re
from collections import Counter

from shelfmark.llm.quality_rules import AROUND, RULES, STOP_WORDS, SYMBOLS, Rule, judged, kept_documents, spellings

STOPS = set(spellings(STOP_WORDS))
WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + step for i, w in enumerate(windows) if often[w] > 1 for step in range(5)}
    c = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(s) for s in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_exclamations": text.count("!"),
        "n_stop_words": sum(w.strip(AROUND) in STOPS for w in words), "n_lines": len(lines),
    }
    base = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    failed = [
        r.name for r in RULES
        if c["n_words"] >= r.from_words
        and ((r.least is not None and 100 * c[r.count] < r.least * c[r.per]) or (r.most is not None and 100 * c[r.count] > r.most * c[r.per]))
    ]
    return (*c.values(), base, ",".join(failed), not base and not failed)


PROSE = "The cat sat on the mat and it was not at all sure that the dog, which barked, had gone away for good."
TEXTS = [
    None, "", "   \n\t ", "word", PROSE, PROSE + " " + PROSE, "\n".join([PROSE, "one line", "one line", "one line", "", " "]),
    "a a a a a a a a a a a a", "a b c d e " * 3, "x\x0by\x0cz\rw v u", "### && word | word * $ % < >" * 5,
    "GROß UND KLEIN und weiter im Text für das Haus. " * 2, "THIS!! IS!! LOUD!! AND!! LONG!! ENOUGH!! FOR!! THE!! RULE!! TO!! SEE!!",
    "日本語 のテキスト 🎉 " * 4, "Él y ella están en la casa de los padres con su perro y no hay más que decir.",
    "ab cd ef gh ij kl ab cd ef gh ij mn", "x" * 5000, "qwrt zxcv bnmp " * 20,
]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert rows(judged(docs)) == sorted(((i, *brute(t)) for i, t in enumerate(TEXTS)), key=repr)


def test_equals_brute_force_on_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = [(r.doc_id, *brute(r.text)) for r in docs.collect()]
    assert rows(judged(docs)) == sorted(want, key=repr)


def test_very_long_text(spark):
    unique = " ".join(f"word{i}" for i in range(60_000))
    long = unique + " the end of it all " + "over and over again it goes " * 2_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert rows(judged(docs)) == [(1, *brute(long))]


def test_nulls_repeats_and_clashing_columns(spark):
    names = "doc_id long, text string, __sm_text string, __sm_words int, n_words int, kept string, `a.b` int"
    data = [(None, PROSE, "x", 1, 2, "y", 3), (None, PROSE, "x", 1, 2, "y", 3), (5, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, names)
    got = rows(judged(docs))
    assert got == sorted([(None, *brute(PROSE))] * 2 + [(5, *brute(None))], key=repr)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == data[:2]


def test_empty_table_and_own_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert judged(empty).collect() == [] and kept_documents(empty).collect() == []
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert judged(docs, ()).first().kept
    strict = judged(docs, (Rule("short", "n_words", "n_words", most=50),)).first()
    assert strict.failed == "short" and not strict.kept


def test_no_python_in_the_plan(spark, small):
    plan = judged(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_labelled_documents(spark, small):
    """Documents labelled good are kept unless a base rule drops them; most of those labelled bad go."""
    folder = small.replace("0.001", "0.01")
    found = judged(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
