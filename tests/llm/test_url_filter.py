"""Rules against a plain statement of them; the trees by held-out accuracy."""

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.url_filter import RULES, UrlModel, fit, judge, labelled_by_words, op8_url_filter

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/fr/", "http://example.com/de/x?y#z", "http://www.example.com/en/", "http://x.org/fr/1", "http://x.org/fr",
    "http://net/", "http://net", "http://planet/", "http://myexample.com/de/", "no scheme/net/", None, "", "://b.net/a", "http://a.net?x=/", "HTTP://A.Net#/",
    "http://ÄÖ.NET/", "x://y://z.net/", "http://example.net/en", "http://example.net/EN/", "http://a.com/\nb?c",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_rules_hosts_and_paths(spark):
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in judge(frame, UrlModel(None, None, "allow"), columns=["page_id"]).collect()}
    for i, url in enumerate(URLS):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == plain(url), url


def test_trees_judge_unseen_hosts(spark):
    urls = table(spark, "/root/testdata/sf0.1", "pages").select("url").distinct()
    labelled = labelled_by_words(urls)
    host = F.regexp_extract("url", "://([^/]*)", 1)
    held = F.pmod(F.xxhash64(host), F.lit(4)) == 0
    model = fit(labelled.where(~held))
    got = judge(labelled.where(held), model, rules=(), columns=["bad"]).groupBy("bad", "verdict").count().collect()
    right = sum(r["count"] for r in got if (r.bad == 1) == (r.verdict == "block"))
    assert right / sum(r["count"] for r in got) > 0.95


def test_suffix_statistics_are_those_of_all_rows(spark):
    rows = [(f"http://h{i}.s{i % 40}/", int(i % 40 < 10)) for i in range(800)]
    model = fit(spark.createDataFrame(rows, "url string, bad int"), most=30)
    got = {r["__sm_suffix"]: r["__sm_suffix_share"] for r in model.suffixes.collect()}
    assert len(got) == 40 and model.share == 1 / 4
    assert all(abs(v - (20 * (int(k[1:]) < 10) + 5 / 4) / 25) < 1e-9 for k, v in got.items())


def test_one_kind_of_label_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    for kind, verdict in ((0, "allow"), (1, "block")):
        model = fit(frame.withColumn("bad", F.lit(kind)))
        assert [r.verdict for r in judge(frame, model).collect()] == [verdict] * 3
    assert judge(frame.where("false"), fit(labelled_by_words(frame.where("false")))).count() == 0


def test_query_reads_every_page(spark, small):
    pages = {r.page_id: r.url for r in table(spark, small, "pages").collect()}
    rows = op8_url_filter(spark, small).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


@pytest.mark.parametrize("text", ["SortMergeJoin", "Python", "Arrow", "Pandas"])
def test_plan_is_native(spark, small, text):
    plan = op8_url_filter(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert text not in plan
