import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import golden as gd
from shelfmark.operators import merge as mg
from shelfmark.operators.embedding import embed, hashed_embedder, hashed_words
from shelfmark.plans.ingest import Profile
from shelfmark.sources import files, pages
from shelfmark.sources import golden as gold
from shelfmark.sources import tickets as tk
from shelfmark.sources.tables import PageTable
from shelfmark.streaming import arrivals as stream_arrivals
from shelfmark.streaming import sync

CHUNKS = (
    "chunk_id string, page_id string, title string, space_key string, content string, vector array<float>"
)


def chunk_rows(spark, rows):
    return spark.createDataFrame(
        [(c, p, "t", s, text, [1.0]) for c, p, s, text in rows], CHUNKS
    )


def contents(df):
    return {(r["page_id"], r["chunk_id"]): r["content"] for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = PageTable(spark, str(tmp_path / "table"), CHUNKS, buckets=4)
    first = chunk_rows(spark, [(f"p{p}_{i}", f"p{p}", "A", f"old {p} {i}") for p in range(10) for i in range(3)])
    made.replace(first.select("page_id").distinct(), first)
    return made


def test_replace_touches_only_given_pages(spark, table):
    before = contents(table.read())
    assert len(before) == 30
    touched = spark.createDataFrame([("p1",), ("p2",), ("p99",)], "page_id string")
    fresh = chunk_rows(spark, [("p1_0", "p1", "A", "new"), ("p99_0", "p99", "A", "new page")])
    for _ in range(2):  # again gives the same
        table.replace(touched, fresh)
        after = contents(table.read())
        assert after[("p1", "p1_0")] == "new" and ("p1", "p1_1") not in after
        assert not [k for k in after if k[0] == "p2"]  # touched without new rows
        assert len(after) == 30 - 6 + 2
        assert {k: v for k, v in after.items() if k[0] not in ("p1", "p2", "p99")}.items() <= before.items()


def test_same_batch_is_applied_once_and_dead_attempts_stay_hidden(spark, table):
    one = spark.createDataFrame([("p1",)], "page_id string")
    table.replace(one, chunk_rows(spark, [("p1_0", "p1", "A", "first")]), batch="b1")
    table.replace(one, chunk_rows(spark, [("p1_0", "p1", "A", "second")]), batch="b1")
    assert contents(table.read())[("p1", "p1_0")] == "first"
    # Rows written by a job that died before publishing.
    orphan = chunk_rows(spark, [("p1_9", "p1", "A", "orphan")]).withColumn("generation", F.lit("999999999999-dead")).withColumn("bucket", F.lit(1))
    orphan.write.mode("append").partitionBy("generation", "bucket").parquet(table.rows_path)
    assert ("p1", "p1_9") not in contents(table.read())


def test_upsert_delete_truncate(spark, table):
    table.upsert(chunk_rows(spark, [("p3_1", "p3", "A", "changed"), ("p3_7", "p3", "A", "added")]), "chunk_id")
    rows = contents(table.read())
    assert rows[("p3", "p3_1")] == "changed" and rows[("p3", "p3_7")] == "added" and len(rows) == 31
    table.delete(spark.createDataFrame([("p3",)], "page_id string"))
    assert len(contents(table.read())) == 27
    table.truncate()
    assert table.read().count() == 0


def test_upsert_keeps_columns_and_fills_defaults(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, born int")
    new = spark.createDataFrame([("a", "X", 9), ("c", "Z", 9)], "k string, v string, born int")
    rows = sorted(tuple(r) for r in mg.upsert(base, new, "k", keep=("born",)).collect())
    assert rows == [("a", "X", 1), ("b", "y", 2), ("c", "Z", 9)]
    short = new.drop("born")
    rows = sorted(tuple(r) for r in mg.upsert(base, short, "k", defaults={"born": F.lit(0)}).collect())
    assert rows == [("a", "X", 1), ("b", "y", 2), ("c", "Z", 0)]


def test_stale_pages_rules(spark):
    shape = "space_key string, page_id string"
    stored = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "local_1"), ("B", "3"), ("C", "4")], shape)
    live = spark.createDataFrame([("A", "1"), ("C", "9")], shape)
    spaces = spark.createDataFrame([("A",), ("B",)], "space_key string")
    # B has no live listing, C is not configured, local pages are exempt.
    assert [tuple(r) for r in mg.stale_pages(stored, live, spaces).collect()] == [("A", "2")]


PAGE = {
    "id": "1", "title": "Test Page", "space": {"key": "IT", "name": "Ops"}, "body": {"storage": {"value": "<p>content</p>"}},
    "version": {"number": 3, "when": "2024-01-01T00:00:00.000Z", "by": {"displayName": "Someone"}},
    "ancestors": [{"id": "7", "title": "Root"}], "metadata": {"labels": {"results": [{"name": "approved"}]}},
    "_links": {"webui": "/x"}, "unknown": 1,
}


def land(folder, *records):
    folder.mkdir(exist_ok=True)
    name = folder / f"{len(list(folder.iterdir()))}.json"
    name.write_text("\n".join(json.dumps(r) for r in records))


def test_page_json(spark, tmp_path):
    land(tmp_path / "in", PAGE, {"id": "2"})
    rows = {r["page_id"]: r.asDict() for r in pages.page_metadata(pages.read_pages(spark, str(tmp_path / "in")), "https://w").collect()}
    assert rows["1"]["url"] == "https://w/x" and rows["1"]["ancestors"] == ["Root"] and rows["1"]["labels"] == ["approved"]
    assert rows["2"]["title"] == "" and rows["2"]["labels"] == [] and rows["2"]["version"] == 1 and rows["2"]["html"] == ""
    assert pages.read_pages(spark, str(tmp_path / "in"), "IT").count() == 1


def version(number, body, page="1", labels=(), space="IT"):
    return {
        **PAGE, "id": page, "space": {"key": space}, "body": {"storage": {"value": body}}, "version": {**PAGE["version"], "number": number},
        "metadata": {"labels": {"results": [{"name": x} for x in labels]}},
    }


def test_sync_stream(spark, tmp_path):
    landing, store, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ckpt")
    table = PageTable(spark, store, CHUNKS, buckets=4)
    profile = Profile(dimensions=8)

    def run():
        query = sync.sync_stream(pages.stream_pages(spark, str(landing)), table, profile, marks)
        query.awaitTermination()

    land(landing, version(1, "<p>one</p>"), version(2, "<p>two</p>"), version(1, "<p>keep</p>", "2"), version(1, "<p>draft</p>", "3", ["draft"]))
    run()
    assert contents(table.read()) == {
        ("1", "1_0"): "Page: Test Page\nPath: Root\n\ntwo", ("2", "2_0"): "Page: Test Page\nPath: Root\n\nkeep"}
    land(landing, version(3, "<h1>a</h1><p>x</p><h1>b</h1><p>y</p>"), version(2, "<p>gone</p>", "2", ["archived"]))
    run()
    run()  # nothing new
    assert sorted(contents(table.read())) == [("1", "1_0"), ("1", "1_1")]
    live = spark.createDataFrame([("IT", "5")], "space_key string, page_id string")
    sync.delete_stale(table, live, spark.createDataFrame([("IT",)], "space_key string"))
    assert table.read().count() == 0


def test_stateful_twins_agree_with_batch(spark, tmp_path):
    from shelfmark.operators import arrivals as ar

    shape = "event_id long, client string, ts timestamp"
    rows = spark.range(600).select(
        F.col("id").alias("event_id"), F.concat(F.lit("k"), F.col("id") % 4).alias("client"),
        F.timestamp_seconds(1_700_000_000 + F.floor(F.pow(F.col("id"), 1.3))).alias("ts"),
    )
    for part in range(3):
        rows.where(f"event_id div 200 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return {tuple(r) for r in spark.table(name).drop("ts").collect()}

    def source():
        return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))

    limited = drain(stream_arrivals.rate_limit_stream(source(), burst=2, per_minute=6), "limited")
    assert limited == {tuple(r) for r in ar.rate_limit(rows, burst=2, per_minute=6).drop("ts").collect()}
    single = drain(stream_arrivals.suppress_duplicates_stream(source(), "client", quiet_seconds=30), "single")
    assert single == {tuple(r) for r in ar.suppress_duplicates(rows, "client", quiet_seconds=30).drop("ts").collect()}

    # A very late event and one without a time get rows too; the checkpoints know what came before.
    odd = spark.sql("SELECT 900L event_id, 'k1' client, timestamp'2001-01-01' ts UNION ALL SELECT 901L, 'k1', NULL")
    odd.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    query = stream_arrivals.rate_limit_stream(source(), burst=2, per_minute=6).writeStream.format("memory").queryName("late")
    query.option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.table("late").collect()}
    assert len(got) == 602 and got[900] is not None and got[901] is None


def golden(number, **changes):
    return json.dumps({"queryId": f"q{number}", "query": "what", "relevantChunkIds": ["a"], "extra": 1, **changes})


def test_golden_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join([golden(1), "", "   ", golden(2)]))
    cases = gold.load_golden(spark, str(good))
    assert sorted(r["query_id"] for r in cases.collect()) == ["q1", "q2"]
    assert gold.relevant_pairs(cases).count() == 2
    for lines, message in [
        ([golden(1), "{oops"], "line 2: malformed"), ([golden(1), "", golden(1)], "line 3: duplicate"),
        ([golden(1, relevantChunkIds=[])], "line 1: empty"), ([golden(1, query=None)], "missing query"), (["", " "], "empty"),
    ]:
        bad = tmp_path / "bad.jsonl"
        bad.write_text("\n".join(lines))
        with pytest.raises(gold.GoldenSetError, match=message):
            gold.load_golden(spark, str(bad))


def test_line_numbers_across_splits(spark, tmp_path):
    for name, count in (("a", 500), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f"{name}{i}" for i in range(1, count + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = gold.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 800
    assert all(r["line"][1:] == str(r["line_number"]) for r in rows)


def test_golden_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(f"p{p}_{i}", f"p{p}", "T", "IT", i, f"Sentence {i}. More.") for p in range(5) for i in range(4)] + [("p9_0", "p9", "T", "IT", 0, "no end")],
        "chunk_id string, page_id string, title string, space_key string, chunk_index long, content string",
    )
    samples = [
        [r["chunk_id"] for r in gd.sample_chunks(chunks.repartition(n), 8, seed=5).orderBy("place").collect()] for n in (1, 4, 16)
    ]
    assert samples[0] == samples[1] == samples[2] and len(samples[0]) == 8
    assert samples[0] != [r["chunk_id"] for r in gd.sample_chunks(chunks, 8, seed=6).orderBy("place").collect()]
    sample = gd.sample_chunks(chunks, 21)

    def generator():
        return lambda texts: [ValueError("no sentence") if "." not in t else [(t.split(".")[0] + "?", "why")] for t in texts]

    asked = gd.generate_questions(sample, generator)
    assert asked.where("error IS NOT NULL").count() == 1
    numbered = gd.number_queries(asked)
    assert sorted(r["query_id"] for r in numbered.collect()) == [f"q_{i:03d}" for i in range(1, 21)]
    records = gd.golden_records(numbered, gd.neighbours(sample, chunks), "test", "now")
    first = records.orderBy("queryId").first()
    assert len(first["relevantChunkIds"]) == 4
    source = numbered.orderBy("query_id").first()["source_chunk_id"]
    assert first["relevantChunkIds"][0] == source
    gold.write_golden(records, str(tmp_path / "golden"))
    assert gold.load_golden(spark, str(tmp_path / "golden")).count() == 20


def test_local_files(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a" / "b").mkdir(parents=True)
    (root / "top.TXT").write_text("one\n\ntwo & three")
    (root / "a" / "b" / "deep.md").write_text("# Title\n\ntext")
    (root / "skip.bin").write_text("x")
    found = files.scan_files(spark, str(root))
    rows = {r["relative_path"]: r.asDict() for r in files.file_pages(found).join(found.select("relative_path", F.col("file_path").alias("url")), "url").collect()}
    assert set(rows) == {"top.TXT", "a/b/deep.md"}
    assert rows["top.TXT"]["html"] == "<p>one</p>\n<p>two &amp; three</p>" and rows["top.TXT"]["ancestors"] == []
    deep = rows["a/b/deep.md"]
    assert deep["html"] == "<h1>Title</h1>\n<p>text</p>" and deep["ancestors"] == ["a", "b"] and deep["title"] == "deep"
    assert deep["page_id"].startswith("local_") and len(deep["page_id"]) == 18
    assert files.scan_files(spark, str(tmp_path / "missing")).count() == 0


def test_attachments(spark, tmp_path):
    folder = tmp_path / "att"
    folder.mkdir()
    for name, size in (("a.png", 10), ("b.png", 5000), ("c.pdf", 10)):
        (folder / name).write_bytes(b"x" * size)
    listing = spark.createDataFrame(
        [(n, files.full_path(spark, str(folder / n)), m, s) for n, m, s in
         (("a.png", "image/png", 10), ("b.png", "image/png", 10), ("c.pdf", "application/pdf", 10))],
        "attachment_id string, file_path string, media_type string, file_size long",
    )
    assert [r["attachment_id"] for r in files.read_attachments(spark, str(folder), listing, 100).collect()] == ["a.png"]


def test_ticket_json(spark, tmp_path):
    land(tmp_path / "in", {"key": "IT-1", "fields": {"summary": "s", "description": "  text ", "reporter": None, "labels": None,
                                                    "assignee": {"accountId": "", "displayName": "x"}}}, {"key": "IT-2"})
    rows = {r["ticket_key"]: r.asDict() for r in tk.normalize_tickets(tk.read_tickets(spark, str(tmp_path / "in"))).collect()}
    assert rows["IT-1"]["description"] == "text" and rows["IT-1"]["assignee"] is None and rows["IT-1"]["labels"] == []
    assert rows["IT-2"]["summary"] == "" and rows["IT-2"]["status"] == ""
    land(tmp_path / "c", {"key": "IT-1", "comments": [{"id": "1", "author": {"accountId": "a", "displayName": "A"}, "body": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hi"}]}]}}, {}]})
    said = tk.normalize_comments(spark.read.schema(tk.COMMENTS).json(str(tmp_path / "c"))).orderBy("place").collect()
    assert [(r["author"], r["body"]) for r in said] == [("a", "hi"), ("", "")]


def test_embedders(spark):
    df = spark.createDataFrame([("a b A",), ("",), ("c\td  e",)], "text string")
    default = [r["vector"] for r in hashed_words(df, "text", width=16).collect()]
    assert default[1] is None and sum(default[0]) == 3 and sum(default[2]) == 3
    plugged = [r["vector"] for r in embed(df, "text", lambda: hashed_embedder(16), width=16, batch_size=2).collect()]
    assert plugged[0] == default[0] and plugged[2] == default[2]
    with pytest.raises(Exception, match="width"):
        embed(df, "text", lambda: hashed_embedder(8), width=16).collect()


def test_paged_source(spark, tmp_path):
    from shelfmark.sources.paged import PagedSource

    (tmp_path / "fake_wiki.py").write_text(
        "def count(params):\n    return 130 if params['space'] == 'IT' else 0\n\n"
        "def fetch(start, limit, params):\n"
        "    return [{'id': str(i), 'title': f'P {i}', 'space': {'key': params['space']}} for i in range(start, start + limit)]\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fake_wiki.py"))
    spark.dataSource.register(PagedSource)

    def load(space):
        reader = spark.read.format("paged").option("fetch", "fake_wiki:fetch").option("count", "fake_wiki:count")
        return reader.option("pages_per_task", 1).option("page_size", 50).option("param.space", space).load()

    raw = load("IT")
    assert raw.rdd.getNumPartitions() == 3
    found = pages.page_metadata(pages.parse_pages(raw, "json"))
    assert found.count() == 130 and found.select("page_id").distinct().count() == 130
    assert {r["space_key"] for r in found.collect()} == {"IT"}
    assert load("EMPTY").count() == 0


def test_questions_are_numbered_in_blocks(spark):
    q = lambda n: [{"question": f"q{i}", "rationale": "r"} for i in range(n)]
    rows = [(place, f"c{place}", "p", "t", "s", q(place % 3) if place % 5 else None) for place in range(9000)]
    shape = "place int, chunk_id string, page_id string, title string, space_key string, questions array<struct<question: string, rationale: string>>"
    numbered = gd.number_queries(spark.createDataFrame(rows, shape).repartition(5))
    got = sorted((int(r.query_id[2:]), int(r.source_chunk_id[1:]), r.query) for r in numbered.collect())
    want = [(place, f"q{i}") for place, _, _, _, _, qs in rows for i in range(len(qs or []))]
    assert [(p, t) for _, p, t in got] == want and [n for n, _, _ in got] == list(range(1, len(want) + 1))


def test_broken_golden_lines_do_not_meet(spark):
    lines = ["{", "[]", '{"queryId": "a", "query": "x", "relevantChunkIds": ["1"]}'] * 3
    frame = spark.createDataFrame(list(enumerate(lines)), "line_number long, line string")
    problems = [r.problem for r in gd.check_golden_lines(frame).orderBy("line_number").collect()]
    assert problems == ["malformed JSON", "missing queryId", None, "malformed JSON", "missing queryId", "duplicate queryId", "malformed JSON", "missing queryId", "duplicate queryId"]
