import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import filters as fl
from shelfmark.operators import golden as gd
from shelfmark.operators import records as rc
from shelfmark.operators import retrieval as rt
from shelfmark.operators import triage as tr


def stated_override(path, hits, retrievals, clarifications, context, confidence):
    """The rules in words: unsure goes to people; an empty cache means looking things up; looking up happens
    once, and then there is either something to answer with, or nothing left to ask."""
    if confidence < 0.4:
        return "escalate"
    looking_up = path == "need_context" or (path == "use_cache" and hits == 0)
    if not looking_up:
        return path
    if retrievals == 0:
        return "need_context"
    return "answer" if context or hits or clarifications >= 2 else "ask_reporter"


def test_overrides_on_the_full_grid(spark):
    grid = itertools.product(
        ("use_cache", "need_context", "answer", "ask_reporter", "escalate"), (0, 1, 4), (0, 1, 2), (0, 1, 2, 3), (False, True), (0.0, 0.39, 0.4, 1.0)
    )
    rows = list(grid)
    names = ["path", "hits", "retrievals", "clarifications", "context", "confidence"]
    frame = spark.createDataFrame(rows, "path string, hits int, retrievals int, clarifications int, context boolean, confidence double")
    c = {name: F.col(name) for name in names}
    chosen = tr.overrides(c["path"], c["confidence"], c["hits"], c["retrievals"], c["clarifications"], c["context"])
    for r in frame.withColumn("chosen", chosen).collect():
        assert r["chosen"] == stated_override(*[r[n] for n in names]), r


def labels_kept(spark, labels, include=None, exclude=fl.EXCLUDED_LABELS):
    df = spark.createDataFrame([(labels,)], "labels array<string>")
    return df.where(fl.keep_by_labels(F.col("labels"), include, exclude)).count() == 1


def test_labels(spark):
    assert labels_kept(spark, [])
    assert labels_kept(spark, None)
    assert not labels_kept(spark, ["draft", "good"], ["good"])
    assert labels_kept(spark, ["good", None], ["good"])
    assert not labels_kept(spark, ["other"], ["good"])
    assert labels_kept(spark, ["draft"], None, None)


def test_label_overlap_filter_on_search(spark):
    df = spark.createDataFrame([("a", "S", ["x"]), ("b", "S", None), ("c", "T", ["x", None])], "chunk_id string, space_key string, labels array<string>")
    assert rt.filter_chunks(df).count() == 3
    assert [r["chunk_id"] for r in rt.filter_chunks(df, space="T", labels=["x"]).collect()] == ["c"]
    assert rt.filter_chunks(df, space="", labels=[]).count() == 3


def test_rules_first_match_and_unique_ids(spark):
    df = spark.createDataFrame(
        [("Service Request", "Zugriff auf Grafana", "ich brauche"), ("Bug", "Zugriff kaputt", ""), ("service request", "New laptop", ""),
         ("Service Request", "Need admin permission", "thanks"), ("Service Request", "accessory", "")],
        "t string, s string, d string",
    )
    access = tr.access_request_rule(F.col("t"), F.col("s"), F.col("d"), "DE", "EN")
    every = tr.Rule("every", F.lit(True), F.lit("x"))
    rows = df.select(tr.first_rule([access]).alias("id"), tr.first_rule([access], "reply").alias("r"), tr.first_rule([access, every]).alias("b"))
    assert [tuple(r) for r in rows.collect()] == [
        ("access-request", "DE", "access-request"), (None, None, "every"), (None, None, "every"),
        ("access-request", "EN", "access-request"), (None, None, "every")]
    with pytest.raises(ValueError, match="unique"):
        tr.first_rule([every, every])


def test_action_plans(spark):
    df = spark.createDataFrame(
        [("answered", "r"), ("clarification", "r"), ("clarification", None), ("escalated", "r"), ("handler", "r")], "o string, r string"
    )
    plan = tr.action_plan(F.col("o"), F.col("r"), rule_transition=F.lit("resolve"), rule_to_reporter=F.lit(False))
    assert [r[0] for r in df.select(tr.describe_actions(plan)).collect()] == [
        "addComment,transition:resolve", "addComment,transition:waiting-for-reporter,assignIssue:r",
        "addComment,transition:waiting-for-reporter", "addComment", "addComment,transition:resolve"]


def test_roles_and_tools(spark):
    claims = [
        ('{"realm_access": {"roles": ["a", "b"]}, "role": "c"}', "x", "a", "x"), ('{"role": "c"}', " ", "c", "default"),
        ('{"role": 1}', None, "default", "default"), ("broken", " y ", "default", "y"),
    ]
    df = spark.createDataFrame([c[:2] for c in claims], "claims string, header string")
    out = df.select(
        fl.resolve_role(F.col("claims"), [F.col("header")], verified=True), fl.resolve_role(F.col("claims"), [F.col("header")], verified=False)
    ).collect()
    assert [tuple(r) for r in out] == [c[2:] for c in claims]
    asked = spark.createDataFrame([("admin",), ("stranger",)], "role string")
    shape = "role string, tools array<string>"
    grants = spark.createDataFrame([("admin", ["t2", "t1"])], shape)
    tools = lambda g, **o: {r["role"]: r["allowed_tools"] for r in fl.allowed_tools(asked, g, ["t1", "t2", "t3"], **o).collect()}
    assert tools(grants) == {"admin": ["t1", "t2"], "stranger": []}
    assert tools(grants.union(spark.createDataFrame([("default", ["t3"])], shape))) == {"admin": ["t1", "t2"], "stranger": ["t3"]}
    assert tools(grants, restricted=False) == {"admin": ["t1", "t2", "t3"], "stranger": ["t1", "t2", "t3"]}
    with pytest.raises(ValueError, match="admin"):
        fl.check_tool_config({"admin": "t1"})


def test_profile_checks(spark):
    df = spark.createDataFrame([("ok_1",), ("default",), ("1bad",), ("twice",), ("twice",), (None,)], "name string")
    problems = {(r["name"], r["problem"]) for r in fl.check_profiles(df).collect()}
    assert problems == {("ok_1", None), ("default", "reserved name"), ("1bad", "invalid identifier"), ("twice", "duplicate name"), (None, "invalid identifier")}
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    registry = spark.createDataFrame([("a", "t", "p", "m", 3)], "profile_name string, table_name string, embedding_provider string, embedding_model string, embedding_dimensions int")
    missing = {r["name"]: r["error"] for r in fl.resolve_profiles(names, registry, None).collect()}
    assert missing["a"] is None and "not found" in missing["b"]


def test_chunk_metadata_checks(spark):
    metas = ['{"chunkIndex": 1, "totalChunks": 2, "headerPath": ["a", 3, "b"]}', '{"missing": true}', '{"chunkIndex": "1", "totalChunks": 2}',
             '{"chunkIndex": 1.5, "totalChunks": 2}', None, '{"chunkIndex": 0, "totalChunks": 1, "headerPath": "x", "spaceName": "S"}']
    df = spark.createDataFrame([(f"c{i}", "p", None, None, "text", m) for i, m in enumerate(metas)],
                               "chunk_id string, page_id string, title string, space_key string, content string, metadata string")
    rows = {r["chunk_id"]: r for r in gd.valid_chunks(df).collect()}
    assert set(rows) == {"c0", "c5"}
    assert rows["c0"]["header_path"] == ["a", "b"] and rows["c0"]["title"] == "" and rows["c5"]["space_name"] == "S"


def test_ticket_events(spark):
    lines = ['{"webhookEvent": "jira:issue_created", "issue": {"key": "A-1", "more": 1}}', '{"webhookEvent": "jira:issue_updated"}', "oops",
             '{"webhookEvent": "other", "issue": {"key": "A-2"}}', '{"webhookEvent": "jira:issue_updated", "issue": {"key": ""}}']
    df = spark.createDataFrame([(x,) for x in lines], "payload string")
    assert [r["ticket_key"] for r in fl.issue_events(df).collect()] == ["A-1"]


def test_poll_page_is_the_oldest(spark):
    df = spark.createDataFrame([(f"A-{i}", "A", "bot", "new", [], f"2024-01-0{9 - i}") for i in range(5)],
                               "ticket_key string, project_key string, assignee string, status_category string, labels array<string>, created string")
    assert [r["ticket_key"] for r in fl.tickets_to_process(df, "A", "bot", page=2).collect()] == ["A-4", "A-3"]


def test_claims(spark):
    df = spark.createDataFrame([("A", "claim", 1, 1), ("A", "finish", 2, 2), ("B", "claim", 1, 3), ("B", "clarify", 5, 4), ("C", "note", 1, 5)],
                               "ticket_key string, event string, ts long, event_id long")
    assert {r["ticket_key"]: r["status"] for r in tr.claim_status(df).collect()} == {"A": "done", "B": "none"}


def test_usage_and_providers(spark):
    df = spark.createDataFrame([("r", 1, 2, "stop", 2), ("r", None, None, None, 1), ("r", 3, 4, "length", 3), ("r", 0, 0, "stop", 4)],
                               "request_id string, input_tokens long, output_tokens long, finish_reason string, seq long")
    assert tuple(rc.token_usage(df).first()) == ("r", 4, 6, 4, 10)
    assert rc.finish_reasons(df).first()["finish_reasons"] == ["stop", "length"]
    models = spark.createDataFrame([("claude-1",), ("gpt-4",), ("o3",), ("gemini-x",), ("llama",), (None,)], "m string")
    assert [r[0] for r in models.select(rc.provider_of(F.col("m"))).collect()] == ["anthropic", "openai", "openai", "gemini", None, None]


def test_blocks_of_a_models_input(spark):
    df = spark.createDataFrame([("T-1", 0.925, True, "q?", "done"), ("T-2", 0.8, False, "r?", "no")], "k string, s double, strong boolean, q string, r string")
    line = tr.cache_hit_line(F.col("k"), F.col("s"), F.col("strong"), F.col("q"), F.col("r"))
    lines = [r[0] for r in df.orderBy("k").select(line).collect()]
    assert lines[1] == "[T-2 — similarity 0.80]\nQuestion: r?\nResolution: no" and ", strong match]" in lines[0]
    none = F.lit(None).cast("array<string>")
    row = spark.range(1).select(
        tr.cache_hits_block(F.array(F.lit("a"), F.lit("b"))).alias("hits"), tr.cache_hits_block(none).alias("no_hits"), tr.comments_block(none).alias("silent"),
        tr.comment_line(F.lit("me"), F.lit("Bot"), F.lit("hi"), "me").alias("own"), tr.comment_line(F.lit("x"), F.lit("Ann"), F.lit("ho"), "me").alias("other"),
    ).first()
    assert row.hits == "<similar_resolved_tickets>\na\n---\nb\n</similar_resolved_tickets>"
    assert row.no_hits == "<similar_resolved_tickets>\n(none)\n</similar_resolved_tickets>" and row.silent == "<comments>\n(none)\n</comments>"
    assert row.own == "[agent (you) — Bot]\nhi" and row.other == "[reporter/user — Ann]\nho"


def test_a_join_of_tickets_and_hits_has_tasks_by_the_size_of_the_input(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shelfmark.operators import spread as sp
    from shelfmark.operators import triage as tr

    shape = "ticket_key string, issue_type string, status string, reporter_name string, summary string, description string"
    tickets = spark.createDataFrame([(f"T-{i}", "Bug", "new", None, "s", "") for i in range(60)], shape)
    hits = tickets.select("ticket_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).where("ticket_key != 'T-3'").select(
        "*", F.lit("H").alias("hit_key"), F.lit(0.9).alias("score"), F.lit(False).alias("strong"), F.lit("q").alias("question"), F.lit("r").alias("resolution")
    )
    monkeypatch.setattr(sp, "JOIN_BYTES", max(1, sp.input_bytes(tickets) // 37))
    assert 30 <= sp.join_parts(tickets, hits) <= 40 and sp.join_parts(spark.range(1)) >= spark.sparkContext.defaultParallelism
    nothing = spark.createDataFrame([], "ticket_key string, place long, author string, author_name string, body string")
    parts = tr.prompt_parts(tickets, nothing, spark.createDataFrame([], "ticket_key string, context string"), "a", hits).where("section = 2")
    assert "REPARTITION_BY_NUM" in parts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ticket_key, r.place) for r in parts.collect()) == sorted([("T-3", 0)] + [(f"T-{i}", p) for i in range(60) if i != 3 for p in (1, 2)])
