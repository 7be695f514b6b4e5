import pytest
from pyspark.sql import functions as F

from shelfmark.operators import metrics
from shelfmark.operators.inference import call_model, rewritten
from shelfmark.plans import evaluation as ev


def test_model_calls_fail_by_row_and_rewrites_fall_back(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "boom", True), (3, "blank", True), (4, "d", False)], "id long, q string, prior boolean")

    def make():
        answers = {"boom": ValueError("no"), "blank": "  "}
        return lambda texts: [answers.get(t, t.upper()) for t in texts]

    out = call_model(df, "q", make, "string", name="new", batch_size=2)
    rows = {r["id"]: r for r in out.withColumn("final", rewritten(F.col("q"), F.col("new"), F.col("prior"))).collect()}
    assert [rows[i]["final"] for i in (1, 2, 3, 4)] == ["A", "boom", "blank", "d"]
    assert rows[2]["new_error"] == "no" and rows[1]["new_error"] is None
    with pytest.raises(Exception, match="results"):
        call_model(df, "q", lambda: lambda texts: [], "string", name="new").collect()


def test_structured_results(spark):
    df = spark.createDataFrame([("x",)], "t string")
    kind = "struct<path: string, confidence: double>"
    out = call_model(df, "t", lambda: lambda ts: [{"path": "answer", "confidence": 0.9} for _ in ts], kind, name="decision")
    assert out.select("decision.path", "decision.confidence").first() == ("answer", 0.9)


def test_report_files(spark, tmp_path):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    cases = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<double>")
    relevant = spark.createDataFrame([("q", "a")], "query_id string, chunk_id string")
    scores = ev.evaluate_pairs(chunks, cases, relevant, k_values=[1, 2])
    means = metrics.aggregate(scores, [1, 2])
    ev.write_report(means, scores, str(tmp_path / "report"), "run")
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report" / "summary")).collect())
    assert "| 1 | 1.0000 | 1.0000 | 1.0000 |" in text and "- MRR: 1.0000" in text
    assert spark.read.json(str(tmp_path / "report" / "aggregated")).count() == 8
    assert spark.read.json(str(tmp_path / "report" / "per_query")).count() == 1


def test_queries_may_have_their_own_embedder(spark):
    from shelfmark.plans.answering import sub_query_hits

    questions = spark.createDataFrame([(1, "alpha and more beta"), (2, "gamma")], "question_id long, message string")
    corpus = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "chunk_id long, vector array<double>")

    def embed(asked):
        hot = F.when(F.col("sub_query").contains("alpha"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
        return asked.select("query_id", hot.alias("vector"))

    hits = sub_query_hits(questions, corpus, k=1, threshold=0.5, embed=embed).collect()
    assert {(r.question_id, r.sub_query, r.chunk_id) for r in hits} == {(1, "alpha and more beta", 10), (1, "alpha", 10), (1, "more beta", 11), (2, "gamma", 11)}
