"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of token characters with a digit in them, and whatever
stands after an announcing word and ``=`` or ``:``, up to white space or a quote,
at any length and with or without a digit. The forest
knows a candidate's length, its character transitions, how much of it common
words of the corpus cover, the path it was found under and its neighbours. All
of it is Column expressions and Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import drawn, stored, table
from shelfmark.llm.registry import query

CANDIDATE = r"[A-Za-z0-9+/_\-]*[0-9][A-Za-z0-9+/_\-]*"
LEAST, NEAR = 8, 24
#: Words that announce a secret; any may be part of a longer name.
ANNOUNCING = ("token", "password", "passwd", "secret", "apikey", "api_key", "credential", "bearer", "auth", "private")
#: Where an announced value begins; the first two looks behind are there to pass other places fast.
ANNOUNCED = r"(?<=[=:\s\"'])(?<=[=:]\s{0,8}[\"']?)(?<=(?i:" + "|".join(ANNOUNCING) + r")[A-Za-z0-9_\-]{0,24}[\"']?\s{0,8}[=:]\s{0,8}[\"']?)"
FOUND = ANNOUNCED + r"[^\s\"']+|" + CANDIDATE
#: Formats of labelled findings. The name decides between 1 (a secret) and 0.
KNOWN_SECRETS = (
    r"(?i)(?:token|secret|api_?key|password|passwd)\s*[=:]\s*[\"']?$",  # what stands before
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$",  # the candidate itself
)
FEATURES = [
    "chars", "transitions", "digit_share", "upper_share", "lower_share", "symbol_share", "distinct_share", "longest_run", "hex", "covered",
    "announced", "assigned", "quoted", "word_before", "word_after", "path_chars", "path_depth", "path_digits",
]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 4_000) -> list[str]:
    """The most frequent words of three letters or more, counted over all texts; ties by the word."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z]+")).alias("w")).where(F.length("w").between(3, 20))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    return sorted(r.w for r in counts.orderBy(F.desc("n"), "w").limit(most).collect())


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per candidate: the named columns, ``at`` (its first code point, from 0), ``found``, and what is near.

    A null text has none. Repeated rows give repeated findings.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__sm_col_{i}") for i, c in enumerate(columns)], path.alias("__sm_path"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__sm_text"),
    )
    # Pieces between the candidates, and the candidates, in turn.
    split = rows.select(
        "*", F.split("__sm_text", FOUND).alias("__sm_between"), F.regexp_extract_all("__sm_text", F.lit(FOUND), F.lit(0)).alias("__sm_all"),
    ).where(F.size("__sm_all") > 0).drop("__sm_text").withColumn("__sm_row", F.monotonically_increasing_id())
    near = F.transform(
        "__sm_all",
        lambda c, i: F.struct(
            c.alias("found"), F.length(F.get("__sm_between", i)).alias("gap"),
            F.substring(F.get("__sm_between", i), F.greatest(F.length(F.get("__sm_between", i)) - NEAR + 1, F.lit(1)), F.lit(NEAR)).alias("before"),
            F.substring(F.get("__sm_between", i + 1), 1, NEAR).alias("after"),
            F.concat(F.when(i > 0, F.get("__sm_all", i - 1)).otherwise(F.lit("")), F.get("__sm_between", i)).rlike(ANNOUNCED + "$").alias("named"),
        ),
    )
    flat = split.select(*[c for c in split.columns if c not in ("__sm_between", "__sm_all")], F.posexplode(near).alias("__sm_turn", "c")).select("*", "c.*").drop("c")
    upto = Window.partitionBy("__sm_row").orderBy("__sm_turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("at", (F.sum(F.col("gap") + F.length("found")).over(upto) - F.length("found")).cast("long"))
    kept = placed.where((F.length("found") >= LEAST) | F.col("named"))
    return kept.select(*[F.col(f"__sm_col_{i}").alias(c) for i, c in enumerate(columns)], F.col("__sm_path"), "at", "found", "before", "after")


def features(found: DataFrame, dictionary: Sequence[str]) -> DataFrame:
    """The candidates with their features under ``__sm_`` names."""
    c, before, after, path = F.col("found"), F.col("before"), F.col("after"), F.col("__sm_path")
    size = F.length(c).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / size
    runs = F.regexp_replace(c, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")
    pieces = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    words = F.array_intersect(F.array_distinct(pieces), F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>"))
    last = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]*$", 1))
    values = {
        "chars": size, "transitions": (F.length(runs) - 1) / size, "digit_share": share("[^0-9]"), "upper_share": share("[^A-Z]"),
        "lower_share": share("[^a-z]"), "symbol_share": share("[A-Za-z0-9]"), "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / size,
        "longest_run": F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)), F.length)),
        "hex": c.rlike("^[0-9a-f]+$"), "covered": F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / size,
        "announced": last.rlike("|".join(ANNOUNCING)), "assigned": before.rlike("[=:]\\s*[\"']?$"), "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "word_before": F.length(last), "word_after": F.length(F.regexp_extract(after, "^[^A-Za-z]*([A-Za-z]+)", 1)),
        "path_chars": F.length(path), "path_depth": F.size(F.split(path, "/")), "path_digits": F.length(F.regexp_replace(path, "[^0-9]", "")),
    }
    return found.withColumns({f"__sm_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


def labelled_by_format(found: DataFrame) -> DataFrame:
    """The candidates with ``label``: 1 where a known format says secret, else 0."""
    before, own = KNOWN_SECRETS
    return found.withColumn("label", (F.col("before").rlike(before) | F.col("found").rlike(own)).cast("int"))


class SecretModel:
    """A forest, or one answer for all if the labels were of one kind."""

    def __init__(self, forest: PipelineModel | None, only: float):
        self.forest, self.only = forest, only

    def probability(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        if self.forest is None:
            return rows, F.lit(self.only)
        return self.forest.transform(rows), F.element_at(vector_to_array("__sm_probability"), 2)


def fit(labelled: DataFrame, dictionary: Sequence[str], *, most: int = 10_000, trees: int = 30, depth: int = 6) -> SecretModel:
    """A forest from at most ``most`` distinct labelled findings, half of them secrets at most, drawn by a hash.

    Findings with a null label teach nothing.
    """
    rows = labelled.where("label IS NOT NULL").select("__sm_path", "found", "before", "after", "label")
    halves = [drawn(rows.where(F.col("label") == kind), most // 2, ["found", "before", "after", "__sm_path"]) for kind in (0, 1)]
    taught = stored(features(halves[0].unionByName(halves[1]), dictionary).withColumn("__sm_label", F.col("label").cast("double")).coalesce(1))
    kinds = [r["__sm_label"] for r in taught.select("__sm_label").distinct().collect()]
    if len(kinds) < 2:
        return SecretModel(None, kinds[0] if kinds else 0.0)
    assemble = VectorAssembler(inputCols=[f"__sm_{f}" for f in FEATURES], outputCol="__sm_features")
    forest = RandomForestClassifier(featuresCol="__sm_features", labelCol="__sm_label", numTrees=trees, maxDepth=depth, seed=11,
                                    predictionCol="__sm_prediction", rawPredictionCol="__sm_raw", probabilityCol="__sm_probability")
    return SecretModel(Pipeline(stages=[assemble, forest]).fit(taught), 0.0)


def scan(found: DataFrame, model: SecretModel, dictionary: Sequence[str], columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The named columns, at, chars, found, score and secret for every candidate; secret where the score is 0.5 or more."""
    rows, score = model.probability(features(found, dictionary))
    return rows.select(*[F.col(f"`{c}`") for c in columns], "at", F.length("found").cast("long").alias("chars"), "found",
                       F.round(score, 6).alias("score"), (score >= 0.5).alias("secret"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    dictionary = frequent_words(docs)
    found = stored(candidates(docs))
    rows = scan(found, fit(labelled_by_format(found), dictionary), dictionary)
    return rows.select("doc_id", "at", "chars", F.sha2("found", 256).alias("found_sha256"), "score", "secret")
