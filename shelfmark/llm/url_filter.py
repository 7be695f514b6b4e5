"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is Column expressions and Spark ML. The trees never see the words of
a URL: they learn its shape from labelled URLs, so they also judge hosts that no
list has.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import drawn, stored, table
from shelfmark.llm.registry import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_chars", "host_chars", "path_chars", "depth", "labels", "longest_label", "hyphens", "digit_ratio", "letter_ratio", "vowel_ratio",
    "host_entropy", "parameters", "fragment", "suffix_share", "suffix_rows",
]


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Words whose hosts label URLs as bad for training; hosts without them count as good.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def host_of(url: str | Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, host and path counted together; null if none does."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        named = F.when(fits, rule.host + rule.path).otherwise(named)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return named, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with lexical features of the URL under ``__sm_`` names; ``__sm_suffix`` is the host's last label."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), host_of(url_col), path_of(url_col)
    rows = urls.withColumns({"__sm_url": url, "__sm_host": host, "__sm_path": path})
    host, path, url = F.col("__sm_host"), F.col("__sm_path"), F.col("__sm_url")
    labels = F.split(host, r"\.")
    part = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host)
    letters = F.array_distinct(F.filter(F.split(host, ""), lambda c: c != ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda s, c: s - part(c) * F.log2(part(c)))
    found = {
        "url_chars": F.length(url), "host_chars": F.length(host), "path_chars": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")), "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, F.length)), "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "digit_ratio": _share(url, "[^0-9]"), "letter_ratio": _share(host, "[^a-z]"), "vowel_ratio": _share(host, "[^aeiou]"),
        "host_entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")), "fragment": F.instr(url, "#") > 0,
    }
    return rows.withColumns({f"__sm_{k}": v.cast("double") for k, v in found.items()}).withColumn("__sm_suffix", _suffix(host))


def _suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


class UrlModel(NamedTuple):
    """Trees and suffix statistics; ``only`` is the verdict if the labels were of one kind or none, ``share`` the part of bad rows."""

    trees: PipelineModel | None
    suffixes: DataFrame | None
    only: str | None
    share: float = 0.0


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "bad", *, most: int = 8_000, trees: int = 12, depth: int = 3) -> UrlModel:
    """Boosted trees from at most ``most`` labelled URLs (``bad`` 0 or 1), drawn by a hash of the URL.

    Null URLs and labels teach nothing. The suffix statistics are those of all
    labelled rows, each repetition counted.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(url_col, F.col(label_col).cast("double").alias("__sm_label"))
    taught = stored(features(drawn(rows, most, [url_col, "__sm_label"]), url_col).coalesce(1))
    counts = {r["__sm_label"]: r["count"] for r in rows.groupBy("__sm_label").count().collect()}
    kinds = {r["__sm_label"] for r in taught.select("__sm_label").distinct().collect()}
    if len(kinds) < 2:
        return UrlModel(None, None, "block" if 1.0 in kinds else "allow")
    share = counts.get(1.0, 0) / sum(counts.values())
    sums = rows.groupBy(_suffix(host_of(url_col)).alias("__sm_suffix")).agg(F.sum("__sm_label").alias("b"), F.count("*").alias("n"))
    suffixes = stored(sums.select("__sm_suffix", ((F.col("b") + 5 * share) / (F.col("n") + 5)).alias("__sm_suffix_share"), F.log2(F.col("n") + 1.0).alias("__sm_suffix_rows")))
    joined = taught.join(suffixes, "__sm_suffix")
    assemble = VectorAssembler(inputCols=[f"__sm_{f}" for f in FEATURES], outputCol="__sm_features")
    boosted = GBTClassifier(featuresCol="__sm_features", labelCol="__sm_label", maxIter=trees, maxDepth=depth, seed=7,
                            predictionCol="__sm_prediction")
    return UrlModel(Pipeline(stages=[assemble, boosted]).fit(joined), suffixes, None, share)


def judge(urls: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, url_col: str = "url", columns: Sequence[str] = ()) -> DataFrame:
    """The named columns, host, path, rule and verdict of every row.

    A fitting rule decides, the longest first; else the trees, which block a
    URL that is likelier bad than good. A null or malformed URL has an empty
    host and path, so no rule; the trees judge it by the same features.
    Repeated rows get the same verdict, an empty table no rows.
    """
    rows = features(urls.select(*[F.col(f"`{c}`").alias(f"__sm_col_{i}") for i, c in enumerate(columns)], F.col(f"`{url_col}`").alias("__sm_given")), "__sm_given")
    if model.trees is None:
        guess = F.lit(model.only)
    else:
        rows = rows.join(model.suffixes, "__sm_suffix", "left")
        rows = rows.fillna({"__sm_suffix_share": model.share, "__sm_suffix_rows": 0.0})
        rows = model.trees.transform(rows)
        guess = F.when(F.col("__sm_prediction") == 1.0, "block").otherwise("allow")
    named, verdict = rule_of(F.col("__sm_host"), F.col("__sm_path"), rules)
    own = [F.col(f"__sm_col_{i}").alias(c) for i, c in enumerate(columns)]
    return rows.select(*own, F.col("__sm_host").alias("host"), F.col("__sm_path").alias("path"), named.alias("rule"), F.coalesce(verdict, guess).alias("verdict"))


def labelled_by_words(urls: DataFrame, url_col: str = "url", bad_words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """(url, bad): hosts with one of the words as a part between dots and hyphens are bad."""
    parts = F.split(host_of(url_col), r"[.\-]")
    return urls.select(F.col(url_col).alias("url"), F.arrays_overlap(parts, F.array(*map(F.lit, bad_words))).cast("int").alias("bad"))


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judge(pages, fit(labelled_by_words(pages)), columns=["page_id"])
