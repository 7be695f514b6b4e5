"""Quality rules: a table of thresholds compiled into one projection.

A rule holds a share of two counts of a text, in percent, between two bounds;
a text must have ``from_words`` words before the rule applies. All counts and
rules are Column expressions, and comparisons are made in whole numbers, so no
rounding decides.

Words that belong to a repeated five-word window are found by sorting: windows
whose hash another window of the text has are sorted as strings, neighbours are
compared, and the places that repeat are covered from left to right. Texts
without two equal hashes skip the sorts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.registry import query

WINDOW = 5
# White space, symbols, and the bounds of the base rules.
WHITE = r"[\x20\x09-\x0D]+"
NO_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BASE_WORDS, BASE_REPEATED = 10, 20
#: What may stand around a stop word.
AROUND = ".,;:!?()"
#: Frequent function words of English, German, French and Spanish; also met with a capital, or in capitals.
STOP_WORDS = tuple(sorted(set((
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht oder sich sie sind um und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con del el ella esta este ha hay la las lo los más me mi muy no o para pero por si sin sobre su sus también un una y ya"
).split())))


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * count / per <= ``most``, for texts of ``from_words`` words or more; None leaves a side open."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0


#: The threshold table. Stop words are asked for only where a text is long enough to show them.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1_000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("exclamations", "n_exclamations", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=8, from_words=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=40),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")


def spellings(words: Sequence[str]) -> list[str]:
    """The words, also with a first capital and in capitals."""
    return sorted({s for w in words for s in (w, w.capitalize(), w.upper())})


def _only(text: Column, letters: str) -> Column:
    """How often the named ASCII characters occur."""
    return F.octet_length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "__sm_", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The rows with all counts as longs under ``prefix``. A null text counts as empty.

    The arrays are columns of their own in steps, because the functions over
    them read them at every element.
    """
    text, words, hashes = F.col(f"{prefix}text"), F.col(f"{prefix}words"), F.col(f"{prefix}hashes")
    order, near = F.col(f"{prefix}order"), F.col(f"{prefix}near")
    rows = docs.withColumn(f"{prefix}text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = rows.withColumns({
        f"{prefix}words": F.filter(F.split(text, WHITE), lambda w: w != ""),
        f"{prefix}lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(NO_WHITE)),
    })
    lines = F.col(f"{prefix}lines")
    windows = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    rows = rows.withColumn(
        f"{prefix}hashes",
        F.transform(F.slice(words, F.lit(1), windows), lambda w, i: F.xxhash64(w, *[words[i + step] for step in range(1, WINDOW)])),
    )
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn(f"{prefix}order", F.when(again, F.sort_array(numbered)).otherwise(F.slice(numbered, 1, 0)))
    # Windows that share their hash with another one, as strings: words hold no space.
    shared = F.filter(order, lambda s, k: _beside(order, k, s["h"], "h"))
    texts = F.transform(shared, lambda s: F.struct(F.array_join(F.slice(words, s["i"] + 1, WINDOW), " ").alias("w"), s["i"].alias("i")))
    rows = rows.withColumn(f"{prefix}near", F.sort_array(texts))
    starts = F.sort_array(F.transform(F.filter(near, lambda s, k: _beside(near, k, s["w"], "w")), lambda s: s["i"]))
    repeated = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
    )["n"]
    counts = {
        "n_words": F.size(words), "word_chars": F.char_length(F.array_join(words, "")), "n_symbols": _only(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeated, "n_exclamations": _only(text, "!"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.btrim(w, F.lit(AROUND)).isin(spellings(stop_words)))), "n_lines": F.size(lines),
    }
    rows = rows.withColumns({f"{prefix}{name}": value.cast("long") for name, value in counts.items()})
    return rows.drop(*[f"{prefix}{c}" for c in ("text", "words", "lines", "hashes", "order", "near")])


def _beside(sorted_array: Column, k: Column, value: Column, field: str) -> Column:
    """Whether the element before or after has the same value; both ends are passed by ``get``, which gives null there."""
    return F.coalesce(F.get(sorted_array, k - 1)[field] == value, F.lit(False)) | F.coalesce(F.get(sorted_array, k + 1)[field] == value, F.lit(False))


def failed_rules(rules: Sequence[Rule] = RULES, prefix: str = "__sm_") -> Column:
    """The names of the rules that a row breaks, in the table's order, as one array Column over the counts."""
    found = []
    for rule in rules:
        value, per = 100 * F.col(prefix + rule.count), F.col(prefix + rule.per)
        broken = F.lit(False)
        if rule.least is not None:
            broken = broken | (value < rule.least * per)
        if rule.most is not None:
            broken = broken | (value > rule.most * per)
        found.append(F.when(broken & (F.col(f"{prefix}n_words") >= rule.from_words), F.lit(rule.name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def base_failed(prefix: str = "__sm_") -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < BASE_WORDS) | (100 * repeated > BASE_REPEATED * words)


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The named columns, all counts, ``base_failed``, ``failed`` (rules broken, comma-joined) and ``kept`` for every row.

    A null or empty text has no words, so it fails the base rules; a share of
    nothing breaks no rule. Repeated rows are judged alike, one by one. An empty
    table gives no rows. Further columns, whatever their names, are not read;
    name them in ``columns`` to have them in the result.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"__sm_col_{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").alias("__sm_source"))
    rows = with_counts(own, "__sm_source")
    return rows.select(
        *[F.col(f"__sm_col_{i}").alias(c) for i, c in enumerate(columns)], *[F.col(f"__sm_{c}").alias(c) for c in COUNTS],
        base_failed().alias("base_failed"), F.array_join(failed_rules(rules), ",").alias("failed"),
        (~base_failed() & (F.size(failed_rules(rules)) == 0)).alias("kept"),
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass the base rules and the table, with all their columns; edge cases as in ``judged``."""
    names = docs.columns
    own = docs.toDF(*[f"__sm_col_{i}" for i in range(len(names))])
    rows = with_counts(own, f"__sm_col_{names.index(text_col)}")
    passed = rows.where(~base_failed() & (F.size(failed_rules(rules)) == 0))
    return passed.select(*[f"__sm_col_{i}" for i in range(len(names))]).toDF(*names)


def _sql_rule(rule: Rule) -> str:
    sides = []
    if rule.least is not None:
        sides.append(f"100 * {rule.count} < {rule.least} * {rule.per}")
    if rule.most is not None:
        sides.append(f"100 * {rule.count} > {rule.most} * {rule.per}")
    return f"CASE WHEN n_words >= {rule.from_words} AND ({' OR '.join(sides)}) THEN '{rule.name}' END"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{NO_WHITE}')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, words[i:i + {WINDOW - 1}] AS w FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT i + s) AS n FROM again, range(0, {WINDOW}) AS steps(s) GROUP BY r),
c AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_length_sum,
         length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
         len(list_filter(words, lambda w: trim(w, '{AROUND}') IN ({", ".join(f"'{w}'" for w in spellings(STOP_WORDS))})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN covered USING (r)),
k AS (SELECT * EXCLUDE (word_length_sum), coalesce(word_length_sum, 0)::BIGINT AS word_chars FROM c),
j AS (
  SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED} * n_words AS base_failed,
         concat_ws(',', {", ".join(map(_sql_rule, RULES))}) AS failed
  FROM k)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM j
"""


@query("op11_quality_rules", SQL)
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"))
