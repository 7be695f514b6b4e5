"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of the last three lines closes a chunk where it
is a multiple of four, so boundaries depend on nearby lines only and survive
insertions elsewhere. A chunk of two or more lines that occurs more than once
in the corpus stays where it comes first and is removed everywhere else.
Hashes only propose: chunks are equal when their bytes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, keyed, row_key, stored, table
from shelfmark.llm.registry import query

DIVISOR = 4
FEW = 200_000  # marks of 8 bytes


def _chunks(lines: Column, divisor: int) -> Column:
    """Array of (lines of one chunk); every line is in exactly one chunk."""

    def cut(xs: Column) -> Column:
        hashes = F.transform(xs, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))

        def ends_of(hs: Column) -> Column:
            def closes(i: Column) -> Column:
                at = lambda back: F.when(i > back, F.element_at(hs, (i - back).cast("int"))).otherwise(0)
                return (i == F.size(hs)) | ((at(0) + 31 * at(1) + 961 * at(2)) % divisor == 0)

            return F.filter(F.sequence(F.lit(1), F.size(hs)), closes)

        def pieces(ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            return F.transform(
                F.arrays_zip(starts.alias("a"), ends.alias("b")),
                lambda p: F.slice(xs, p["a"] + 1, p["b"] - p["a"]),
            )

        return _let(ends_of, hashes, pieces)

    return _let(lambda xs: xs, lines, cut)


def _let(first, value: Column, then) -> Column:
    """``then(first(value))`` with both arguments evaluated once."""
    bound = F.transform(F.array(value), first)
    return F.element_at(F.transform(bound, then), 1)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
) -> DataFrame:
    """(key, __sm_kept, n_lines, n_chunks, n_removed_chunks, n_removed_lines) per distinct (id, text).

    The first occurrence is the one with the smallest id (a null id counts as
    0), then text hash, then place. Chunks of blank lines alone stay. A null
    or empty text is one empty line. Rows that repeat id and text share one
    row here, and each repetition counts as an occurrence.
    """
    base = keyed(docs, id_col, text_col)
    cut = _chunks(F.split("__sm_text", "\n"), divisor)
    joined_chunks = F.transform(cut, lambda c: F.struct(F.size(c).alias("n"), F.array_join(c, "\n").alias("t")))
    multi = (F.col("c.n") > 1) & (F.length(F.trim(F.translate("c.t", "\n\r\t", ""))) > 0)
    # The outer form keeps Spark from filtering on the size of the array, which would compute it twice; no array is empty.
    chunks = base.select(*KEY, F.posexplode_outer(joined_chunks).alias("i", "c")).where(multi)
    chunks = chunks.select(*KEY, "i", F.col("c.t").alias("t"), F.xxhash64("c.t").alias("mark"))
    again = stored(chunks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    if again.count() <= FEW:  # few enough to be sent to the chunks; more of them are worth a shuffle of these
        again = F.broadcast(again)
    found = stored(chunks.join(again, "mark", "left_semi").select(*KEY, "i", "t"))
    first = F.min(F.struct(F.col(KEY[0]), F.col(KEY[1]), F.col("i"))).alias("first")
    # Stored tables leave both sides of these joins plain exchanges, which Spark splits where one chunk is in very many texts.
    repeated = stored(found.groupBy("t").agg(F.count("*").alias("n"), first).where("n > 1").select("t", "first"))
    later = found.join(repeated, "t").where(F.struct(*KEY, "i") != F.col("first"))
    drop = later.groupBy(*KEY).agg(F.collect_set("i").alias("gone"))
    done = base.join(drop, KEY, "left").dropDuplicates(KEY)
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    rows = done.select(*KEY, gone.alias("gone"), joined_chunks.alias("cs"))  # the join leaves rows in key order
    stay = F.filter("cs", lambda c, i: ~F.array_contains("gone", i))
    return rows.select(
        *KEY, F.array_join(F.transform(stay, lambda c: c["t"]), "\n").alias("__sm_kept"),
        F.aggregate("cs", F.lit(0), lambda a, c: a + c["n"]).cast("long").alias("n_lines"),
        F.size("cs").cast("long").alias("n_chunks"), F.size("gone").cast("long").alias("n_removed_chunks"),
        F.aggregate(
            F.filter("cs", lambda c, i: F.array_contains("gone", i)), F.lit(0), lambda a, c: a + c["n"]
        ).cast("long").alias("n_removed_lines"),
    )


def deduped_documents(docs: DataFrame) -> DataFrame:
    """Documents with repeated chunks taken out of ``text`` and ``n_chars`` counted anew; no row is dropped."""
    rest = docs.select(*row_key(), "doc_id", "lang", "source")
    joined = rest.join(line_dedup(docs).select(*KEY, "__sm_kept"), KEY)
    return joined.select(
        "doc_id", F.col("__sm_kept").alias("text"), "lang", "source", F.char_length("__sm_kept").cast("long").alias("n_chars")
    )


DEDUPED_SQL = """
    line AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
      FROM {documents}),
    hashed AS (SELECT *, ('0x' || substr(md5(x), 1, 7))::BIGINT AS h FROM line),
    closing AS (
      SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS closes
      FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (
      SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM closing),
    chunk AS (SELECT doc_id, c, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM numbered GROUP BY ALL),
    judged AS (
      SELECT *, n > 1 AND length(trim(translate(t, chr(10) || chr(13) || chr(9), ''))) > 0
                AND row_number() OVER (PARTITION BY t ORDER BY doc_id, c) > 1 AS gone
      FROM chunk),
    deduped AS (
      SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text, sum(n)::BIGINT AS n_lines,
             count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
             coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines
      FROM judged GROUP BY doc_id)
"""


@query(
    "op3_line_dedup",
    f"""
    WITH {DEDUPED_SQL.format(documents="documents")}
    SELECT doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, sha256(text) AS kept_sha256 FROM deduped
    """,
)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(*row_key(), "doc_id").join(line_dedup(docs), KEY)
    return rows.select(
        "doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2("__sm_kept", 256).alias("kept_sha256"),
    )
