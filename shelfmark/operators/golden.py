"""Golden sets: valid chunks, seeded samples, questions, neighbours, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as tx
from shelfmark.operators.ordered import running_sum

SAMPLE_CHUNKS = 50
SAMPLE_SEED = 42


def _variant_is(document: Column, path: str, kinds: Sequence[str]) -> Column:
    found = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.coalesce(found.isin(*kinds), F.lit(False))


def valid_chunks(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Chunks whose JSON metadata has whole-number chunkIndex and totalChunks.

    Adds chunk_index, total_chunks, header_path and space_name; a null title or
    space becomes an empty text.
    """
    parsed = chunks.withColumn("__m", F.try_parse_json(metadata))
    document = F.col("__m")
    whole = ("BIGINT", "BOOLEAN")
    usable = (
        F.col("chunk_id").isNotNull()
        & F.col("page_id").isNotNull()
        & F.col("content").isNotNull()
        & _variant_is(document, "$.chunkIndex", whole)
        & _variant_is(document, "$.totalChunks", whole)
    )
    entries = F.coalesce(
        F.try_variant_get(document, "$.headerPath", "array<variant>"), F.array().cast("array<variant>")
    )
    texts = F.transform(
        F.filter(entries, lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: F.try_variant_get(e, "$", "string"),
    )
    space_name = F.when(
        _variant_is(document, "$.spaceName", ("STRING",)), F.try_variant_get(document, "$.spaceName", "string")
    )
    replaced = {
        "title": F.coalesce("title", F.lit("")),
        "space_key": F.coalesce("space_key", F.lit("")),
    }
    return parsed.where(usable).select(
        *[replaced.get(c, F.col(c)).alias(c) for c in chunks.columns if c != metadata],
        F.try_variant_get(document, "$.chunkIndex", "bigint").alias("chunk_index"),
        F.try_variant_get(document, "$.totalChunks", "bigint").alias("total_chunks"),
        texts.alias("header_path"),
        space_name.alias("space_name"),
    )


def sample_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_chunks(
    chunks: DataFrame, n: int = SAMPLE_CHUNKS, seed: int = SAMPLE_SEED, space: str | None = None
) -> DataFrame:
    """The same n chunks for the same seed and corpus, on any partitioning.

    Adds ``place``, 0 to n-1. Ordering by hash with a limit keeps only n rows
    per task, so the sample - not the corpus - is sorted.
    """
    pool = chunks.where(F.col("space_key") == space) if space is not None else chunks
    order = sample_order(F.col("chunk_id"), seed)
    picked = pool.withColumn("__order", order).orderBy("__order", "chunk_id").limit(n)
    # At most n rows from here on.
    place = F.row_number().over(Window.orderBy("__order", "chunk_id")) - 1
    return picked.withColumn("place", place.cast("long")).drop("__order")


def neighbours(sample: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relevant chunks of each sampled chunk: itself first, then its page by index.

    Long rows instead of arrays, so a page of any size is no problem:
    (source_chunk_id, chunk_id, is_source, chunk_index). Every row of the
    sample counts; Spark picks the join by its size.
    """
    wanted = sample.select(F.col("chunk_id").alias("source_chunk_id"), "page_id")
    joined = chunks.select("page_id", "chunk_id", "chunk_index").join(wanted, "page_id")
    return joined.select(
        "source_chunk_id",
        "chunk_id",
        (F.col("chunk_id") == F.col("source_chunk_id")).alias("is_source"),
        "chunk_index",
    )


QUESTION = T.ArrayType(
    T.StructType([T.StructField("question", T.StringType()), T.StructField("rationale", T.StringType())])
)
Generator = Callable[[Sequence[str]], Sequence[object]]


def generate_questions(
    sample: DataFrame, make_generator: Callable[[], Generator], *, text: str = "content", batch_size: int = 16
) -> DataFrame:
    """Adds ``questions`` and ``error`` from a question model.

    The generator returns, per text, a list of (question, rationale) or an
    exception; a failure only skips its chunk.
    """
    schema = T.StructType(
        [*sample.schema.fields, T.StructField("questions", QUESTION), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_generator()
        for batch in batches:
            questions, errors = [], []
            texts = batch[text].tolist()
            for start in range(0, len(texts), batch_size):
                for found in ask(texts[start : start + batch_size]):
                    failed = isinstance(found, Exception)
                    errors.append(str(found) if failed else None)
                    questions.append(
                        None if failed else [{"question": q, "rationale": r} for q, r in found]
                    )
            yield batch.assign(questions=questions, error=errors)

    return sample.mapInPandas(run, schema)


def first_sentence_questions(sample: DataFrame, text: str = "content") -> DataFrame:
    """The offline default generator: the first sentence of the chunk."""
    sentence = tx.strip(F.regexp_extract(F.col(text), r"\A\s*([^.!?]*[.!?])", 1))
    found = F.length(sentence) > 0
    entry = F.struct(sentence.alias("question"), F.lit("first sentence").alias("rationale"))
    return sample.withColumn("questions", F.when(found, F.array(entry))).withColumn(
        "error", F.when(~found, F.lit("no sentence found"))
    )


def number_queries(asked: DataFrame) -> DataFrame:
    """Dense ids q_001, q_002, ... in sample order after failures are left out.

    Questions are counted in blocks of places, so that a large sample is not
    numbered by one task.
    """
    usable = asked.where(F.size("questions") > 0).withColumn("__all", F.lit(0))
    upto = running_sum(usable, ["__all"], "place", F.size("questions"), "__upto")
    rows = upto.select(
        "place", F.col("chunk_id").alias("source_chunk_id"), "page_id", "title", "space_key", (F.col("__upto") - F.size("questions")).alias("__before"),
        F.posexplode("questions").alias("nth", "q"),
    )
    return rows.select(
        F.format_string("q_%03d", (F.col("__before") + F.col("nth") + 1).cast("long")).alias("query_id"),
        F.col("q.question").alias("query"),
        F.col("q.rationale").alias("rationale"),
        "source_chunk_id", "page_id", "title", "space_key",
    )


def golden_pairs(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The golden set in long form: one row per query and relevant chunk."""
    return pairs.join(queries, "source_chunk_id")


def golden_records(queries: DataFrame, pairs: DataFrame, generated_by: str, generated_at: str) -> DataFrame:
    """One record per query in export shape (camelCase, one array per query).

    The export format holds all relevant ids of a query in one line; work on
    the long ``pairs`` wherever a page may be very large.
    """
    listed = pairs.groupBy("source_chunk_id").agg(
        F.array_sort(F.collect_list(F.struct((~F.col("is_source")).alias("a"), "chunk_index", "chunk_id"))).alias("r")
    )
    metadata = F.struct(
        F.col("page_id").alias("sourcePageId"),
        F.col("title").alias("sourcePageTitle"),
        F.col("space_key").alias("sourceSpaceKey"),
        "rationale",
        F.lit(generated_by).alias("generatedBy"),
        F.lit(generated_at).alias("generatedAt"),
    )
    return queries.join(listed, "source_chunk_id").select(
        F.col("query_id").alias("queryId"),
        "query",
        F.transform("r", lambda x: x["chunk_id"]).alias("relevantChunkIds"),
        F.lit("synthetic").alias("source"),
        metadata.alias("metadata"),
    )


def check_golden_lines(lines: DataFrame, line: str = "line", number: str = "line_number") -> DataFrame:
    """Adds query_id, query, relevant_chunk_ids and ``problem`` to numbered JSONL lines.

    Blank lines are skipped. Reported per line: malformed JSON, a missing or
    empty field, an empty id list or a query id that an earlier line used.
    """

    def fields(document: Column) -> Column:
        def text_field(path: str) -> Column:
            return F.when(_variant_is(document, path, ("STRING",)), F.try_variant_get(document, path, "string"))

        entries = F.try_variant_get(document, "$.relevantChunkIds", "array<variant>")
        ids = F.transform(
            entries, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
        )
        return F.struct(
            text_field("$.queryId").alias("query_id"),
            text_field("$.query").alias("query"),
            ids.alias("relevant_chunk_ids"),
            document.isNull().alias("__broken"),
        )

    filled = lines.where(F.length(tx.strip(F.col(line))) > 0)
    parsed = filled.withColumn("__d", tx.let(F.try_parse_json(tx.strip(F.col(line))), fields))
    shaped = parsed.select(*lines.columns, "__d.*")
    bad_ids = F.size(F.filter("relevant_chunk_ids", lambda x: F.coalesce(F.length(x), F.lit(0)) == 0)) > 0
    problem = (
        F.when(F.col("__broken"), "malformed JSON")
        .when(F.coalesce(F.length("query_id"), F.lit(0)) == 0, "missing queryId")
        .when(F.coalesce(F.length("query"), F.lit(0)) == 0, "missing query")
        .when(F.col("relevant_chunk_ids").isNull(), "missing relevantChunkIds")
        .when(F.size("relevant_chunk_ids") == 0, "empty relevantChunkIds")
        .when(bad_ids, "empty relevant id")
    )
    checked = shaped.withColumn("problem", problem).drop("__broken")
    first = checked.where(F.col("problem").isNull()).groupBy("query_id").agg(F.min(number).alias("__first"))
    # Lines with a problem look for nothing; a key of their own keeps them from meeting in one.
    own = F.when(F.col("problem").isNull(), F.concat(F.lit("="), "query_id")).otherwise(F.col(number).cast("string")).alias("__key")
    joined = checked.select("*", own).join(first.select(F.concat(F.lit("="), "query_id").alias("__key"), "__first"), "__key", "left").drop("__key")
    repeated = F.col("problem").isNull() & (F.col(number) > F.col("__first"))
    return joined.withColumn("problem", F.when(repeated, F.lit("duplicate queryId")).otherwise(F.col("problem"))).drop("__first")
