"""Benchmark decontamination by suffix arrays over the training texts.

Each shard of documents gets a suffix array over its words. Every suffix of a
test item is searched in it, by its first ten words; the ranges found give the
places of all verbatim matches, and runs of places on one diagonal the longest
ones. Words that no item has cannot be part of a match: they end a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, buffers, row_key, slices, table
from shelfmark.llm.registry import query
from shelfmark.llm.suffixes import ranges, suffix_array
from shelfmark.llm.words import words

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 3 << 20

HITS = "n_words long, hits array<struct<start: long, stop: long>>, items array<string>, matches array<struct<item: string, at: long, words: long>>"


class Tests:
    """Windows of one block of test items; bounded by the block's bytes."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        hashes, cuts = words(data, offsets)
        self.vocabulary = np.unique(hashes)
        seq = np.searchsorted(self.vocabulary, hashes) + 1
        padded = np.concatenate([seq, np.zeros(window, np.int64)])
        sizes = cuts[1:] - cuts[:-1]
        count = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        item = np.repeat(np.arange(len(names)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = cuts[:-1][item] + place
        size = np.minimum(sizes[item], window)
        grid = padded[at[:, None] + np.arange(window)] * (np.arange(window) < size[:, None])
        self.windows, which = np.unique(grid, axis=0, return_inverse=True)
        self.sizes = (self.windows > 0).sum(axis=1)
        by = np.argsort(which.ravel(), kind="stable")
        self.items, self.item_places = item[by], place[by]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.windows)))]).astype(np.int64)
        self.names, self.window = names, window

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per text; and for each occurrence its text, first word in the text, window number)."""
        hashes, cuts = words(data, offsets)
        sizes = cuts[1:] - cuts[:-1]
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.windows):
            return sizes, none, none, none
        row = np.repeat(np.arange(len(sizes)), sizes)
        near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        seq = np.zeros(len(hashes) + len(sizes) + 2 * self.window + 8, np.int64)
        spot = np.arange(len(hashes)) + row  # one 0 between texts
        seq[spot] = np.where(self.vocabulary[near] == hashes, near + 1, 0)
        places = np.flatnonzero(seq)
        if not len(places):
            return sizes, none, none, none
        bits = int(len(self.vocabulary) + 1).bit_length()
        known = min(max(1, 62 // bits), self.window)
        key = np.zeros(len(places), np.int64)
        ended = np.zeros(len(places), bool)
        for k in range(known):
            symbol = np.where(ended, 0, seq[places + k])
            ended |= symbol == 0
            key = key << bits | symbol
        order = suffix_array(seq, places, key, known, self.window)
        low, high = ranges(seq, order, self.windows, self.sizes)
        found = high - low
        window = np.repeat(np.arange(len(found)), found)
        at = order[np.arange(found.sum()) + np.repeat(low - np.cumsum(found) + found, found)]
        text = np.searchsorted(cuts[:-1] + np.arange(len(sizes)), at, "right") - 1
        return sizes, text, at - cuts[:-1][text] - text, window

    def matches(self, at: np.ndarray, window: np.ndarray) -> list[tuple[str, int, int]]:
        """Longest verbatim matches of one text as (item, first word, words), from its occurrences."""
        count = self.cuts[window + 1] - self.cuts[window]
        pick = np.arange(count.sum()) + np.repeat(self.cuts[window] - np.cumsum(count) + count, count)
        item, place = self.items[pick], self.item_places[pick]
        start, size = np.repeat(at, count), np.repeat(self.sizes[window], count)
        by = np.lexsort((start, start - place, item))
        item, place, start, size = item[by], place[by], start[by], size[by]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1] + 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(item)) - 1
        return [(self.names[item[a]], int(start[a]), int(start[b] + size[b] - start[a])) for a, b in zip(firsts, lasts, strict=True)]


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    """Union of half-open ranges."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    firsts = np.flatnonzero(new)
    ends = reach[np.append(firsts[1:], len(starts)) - 1]
    return [{"start": int(a), "stop": int(b)} for a, b in zip(starts[firsts], ends, strict=True)]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items, a bounded block at a time; a block is as large as its bytes allow."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        some = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block)
        found = some.collect()
        yield [r.i for r in found], [r.t for r in found]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, id, n_words, hits, items, matches) for every document row.

    ``hits`` are merged word ranges inside occurrences of item windows,
    ``items`` the ids with an occurring window, sorted as strings, ``matches``
    the longest verbatim runs (item, first word, words). Items are searched in
    blocks of ``block_bytes``, whatever their number. Null texts have no words;
    a null item id is named ``null``; items that repeat an id count once. Empty
    tables give no hits or no rows.
    """
    spark = docs.sparkSession
    source = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("__sm_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__sm_text"))
    schema = f"{KEY[0]} long, {KEY[1]} long, __sm_doc long, {HITS}"
    arrow = pa.schema([
        (KEY[0], pa.int64()), (KEY[1], pa.int64()), ("__sm_doc", pa.int64()), ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string())),
        ("matches", pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("words", pa.int64())]))),
    ])

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests: Tests = shared.value
            for batch in batches:
                data, offsets = buffers(batch.column(3))
                for start, stop in slices(offsets, SHARD_BYTES):
                    low, high = offsets[start], offsets[stop]
                    sizes, text, at, win = tests.find(data[low:high], offsets[start : stop + 1] - low)
                    by = np.argsort(text, kind="stable")
                    text, at, win = text[by], at[by], win[by]
                    cuts = np.searchsorted(text, np.arange(stop - start + 1))
                    hits, names, matches = [], [], []
                    for row in range(stop - start):
                        a, b = cuts[row], cuts[row + 1]
                        hits.append(_merged(at[a:b], at[a:b] + tests.sizes[win[a:b]]) if b > a else [])
                        found = tests.matches(at[a:b], win[a:b]) if b > a else []
                        names.append(sorted({name for name, _, _ in found}))
                        matches.append([{"item": i, "at": p, "words": n} for i, p, n in found])
                    part = batch.slice(start, stop - start)
                    columns = [*part.columns[:3], pa.array(sizes), *[pa.array(v, arrow.field(i + 4).type) for i, v in enumerate((hits, names, matches))]]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return run

    frames = [source.mapInArrow(search(spark.sparkContext.broadcast(Tests(n, t, window))), schema) for n, t in _blocks(items, item_col, "text", block_bytes)]
    if len(frames) == 1:
        return frames[0]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    # One row per block and document row: collect the blocks again, then restore repeated rows.
    grouped = every.groupBy(*KEY, "__sm_doc", "n_words").agg(
        (F.count("*") / len(frames)).cast("int").alias("__sm_rows"), F.flatten(F.collect_set("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.flatten(F.collect_set("matches")).alias("matches"),
    )
    spread = grouped.select("*", F.explode(F.sequence(F.lit(1), F.col("__sm_rows")))).drop("col", "__sm_rows")
    rows = spread.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("hits")
            union = [
                _merged(np.array([h["start"] for h in hits], np.int64), np.array([h["stop"] for h in hits], np.int64)) if hits else []
                for hits in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, "hits", pa.array(union, arrow.field("hits").type))

    return spread.mapInArrow(merge, rows)


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["stop"] - h["start"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit; all their columns stay as they are."""
    hit = benchmark_hits(docs, items, window=window).where(F.size("hits") > 0).select(*KEY).distinct()
    names = docs.columns
    return docs.select("*", *row_key()).join(hit, KEY, "left_anti").select(*[F.col(f"`{c}`") for c in names])


@query(
    "op4_benchmark_decontamination",
    """
    WITH w AS (
      SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ') AS raw FROM documents),
    d AS (SELECT doc_id, CASE WHEN raw = [''] THEN [] ELSE raw END AS ws FROM w),
    v AS (
      SELECT item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ') AS raw FROM benchmark),
    b AS (SELECT item_id, raw AS ws, len(raw) AS n FROM v WHERE raw <> ['']),
    item_window AS (
      SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(ws[i : i + least(n, 10) - 1], ' ') AS t
      FROM (SELECT *, unnest(generate_series(1, greatest(n - 9, 1))) AS i FROM b)),
    size AS (SELECT DISTINCT size FROM item_window),
    doc_window AS (
      SELECT doc_id, s.size, i, array_to_string(ws[i : i + s.size - 1], ' ') AS t
      FROM (SELECT doc_id, ws, s.size, unnest(generate_series(1, len(ws) - s.size + 1)) AS i FROM d, size s WHERE len(ws) >= s.size) AS s),
    found AS (SELECT doc_id, i, dw.size, item_id FROM doc_window dw JOIN item_window iw ON dw.size = iw.size AND dw.t = iw.t),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY 1),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY 1)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select(
        F.col("__sm_doc").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"),
    )
