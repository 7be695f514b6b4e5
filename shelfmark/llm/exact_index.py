"""Exact dedup over a cuckoo-filter index of live content digests.

A shard of the index holds the digests of its hash bucket: a cuckoo filter that
answers "surely new" without a lookup, and the stored entries that verify every
hit by the whole 32-byte SHA-256 of the content and its length. Digests can be
deleted again; when an insertion finds no free slot the filter is rebuilt twice
as large from the stored keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import parts, table
from shelfmark.llm.registry import query

SLOTS = 4
KICKS = 64
WHITE = " \t\n\x0b\x0c\r"  # fixed values: \x20 \x09-\x0D


class CuckooFilter:
    """16-bit fingerprints of 32-byte digests, four to a bucket, two buckets each."""

    def __init__(self, buckets: int = 256):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.cells = array("H", bytes(2 * SLOTS * (self.mask + 1)))
        self.victim = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & self.mask)

    def might_hold(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        cells = self.cells
        return mark in cells[first * SLOTS : first * SLOTS + SLOTS] or mark in cells[second * SLOTS : second * SLOTS + SLOTS]

    def _put(self, place: int, mark: int) -> bool:
        for at in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.cells[at]:
                self.cells[at] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter is full; the caller then rebuilds it from its keys."""
        mark, first, second = self._places(digest)
        if self._put(first, mark) or self._put(second, mark):
            return True
        place = second
        for _ in range(KICKS):
            self.victim = (self.victim + 1) % SLOTS
            at = place * SLOTS + self.victim
            mark, self.cells[at] = self.cells[at], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Take out one fingerprint; only for digests that were inserted."""
        mark, first, second = self._places(digest)
        for place in (first, second):
            for at in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.cells[at] == mark:
                    self.cells[at] = 0
                    return


class DigestIndex:
    """Live digests with their number of rows and the best row so far.

    ``entries`` maps a digest to [rows, characters of the best row, its id]. A
    larger character count is better, then the smaller id; a null id comes last.
    """

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.entries: dict[bytes, list] = {}

    def _resize(self) -> None:
        buckets = 2 * (self.filter.mask + 1)
        while True:
            bigger = CuckooFilter(buckets)
            if all(bigger.insert(key) for key in self.entries):
                self.filter = bigger
                return
            buckets *= 2

    def holds(self, digest: bytes) -> bool:
        return self.filter.might_hold(digest) and digest in self.entries

    def insert(self, digest: bytes, rows: int, chars: int, row_id: int | None) -> None:
        if self.holds(digest):
            entry = self.entries[digest]
            entry[0] += rows
            better = chars > entry[1] or (
                chars == entry[1] and row_id is not None and (entry[2] is None or row_id < entry[2])
            )
            if better:
                entry[1], entry[2] = chars, row_id
            return
        self.entries[digest] = [rows, chars, row_id]
        if not self.filter.insert(digest):
            self._resize()

    def delete(self, digest: bytes, rows: int = 1) -> bool:
        """Take rows of a digest away; the digest goes with its last row. False if it isn't live."""
        if not self.holds(digest):
            return False
        entry = self.entries[digest]
        entry[0] -= rows
        if entry[0] <= 0:
            del self.entries[digest]
            self.filter.delete(digest)
        return True


GROUP = "digest binary, n long, chars long, row_id long"
GROUP_ARROW = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("row_id", pa.int64())])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert a task's rows into one index; then one row per live digest."""
    index = DigestIndex()
    for batch in batches:
        for row in zip(*[batch.column(name).to_pylist() for name in GROUP_ARROW.names], strict=True):
            index.insert(*row)
    keys = list(index.entries)
    for start in range(0, len(keys), 10_000):
        some = keys[start : start + 10_000]
        columns = [some, *[[index.entries[key][i] for key in some] for i in range(3)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GROUP_ARROW, strict=True)], schema=GROUP_ARROW)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, digest, chars): SHA-256 of the text without white space, and its original code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("row_id"), F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )


def live_groups(rows: DataFrame) -> DataFrame:
    """(digest, n, chars, row_id): one row per digest, with the row that stays.

    Each task first indexes its own rows, so that a digest reaches the shard of
    its bucket as one row per task however many copies it has.
    """
    local = rows.select("digest", F.lit(1).cast("long").alias("n"), "chars", "row_id").mapInArrow(_indexed, GROUP)
    return local.repartition(parts(rows.sparkSession), "digest").mapInArrow(_indexed, GROUP)


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index (as ``live_groups`` gives it) after insertions and deletions.

    ``changes`` has digest, chars, row_id and delta (+1 inserts a row, -1 takes
    one away). Changes of one digest are summed first. A digest whose rows are
    all gone leaves; deleting more than is there, or what isn't live, does no
    more. The best row is judged over the index and the inserted rows; if it is
    deleted while others stay, the digest keeps its count and the old best.
    """
    grown = changes.where("delta > 0").select("digest", F.col("delta").cast("long").alias("n"), "chars", "row_id")
    grown = grown.mapInArrow(_indexed, GROUP)
    gone = changes.where("delta < 0").groupBy("digest").agg(F.sum("delta").cast("long").alias("n"))
    gone = gone.select("digest", "n", F.lit(None).cast("long").alias("chars"), F.lit(None).cast("long").alias("row_id"))
    every = index.select("digest", "n", "chars", "row_id").unionByName(grown).unionByName(gone)
    sorted_rows = every.repartition(parts(index.sparkSession), "digest").sortWithinPartitions(F.col("n") < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = DigestIndex(), None
        for batch in batches:
            for digest, n, chars, row_id in zip(*[batch.column(c).to_pylist() for c in GROUP_ARROW.names], strict=True):
                if n > 0:
                    shard.insert(digest, n, chars, row_id)
                else:
                    shard.delete(digest, -n)
        for key, (n, chars, row_id) in shard.entries.items():
            last = pa.RecordBatch.from_pylist([{"digest": key, "n": n, "chars": chars, "row_id": row_id}], schema=GROUP_ARROW)
            yield last

    return sorted_rows.mapInArrow(run, GROUP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row.

    A null text counts as empty. Of equal texts the one with the most code
    points stays, then the smallest id; a null id comes last. Rows that repeat
    id and text share one decision. An empty table gives no rows.
    """
    rows = digests(docs, id_col, text_col)
    groups = live_groups(rows).select(
        "digest", F.col("n").alias("group_size"), F.col("chars").alias("keep_chars"), F.col("row_id").alias("keep_id"),
    )
    joined = rows.join(groups, "digest")
    stays = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select(
        F.col("row_id").alias(id_col), "keep_id", "group_size", stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query(
    "op9_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
             sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
    """,
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))
