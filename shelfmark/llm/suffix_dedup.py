"""Removal of long repeated byte strings by suffix arrays.

A string of 200 bytes has one anchor: the 48 bytes in it that hash lowest.
Equal strings have equal anchors, so only strings whose anchor occurs twice
anywhere can repeat, and they all meet under that anchor. The bytes around such
anchors are dealt to shards; each shard builds a suffix array, by
Larsson-Sadakane refinement, with Kasai's common prefixes, which shows the
strings that repeat within it. An anchor with very many occurrences is dealt to
several shards; their sorted strings are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, buffers, keyed, parts, slices, stored, table
from shelfmark.llm.registry import query
from shelfmark.llm.suffixes import common_prefixes, suffix_array
from shelfmark.llm.words import mixed, powers

LENGTH = 200
ANCHOR = 24
SHARD_BYTES = 1 << 20
CROWD = 512  # different surroundings of one anchor in a shard; more are dealt to several shards
SLICE = 1 << 20

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTES = np.random.default_rng(4).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 32) - 1)


class Rolling:
    """Hashes of any byte ranges of a buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTES[kind][data] * powers("gram", _BASE, len(data)), dtype=np.uint64, out=self.sums[1:])
        self.back = powers("gram inverse", _INVERSE, len(data) + 1)

    def grams(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from every place where so many are left."""
        count = max(len(self.sums) - size, 0)
        return mixed((self.sums[size:] - self.sums[:count]) * self.back[:count])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by running minima within blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, surroundings) of runs of window starts that have one anchor.

    The anchor of a window is its gram with the least hash, the leftmost of
    equals; anchor and surroundings (all bytes of the run's windows) are hashes.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    rolling = Rolling(data)
    hashes = rolling.grams(gram)
    least = window_minima(hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    at = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 2, np.int64)
    some = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[: len(at)])
    if not len(valid):
        return none, none, none, none, none
    text = np.searchsorted(offsets, valid, "right") - 1
    new = np.ones(len(valid), bool)
    new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = valid[np.append(first[1:], len(valid)) - 1]
    text, first = text[first], valid[first]
    around = rolling.ranges(first, last + length)
    return text, first - offsets[text], last - offsets[text], hashes[at[first]].view(np.int64), around.view(np.int64)


def _starts(seq: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, group): places of ``seq`` whose ``length`` symbols occur at another place too, and which are equal.

    ``seq`` has symbols from 1 on, 0 after every piece and enough zeros at the end.
    """
    places = np.flatnonzero(seq)
    key = np.zeros(len(places), np.int64)
    ended = np.zeros(len(places), bool)
    for k in range(7):
        symbol = np.where(ended, 0, seq[places + k])
        ended |= symbol == 0
        key = key << 9 | symbol
    order = suffix_array(seq, places, key, 7, length)
    like = common_prefixes(seq, order, length) >= length
    member = like.copy()
    member[:-1] |= like[1:]
    group = np.cumsum(~like)
    return order[member], group[member]


def _intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every run of consecutive numbers in a sorted array."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts))[: len(first)] - 1]


RUNS = f"{KEY[0]} long, {KEY[1]} long, first long, last long"
FOUND = f"{RUNS}, range int, strings binary"
STRING = np.dtype([("mark1", "u8"), ("mark2", "u8"), ("id", "i8"), ("h", "i8"), ("at", "i8"), ("known", "?")])


def _anchor_rows(base: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for start, stop in slices(offsets, SLICE):
                low, high = offsets[start], offsets[stop]
                text, *rest = anchors(data[low:high], offsets[start : stop + 1] - low, length, gram)
                own = pa.array(text + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, rest)], names=[*KEY, "first", "last", "anchor", "around"]
                )

    return base.mapInArrow(run, f"{RUNS}, anchor long, around long")


def _pieces(wanted: DataFrame, length: int) -> DataFrame:
    """Cut the bytes of the runs in ``runs`` out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            raw, cuts = data.tobytes(), offsets.tolist()
            rows, pieces, fields = [], [], []
            for row, runs in enumerate(batch.column(3).to_pylist()):
                for r in runs:
                    rows.append(row)
                    fields.append(r)
                    pieces.append(raw[cuts[row] + r["first"] : cuts[row] + r["last"] + length])
                if len(rows) > 5000 or row + 1 == batch.num_rows:
                    own = pa.array(rows, pa.int64())
                    columns = [pa.array([f[c] for f in fields], pa.int64()) for c in ("first", "last", "anchor", "salt")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *columns, pa.array([f["crowded"] for f in fields], pa.bool_()), pa.array(pieces, pa.binary())],
                        names=[*KEY, "first", "last", "anchor", "salt", "crowded", "piece"],
                    )
                    rows, pieces, fields = [], [], []

    return wanted.mapInArrow(run, f"{RUNS}, anchor long, salt long, crowded boolean, piece binary")


def _shards(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Repeats within shards; and, of crowded anchors, what other shards must see.

    Rows with a null ``range`` are runs of starts that repeat. The others are
    sorted lists of single strings by their 128-bit mark, one list for each
    range of marks, ``known`` if they repeat in their shard.
    """
    count = parts(pieces.sparkSession)
    names = [*KEY, "first", "last", "range", "strings"]

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        texts = whole.column(7).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        seq = np.zeros(sizes.sum() + len(texts) + 2 * length + 64, np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        seq[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = flat.astype(np.int64) + 1
        at, group = _starts(seq, length)
        by = np.argsort(at)
        at, group = at[by], group[by]
        low, high = _intervals(at)
        row = np.searchsorted(begin, low, "right") - 1
        base = whole.column(2).to_numpy() - begin
        own, none = pa.array(row), pa.nulls(len(row), pa.int32())
        ends = [pa.array(low + base[row]), pa.array(high + base[row])]
        tables = [pa.Table.from_arrays([whole.column(0).take(own), whole.column(1).take(own), *ends, none, pa.nulls(len(row), pa.binary())], names=names)]
        crowded = np.flatnonzero(whole.column(6).to_numpy(zero_copy_only=False))
        if len(crowded):
            repeats = np.zeros(len(seq), np.int64)
            repeats[at] = group
            starts = sizes[crowded] - length + 1
            of = np.repeat(crowded, starts)
            place = begin[of] + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
            member = repeats[place]
            _, lead = np.unique(member, return_index=True)
            use = member == 0
            use[lead] = True
            of, place, member = of[use], place[use], member[use]
            symbols = np.minimum(seq, 256)[: begin[-1] + sizes[-1] + 1].astype(np.int64)
            symbols = np.maximum(symbols - 1, 0).astype(np.uint8)
            strings = np.zeros(len(of), STRING)
            for kind in (0, 1):
                strings[f"mark{kind + 1}"] = Rolling(symbols, kind).ranges(place, place + length)
            strings["id"], strings["h"] = whole.column(0).to_numpy()[of], whole.column(1).to_numpy()[of]
            strings["at"], strings["known"] = place + base[of], member > 0
            strings = strings[np.lexsort((strings["mark2"], strings["mark1"]))]
            cuts = np.searchsorted(strings["mark1"], np.array([(i << 64) // count for i in range(1, count)], np.uint64))
            lists = [(i, part.tobytes()) for i, part in enumerate(np.split(strings, cuts)) if len(part)]
            blank = pa.nulls(len(lists), pa.int64())
            tables.append(pa.Table.from_arrays([blank] * 4 + [pa.array([i for i, _ in lists], pa.int32()), pa.array([x for _, x in lists], pa.binary())], names=names))
        return pa.concat_tables(tables).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by anchor and salt; a shard ends between anchors once it is large enough.
        held, size, last = [], 0, None
        for batch in batches:
            anchor, salt = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            bytes_ = np.cumsum(np.array([len(x) for x in batch.column(7).to_pylist()], np.int64))
            ends = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            done = 0
            if held and (anchor[0], salt[0]) != last and size >= shard_bytes:
                yield from search(held).to_batches()
                held, size = [], 0
            for end in ends:
                if size + bytes_[end - 1] - (bytes_[done - 1] if done else 0) >= shard_bytes:
                    yield from search([*held, batch.slice(done, end - done)]).to_batches()
                    held, size, done = [], 0, end
            if done < batch.num_rows:
                held.append(batch.slice(done))
                size += bytes_[-1] - (bytes_[done - 1] if done else 0)
            last = anchor[-1], salt[-1]
        if held:
            yield from search(held).to_batches()

    return pieces.repartition(count, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(run, FOUND)


def _merged(lists: DataFrame) -> DataFrame:
    """Runs of the strings that another shard has too; each shard lists a string once."""
    names = [*KEY, "first", "last"]

    def merge(held: list[bytes]) -> pa.RecordBatch:
        shards = [np.frombuffer(x, STRING) for x in held]
        own = [np.rec.fromarrays([s["mark1"], s["mark2"]]) for s in shards]
        found = []
        every = np.sort(np.concatenate(own))
        for strings, marks in zip(shards, own, strict=True):
            # Binary search of each shard's strings among those of all shards.
            shared = np.searchsorted(every, marks, "right") - np.searchsorted(every, marks, "left") > 1
            found.append(strings[shared & ~strings["known"]])
        hit = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hit[c])) for c in ("id", "h", "at", "at")], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for at, strings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and at != last:
                    yield merge(held)
                    held = []
                held.append(strings)
                last = at
        if held:
            yield merge(held)

    dealt = lists.repartition(parts(lists.sparkSession), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, RUNS)


def repeated_runs(base: DataFrame, length: int = LENGTH, gram: int = ANCHOR, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, first, last): runs of starts of strings of ``length`` bytes that also start elsewhere.

    ``base`` holds the key and ``__sm_text``.
    """
    rows = stored(_anchor_rows(base, length, gram))
    per_anchor = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi"))
    again = stored(per_anchor.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("differ")))
    places = stored(rows.join(again, "anchor"))
    run = [*KEY, "first", "last"]
    # One surrounding everywhere: all its strings repeat.
    alike = places.where("NOT differ").select(*run)
    differ = places.where("differ")
    kinds = differ.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct(*run)).alias("run"))
    kinds = stored(kinds.select("anchor", "around", "n", "run.*"))
    same = differ.join(kinds.where("n > 1").select("anchor", "around"), ["anchor", "around"], "left_semi").select(*run)
    crowds = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > crowd)
    dealt = kinds.join(crowds, "anchor", "left").withColumn("shards", F.ceil(F.coalesce("kinds", F.lit(0)) / crowd))
    salt = F.when(F.col("shards") > 1, F.pmod("around", "shards")).otherwise(0).cast("long")
    fields = F.struct("first", "last", "anchor", salt.alias("salt"), (F.col("shards") > 1).alias("crowded"))
    wanted = base.join(dealt.groupBy(*KEY).agg(F.collect_list(fields).alias("runs")), KEY).select(*KEY, "__sm_text", "runs")
    found = stored(_shards(_pieces(wanted, length), length, shard_bytes))
    across = _merged(found.where("range IS NOT NULL").select("range", "strings"))
    return alike.unionByName(same).unionByName(found.where("range IS NULL").select(*run)).unionByName(across)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = ANCHOR, **sizes: int) -> DataFrame:
    """(key, id, n_bytes, spans, kept) for every row: each byte of a repeated ``length``-byte string removed.

    Texts are UTF-8 bytes and may be cut within a character, so ``kept`` is
    binary. Strings repeat if they also start elsewhere in this or another
    text; overlapping ones count, and all are judged on the input, so the
    first occurrence goes as well. Matches never cross texts. A null text is
    empty; rows that repeat id and text repeat each other.
    """
    base = keyed(docs, id_col, text_col)
    runs = repeated_runs(base, length, gram, **sizes).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = base.join(runs, KEY, "left")
    no_id = (F.col(KEY[0]) == 0) & (F.col(KEY[1]) == F.xxhash64(F.lit(True), F.col("__sm_text")))
    source = joined.select(*KEY, F.when(~no_id, F.col(KEY[0])).alias("__sm_doc"), "__sm_text", "runs")
    shape = pa.schema([
        (KEY[0], pa.int64()), (KEY[1], pa.int64()), ("__sm_doc", pa.int64()), ("n_bytes", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            raw, cuts = data.tobytes(), offsets.tolist()
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                spans, kept = [], []
                for row, found in enumerate(part.column(4).to_pylist()):
                    text = raw[cuts[low + row] : cuts[low + row + 1]]
                    gone: list[list[int]] = []
                    for r in sorted(found or [], key=lambda r: r["first"]):
                        if gone and r["first"] <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], r["last"] + length)
                        else:
                            gone.append([r["first"], r["last"] + length])
                    edges = [0, *[x for span in gone for x in span], len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "stop": b} for a, b in gone])
                sizes_ = np.diff(offsets[low : low + part.num_rows + 1])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes_), pa.array(spans, shape.field("spans").type), pa.array(kept, pa.binary())], schema=shape)

    return source.mapInArrow(
        run, f"{KEY[0]} long, {KEY[1]} long, __sm_doc long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    )


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select(
        F.col("__sm_doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
