"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

A document is its weighted set of five-word shingles: term frequency times a
document frequency weight between 1 and 2, from counts over all documents in a
hashed space of fixed size. Improved consistent weighted sampling draws
(shingle, level) pairs that agree between two documents as often as their
weighted Jaccard similarity; bands of samples put likely pairs into buckets,
and every link is verified by the exact weighted Jaccard similarity.

Copies are one vertex. Within a bucket not everybody is compared with
everybody: all members meet one leader, the one whose buckets are the largest,
as the original of many edited copies is. Members unlike their leader meet
again under two bands at once, and another leader. Members outside their
leader's class then meet a few members of that class, one after the other, until
one links them to it. What is left is settled for all members of buckets with
several classes, however unlike their leader: each is compared with it, and two
are compared if what both have more or less of than it can make them similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, buffers, frugal, keyed, parts, row_key, slices, small_batches, stored, table
from shelfmark.llm.registry import query
from shelfmark.llm.words import mixed, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 2
SAMPLES = BANDS * ROWS
AGREE = 8  # of 20 samples; a pair at 0.8 has fewer with a chance of 2e-5, less than that of missing all bands
UNLIKE = 12
LEADERS = 2
FEW = 200_000  # vertices of 16 bytes
SPACE_BITS = 18
RANGES = 64
SLICE = 512 << 10

_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 4 - k, 1 << 64)) for k in range(SHINGLE)]
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, (SAMPLES + 2, 2), dtype=np.uint64)


def shingles(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) for every place; a text of fewer than five words, but not none, is one shingle."""
    sizes = cuts[1:] - cuts[:-1]
    count = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    at = cuts[:-1][row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    short = sizes[row] < SHINGLE
    for k in range(SHINGLE):
        word = padded[at + k]
        if short.any():
            word = np.where(at + k < cuts[1:][row], word, np.uint64(0))
        found += word * _FACTORS[k]
    return row, mixed(found)


def weighted(row: np.ndarray, found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct shingle, weight), ordered by text and shingle."""
    by = np.argsort(found, kind="stable")
    by = by[np.argsort(row[by], kind="stable")]
    row, found = row[by], found[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(row)))
    row, found = row[first], found[first]
    return row, found, times * idf[(found & np.uint64((1 << SPACE_BITS) - 1)).astype(np.int64)]


def samples(row: np.ndarray, found: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """(rows, SAMPLES) improved consistent weighted samples; texts without shingles have zeros.

    With r and c from Gamma(2, 1) and b uniform, all derived from the shingle,
    the shingle of least ln c - r (t - b + 1) is drawn, t being the level
    floor(ln weight / r + b).
    """
    out = np.zeros((rows, SAMPLES), np.uint64)
    if not len(row):
        return out
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(starts, len(row)))
    logs = np.log(weight).astype(np.float32)
    third, scale = np.uint64((1 << 21) - 1), np.float32(2.0**-21)
    unit = lambda x, shift: ((x >> np.uint64(shift)) & third).astype(np.float32) * scale + scale / 2
    for m in range(SAMPLES):
        x = mixed(found + _SEEDS[m, 0])
        y = mixed(x ^ _SEEDS[m, 1])
        r = -np.log(unit(x, 0) * unit(x, 21))
        b = unit(x, 42)
        level = np.floor(logs / r + b)
        value = np.log(-np.log(unit(y, 0) * unit(y, 21))) - r * (level - b + 1)
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, size))
        pick = hit[np.searchsorted(hit, starts)]
        out[row[starts], m] = mixed(found[pick] ^ mixed(level[pick].astype(np.int64).astype(np.uint64) + _SEEDS[m, 0]))
    return out


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of every cell of the hashed shingle space, from all documents: 1 + ln((n + 1) / (df + 1)) / ln(n + 1).

    The space has 2 ** SPACE_BITS cells at any size of the corpus. Tasks count
    for themselves and send one packed row per range of cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SPACE_BITS, np.int64), 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            n += batch.num_rows
            for start, stop in slices(offsets, SLICE):
                low, high = offsets[start], offsets[stop]
                row, found = shingles(*words(data[low:high], offsets[start : stop + 1] - low))
                cell = np.unique(row << SPACE_BITS | (found & np.uint64((1 << SPACE_BITS) - 1)).astype(np.int64))
                total += np.bincount(cell & ((1 << SPACE_BITS) - 1), minlength=1 << SPACE_BITS)
        if n:
            packed = [part.tobytes() for part in np.split(total, RANGES)] + [np.array([n]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES + 1), pa.int32()), pa.array(packed, pa.binary())], names=["at", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(cells, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "cells"])

    shape = "at int, cells binary"
    partial = docs.select(F.coalesce("__sm_text", F.lit(""))).mapInArrow(frugal("near_dedup", count), shape)
    summed = partial.repartition(RANGES, "at").mapInArrow(add, shape)
    found = {r["at"]: np.frombuffer(bytes(r.cells), np.int64) for r in summed.collect()}
    if not found:
        return np.ones(1 << SPACE_BITS, np.float32)
    n = float(found.pop(RANGES)[0])
    df = np.concatenate([found[i] for i in range(RANGES)])
    return (1 + np.log((n + 1) / (df + 1)) / np.log(n + 1)).astype(np.float32)


def _sketches(base: DataFrame, idf) -> DataFrame:
    """(key, vertex, samples): the vertex names the word sequence, null without words."""
    shape = f"{KEY[0]} long, {KEY[1]} long, vertex binary, samples binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for start, stop in slices(offsets, SLICE):
                low, high = offsets[start], offsets[stop]
                hashes, cuts = words(data[low:high], offsets[start : stop + 1] - low)
                place = np.arange(len(hashes)).astype(np.uint64) - np.repeat(cuts[:-1], np.diff(cuts)).astype(np.uint64)
                names = []
                for a, b in _SEEDS[-2:]:
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ mixed(place * a + b)), dtype=np.uint64)])
                    names.append(sums[cuts[1:]] - sums[cuts[:-1]])
                both = np.ascontiguousarray(np.stack(names, axis=1))
                some = np.diff(cuts) > 0
                drawn = samples(*weighted(*shingles(hashes, cuts), idf.value), stop - start).astype(np.uint32)
                part = batch.slice(start, stop - start)
                vertex = [both[i].tobytes() if some[i] else None for i in range(stop - start)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(vertex, pa.binary()), pa.array([drawn[i].tobytes() for i in range(stop - start)], pa.binary())],
                    names=[*KEY, "vertex", "samples"],
                )

    return base.mapInArrow(frugal("near_dedup", run), shape)


def _bands() -> Column:
    size = 4 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("samples", 1 + i * size, size)) for i in range(BANDS)])


def _buckets(every: DataFrame, sampled: DataFrame) -> DataFrame:
    """(bucket, vertex, samples, turn) of buckets of two or more vertices; ``turn`` orders possible leaders.

    Most rows of ``every`` (bucket, vertex) are alone in their bucket, so the samples come to those that are left.
    """
    crowded = stored(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    rows = stored(every.join(crowded, "bucket"))
    reach = rows.groupBy("vertex").agg(F.sum("n").alias("n")).join(sampled, "vertex")
    turn = F.struct((-F.col("n")).alias("n"), F.xxhash64("vertex").alias("h")).alias("turn")
    return stored(rows.drop("n").join(reach.select("vertex", "samples", turn), "vertex"))


def _agreeing(a: str, b: str) -> Column:
    """Samples that two documents share."""
    same = [(F.substring(a, 1 + 4 * i, 4) == F.substring(b, 1 + 4 * i, 4)).cast("int") for i in range(SAMPLES)]
    total = same[0]
    for one in same[1:]:
        total = total + one
    return total


MEASURED = "a binary, b binary, distance double, common double, wa double, wb double"
MARKED = MEASURED + ", only_a array<long>, only_b array<long>, more_a array<double>, more_b array<double>"


def _verified(pairs: DataFrame, texts: DataFrame, idf, marked: bool = False) -> DataFrame:
    """The pairs with the exact weighted Jaccard distance of their texts, common weight and weights.

    If ``marked``, also with the hashes of all shingles that one has more of than the other, and the weight of how much more.
    Further columns of the pairs come last.
    """
    further = [f for f in pairs.schema if f.name not in ("a", "b")]
    more_names = [f.name for f in further]
    pairs = stored(pairs.select("a", "b", *more_names))
    ends = stored(pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct())
    if ends.count() <= FEW:  # few enough to be sent to the texts; more of them are worth a shuffle of all texts
        texts = texts.join(F.broadcast(ends), "vertex", "left_semi")
    joined = pairs.join(texts.withColumnsRenamed({"vertex": "a", "__sm_text": "ta"}), "a")
    joined = joined.join(texts.withColumnsRenamed({"vertex": "b", "__sm_text": "tb"}), "b").select("a", "b", "ta", "tb", *more_names)

    def sets(column: pa.Array) -> tuple[np.ndarray, ...]:
        row, found, weight = weighted(*shingles(*words(*buffers(column))), idf.value)
        return found, weight.astype(np.float64), np.searchsorted(row, np.arange(len(column) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.float64())] * 2
        for batch in batches:
            sizes = buffers(batch.column(2))[1] + buffers(batch.column(3))[1]
            for start, stop in slices(sizes, 4 * SLICE):
                part = batch.slice(start, stop - start)
                (fa, wa, ca), (fb, wb, cb) = sets(part.column(2)), sets(part.column(3))
                found, more = np.zeros((4, part.num_rows)), ([], [], [], [])
                for i in range(part.num_rows):
                    x, y = fa[ca[i] : ca[i + 1]], fb[cb[i] : cb[i + 1]]
                    _, at, of = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    common = np.minimum(wa[ca[i] + at], wb[cb[i] + of]).sum()
                    first, second = wa[ca[i] : ca[i + 1]].sum(), wb[cb[i] : cb[i + 1]].sum()
                    found[:, i] = 1 - common / (first + second - common), common, first, second
                    if marked:
                        p, q = wa[ca[i] : ca[i + 1]].copy(), wb[cb[i] : cb[i + 1]].copy()
                        p[at], q[of] = p[at] - q[of], q[of] - p[at]
                        for k, (names, rest) in enumerate(((x, p), (y, q))):
                            more[k].append(names[rest > 0].view(np.int64))
                            more[k + 2].append(rest[rest > 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, found), *[pa.array(m, shape) for m, shape in zip(more, shapes, strict=True) if marked], *part.columns[4:]],
                    names=["a", "b", "distance", "common", "wa", "wb", "only_a", "only_b", "more_a", "more_b"][: 10 if marked else 6] + more_names,
                )

    return joined.mapInArrow(frugal("near_dedup", run), ", ".join([MARKED if marked else MEASURED, *[f"{f.name} {f.dataType.simpleString()}" for f in further]]))


def components(links: DataFrame) -> DataFrame:
    """(vertex, class): the least vertex that it is linked to over any path, for every vertex with a link.

    Every round takes the least of a vertex's class, its neighbours' classes
    and the class of its class; rounds end when nothing changes. Tables are
    stored between.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    classes = stored(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("vertex"), F.least("a", "n").alias("class")))
    while True:
        near = both.join(classes.withColumnRenamed("vertex", "b"), "b").groupBy("a").agg(F.min("class").alias("near"))
        up = classes.select(F.col("vertex").alias("class"), F.col("class").alias("up"))
        step = classes.join(near.withColumnRenamed("a", "vertex"), "vertex").join(up, "class", "left")
        step = stored(step.select("vertex", F.col("class").alias("old"), F.least("class", "near", F.coalesce("up", "class")).alias("class")))
        classes = step.select("vertex", "class")
        if step.where("class != old").isEmpty():
            return classes


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after further links, by the components of the classes that these join."""
    ends = links.select(F.col("a").alias("vertex")).union(links.select("b")).distinct()
    every = stored(classes.join(ends, "vertex", "full").select("vertex", F.coalesce("class", "vertex").alias("class")))
    at = lambda end: every.select(F.col("vertex").alias(end), F.col("class").alias(f"class_{end}"))
    joined = links.join(at("a"), "a").join(at("b"), "b").where("class_a != class_b")
    step = components(joined.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    step = step.select(F.col("vertex").alias("class"), F.col("class").alias("up"))
    return stored(every.join(step, "class", "left").select("vertex", F.coalesce("up", "class").alias("class")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, id, class_id, class_size, kept) for every row.

    Two documents share a class if a chain of links of at least ``similarity``
    joins them. ``class_id`` is the smallest id of the class (a null id comes
    last) and ``kept`` marks its row. A null text is empty; a text without
    words is a class of its own. Texts with equal word sequences are copies.
    Rows that repeat id and text count in the class and share one decision,
    but of rows without an id that repeat a text one is kept.
    """
    base = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(document_frequencies(base))
    sketches = stored(_sketches(base, idf))
    named = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("__sm_doc"))
    # The key says what the text hash says; the first row of a vertex lends its text.
    vertices = stored(sketches.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min(F.struct(*KEY)).alias("k"), F.min("samples").alias("samples")))
    classes = _classes(vertices, base, idf, similarity)
    rows = sketches.select(*KEY, "vertex").dropDuplicates(KEY)
    rows = named.join(rows, KEY).join(classes, "vertex", "left")
    alone = F.concat(F.lit("row"), F.col(KEY[0]).cast("string"), F.lit(":"), F.col(KEY[1]).cast("string")).cast("binary")
    rows = stored(rows.select(*KEY, "__sm_doc", F.coalesce("class", "vertex", alone).alias("class"), F.when(F.col("__sm_doc").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("mark")))
    order = F.struct(F.col("__sm_doc").isNull().alias("n"), F.col("__sm_doc").alias("i"), F.col(KEY[1]).alias("h"), F.col("mark").alias("m"))
    sums = stored(rows.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("class_size")))
    return rows.join(sums, "class").select(
        *KEY, F.col("__sm_doc"), F.col("first.i").alias("class_id"), "class_size", (order == F.col("first")).alias("kept"),
    )


def _led(buckets: DataFrame) -> DataFrame:
    """The members of buckets with their leader and the samples they share with it."""
    first = buckets.groupBy("bucket").agg(F.min(F.struct("turn", "vertex", "samples")).alias("f"))
    first = stored(first.select("bucket", F.col("f.vertex").alias("leader"), F.col("f.samples").alias("leads")))
    met = buckets.join(first, "bucket").where("vertex != leader")
    return met.select("bucket", "vertex", "samples", "leader", _agreeing("samples", "leads").alias("agree"))


def _ordered_pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _likely(pairs: DataFrame, sampled: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough samples to be similar."""
    found = pairs.join(sampled.toDF("a", "sa"), "a").join(sampled.toDF("b", "sb"), "b")
    return found.where(_agreeing("sa", "sb") >= AGREE).select("a", "b")


def _classes(vertices: DataFrame, base: DataFrame, idf, similarity: float) -> DataFrame:
    """(vertex, class) for every vertex with a link."""
    reach = 1 - similarity + 1e-9
    buckets = _buckets(vertices.select("vertex", F.explode(_bands()).alias("bucket")), vertices.select("vertex", "samples"))
    crowd = stored(vertices.select("vertex", "k.*", "samples").join(buckets.select("vertex").distinct(), "vertex"))
    sampled = crowd.select("vertex", "samples")
    # A vertex has one key, so rows that repeat it are together already.
    texts = stored(base.join(crowd.drop("samples"), KEY).dropDuplicates([*KEY, "vertex"]).select("vertex", "__sm_text"))
    met = stored(_led(buckets))
    # Those unlike their leader: once more, in buckets of two bands. Of two that are similar, one being too unlike
    # the leader to be tested, the other is not much more like it; so the bound here is higher than AGREE.
    unlike = met.where(F.col("agree") < UNLIKE).select("vertex", "samples", "bucket")
    again = unlike.select("vertex", F.explode(F.transform(_bands(), lambda band: F.when(band != F.col("bucket"), F.xxhash64(F.least(band, "bucket"), F.greatest(band, "bucket"))))).alias("bucket"))
    met_again = _led(_buckets(again.where("bucket IS NOT NULL").distinct(), sampled))
    pairs = stored(met.select("vertex", "leader", "agree").union(met_again.select("vertex", "leader", "agree")).where(F.col("agree") >= AGREE).select("vertex", "leader").distinct())
    tested = stored(_verified(pairs.select(*_ordered_pair("vertex", "leader")).distinct(), texts, idf))
    links = tested.where(F.col("distance") <= reach).select("a", "b")
    classes = components(links)
    classes, tested = _more_leaders(met, sampled, classes, tested.select("a", "b"), texts, idf, reach)

    # Members of one leader in buckets with several classes; those outside the leader's class look for others.
    of = met.select("bucket", "vertex", "leader").join(classes, "vertex", "left").join(classes.withColumnsRenamed({"vertex": "leader", "class": "main"}), "leader", "left")
    of = stored(of.select("bucket", "vertex", "leader", F.coalesce("class", "vertex").alias("class"), F.coalesce("main", "leader").alias("main")))
    mixed_ = stored(of.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("bucket"))
    state = of.join(mixed_, "bucket", "left_semi").select("vertex", "leader", F.xxhash64("class").alias("class"), (F.col("class") != F.col("main")).alias("waits"))
    state = stored(state.distinct())
    if state.isEmpty():
        return classes
    # Leaders are in one order over all buckets, so no pair of state comes the other way round too.
    measured = stored(_verified(state.withColumnsRenamed({"vertex": "a", "leader": "b"}), texts, idf, marked=True))
    more = stored(_possible(measured, similarity).join(tested, ["a", "b"], "left_anti"))
    late = stored(_verified(_likely(more, sampled), texts, idf).where(F.col("distance") <= reach).select("a", "b"))
    return classes if late.isEmpty() else _merged(classes, late)


def _possible(measured: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of members (a) of one leader (b) in different classes, one of which waits, that can be similar.

    With c for what a member has in common with the leader, w and l for their weights and k = similarity / (1 + similarity),
    two members have c1 + c2 - l in common and what their differences from the leader share, more and less of a shingle apart.
    They are similar from k (w1 + w2) on, so their differences have to share k (w1 + w2) + l - c1 - c2. One that waits
    is not similar to the leader, c1 < k (w1 + l): the other has to share k w2 + (1 - k) l - c2 at least, half of what it
    differs by if it is as heavy as the leader, and the one that waits k (w1 + l) - c1. So differences are put in one order,
    those that fewest members have last, and the first ones are left out as long as they are too few to be enough.
    """
    k = similarity / (1 + similarity)
    zipped = F.concat(
        F.transform(F.arrays_zip("only_a", "more_a"), lambda x: F.struct(F.xxhash64("leader", F.lit(1), x["only_a"]).alias("mark"), x["more_a"].alias("more"))),
        F.transform(F.arrays_zip("only_b", "more_b"), lambda x: F.struct(F.xxhash64("leader", F.lit(0), x["only_b"]).alias("mark"), x["more_b"].alias("more"))),
    )
    # A member of a leader is one number while its differences, hundreds of them, are dealt by mark and back.
    who = F.xxhash64("vertex", "leader").alias("who")
    measured = measured.withColumnsRenamed({"a": "vertex", "b": "leader", "wa": "weight", "wb": "lead"})
    members = measured.select(who, "vertex", "class", "waits", "common", "weight", "lead")
    every = measured.select(who, "class", "waits", F.explode(zipped).alias("d")).select("who", "class", "waits", "d.mark", "d.more")
    often = every.groupBy("mark").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.max("waits").alias("w"))
    often = stored(often.where("lo != hi AND w").select("mark", "n"))
    so_far = Window.partitionBy("who").orderBy(F.desc("n"), "mark").rowsBetween(Window.unboundedPreceding, 0)
    every = every.select("who", "mark", "more").join(often, "mark").withColumn("most", F.sum("more").over(so_far)).select("who", "mark", "most").join(members, "who")
    near = lambda w: 1e-6 * w
    asks = F.col("waits") & (F.col("most") >= k * (F.col("weight") + F.col("lead")) - F.col("common") - near(F.col("weight") + F.col("lead")))
    told = F.col("most") >= k * F.col("weight") + (1 - k) * F.col("lead") - F.col("common") - near(F.col("weight") + F.col("lead"))
    every = stored(every.select("mark", "vertex", "class", "common", "weight", "lead", "most", asks.alias("asks"), told.alias("told")).where("asks OR told"))
    names = ["vertex", "class", "common", "weight", "most"]
    others = every.where("told").select("mark", *[F.col(c).alias(f"other_{c}") for c in names])
    both = F.col("common") + F.col("other_common")
    least = k * (F.col("weight") + F.col("other_weight")) + F.col("lead") - both - near(F.col("weight") + F.col("other_weight") + F.col("lead"))
    share = F.least(F.col("weight") - F.col("common"), F.col("other_weight") - F.col("other_common")) + F.col("lead") - F.greatest("common", "other_common")
    hits = every.where("asks").join(others, "mark").where("class != other_class").where((F.least("most", "other_most") >= least) & (share >= least))
    return hits.select(*_ordered_pair("vertex", "other_vertex")).distinct()


def _more_leaders(met: DataFrame, sampled: DataFrame, classes: DataFrame, tested: DataFrame, texts: DataFrame, idf, reach: float) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs tested) after members outside their leader's class have met further members of that class, one a round.

    In a group of edited copies most pairs are similar, so a member that is just too unlike the leader is linked to
    the class by one of the next few; only what is left needs the search for whom it could be similar to. A round's
    leader has the least hash, so buckets of one group mostly share it and a pair is tested once.
    """
    for turn in range(LEADERS):
        heads = classes.withColumnsRenamed({"vertex": "leader", "class": "main"})
        of = met.select("bucket", "vertex", "leader").join(classes, "vertex", "left").join(heads, "leader", "left")
        of = stored(of.select("bucket", "vertex", (F.coalesce("class", "vertex") != F.coalesce("main", "leader")).alias("waits")))
        waiting = of.where("waits").select("bucket", "vertex")
        if waiting.isEmpty():
            break
        first = F.min(F.struct(F.xxhash64("vertex", F.lit(turn)).alias("h"), F.col("vertex").alias("head"))).alias("f")
        crowded = waiting.select("bucket").distinct()
        heads = of.where("NOT waits").join(crowded, "bucket", "left_semi").groupBy("bucket").agg(first).select("bucket", "f.head")
        pairs = waiting.join(heads, "bucket").select(*_ordered_pair("vertex", "head")).distinct()
        found = stored(_verified(_likely(pairs.join(tested, ["a", "b"], "left_anti"), sampled), texts, idf))
        tested = tested.union(found.select("a", "b"))
        late = found.where(F.col("distance") <= reach).select("a", "b")
        if not late.isEmpty():
            classes = _merged(classes, late)
    return classes, tested


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows whose document stays, with all their columns."""
    kept = near_duplicates(docs).where("kept").select(*KEY).distinct()
    names = docs.columns
    stays = lambda rows: rows.select("*", *row_key()).join(kept, KEY, "left_semi")
    rows = stays(docs.where("doc_id IS NOT NULL")).union(stays(docs.where("doc_id IS NULL")).dropDuplicates(KEY))
    return rows.select(*[F.col(f"`{c}`") for c in names])


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates(table(spark, folder, "documents"))
    return rows.select(F.col("__sm_doc").alias("doc_id"), "class_id", "class_size", "kept")
