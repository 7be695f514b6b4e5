"""Centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors become whole numbers, and vectors and centroids are transformed exactly:
the sum of squared coefficient differences is 64 times the squared distance.
Coefficients are ordered from coarse (few sign changes) to fine. After the
first ones the most promising centroid is finished; every centroid whose sum so
far is already strictly larger is out, the others take the next coefficients,
and those left at the end have all 64. What is dropped is strictly worse, so the
nearest centroid and every tie are exact.

The coefficients are written once as a table. A round is one pass over it: each
task adds up its vectors per cluster, one row per cluster and task is shuffled,
and the sums of at most ``k`` clusters reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import parts, stored, table
from shelfmark.llm.registry import query

WIDTH, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, "2:"
#: Components below this bound keep every sum of squares of the transform within 64 bits; others are Python integers.
SAFE = 1 << 24
#: Where the search stops to drop centroids, in coefficients.
STEPS = (8, 16, 32, 64)
ROWS = 4096
LONG = (1 << 63) - 1


def _coarse_to_fine() -> np.ndarray:
    """Places of the transform's rows by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < WIDTH:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


ORDER = _coarse_to_fine()
BACK = np.argsort(ORDER)


def _butterflies(x: np.ndarray) -> np.ndarray:
    half = 1
    while half < WIDTH:
        pairs = x.reshape(len(x), WIDTH // (2 * half), 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([left + right, left - right], axis=2).reshape(len(x), WIDTH)
        half *= 2
    return x


def transformed(x: np.ndarray) -> np.ndarray:
    """Coefficients of whole-number vectors (rows), coarse to fine; exact."""
    return _butterflies(x)[:, ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The vectors whose coefficients these are; exact, as the transform is its own inverse times 64."""
    return _butterflies(coefficients[:, BACK]) // WIDTH


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of coefficients; ties go to the smaller number."""
    gap = x[:, None, : STEPS[0]] - centroids[None, :, : STEPS[0]]
    so_far = (gap * gap).sum(2)
    guess = centroids[so_far.argmin(1)]
    bound = ((x - guess) * (x - guess)).sum(1)
    at, which = np.nonzero(so_far <= bound[:, None])
    total = so_far[at, which]
    for start, stop in zip(STEPS, STEPS[1:], strict=False):
        gap = x[at, start:stop] - centroids[which, start:stop]
        total = total + (gap * gap).sum(1)
        left = np.flatnonzero(total <= bound[at])
        at, which, total = at[left], which[left], total[left]
    # Every row keeps at least its guess; survivors stand in order of row and centroid.
    first = np.searchsorted(at, np.arange(len(x)))
    least = np.minimum.reduceat(total, first)
    tied = np.flatnonzero(total == least[at])
    best = tied[np.searchsorted(at[tied], np.arange(len(x)))]
    return which[best], least // WIDTH


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(rows whose vector has 64 finite components, their whole numbers, those of large vectors by place among them).

    A large vector has a component of ``SAFE`` or more; its row of the array is zero.
    """
    offsets = column.offsets.to_numpy().astype(np.int64)
    fits = (np.diff(offsets) == WIDTH) & ~column.is_null().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    found = values[offsets[:-1][rows][:, None] + np.arange(WIDTH)]
    finite = np.isfinite(found).all(1)
    rows, found = rows[finite], found[finite]
    large = np.flatnonzero((np.abs(found) >= SAFE // SCALE).any(1))
    # Beyond 2 ** 53 a double is a whole number, and scaling it could leave the range of doubles.
    exact = {int(i): [int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in found[i].tolist()] for i in large}
    found[large] = 0
    return rows, np.floor(found * SCALE).astype(np.int64), exact


KEPT = "vec_id long, large boolean, coefficients binary"
KEPT_ARROW = pa.schema([("vec_id", pa.int64()), ("large", pa.bool_()), ("coefficients", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, vectors, exact = whole_vectors(batch.column(1))
        cells = [row.tobytes() for row in transformed(vectors)]
        for i, vector in exact.items():
            cells[i] = ",".join(map(str, transformed(np.array([vector], object))[0])).encode()
        large = np.zeros(len(rows), bool)
        large[list(exact)] = True
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(large), pa.array(cells, pa.binary())], schema=KEPT_ARROW)


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, large, coefficients) of the rows with exactly 64 components, none null, NaN or infinite."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return own.mapInArrow(_packed, KEPT)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, coefficients) in portions of one kind: machine integers, or Python's."""
    cells, large = batch.column("coefficients"), batch.column("large").to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~large)
    for start in range(0, len(plain), ROWS):
        rows = plain[start : start + ROWS]
        yield rows, np.frombuffer(b"".join(cells.take(pa.array(rows)).to_pylist()), np.int64).reshape(-1, WIDTH)
    rows = np.flatnonzero(large)
    if len(rows):
        yield rows, np.array([[int(v) for v in cells[i].as_py().split(b",")] for i in rows], object)


class Centroids:
    """At most ``k`` whole-number centroids with their coefficients; small, so they travel with the tasks."""

    def __init__(self, vectors: Sequence[Sequence[int]]):
        self.vectors = [list(map(int, v)) for v in vectors]
        self.exact = transformed(np.array(self.vectors, object).reshape(-1, WIDTH))
        large = [any(abs(v) >= SAFE for v in vector) for vector in self.vectors]
        self.near = np.array([i for i, far in enumerate(large) if not far], np.int64)
        self.far = [i for i, far in enumerate(large) if far]
        self.plain = self.exact[self.near].astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As the function of this name. Large centroids meet machine integers only where they could be nearest."""
        if x.dtype == object or not len(self.near):
            return nearest(x.astype(object), self.exact)
        which, least = nearest(x, self.plain)
        which = self.near[which]
        if not self.far:
            return which, least
        vectors, again = restored(x), np.zeros(len(x), bool)
        for i in self.far:
            j = max(range(WIDTH), key=lambda j: abs(self.vectors[i][j]))
            value = max(-(1 << 30), min(1 << 30, self.vectors[i][j]))  # nearer than it is, or equal
            gap = value - vectors[:, j]
            again |= gap * gap <= least
        if again.any():
            which, least = which.astype(object), least.astype(object)
            which[again], least[again] = nearest(x[again].astype(object), self.exact)
            which = which.astype(np.int64)
        return which, least

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.vectors[i])).encode()).hexdigest()


SUMS = "cluster int, n long, sums array<string>"
SUMS_ARROW = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _sum_rows(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
    rows = [{"cluster": c, "n": n, "sums": [str(int(v)) for v in total]} for c, (n, total) in sorted(sums.items())]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=SUMS_ARROW)


def new_sums(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, n, sums) once per cluster that has vectors: the exact sums of their coefficients, as decimal texts."""

    def add(sums: dict[int, list], cluster: int, n: int, total: np.ndarray) -> None:
        entry = sums.setdefault(int(cluster), [0, np.zeros(WIDTH, object)])
        entry[0] += int(n)
        entry[1] = entry[1] + total.astype(object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in _slices(batch):
                which, _ = centroids.nearest(x)
                order = np.argsort(which, kind="stable")
                found, starts, n = np.unique(which[order], return_index=True, return_counts=True)
                for row in zip(found, n, np.add.reduceat(x[order], starts), strict=True):
                    add(sums, *row)
        yield from _sum_rows(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(sums, row["cluster"], row["n"], np.array([int(v) for v in row["sums"]], object))
        yield from _sum_rows(sums)

    return kept.mapInArrow(assign, SUMS).repartition(min(len(centroids.vectors), parts(kept.sparkSession)), "cluster").mapInArrow(merge, SUMS)


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> Centroids:
    """The ``k`` vectors with the smallest SHA-256 of seed and id; equal ids are told apart by their coefficients."""
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = kept.withColumn("mark", mark).orderBy("mark", F.col("vec_id").isNull(), "large", "coefficients").limit(k).collect()
    read = [[int(v) for v in r.coefficients.split(b",")] if r.large else np.frombuffer(r.coefficients, np.int64).tolist() for r in chosen]
    return Centroids(restored(np.array(read, object).reshape(-1, WIDTH)))


def fit(kept: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> Centroids:
    """Centroids after the rounds; a centroid without vectors stays where it is. ``kept`` should be a stored table."""
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids.vectors else 0):
        vectors = [*centroids.vectors]
        for row in new_sums(kept, centroids).collect():  # at most k rows
            total = restored(np.array([[int(v) for v in row["sums"]]], object))[0]
            vectors[row["cluster"]] = [int(v) // row["n"] for v in total]
        if vectors == centroids.vectors:
            break  # further rounds would repeat this one
        centroids = Centroids(vectors)
    return centroids


ASSIGNED = "vec_id long, cluster int, distance decimal(38,0)"
ASSIGNED_ARROW = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.decimal128(38, 0))])


def assigned(kept: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every kept vector; a distance of more than 38 digits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _slices(batch):
                which, least = centroids.nearest(x)
                if least.dtype == object:
                    far = pa.array([int(v) if v < 10**38 else None for v in least], pa.decimal128(38, 0))
                else:
                    far = pa.array(least).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(which, pa.int32()), far], schema=ASSIGNED_ARROW)

    return kept.mapInArrow(run, ASSIGNED)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Rows with another number of components, a null, a NaN or an infinite one are
    left out; an empty table, or one without kept rows, gives no rows. Fewer
    kept vectors than ``k`` are all centroids. Repeated rows are vectors of their
    own, a null id is hashed like an empty one. Components of any size are exact;
    a distance or sum that a long can't hold is null. Further columns are not read.
    """
    spark = vectors.sparkSession
    kept = stored(kept_vectors(vectors, id_col, vector_col))
    centroids = fit(kept, k, rounds)
    rows = stored(assigned(kept, centroids))
    missing = F.max(F.col("distance").isNull())
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("s"), missing.alias("missing")).collect()  # at most k rows
    per = {r.cluster: None if r.missing or r.s is None or r.s > LONG else int(r.s) for r in sums}
    total = sum(per.values()) if None not in per.values() else None
    total = total if total is None or total <= LONG else None
    small = spark.createDataFrame(
        [(c, own, total, centroids.digest(c)) for c, own in sorted(per.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    joined = rows.join(F.broadcast(small), "cluster")
    return joined.select(
        F.col("vec_id").alias(id_col), "cluster", F.when(F.col("distance") <= LONG, F.col("distance")).cast("long").alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256",
    )


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), vec_id) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), vec_id) <= {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT v.r, v.vec_id, v.x, c.c, {distance}::BIGINT AS d FROM v, c{i} c
  QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)""")
        if i < ROUNDS:
            steps.append(f"""
s{i} AS MATERIALIZED (
  SELECT c, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {WIDTH + 1}) AS t(j) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY c) m ON m.c = c.c)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""


@query("op12_centroid_clusters", _sql())
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings"))
