"""Many-query top-k over a large corpus, without pairing every query and chunk.

The corpus stays where it is. Each task keeps only the best ``k`` rows per
query while its Arrow batches stream by, so it emits at most ``k`` rows per
query; a window over those few rows gives the final ranks.

The query side is held in memory by every task, so its size is checked first.
Beyond the bound both sides are cut into blocks of similar vectors, and a query
block meets a corpus block only if the angles between them allow a score that
reaches its queries' k-th (see ``cells``); where that spares too little, and for
queries with scopes, every block of queries meets every block of the corpus (of
its scope), in blocks so large that each side is sent a few times only. All ways
are exact and give the same rows.

Scores are rounded to nine decimals before ranking, so ranks do not depend on
the order in which a product was summed. Ties are broken by chunk id. Products
are first taken in single precision; everything that could still be among the
best k, given the largest possible error, is scored again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.operators.spread import SMALL_BYTES, input_bytes, stored

SCORE_DECIMALS = 9
MAX_QUERY_ROWS = 8192
MAX_QUERY_BYTES = 128 << 20
CORPUS_BLOCK_ROWS = 100_000
#: Blocks of a grid hold up to this many times the queries that are scored at once.
GRID_TILES = 16
#: Groups of a grid per core, so that uneven tasks do not keep one core busy at the end.
GRID_GROUPS = 8
SMALL_GROUPS = 100_000
_CELLS_PER_STEP = 1 << 20


@dataclass(frozen=True)
class Limits:
    """How large a query set one task may hold, and the block sizes beyond."""

    query_rows: int = MAX_QUERY_ROWS
    query_bytes: int = MAX_QUERY_BYTES
    corpus_block_rows: int = CORPUS_BLOCK_ROWS


def _numpy(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    if column.num_chunks == 1:
        return column.chunk(0)
    merged = column.combine_chunks()
    return merged if isinstance(merged, pa.Array) else pa.concat_arrays(merged.chunks)


def matrix_of(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; all lists must have the same width."""
    lists = one_array(column)
    rows = len(lists)
    if rows == 0:
        return np.zeros((0, width or 0))
    found = pc.min_max(pc.list_value_length(lists))
    low, high = found["min"].as_py(), found["max"].as_py()
    if low != high or (width is not None and low != width):
        raise ValueError(f"vectors of different widths: {low} to {high}, expected {width or low}")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, low)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; zero vectors become NaN rows."""
    matrix = matrix.astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / np.where(norms == 0, np.nan, norms)


@dataclass(frozen=True)
class Scored:
    """Scores of some rows against some queries: rows x queries, -inf for no hit.

    ``rough`` is within ``error`` of the true score, which ``exact`` gives for
    single (row, query) cells.
    """

    rough: np.ndarray
    error: float
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]


Scorer = Callable[[pa.Table | pa.RecordBatch, int, int, np.ndarray], Scored]


def _at_least(scores: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Flat places of the finite scores that reach their column's bound, compared in the scores' own precision."""
    low = bound.astype(scores.dtype)
    low = np.where(low > bound, np.nextafter(low, scores.dtype.type(-np.inf)), low)
    return np.flatnonzero(scores >= np.maximum(low, np.finfo(scores.dtype).min))


class BestRows:
    """The best k (score, id) per query seen so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.ids: np.ndarray | None = None
        self.extra: list[pa.Array] = []
        self.floor = np.full(queries, -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]] = []
        self.n_waiting = 0

    def offer(
        self, part: Scored, queries: np.ndarray, ids: pa.Array, extra: list[pa.Array], threshold: float | None
    ) -> None:
        """Take in the rows of one part that may still be among the best of ``queries``."""
        scores = part.rough
        rows, width = scores.shape
        bound = self.floor[queries] - part.error
        if threshold is not None:
            bound = np.maximum(bound, threshold - part.error)
        near = _at_least(scores, bound)
        if rows > self.k and len(near) > 2 * self.k * width:  # the part's own k-th score is a bound as well
            kth = np.partition(scores, rows - self.k, axis=0)[rows - self.k]
            near = _at_least(scores, np.maximum(bound, kth - 2 * part.error))
        if len(near) == 0:
            return
        row, query = np.divmod(near, width)
        score = np.round(part.exact(row, query), SCORE_DECIMALS)
        query = queries[query]
        reaching = score >= self.floor[query]
        if threshold is not None:
            reaching &= score >= threshold
        row, query, score = row[reaching], query[reaching], score[reaching]
        if len(row) == 0:
            return
        places = pa.array(row)
        self.waiting.append((query, score, _numpy(ids.take(places)), [column.take(places) for column in extra]))
        self.n_waiting += len(row)
        if 4 * self.n_waiting >= len(self.query):  # a few new rows can wait: the bounds are lower then, but hold
            self.merge()

    def merge(self) -> None:
        """Put the waiting rows among the best, and raise the bounds."""
        if not self.waiting:
            return
        if self.ids is not None:
            self.waiting.insert(0, (self.query, self.score, self.ids, self.extra))
        query, score, found = (np.concatenate(column) for column in list(zip(*self.waiting))[:3])
        carried = [pa.concat_arrays(column) for column in zip(*[w[3] for w in self.waiting])]
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        sizes = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        kept = place < self.k
        self.query, self.score, self.ids = query[kept], score[kept], found[kept]
        self.extra = [column.take(pa.array(order[kept])) for column in carried]
        full = sizes >= self.k
        self.floor[query[starts[full]]] = score[starts[full] + self.k - 1]

    def table(self, query_ids: pa.Array, schema: pa.Schema) -> pa.Table:
        self.merge()
        if self.ids is None:
            return schema.empty_table()
        columns = [query_ids.take(pa.array(self.query)), pa.array(self.ids), pa.array(self.score), *self.extra]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


class _Scopes:
    """Which queries may see which scope; a query without scopes sees all, a null among them opens nothing."""

    def __init__(self, queries: pa.Table) -> None:
        allowed = queries.column("scopes").to_pylist()
        self.names = pa.array(sorted({s for a in allowed if a is not None for s in a if s is not None}), pa.string())
        code = {name: place for place, name in enumerate(self.names.to_pylist())}
        asking: list[list[int]] = [[] for _ in range(len(code) + 1)]
        for query, scopes in enumerate(allowed):
            for place in range(len(asking)) if scopes is None else {code[s] for s in scopes if s is not None}:
                asking[place].append(query)
        self.asking = [np.array(queries_here, dtype=np.int64) for queries_here in asking]

    def parts(self, batch: pa.Table | pa.RecordBatch) -> Iterator[tuple[pa.Table | pa.RecordBatch, np.ndarray]]:
        """The batch cut by scope, each with the queries that may see it."""
        found = pc.fill_null(pc.index_in(one_array(batch.column("scope")), value_set=self.names), len(self.names))
        codes = found.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else []
        for start, stop in zip(starts, [*starts[1:], len(codes)]):
            queries = self.asking[codes[start]]
            if len(queries):
                yield batch.take(pa.array(order[start:stop])), queries


def dense_scorer(queries: pa.Table) -> Scorer:
    """Cosine similarity; zero vectors never count."""
    wanted = unit_rows(matrix_of(queries.column("vector")))
    rough_wanted = wanted.astype(np.float32)
    aimless = np.isnan(rough_wanted).any(axis=1)
    width = wanted.shape[1]
    # Largest error of a single-precision product of two unit rows, with room.
    error = (width + 8) * 1.2e-7 + 10.0**-SCORE_DECIMALS
    step = max(1, _CELLS_PER_STEP // max(1, width))

    def score(batch: pa.Table | pa.RecordBatch, start: int, rows: int, queries: np.ndarray) -> Scored:
        raw = matrix_of(one_array(batch.column("vector")).slice(start, rows), width)
        single = raw.astype(np.float32)
        norms = np.linalg.norm(single, axis=1, keepdims=True)
        odd = ~np.isfinite(norms[:, 0]) | (norms[:, 0] < 1e-15)
        if odd.any():  # too long or too short for single precision
            single = unit_rows(raw).astype(np.float32)
            norms = np.ones((rows, 1), dtype=np.float32)
        everyone = len(queries) == len(rough_wanted)
        units = single / norms
        rough = units @ (rough_wanted if everyone else rough_wanted[queries]).T
        without = np.isnan(units).any(axis=1)
        if without.any():
            rough[without] = -np.inf
        if aimless.any():
            rough[:, aimless if everyone else aimless[queries]] = -np.inf

        def exact(row: np.ndarray, query: np.ndarray) -> np.ndarray:
            out = np.empty(len(row))
            for place in range(0, len(row), step):
                some = slice(place, place + step)
                out[some] = np.einsum("ij,ij->i", unit_rows(raw[row[some]]), wanted[queries[query[some]]])
            return out

        return Scored(rough, error, exact)

    return score


def lexical_scorer(queries: pa.Table) -> Scorer:
    """Share of a query's distinct terms that occur in the chunk; none is no hit."""
    terms = one_array(queries.column("terms"))
    flat = terms.flatten()
    owner = np.repeat(
        np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    )
    vocabulary = flat.unique()
    code = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    postings = owner[order]
    sizes = np.bincount(code, minlength=len(vocabulary))
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, dtype=np.int64)
    totals = np.bincount(owner, minlength=len(terms)).astype(np.float64)

    def score(batch: pa.Table | pa.RecordBatch, start: int, rows: int, queries: np.ndarray) -> Scored:
        lists = one_array(batch.column("terms")).slice(start, rows)
        sizes_here = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        row = np.repeat(np.arange(rows), sizes_here)
        found = pc.index_in(lists.flatten(), value_set=vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        row = row[known]
        term = found.drop_null().to_numpy(zero_copy_only=False)
        counts = sizes[term]
        cell_row = np.repeat(row, counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        cell_query = postings[np.repeat(starts[term], counts) + offset]
        hits = np.bincount(cell_row * len(totals) + cell_query, minlength=rows * len(totals))
        hits = hits.reshape(rows, len(totals)).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = np.where(hits > 0, hits / totals, -np.inf)
        if len(queries) != len(totals):
            shares = shares[:, queries]
        return Scored(shares, 10.0**-SCORE_DECIMALS, lambda row, query: shares[row, query])

    return score


def prefix_scorer(queries: pa.Table) -> Scorer:
    """Cosine of the first components only: a query's ``probe`` is a struct of vector and width, a chunk's the whole vector.

    One pass over the chunks thus serves the same queries at several widths.
    """
    probes = one_array(queries.column("probe"))
    vectors, widths = matrix_of(probes.field("vector")), probes.field("width").to_numpy()
    groups = [(w, np.flatnonzero(widths == w), unit_rows(vectors[widths == w][:, :w])) for w in np.unique(widths)]

    def score(batch: pa.Table | pa.RecordBatch, start: int, rows: int, asking: np.ndarray) -> Scored:
        raw = matrix_of(one_array(batch.column("probe")).slice(start, rows))
        scores = np.empty((rows, len(widths)))
        for width, at, wanted in groups:
            scores[:, at] = unit_rows(raw[:, :width]) @ wanted.T
        scores = scores[:, asking]
        scores[np.isnan(scores)] = -np.inf
        return Scored(scores, 10.0**-SCORE_DECIMALS, lambda row, query: scores[row, query])

    return score


SCORERS = {"probe": prefix_scorer, "vector": dense_scorer, "terms": lexical_scorer}


class _BlockSearch:
    """Scores corpus batches against one block of queries held in memory."""

    def __init__(self, queries: pa.Table, field: str, k: int, threshold: float | None, skip_self: bool,
                 carry: Sequence[str], scorer: Callable[[pa.Table], Scorer] | None = None) -> None:
        self.queries = queries
        self.ids = one_array(queries.column("query_id"))
        self.own = _numpy(self.ids) if skip_self else None
        self.score = (scorer or SCORERS[field])(queries)
        self.scopes = _Scopes(queries) if "scopes" in queries.column_names else None
        self.everyone = np.arange(len(queries))
        self.threshold, self.carry = threshold, carry
        self.best = BestRows(len(queries), k)

    def feed(self, batch: pa.Table | pa.RecordBatch) -> None:
        for part, queries in self.scopes.parts(batch) if self.scopes else [(batch, self.everyone)]:
            part = part.combine_chunks() if isinstance(part, pa.Table) else part
            ids = one_array(part.column("chunk_id"))
            extra = [one_array(part.column(name)) for name in self.carry]
            step = max(1, _CELLS_PER_STEP // max(1, len(queries)))
            for start in range(0, part.num_rows, step):
                rows = min(step, part.num_rows - start)
                scored = self.score(part, start, rows, queries)
                some = ids.slice(start, rows)
                if self.own is not None:
                    scored.rough[_numpy(some)[:, None] == self.own[queries][None, :]] = -np.inf
                carried = [column.slice(start, rows) for column in extra]
                self.best.offer(scored, queries, some, carried, self.threshold)


def _prepare(df: DataFrame, key: str, field: str, others: Sequence[str]) -> DataFrame:
    present = dict.fromkeys([key, field, *[c for c in others if c in df.columns]])
    return df.where(F.col(field).isNotNull()).select(*present)


def score_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    field: str = "vector",
    threshold: float | None = None,
    skip_self: bool = False,
    carry: Sequence[str] = (),
    limits: Limits = Limits(),
    held: pa.Table | None = None,
    scorer: Callable[[pa.Table], Scorer] | None = None,
) -> DataFrame:
    """Candidates (query_id, chunk_id, score): every query's best k and more.

    ``chunks`` has chunk_id, the scored field and, with scopes, ``scope``;
    ``queries`` has query_id, the field and optionally ``scopes``. ``carry``
    names small chunk columns to keep on the hits, which saves joining them
    back; leave texts out, as every chunk's value passes through Python.
    ``held`` are the queries if the caller has them from ``held_queries``;
    ``scorer`` takes the place of the field's own.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    scoped = "scopes" in queries.columns
    corpus = _prepare(chunks, "chunk_id", field, [*carry, *(["scope"] if scoped else [])])
    asked = _prepare(queries, "query_id", field, ["scopes"])
    out = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
            *[corpus.schema[name] for name in carry],
        ]
    )
    arrow_out = to_arrow_schema(out)

    held = _hold(asked, limits) if held is None else held
    if held is not None:
        if held.num_rows == 0:
            return asked.sparkSession.createDataFrame([], out)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _BlockSearch(held, field, k, threshold, skip_self, carry, scorer)
            for batch in batches:
                block.feed(batch)
            yield from block.best.table(block.ids, arrow_out).to_batches()

        return corpus.mapInArrow(search, out)

    def meet(part: pa.Table, block: pa.Table) -> pa.Table:
        """The block's queries are scored some at a time, so that their products stay small however large the block."""
        found = [arrow_out.empty_table()]
        for start in range(0, block.num_rows if part.num_rows else 0, limits.query_rows):
            search = _BlockSearch(block.slice(start, limits.query_rows), field, k, threshold, skip_self, carry, scorer)
            search.feed(part)
            found.append(search.best.table(search.ids, arrow_out))
        return pa.concat_tables(found)

    sample = asked.limit(16).toArrow()
    row_bytes = max(1, 2 * sample.nbytes // max(1, sample.num_rows))
    block_rows = max(1, min(limits.query_rows, limits.query_bytes // row_bytes))
    chunk_rows = max(1, min(limits.corpus_block_rows, limits.query_bytes // row_bytes))
    if field != "vector":
        return _grid_topk(corpus, asked, meet, out, block_rows, chunk_rows)
    # Both sides are read several times from here on, and the caller may read the result more than once.
    corpus, asked = stored(corpus), stored(asked)
    grid_rows = max(1, min(GRID_TILES * limits.query_rows, limits.query_bytes // row_bytes))
    if scoped:
        return stored(_scoped_topk(corpus, asked, meet, out, carry, grid_rows))
    from shelfmark.operators.cells import bounded_topk

    return stored(bounded_topk(corpus, asked, k, meet, out, block_rows=block_rows, chunk_rows=chunk_rows, grid_rows=grid_rows, threshold=threshold))


def held_queries(queries: DataFrame, limits: Limits = Limits()) -> pa.Table | None:
    """The queries as every task would hold them, or None if they are beyond the bound."""
    return _hold(queries, limits)


def _hold(asked: DataFrame, limits: Limits) -> pa.Table | None:
    """The queries, if they are few enough for every task to hold them.

    Reads at most one row more than that. Where the input is large the ids are
    counted first, partition by partition, until the bound is passed.
    """
    most = limits.query_rows
    if input_bytes(asked) > SMALL_BYTES and len(asked.select("query_id").take(most + 1)) > most:
        return None
    held = asked.limit(most + 1).toArrow()
    fits = held.num_rows <= most and held.nbytes * 2 <= limits.query_bytes
    return held if fits else None


def _grid_topk(
    corpus: DataFrame, asked: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], out: T.StructType, block_rows: int, chunk_rows: int,
) -> DataFrame:
    """Every query block meets every corpus block; both blocks are of bounded size. For fields without bounds."""
    query_blocks = max(1, math.ceil(asked.count() / block_rows))
    corpus_blocks = max(1, math.ceil(corpus.count() / chunk_rows))

    def block_of(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = corpus.withColumn("cb", block_of("chunk_id", corpus_blocks)).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", block_of("query_id", query_blocks)).withColumn("cb", every(corpus_blocks))
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, out)


def grid_rows_for(pairs: int, cores: int, most: int) -> int:
    """Rows of a block: as large as the bound allows, but with enough pairs of blocks for all cores."""
    return max(1, min(most, math.isqrt(max(1, pairs) // (GRID_GROUPS * cores))))


def grid_of_groups(
    corpus: DataFrame, asked: DataFrame, group: str, meet: Callable[[pa.Table, pa.Table], pa.Table], out: T.StructType, most: int,
) -> DataFrame:
    """Every query meets every chunk of its ``group``, in blocks of at most about ``most`` rows; groups of any size.

    The blocks are as large as that, so each row is sent once for every block
    of the other side, and no more.
    """
    spark = corpus.sparkSession
    n = lambda df, name: df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    sizes = stored(n(corpus, "__c").join(n(asked, "__q"), group))
    many, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__c") * F.col("__q")), F.lit(0))).first()
    rows = grid_rows_for(total, spark.sparkContext.defaultParallelism, most)
    blocks = lambda name: F.ceil(F.col(name) / rows).cast("int").alias(f"{name}b")
    cut = sizes.select(group, blocks("__c"), blocks("__q"))
    cut = F.broadcast(cut) if many <= SMALL_GROUPS else cut  # a join by so few groups would be uneven
    groups = cut.agg(F.coalesce(F.sum(F.col("__cb") * F.col("__qb")), F.lit(0))).first()[0]

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias("cb" if own == "__cb" else "qb")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("cb" if other == "__cb" else "qb")
        return df.join(cut, group).select(*df.columns, block, every)

    keys = [group, "qb", "cb"]
    parts = max(1, min(2 * groups, 8192))
    left = dealt(corpus, "chunk_id", "__cb", "__qb").repartition(parts, *keys)
    right = dealt(asked, "query_id", "__qb", "__cb").repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out)


def _scoped_topk(
    corpus: DataFrame, asked: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], out: T.StructType, carry: Sequence[str], most: int,
) -> DataFrame:
    """Queries meet the chunks of their scopes only; those without scopes meet all chunks."""
    bare = [c for c in corpus.columns if c != "scope" or c in carry]
    shared = asked.where(F.col("scopes").isNotNull()).withColumn("__scope", F.explode(F.array_distinct("scopes"))).drop("scopes")
    scored = grid_of_groups(corpus.select(*bare, F.col("scope").alias("__scope")), shared, "__scope", meet, out, most)
    free = asked.where(F.col("scopes").isNull()).drop("scopes").withColumn("__scope", F.lit(0))
    if free.isEmpty():
        return scored
    return scored.unionByName(grid_of_groups(corpus.select(*bare, F.lit(0).alias("__scope")), free, "__scope", meet, out, most))


def rank_hits(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Final ranks 1..k per query, best score first, ties by chunk id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(chunks: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Ranked hits (query_id, chunk_id, score, rank) of every query."""
    return rank_hits(score_topk(chunks, queries, k, **options), k)
