"""Quality and toxicity by co-training two views of a document.

The content view sees which words and which pairs of neighbouring character
classes a text holds; the metadata view sees language, source, the declared
length and the page's shape. Both are logistic regressions over selected
features. In each round a view labels the unlabelled documents it is surest of
for the other view. Calibrated on labelled rows that neither has seen, the
views' log-odds are combined and score every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffers, drawn, frugal, slices, small_batches, table
from shelfmark.llm.registry import query
from shelfmark.llm.words import words

WORD_BITS = 22
CLASSES = 64
SLICE = 1 << 20
TARGETS = ("quality", "toxic")


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds; the samples are the only rows the fit sees, scoring covers all."""

    labelled: int = 8_000
    unlabelled: int = 4_000
    rounds: int = 3
    share: float = 0.05  # of the unlabelled rows of either class that a view may label in a round
    sure: float = 0.97
    features: int = 400
    least_z: float = 4.5
    held_out: float = 0.3


def _char_classes() -> np.ndarray:
    """Lower, upper, digit and non-ASCII bytes are one class each, every other ASCII byte has its own."""
    found = np.zeros(256, np.int64)
    found[97:123], found[65:91], found[48:58], found[128:] = 1, 2, 3, 4
    rest = [b for b in range(128) if not found[b]]
    found[rest] = 5 + np.minimum(np.arange(len(rest)), CLASSES - 6)
    printable = [b for b in rest if b >= 32 or b in (9, 10)]
    found[rest] = CLASSES - 1
    found[printable] = 5 + np.arange(len(printable))
    return found


CHAR_CLASS = _char_classes()


def _hashed(column: pa.Array, size: int) -> np.ndarray:
    """A small code for each string, by its bytes; null has its own."""
    known: dict = {None: 0}
    for value in column.unique().to_pylist():
        if value is not None:
            code = 0
            for byte in value.encode():
                code = (code * 31 + byte) % 1_000_003
            known[value] = 1 + code % (size - 1)
    return np.array([known[v] for v in column.to_pylist()], np.int64)


def features(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the content and the metadata view: (row, feature) of every feature present, once each.

    The batch holds __sm_text, __sm_lang, __sm_source and __sm_chars.
    """
    data, offsets = buffers(batch.column(batch.schema.get_field_index("__sm_text")))
    rows = batch.num_rows
    sizes = offsets[1:] - offsets[:-1]
    hashes, cuts = words(data, offsets)
    counts = cuts[1:] - cuts[:-1]
    key = np.sort(np.repeat(np.arange(rows, dtype=np.uint64), counts) << np.uint64(40) | hashes >> np.uint64(24))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    word_row = (key >> np.uint64(40)).astype(np.int64)
    word = (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    kind = CHAR_CLASS[data]
    byte_row = np.repeat(np.arange(rows), sizes)
    pairs = np.zeros(0, np.int64)
    if len(data) > 1:
        inside = byte_row[1:] == byte_row[:-1]
        table_ = np.zeros(rows * CLASSES * CLASSES, bool)
        table_[(byte_row[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[inside]] = True
        pairs = np.flatnonzero(table_)
    content = (
        np.concatenate([word_row, pairs // CLASSES**2]), np.concatenate([word, (1 << WORD_BITS) + pairs % CLASSES**2]),
    )

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(sizes, 1)

    distinct = np.bincount(word_row, minlength=rows)
    lines = share(data == 10) * sizes + 1
    declared = batch.column(batch.schema.get_field_index("__sm_chars"))
    given = np.array([-1 if v is None else v for v in declared.to_pylist()], np.float64)
    chars = sizes * (1 - share((data & 0xC0) == 0x80))
    log = lambda x: np.log2(np.maximum(x, 0) + 1)
    scaled = [
        np.where(given < 0, 31, log(given)), np.where(given < 0, 31, np.minimum(np.abs(log(given) - log(chars)) * 4, 30)),
        log(lines), log(sizes / lines) * 2, share(kind == 2) * 30, share(kind == 3) * 60, share(kind == 4) * 30,
        share(kind > 6) * 40, share(np.isin(data, np.frombuffer(b"!|#%$&*", np.uint8))) * 100,
        distinct / np.maximum(counts, 1) * 30, log(counts), sizes / np.maximum(counts, 1) * 2,
    ]
    numeric = [np.clip(v, 0, 31).astype(np.int64) + 512 + 32 * i for i, v in enumerate(scaled)]
    lang = _hashed(batch.column(batch.schema.get_field_index("__sm_lang")), 128)
    source = _hashed(batch.column(batch.schema.get_field_index("__sm_source")), 384) + 128
    columns = [lang, source, *numeric]
    meta = np.tile(np.arange(rows), len(columns)), np.concatenate(columns)
    return content, meta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = _sigmoid(x @ weights)
        slope = x.T @ (y - p) - ridge * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class View:
    """Selected features of one view with their weights."""

    picked: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0

    def fit(self, rows: np.ndarray, dims: np.ndarray, chosen: np.ndarray, y: np.ndarray, settings: Settings) -> View:
        """``chosen`` rows have the labels ``y``; features differ between the classes by ``least_z`` deviations."""
        label = np.full(max(int(rows.max(initial=0)), int(chosen.max(initial=0))) + 1, -1, np.int8)
        label[chosen] = y
        of = label[rows]
        names, at = np.unique(dims, return_inverse=True)
        yes = np.bincount(at[of == 1], minlength=len(names))
        no = np.bincount(at[of == 0], minlength=len(names))
        n_yes, n_no = (y == 1).sum(), (y == 0).sum()
        share = (yes + no + 1) / (n_yes + n_no + 2)
        spread = np.sqrt(share * (1 - share) * (1 / n_yes + 1 / n_no))
        z = np.abs(yes / n_yes - no / n_no) / np.maximum(spread, 1e-9)
        z[yes + no < 5] = 0
        best = np.argsort(-z, kind="stable")[: settings.features]
        self.picked = np.sort(names[best[z[best] >= settings.least_z]]).astype(np.int64)
        weights = _regression(self.matrix(rows, dims, chosen, len(label)), y)
        self.weights, self.base = weights[:-1], float(weights[-1])
        return self

    def matrix(self, rows: np.ndarray, dims: np.ndarray, chosen: np.ndarray, count: int) -> np.ndarray:
        place = np.full(count, -1)
        place[chosen] = np.arange(len(chosen))
        dense = np.zeros((len(chosen), len(self.picked)), np.float32)
        if len(self.picked):
            at = np.minimum(np.searchsorted(self.picked, dims), len(self.picked) - 1)
            use = (self.picked[at] == dims) & (place[rows] >= 0)
            dense[place[rows[use]], at[use]] = 1
        return dense

    def scores(self, rows: np.ndarray, dims: np.ndarray, count: int) -> np.ndarray:
        """Log-odds of every row."""
        if not len(self.picked):
            return np.full(count, self.base)
        at = np.minimum(np.searchsorted(self.picked, dims), len(self.picked) - 1)
        use = self.picked[at] == dims
        return self.base + np.bincount(rows[use], self.weights[at[use]], minlength=count)


@dataclass
class Model:
    """Two views and the calibrated sum of their log-odds; ``constant`` if there was one class only."""

    views: list[View] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None

    def scores(self, both: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(count, self.constant)
        odds = [view.scores(*found, count) for view, found in zip(self.views, both, strict=True)]
        return _sigmoid(self.mix[0] * odds[0] + self.mix[1] * odds[1] + self.mix[2])


def co_train(both: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> Model:
    """``labels`` holds 1, 0 or -1 (unlabelled) for every row, in a fixed order."""
    known, open_ = np.flatnonzero(labels >= 0), np.flatnonzero(labels < 0)
    if len(np.unique(labels[known])) < 2:
        return Model(constant=float(labels[known[0]]) if len(known) else 0.5)
    every = max(2, round(1 / settings.held_out))
    seen, held = known[np.arange(len(known)) % every > 0], known[np.arange(len(known)) % every == 0]
    if min((labels[seen] == 1).sum(), (labels[seen] == 0).sum()) == 0 or len(np.unique(labels[held])) < 2:
        seen = held = known
    pools = [(seen, labels[seen]), (seen, labels[seen])]
    views = [View(), View()]
    count = len(labels)
    for turn in range(settings.rounds + 1):
        for view, found, pool in zip(views, both, pools, strict=True):
            view.fit(*found, *pool, settings)
        if turn == settings.rounds or not len(open_):
            break
        given = []
        for view, found in zip(views, both, strict=True):
            p = _sigmoid(view.scores(*found, count)[open_])
            by = []
            for kind in (p > 0.5, p <= 0.5):  # the surest of each class, in proportion
                own = np.flatnonzero(kind)
                own = own[np.argsort(-np.abs(p[own] - 0.5), kind="stable")][: int(settings.share * len(own))]
                by.append(own[np.maximum(p[own], 1 - p[own]) >= settings.sure])
            by = np.concatenate(by)
            given.append((open_[by], (p[by] > 0.5).astype(np.int64)))
        for i, (rows, y) in enumerate(given):  # each view teaches the other
            old, old_y = pools[1 - i]
            new = ~np.isin(rows, old)
            pools[1 - i] = np.concatenate([old, rows[new]]), np.concatenate([old_y, y[new]])
    odds = np.stack([view.scores(*found, count)[held] for view, found in zip(views, both, strict=True)], axis=1)
    return Model(views, _regression(np.clip(odds, -12, 12), labels[held]))


def _columns(docs: DataFrame) -> list:
    found = {c.lower(): c for c in docs.columns}
    text = lambda c: F.col(f"`{found[c]}`").cast("string") if c in found else F.lit(None).cast("string")
    chars = F.col(f"`{found['n_chars']}`").cast("long") if "n_chars" in found else F.lit(None).cast("long")
    return [
        F.coalesce(text("text"), F.lit("")).alias("__sm_text"), text("lang").alias("__sm_lang"), text("source").alias("__sm_source"),
        chars.alias("__sm_chars"),
    ]


def fit_models(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict[str, Model]:
    """One model for each target, from at most ``labelled`` + ``unlabelled`` documents drawn by a hash of their id.

    Labels of one document are combined: the worst counts. Rows without an id
    or with null labels teach nothing.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"),
    )
    taught = drawn(marks, settings.labelled, ["doc_id"])
    others = drawn(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.lit(1).alias("other")), settings.unlabelled, ["doc_id", "other"])
    others = others.join(F.broadcast(taught), "doc_id", "left_anti")
    blank = F.lit(-1).alias
    picked = taught.unionByName(others.select("doc_id", blank("quality"), blank("toxic")))
    # At most labelled + unlabelled rows of three numbers.
    source = docs.select("doc_id", *_columns(docs)).join(F.broadcast(picked), "doc_id").select("doc_id", *TARGETS, "__sm_text", "__sm_lang", "__sm_source", "__sm_chars")
    shape = "doc_id long, quality int, toxic int, content binary, meta binary"
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(3))
            for start, stop in slices(offsets, SLICE):
                part = batch.slice(start, stop - start)
                packed = []
                for rows, dims in features(part):
                    order = np.argsort(rows, kind="stable")
                    cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
                    sorted_dims = dims[order].astype(np.int32)
                    packed.append(pa.array([sorted_dims[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed], names=["doc_id", *TARGETS, "content", "meta"])

    found = sorted(source.mapInArrow(frugal("quality", run), shape).collect(), key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % (1 << 64), r.doc_id, bytes(r.content)))
    both = []
    for name in ("content", "meta"):
        dims = [np.frombuffer(r[name], np.int32) for r in found]
        rows = np.repeat(np.arange(len(dims)), [len(d) for d in dims])
        both.append((rows.astype(np.int32), np.concatenate([*dims, np.zeros(0, np.int32)])))
    return {name: co_train(both, np.array([r[name] for r in found], np.int64), settings) for name in TARGETS}


def score(docs: DataFrame, models: dict[str, Model], columns: list[str] | None = None) -> DataFrame:
    """The named columns of every row, ``quality_score``, ``toxic_score`` (probabilities) and ``accepted``.

    A document is accepted if it is likelier good than not and likelier clean
    than toxic. Null and empty texts are scored like any other; repeated rows
    get equal scores; an empty table gives no rows.
    """
    names = docs.columns if columns is None else columns
    source = docs.select(*[F.col(f"`{c}`") for c in names], *_columns(docs))
    keep = len(names)
    schema = source.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("quality_score"), F.lit(0.0).alias("toxic_score"), F.lit(True).alias("accepted")).schema
    shared = docs.sparkSession.sparkContext.broadcast(models)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(keep))
            for start, stop in slices(offsets, SLICE):
                part = batch.slice(start, stop - start)
                own = pa.RecordBatch.from_arrays(part.columns[keep:], names=["__sm_text", "__sm_lang", "__sm_source", "__sm_chars"])
                both = list(features(own))
                good, toxic = (np.round(shared.value[t].scores(both, part.num_rows), 6) for t in TARGETS)
                accepted = (good >= 0.5) & (toxic < 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(good), pa.array(toxic), pa.array(accepted)], names=[*names, "quality_score", "toxic_score", "accepted"])

    return source.mapInArrow(frugal("quality", run), schema)


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, fit_models(docs, table(spark, folder, "labels")), ["doc_id"])
