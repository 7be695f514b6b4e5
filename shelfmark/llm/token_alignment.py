"""Cross-tokenizer alignment: groups of tokens of two tokenizers that end at the same bytes.

The ends of all tokens are two rising arrays. From a shared border both are
compared at the current index shift, in windows that double as long as every end
is equal: a one-to-one stretch is jumped without looking at borders. Where an end
differs, the smaller side moves on until both meet again; that is an irregular
group, and the shift is the new difference of the indices. Arrays are cut into
lanes at borders, and all lanes of a portion take their steps together in numpy.

Documents are encoded once. Blocks of them keep one list of distinct id pairs,
and a document refers to the pairs of its block by number, so that the count of
a pair travels once per block and not once per document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffers, parts, slices, stored, table
from shelfmark.llm.registry import query

# Fixed value: the word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 2 << 20
#: A block of documents ends at so many bytes of text, or distinct pairs.
BLOCK_BYTES, BLOCK_PAIRS = 8 << 20, 1_000_000
LANE = 128
#: Groups with more links are counted by distinct ids, and links are listed in portions of so many.
LISTED, PORTION = 256, 4 << 20


class ByteTokens:
    """What both tokenizers need here: ids of texts, and the bytes of every id."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        digits = [str(i).encode() for i in range(len(pieces))]
        self.width = max(map(len, digits), default=1)
        self.digit_sizes = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(self.width + 1) for d in digits), np.uint8).reshape(-1, self.width + 1)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


class ByteLevel(ByteTokens):
    """A plain byte-level BPE file; strings of added tokens are plain text."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE")
        # Printable bytes stand for themselves, the others for the letters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = [ranks[bytes(letters[c] for half in (m.split(" ") if isinstance(m, str) else m) for c in half)] for m in model["merges"]]
        if merged != sorted(merged) or any(ranks[bytes([b])] > merged[0] for b in range(256)):
            raise ValueError("ids are not in the order of the merges")
        pieces = [b""] * (max([*ranks.values(), *model["vocab"].values()]) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        super().__init__(pieces)
        self.coder = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.coder.encode_to_numpy(" " + t).astype(np.int64) for t in texts]


class Pieces(ByteTokens):
    """A sentencepiece model with byte fallback; it puts a space in front of a text."""

    def __init__(self, content: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.vocab_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.coder.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.coder.encode(texts, num_threads=1)]


def borders(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B end a group. Both arrays rise strictly and have the same last value."""
    in_a, in_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    jumps_a, jumps_b = np.zeros(len(a_ends) + 1, np.int8), np.zeros(len(b_ends) + 1, np.int8)
    if not len(a_ends):
        return in_a, in_b
    i = np.arange(LANE, len(a_ends), LANE)
    j = np.searchsorted(b_ends, a_ends[i])
    _walk(a_ends, b_ends, i, j, np.arange(len(i)), in_a, in_b)
    i, j = np.concatenate([[0], i]), np.concatenate([[0], j])
    stop = np.concatenate([i[1:], [len(a_ends)]])
    lanes = np.flatnonzero(i < stop)
    while len(lanes):
        probing, size = lanes, 4
        while len(probing):
            steps = np.arange(size)
            at = i[probing][:, None] + steps
            other = np.minimum(j[probing][:, None] + steps, len(b_ends) - 1)
            same = (at < stop[probing][:, None]) & (a_ends[np.minimum(at, len(a_ends) - 1)] == b_ends[other])
            run = np.where(same.all(1), size, same.argmin(1))
            some = probing[run > 0]
            length = run[run > 0]
            jumps_a[i[some]] += 1
            jumps_b[j[some]] += 1
            i[some] += length
            j[some] += length
            jumps_a[i[some]] -= 1
            jumps_b[j[some]] -= 1
            probing, size = probing[run == size], 2 * size
        lanes = lanes[i[lanes] < stop[lanes]]
        _walk(a_ends, b_ends, i, j, lanes, in_a, in_b)
        lanes = lanes[i[lanes] < stop[lanes]]
    return in_a | (np.cumsum(jumps_a[:-1], dtype=np.int64) > 0), in_b | (np.cumsum(jumps_b[:-1], dtype=np.int64) > 0)


def _walk(a_ends: np.ndarray, b_ends: np.ndarray, i: np.ndarray, j: np.ndarray, lanes: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> None:
    """Move the lanes just past their next shared end, which is marked."""
    while len(lanes):
        x, y = a_ends[i[lanes]], b_ends[j[lanes]]
        met = lanes[x == y]
        in_a[i[met]] = in_b[j[met]] = True
        i[lanes] += x <= y
        j[lanes] += y <= x
        lanes = lanes[x != y]


class Groups:
    """The groups of several documents' tokens, with their links; ``a_cuts`` and ``b_cuts`` are the tokens before each document."""

    def __init__(self, a: ByteTokens, b: ByteTokens, a_ids: list[np.ndarray], b_ids: list[np.ndarray]):
        none = [np.zeros(0, np.int64)]
        self.a, self.b = a, b
        self.a_ids, self.b_ids = np.concatenate(none + a_ids), np.concatenate(none + b_ids)
        self.a_cuts, self.b_cuts = (np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) for ids in (a_ids, b_ids))
        last_a, last_b = borders(np.cumsum(a.sizes[self.a_ids]), np.cumsum(b.sizes[self.b_ids]))
        self.last_a, self.last_b = last_a, last_b
        self.group_a, self.group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        count = int(last_a.sum())
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=count), np.bincount(self.group_b, minlength=count)
        self.start_a, self.start_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        #: Groups before each document, and all of them at the end.
        self.cuts = np.concatenate([[0], np.cumsum(last_a)])[self.a_cuts]

    def links(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.n_a * self.n_b)])
        return sums[self.cuts[1:]] - sums[self.cuts[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of every distinct id pair of a document, in that order; a pair is a * len(B) + b."""
        width = len(self.b.pieces)
        span = len(self.a.pieces) * width
        doc = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))  # of each group
        many = np.flatnonzero(self.n_a * self.n_b > LISTED)
        found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in many:
            own_a, times_a = np.unique(self.a_ids[self.start_a[g] : self.start_a[g] + self.n_a[g]], return_counts=True)
            own_b, times_b = np.unique(self.b_ids[self.start_b[g] : self.start_b[g] + self.n_b[g]], return_counts=True)
            found.append((doc[g] * span + own_a[:, None] * width + own_b[None, :]).ravel())
            times.append((times_a[:, None] * times_b[None, :]).ravel())
        repeats = self.n_b[self.group_a]
        repeats[np.isin(self.group_a, many)] = 0
        sums = np.concatenate([[0], np.cumsum(repeats)])
        start = 0
        while start < len(repeats):
            stop = max(start + 1, int(np.searchsorted(sums, sums[start] + PORTION, "right")) - 1)
            group, n = self.group_a[start:stop], repeats[start:stop]
            at = np.arange(sums[stop] - sums[start]) + np.repeat(self.start_b[group] - (sums[start:stop] - sums[start]), n)
            keys = np.repeat(doc[group] * span + self.a_ids[start:stop] * width, n) + self.b_ids[at]
            for list_, part in zip((found, times), np.unique(keys, return_counts=True), strict=True):
                list_.append(part)
            start = stop
        keys, links = np.concatenate(found), np.concatenate(times)
        if len(found) > 2:
            keys, place = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, links)
            links = sums
        return keys // span, keys % span, links

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups written as ``a1,a2|b1;a3|b2,b3``."""
        # The text's places of the tokens: A's of a group, then B's.
        places_a = np.arange(len(self.a_ids)) + self.start_b[self.group_a]
        places_b = np.arange(len(self.b_ids)) + (self.start_a + self.n_a)[self.group_b]
        size = len(self.a_ids) + len(self.b_ids)
        width = max(self.a.width, self.b.width) + 1
        cells, sizes = np.zeros((size, width), np.uint8), np.zeros(size, np.int64)
        for places, side, ids, last, close in ((places_a, self.a, self.a_ids, self.last_a, b"|"), (places_b, self.b, self.b_ids, self.last_b, b";")):
            cells[places, : side.width + 1] = side.digits[ids]
            sizes[places] = side.digit_sizes[ids]
            cells[places, side.digit_sizes[ids]] = np.where(last, close[0], b","[0])
        text = cells[np.arange(width) <= sizes[:, None]]
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])[self.a_cuts + self.b_cuts]
        text = text.tobytes()
        return [hashlib.sha256(text[start : stop - 1]).hexdigest() for start, stop in zip(ends, ends[1:], strict=False)]


class PairBlock:
    """The distinct pairs of a block of documents, numbered as they come, with the documents that hold them."""

    def __init__(self) -> None:
        self.known, self.numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)
        self.bytes = 0

    def number(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of the pairs; each entry is one more document for its pair."""
        own, place = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        new = own[self.known[at] != own] if len(self.known) else own
        every = np.concatenate([self.known, new])
        order = np.argsort(every, kind="stable")
        self.numbers = np.concatenate([self.numbers, np.arange(len(self.docs), len(self.docs) + len(new))])[order]
        self.known = every[order]
        numbers = self.numbers[np.searchsorted(self.known, own)][place]
        self.docs = np.concatenate([self.docs, np.zeros(len(new), np.int64)]) + np.bincount(numbers, minlength=len(every))
        return numbers


ALIGNED = (
    "block long, turn int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "numbers binary, links binary, pairs binary"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])


def _small(values: np.ndarray) -> bytes:
    """One byte a value if that is enough, else four."""
    return values.astype(np.uint8 if not len(values) or values.max() < 256 else np.uint32).tobytes()


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[str, tuple[ByteLevel, Pieces]] = {}


def _mine(shared) -> tuple[ByteLevel, Pieces]:
    """The process's own tokenizers, kept between tasks."""
    key, a, b = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteLevel(a), Pieces(b)
    return _LOADED[key]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document, and one per block (turn -1) with its pairs and how many documents hold each; store it before use.

    The tokenizer files are read by the driver and broadcast; they are of fixed size.
    """
    files = []
    for path in paths or default_paths():
        with open(path, "rb") as file:
            files.append(file.read())
    key = hashlib.sha256(b"".join(files)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, *files))
    schema = _arrow(ALIGNED)

    def documents(block: PairBlock, number: int, turn: int, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        a, b = _mine(shared)
        rows = len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        a_ids, b_ids, kept = a.encode([texts[i] for i in filled]), b.encode([texts[i] for i in filled]), []
        for k, i in enumerate(filled):
            whole = b" " + texts[i].encode()
            if a.joined(a_ids[k]) == whole == b.joined(b_ids[k]):
                kept.append(k)
        groups = Groups(a, b, [a_ids[k] for k in kept], [b_ids[k] for k in kept])
        doc, pairs, links = groups.pairs()
        numbers = block.number(pairs)
        cuts = np.searchsorted(doc, np.arange(len(kept) + 1))
        at = np.array([filled[k] for k in kept], np.int64)
        counts = np.zeros((4, rows), np.int64)
        counts[:, at] = np.diff(groups.a_cuts), np.diff(groups.b_cuts), np.diff(groups.cuts), groups.links()
        digests, own, times = [""] * rows, [b""] * rows, [b""] * rows
        for k, (i, digest) in enumerate(zip(at, groups.digests(), strict=True)):
            part = slice(cuts[k], cuts[k + 1])
            digests[i], own[i], times[i] = digest, numbers[part].astype(np.uint32).tobytes(), _small(links[part])
        block.bytes += sum(map(len, texts))
        columns = [np.full(rows, number), np.arange(turn, turn + rows, dtype=np.int32), ids, *counts, digests, own, times, [None] * rows]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def close(block: PairBlock, number: int) -> pa.RecordBatch:
        pairs = np.zeros(len(block.known), np.int64)
        pairs[block.numbers] = block.known
        row = dict.fromkeys(schema.names) | {"block": number, "turn": -1, "pairs": pairs.tobytes(), "links": block.docs.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, turn, block = TaskContext.get().partitionId() << 32, 0, PairBlock()
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for start, stop in slices(offsets, SLICE):
                ids, texts = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start).to_pylist()
                yield documents(block, number, turn, ids, [t or "" for t in texts])
                turn += stop - start
                if block.bytes >= BLOCK_BYTES or len(block.known) >= BLOCK_PAIRS:
                    yield close(block, number)
                    number, turn, block = number + 1, 0, PairBlock()
        if turn:
            yield close(block, number)

    own = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return own.mapInArrow(run, ALIGNED)


PAIRS = "block long, at int, pair long, docs long"


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, at, pair, docs): the pairs of each block under their numbers."""
    schema = _arrow(PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                pairs, docs = np.frombuffer(pairs, np.int64), np.frombuffer(docs, np.int64)
                for start in range(0, len(pairs), 10_000):
                    part = slice(start, start + 10_000)
                    at = np.arange(start, start + len(pairs[part]), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at), pa.array(pairs[part]), pa.array(docs[part])], schema=schema)

    return rows.where("turn = -1").select("block", "pairs", "links").mapInArrow(run, PAIRS)


def pair_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, docs, best): how many documents hold a pair, and whether no pair of its A id has more."""
    counts = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("docs")))
    a = F.expr(f"pair div {b_size}")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, turn and number: first the block's pairs, then its documents."""
    schema, current, parts_, docs, best = _arrow(SCORED), None, [], None, None
    for batch in batches:
        blocks, turns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "turn"))
        kinds = turns < 0
        starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])])) if len(blocks) else []
        for start, stop in zip(starts, [*starts[1:], len(blocks)], strict=True):
            part = batch.slice(start, stop - start)
            if blocks[start] != current:
                current, parts_, docs = blocks[start], [], None
            if kinds[start]:
                parts_.append((part.column("docs").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(bool)))
                continue
            if docs is None:
                docs = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts_]])
                best = np.concatenate([np.zeros(0, bool), *[p[1] for p in parts_]])
                parts_ = []
            sums = []
            for numbers, links in zip(part.column("numbers").to_pylist(), part.column("links").to_pylist(), strict=True):
                at = np.frombuffer(numbers, np.uint32)
                times = np.frombuffer(links, np.uint8 if len(links) == len(at) else np.uint32).astype(np.int64)
                sums.append((int(times[best[at]].sum()), int((docs[at] * times).sum())))
            found = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
            yield pa.RecordBatch.from_arrays([found.get(name) if name in found else part.column(name) for name in schema.names], schema=schema)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    A null or empty text has no tokens, and neither has one whose tokens don't
    spell a space and the text, as where it contains U+2581: zeros, and an empty
    digest. Rows that repeat are documents of their own in the counts. An empty
    table gives no rows. Other columns are not read. A single document has to fit
    in a task's memory some fifty times.
    """
    paths = paths or default_paths()
    rows = stored(aligned(docs, id_col, text_col, paths))
    pairs = block_pairs(rows)
    width = sentencepiece.SentencePieceProcessor(model_file=paths[1]).vocab_size()
    marked = pairs.drop("docs").join(pair_counts(pairs, width), "pair").select("block", F.lit(-1).alias("turn"), "at", "docs", "best")
    every = rows.where("turn >= 0").drop("pairs").unionByName(marked, allowMissingColumns=True)
    dealt = every.repartition(parts(docs.sparkSession), "block").sortWithinPartitions("block", "turn", "at")
    return dealt.mapInArrow(_scored, SCORED).withColumnRenamed("doc_id", id_col)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(table(spark, folder, "documents"))
