"""Byte-level BPE: a backtracking encoder in linear time, and an offset-table decoder.

An Aho-Corasick automaton over the vocabulary gives the longest token at every
place of a word. The encoder takes it, checks it against the token before in a
table of compatible pairs, and steps back to the next shorter token where they
do not fit. Two neighbours fit when merging could never have joined bytes
across their border, so the tokens found are exactly those of the merge rules.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffers, frugal, kept_for, slices, small_batches, table
from shelfmark.llm.registry import query

# Fixed value: the word pattern of byte-level BPE, with white space spelled out.
SPACE = r"\p{White_Space}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
#: Words of each of two generations that a worker keeps, about 0.2 KiB a word.
CACHED_WORDS = 200_000
KNOWN_PAIRS = 300_000
SLICE = 2 << 20


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytes:
    """The bytes of every id, one after the other, and where each starts: all that decoding needs."""

    def __init__(self, blob: np.ndarray, offsets: np.ndarray):
        self.blob, self.offsets = blob, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        shift = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.blob[shift + np.arange(len(shift))].tobytes()


class Tokenizer:
    """Tables of one byte-level BPE file; small and of fixed size, so they travel with the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not spec["normalizer"]
        if not plain or before["add_prefix_space"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with conditions")
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Steps number the tokens in the order in which merging makes them, bytes first.
        single = [t for t in raw if len(raw[t]) == 1]
        steps = {t: i for i, t in enumerate(single)}
        halves: list[tuple[int, int]] = [(i, i) for i in range(len(single))]
        pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            if left + right in steps or left not in steps or right not in steps:
                raise ValueError(f"{path} makes {left + right!r} twice or from unknown parts")
            steps[left + right] = len(halves)
            pairs[steps[left], steps[right]] = len(halves)
            halves.append((steps[left], steps[right]))
        self.halves, self.pairs = halves, pairs
        self.keys = [raw[t].decode("latin-1") for t in steps]
        self.lengths = [len(k) for k in self.keys]
        self.ids = [model["vocab"][t] for t in steps]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        texts = [b""] * size
        for token, number in model["vocab"].items():
            texts[number] = raw[token]
        for content, number in self.special.items():
            texts[number] = content.encode()
        self.bytes_of = Bytes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        self.ready = False

    def prepare(self) -> Tokenizer:
        """Build what each process makes for itself."""
        if not self.ready:
            self.automaton = ahocorasick.Automaton()
            for step, key in enumerate(self.keys):
                self.automaton.add_word(key, step)
            self.automaton.make_automaton()
            known = {key: step for step, key in enumerate(self.keys)}
            self.shorter = [-1] * len(self.keys)
            for step, key in enumerate(self.keys):
                for cut in range(len(key) - 1, 0, -1):
                    if key[:cut] in known:
                        self.shorter[step] = known[key[:cut]]
                        break
            self.compatible: dict[int, bool] = {}
            self.words = regex.compile(WORDS)
            names = sorted(self.special, key=len, reverse=True)
            self.splits = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
            self.cache: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
            self.ready = True
        return self

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border, undoing merges on both sides from the last one back."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > KNOWN_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._judge(left, right)
        return known

    def _judge(self, left: int, right: int) -> bool:
        halves, pairs, bound = self.halves, self.pairs, len(self.halves)
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < bound:
                return False
            inner, outer = halves[left][1], halves[right][0]
            if inner == left and outer == right:
                return True
            # The later merge is undone first; what it made bounds what could have come before.
            if outer == right or (left > right and inner != left):
                bound, left = left, inner
            else:
                bound, right = right + 1, outer

    def word_ids(self, word: str) -> bytes:
        """Token ids of one word as packed int32."""
        key = word.encode().decode("latin-1")
        size, lengths, shorter = len(key), self.lengths, self.shorter
        longest = [-1] * size
        for end, step in self.automaton.iter(key):
            start = end - lengths[step] + 1
            if longest[start] < 0 or lengths[longest[start]] < lengths[step]:
                longest[start] = step
        usable, tokens, place, step = [True] * (size + 1), [], 0, longest[0]
        while True:
            last = tokens[-1] if tokens else -1
            while step >= 0:
                end = place + lengths[step]
                if usable[end] and (last < 0 or self._fits(last, step)):
                    break
                step = shorter[step]
            if step >= 0:
                tokens.append(step)
                place += lengths[step]
                if place == size:
                    ids = self.ids
                    return array("i", [ids[t] for t in tokens]).tobytes()
                step = longest[place]
            else:
                usable[place] = False
                step = tokens.pop()
                place -= lengths[step]
                step = shorter[step] if not usable[place + lengths[step]] else step

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The cache with all of these words; a full one becomes the older generation, whose words come back when they are met."""
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        for word in words:
            if word not in cache:
                cache[word] = older.get(word) or self.word_ids(word)
        return cache

    def encode(self, text: str) -> bytes:
        out = []
        for i, piece in enumerate(self.splits.split(text) if self.splits else [text]):
            if i % 2:
                out.append(np.int32(self.special[piece]).tobytes())
                continue
            words = self.words.findall(piece)
            try:
                out.append(b"".join(map(self.cache.__getitem__, words)))
            except KeyError:
                out.append(b"".join(map(self._learn(words).__getitem__, words)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.decode(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mine(shared) -> Tokenizer:
    """The process's own prepared tables, kept between tasks."""
    key, loaded = shared.value[0], kept_for("bpe")
    if key not in loaded:
        loaded.clear()
        loaded[key] = shared.value[1].prepare()
    return loaded[key]


def _shared(spark: SparkSession, path: str | None):
    path = path or default_path()
    return spark.sparkContext.broadcast((path, Tokenizer(path)))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns but the text, and ``ids``: the token ids of the whole text.

    A null or empty text has no tokens. Strings of added tokens in a text become
    those tokens. The tokenizer file is read by the driver; its tables have the
    size of the vocabulary and are broadcast.
    """
    shared = _shared(docs.sparkSession, path)
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("__sm_text"))
    schema = source.drop("__sm_text").withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _mine(shared)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__sm_text"))
            _, offsets = buffers(column)
            for start, stop in slices(offsets, SLICE):
                part = batch.slice(start, stop - start)
                packed = [tokenizer.encode(x or "") for x in column.slice(start, stop - start).to_pylist()]
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(cuts), flat)], names=[*rest, ids_col])

    return source.mapInArrow(frugal("bpe", run), schema)


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """All columns, and ``decoded``: the text of the ids. Null ids give an empty text; broken UTF-8 is replaced."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(Tokenizer(path or default_path()).bytes_of)
    small_batches(spark)
    rest = [c for c in tokens.columns if c != text_col]
    source = tokens.select(*[F.col(f"`{c}`") for c in rest if c != ids_col], ids_col)
    schema, names = source.withColumn(text_col, F.lit("")).schema, [*source.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of_bytes: Bytes = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(part.num_columns - 1)
                texts = []
                for row in range(len(lists)):
                    ids = lists[row].values if lists[row].is_valid else None
                    found = b"" if ids is None else table_of_bytes.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64))
                    texts.append(found.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return source.mapInArrow(frugal("bpe", run), schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what the encoder and the decoder give, as digests."""
    decoded = decode(encode(docs.select("doc_id", "text"), path=path), path=path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_bpe")
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))
