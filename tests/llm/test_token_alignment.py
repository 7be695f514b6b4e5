"""Groups, links and counts against the tokenizer libraries and plain Python."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import token_alignment
from shelfmark.llm.token_alignment import ByteLevel, Groups, Pieces, alignment, borders, default_paths

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def plain():
    path_a, path_b = default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or 174 <= n]
    letters = {chr(n): n for n in shown} | {chr(256 + i): n for i, n in enumerate(n for n in range(256) if n not in shown)}
    bytes_a = {i: bytes(letters[c] for c in token) for token, i in a.get_vocab().items() if token != "<|endoftext|>"}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + text).encode()
        if b"".join(bytes_a[i] for i in ids_a) != whole or b"".join(bytes_b[i] for i in ids_b) != whole:
            return [], [], [], []
        return ids_a, ids_b, np.cumsum([len(bytes_a[i]) for i in ids_a]).tolist(), np.cumsum([len(bytes_b[i]) for i in ids_b]).tolist()

    return tokens


def brute(tokens, rows):
    held, out = Counter(), []
    for doc, text in rows:
        ids_a, ids_b, ends_a, ends_b = tokens(text or "")
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            stop_a, stop_b = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((ids_a[i:stop_a], ids_b[j:stop_b]))
            i, j = stop_a, stop_b
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        held.update(links.keys())
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if ids_a else ""))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (doc, a, b, g, sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), digest)
        for doc, a, b, g, links, digest in out
    ]


def same(frame, want):
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


ODD = [
    None, "", " ", "  a\n\n b  ", "▁x", "plain ▁ text", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語テキスト🎉 é\x00", "a" * 3000, " " * 700,
    "ﬁﬂ xyzzy" * 50, "  \u0085x​", "don't we'll I'm", "123456 78.9", "\n", "é", "ß" * 100,
]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_borders_equal_shared_ends(seed):
    random_ = np.random.default_rng(seed)
    for size in (1, 2, 3, 50, 127, 128, 129, 5000):
        for chance in (0.02, 0.5, 0.98):
            ends = np.arange(1, size + 1)
            keep = [random_.random(size) < max(chance, 0.3), random_.random(size) < chance]
            if seed == 3:  # long equal stretches with a change of shift in between
                keep[1] = keep[0].copy()
                keep[1][:: max(1, size // 7)] ^= True
            a, b = (np.concatenate([ends[:-1][k[:-1]], ends[-1:]]) for k in keep)
            in_a, in_b = borders(a, b)
            assert in_a.tolist() == np.isin(a, b).tolist() and in_b.tolist() == np.isin(b, a).tolist()


def test_equals_brute_force(spark, small, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, "twice the same"), (None, "twice the same"), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, block int, n_a string").repartition(3)
    same(alignment(docs), brute(plain, rows))


def test_many_blocks_and_large_groups_change_nothing(spark, plain, monkeypatch):
    random_ = random.Random(5)
    words = ["".join(random_.choice("abcdeé ñü漢字") for _ in range(random_.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(random_.choice(words) for _ in range(random_.randint(0, 80)))) for i in range(60)]
    tokens = brute(plain, rows)
    path_a, path_b = default_paths()
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        sides = ByteLevel(a.read()), Pieces(b.read())
    texts = [t for _, t in rows if t]
    ids = [side.encode(texts) for side in sides]
    want = [x.tolist() for x in Groups(*sides, *ids).pairs()]
    for listed, portion in ((0, 1 << 20), (3, 1 << 20), (256, 5), (2, 7)):
        monkeypatch.setattr(token_alignment, "LISTED", listed)
        monkeypatch.setattr(token_alignment, "PORTION", portion)
        assert [x.tolist() for x in Groups(*sides, *ids).pairs()] == want
    # Bounds are read in the tasks, so several partitions stand for several blocks here.
    for cut in (1, 4, 16):
        same(alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(cut)), tokens)


def test_blocks_number_pairs_as_they_come():
    block = token_alignment.PairBlock()
    assert block.number(np.array([9, 4, 4, 7])).tolist() == [2, 0, 0, 1]
    assert block.number(np.array([7, 1, 12])).tolist() == [1, 3, 4]
    assert block.number(np.zeros(0, np.int64)).tolist() == []
    assert block.docs.tolist() == [2, 2, 1, 1, 1] and block.known.tolist() == [1, 4, 7, 9, 12]


def test_empty_table_and_very_long_text(spark, plain):
    assert alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "Some words, und noch mehr Wörter 123! " * 20_000)]
    got = alignment(spark.createDataFrame(rows, "doc_id long, text string")).first()
    same(spark.createDataFrame([got]), brute(plain, rows))


def test_coder_equals_the_library_on_every_letter():
    path, _ = default_paths()
    with open(path, "rb") as file:
        ours = ByteLevel(file.read())
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b!{chr(c)} {chr(c)}  {chr(c)}" for c in [*range(0x3100), *range(0xD000, 0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x20000, 11)]]
    want = library.encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert all(x.tolist() == e.ids for x, e in zip(ours.encode(texts), want, strict=True))
