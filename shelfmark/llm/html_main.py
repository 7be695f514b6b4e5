"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector: learned
embeddings of the hashed tags, classes and ids on its path, learned embeddings
of its hashed words, and its shape. A bidirectional LSTM in numpy reads the
whole sequence and says of every block, knowing all others, whether it belongs
to the article. It is trained here: on a bounded sample of pages, whose marked
articles are put into many page layouts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import buffers, drawn, slices, table
from shelfmark.llm.registry import query

PATH_CELLS, WORD_CELLS, WIDTH, HIDDEN, SHAPE = 1024, 2048, 12, 16, 8
INPUT = 2 * WIDTH + SHAPE
STEP_CELLS = 40_000  # blocks of one batch, padding included
SLICE = 2 << 20

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: What is inside them is no text of a page.
SILENT = frozenset("script style title textarea noscript template iframe select button svg object".split())
RAW = frozenset("script style title textarea iframe".split())  # of SILENT, those that hold text only
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend label blockquote pre figure figcaption address details summary dialog center hr ins menu".split()
)
#: An opening tag ends open ones of these names, up to the next container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
CONTAINERS = frozenset("ul ol dl table body article section main div nav aside header footer form blockquote menu".split())


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[int, ...]
    linked: float  # share of the characters inside links
    depth: int


def _cells(name: str, attributes: str) -> tuple[int, ...]:
    """Hashed tag name and the word parts of class, id, role and itemprop."""
    found = {name}
    for groups in NAMES.findall(attributes):
        for part in PARTS.findall("".join(groups)):
            found.add("." + part.lower())
    return tuple(sorted({zlib.crc32(f.encode()) % PATH_CELLS for f in found}))


def _element_ends(html: str, name: str) -> dict[int, int]:
    """Where each element of this name ends, by the place after its start tag; nested ones are counted, in one pass."""
    found, open_ = {}, []
    for tag in re.compile(rf"<(/?){name}(?![a-zA-Z0-9])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.I).finditer(html):
        if not tag[1]:
            if not (name == "svg" and tag[2].endswith("/")):
                open_.append(tag.end())
        elif open_:
            found[open_.pop()] = tag.end()
    return found


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order; text between block tags, references decoded, white space folded."""
    found: list[Block] = []
    # Open elements, each with the path cells of itself and all around it.
    stack: list[tuple[str, frozenset[int]]] = []
    ends: dict[str, dict[int, int]] = {}
    pieces: list[str] = []
    linked = links = 0
    known: dict[tuple[str, str], tuple[int, ...]] = {}

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                path = tuple(sorted(stack[-1][1])) if stack else (0,)
                found.append(Block(text, path, min(1.0, linked / len(text)), len(stack)))
            pieces.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        tag = MARKUP.search(html, at)
        text = html[at : tag.start() if tag else size]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in SILENT:
            # Only foreign elements are closed by a slash; elsewhere HTML ignores it.
            if not closing and not (name == "svg" and attributes.endswith("/")):
                if name in RAW:  # to the first end tag, or the end of the page, as in a browser
                    end = re.compile(rf"</{name}(?![a-zA-Z0-9])[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = end.end() if end else size
                else:  # to its own end tag; without one just the tag goes
                    if name not in ends:
                        ends[name] = _element_ends(html, name)
                    at = ends[name].get(at, at)
            if name != "svg":
                pieces.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
        if name not in BLOCKS:
            continue
        close_block()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            links = 0
            continue
        if stack and stack[-1][0] == "p":  # a paragraph holds no block
            stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ENDS.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in CONTAINERS:
                break
        key = name, attributes
        if key not in known:
            known[key] = _cells(name, attributes)
        around = stack[-1][1] if stack else frozenset()
        stack.append((name, around if around.issuperset(known[key]) else around.union(known[key])))
    close_block()
    return found


WORD = re.compile(r"\w+")
END_MARKS = re.compile(r"[.!?…。](?:\s|$)")


class Pages:
    """Blocks of many pages as flat arrays."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        every = [b for p in pages for b in p]
        self.path, self.path_cuts = _flat([b.path for b in every])
        cells: dict[str, int] = {}
        words = [[cells.setdefault(w, zlib.crc32(w.encode()) % WORD_CELLS) for w in WORD.findall(b.text.lower())] for b in every]
        self.words, self.word_cuts = _flat(words)
        place = np.concatenate([np.arange(n) / max(n - 1, 1) for n in self.sizes]) if every else np.zeros(0)
        chars = np.array([len(b.text) for b in every], np.float64)
        count = np.diff(self.word_cuts)
        self.shape = np.stack(
            [
                np.log1p(chars) / 4, np.log1p(count) / 3, np.array([b.linked for b in every]), place,
                np.array([min(b.depth, 12) / 6 for b in every]), np.array([min(len(END_MARKS.findall(b.text)), 8) / 4 for b in every]),
                np.array([sum(map(str.isdigit, b.text)) for b in every]) / np.maximum(chars, 1), np.ones(len(every)),
            ],
            axis=1,
        ).astype(np.float32) if every else np.zeros((0, SHAPE), np.float32)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    return np.array([v for x in lists for v in x], np.int64), cuts


def _means(embedding: np.ndarray, cells: np.ndarray, cuts: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the embeddings of each list over its length to ``power``, and that weight."""
    sizes = np.diff(cuts)
    weight = (1 / np.maximum(sizes, 1) ** power).astype(np.float32)
    sums = np.zeros((len(sizes), embedding.shape[1]), np.float32)
    some = sizes > 0
    if some.any():
        sums[some] = np.add.reduceat(embedding[cells], cuts[:-1][some], axis=0)
    return sums * weight[:, None], weight


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: embeddings, one LSTM in each direction, a logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) * 0.15).astype(np.float32)
        self.weights = {"path": draw(PATH_CELLS, WIDTH), "word": draw(WORD_CELLS, WIDTH), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            start = np.zeros(4 * HIDDEN, np.float32)
            start[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.weights |= {f"{way}_in": draw(INPUT, 4 * HIDDEN), f"{way}_state": draw(HIDDEN, 4 * HIDDEN), f"{way}_bias": start}

    def inputs(self, pages: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        path, path_weight = _means(self.weights["path"], pages.path, pages.path_cuts, 0.5)
        word, word_weight = _means(self.weights["word"], pages.words, pages.word_cuts, 1.0)
        return np.hstack([path, word, pages.shape]), path_weight, word_weight

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, memory: list | None) -> np.ndarray:
        """States after each step of (steps, pages, INPUT); masked steps leave the state as it was."""
        steps, count, _ = x.shape
        gates_in = x @ self.weights[f"{way}_in"] + self.weights[f"{way}_bias"]
        state, cell = np.zeros((count, HIDDEN), np.float32), np.zeros((count, HIDDEN), np.float32)
        out = np.zeros((steps, count, HIDDEN), np.float32)
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            z = gates_in[t] + state @ self.weights[f"{way}_state"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_cell = np.where(m, f * cell + i * g, cell)
            squashed = np.tanh(new_cell)
            if memory is not None:
                memory.append((t, i, f, o, g, cell, state, squashed, m))
            state, cell = np.where(m, o * squashed, state), new_cell
            out[t] = state
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, memories: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = [self._read(x, mask, way, None if memories is None else memories.setdefault(way, [])) for way in ("ahead", "back")]
        states = np.concatenate(both, axis=2)
        return states @ self.weights["out"] + self.weights["bias"], states

    def odds(self, pages: Pages) -> np.ndarray:
        """Log-odds of every block, pages of like length together."""
        result = np.zeros(int(pages.sizes.sum()), np.float32)
        x, _, _ = self.inputs(pages)
        for chosen, spot, mask in _batches(pages.sizes):
            found, _ = self.forward(x[np.maximum(spot, 0)] * mask[:, :, None], mask)
            result[spot[mask]] = found[mask]
        return result

    def train(self, pages: list[list[Block]], labels: list[np.ndarray], rounds: int, rate: float = 0.01, batch: int = 24, seed: int = 5) -> None:
        """Back-propagation through time with Adam; the loss is the mean over blocks. Batches are drawn once."""
        rng = np.random.default_rng(seed)
        mixed = rng.permutation([i for i, page in enumerate(pages) if page])
        drawn = [mixed[low : low + batch] for low in range(0, len(mixed), batch)]
        parts = [(Pages([pages[i] for i in some]), np.concatenate([labels[i] for i in some]).astype(np.float32)) for some in drawn]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        turn = 0
        for _ in range(rounds):
            for at in rng.permutation(len(parts)):
                slope = self._slopes(*parts[at])
                turn += 1
                for k, w in self.weights.items():
                    first[k] += 0.1 * (slope[k] - first[k])
                    second[k] += 0.001 * (slope[k] ** 2 - second[k])
                    step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                    w -= (rate * step).astype(np.float32)

    def _slopes(self, pages: Pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        memories: dict[str, list] = {}
        x, path_weight, word_weight = self.inputs(pages)
        steps = np.arange(int(pages.sizes.max()))[:, None]
        mask = steps < pages.sizes[None, :]
        spot = np.where(mask, (np.cumsum(pages.sizes) - pages.sizes)[None, :] + steps, 0)
        inputs = x[spot] * mask[:, :, None]
        odds, states = self.forward(inputs, mask, memories)
        error = np.where(mask, _sigmoid(odds) - labels[spot], 0).astype(np.float32) / mask.sum()
        slope = {k: np.zeros_like(v) for k, v in self.weights.items()}
        slope["out"] = np.einsum("tb,tbh->h", error, states)
        slope["bias"] = np.array([error.sum()], np.float32)
        to_inputs = np.zeros_like(inputs)
        for n, way in enumerate(("ahead", "back")):
            to_state = np.zeros((spot.shape[1], HIDDEN), np.float32)
            to_cell = np.zeros_like(to_state)
            weight_in, weight_state = self.weights[f"{way}_in"], self.weights[f"{way}_state"]
            part = self.weights["out"][n * HIDDEN : (n + 1) * HIDDEN]
            for t, i, f, o, g, cell, state, squashed, m in reversed(memories[way]):
                to_state = to_state + error[t][:, None] * part
                live = to_state * m
                to_new = to_cell * m + live * o * (1 - squashed**2)
                z = np.hstack([to_new * g * i * (1 - i), to_new * cell * f * (1 - f), live * squashed * o * (1 - o), to_new * i * (1 - g**2)])
                slope[f"{way}_in"] += inputs[t].T @ z
                slope[f"{way}_state"] += state.T @ z
                slope[f"{way}_bias"] += z.sum(axis=0)
                to_inputs[t] += z @ weight_in.T
                to_state = np.where(m, 0, to_state) + z @ weight_state.T
                to_cell = np.where(m, to_new * f, to_cell)
        at, flat = spot[mask], to_inputs[mask]
        per_block = np.zeros((len(x), 2 * WIDTH), np.float32)
        per_block[at] = flat[:, : 2 * WIDTH]
        for name, cells, cuts, weight, low in (("path", pages.path, pages.path_cuts, path_weight, 0), ("word", pages.words, pages.word_cuts, word_weight, WIDTH)):
            spread = np.repeat(per_block[:, low : low + WIDTH] * weight[:, None], np.diff(cuts), axis=0)
            for column in range(WIDTH):
                slope[name][:, column] = np.bincount(cells, spread[:, column], minlength=len(slope[name]))
        return slope


def _batches(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pages, block numbers by step and page, mask) of groups of pages of like length."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * sizes[order[high]] <= STEP_CELLS:
            high += 1
        chosen = order[low:high]
        steps = np.arange(int(sizes[chosen].max()))[:, None]
        mask = steps < sizes[chosen][None, :]
        yield chosen, np.where(mask, starts[chosen][None, :] + steps, -1), mask
        low = high


# Layouts for training pages: containers around the article, and what stands beside or inside it.
ARTICLES = (
    "<article>", "<article class=post>", "<main>", '<main id="content"><article>', '<div class="article-body">', '<div id="main-content" class="content">',
    '<div class="entry-content">', '<section class="story">', '<div class="post-text">', "<body><article>", '<div class="text">',
)
OUTSIDE = (
    ('<nav><ul>', "<li><a href=#>{s}</a></li>", 6), ('<div class="menu"><ul>', "<li><a href=#>{s}</a>", 5), ('<ul class="nav navbar">', "<li><a href=#>{s}</a></li>", 5),
    ('<header>', "<div>{s}</div>", 2), ('<header class="site-header">', "<h1>{s}</h1>", 1), ('<div id="header">', "<p>{m}</p>", 1), ('<div class="breadcrumb">', "<a href=#>{s}</a> &gt; ", 3),
    ('<footer>', "&copy; {m}", 1), ('<footer class="site-footer">', "<p>{m}</p>", 2), ('<div id="footer">', "<p>&copy; {m}</p>", 2), ('<footer>', "<a href=#>{s}</a> &middot; ", 4),
    ('<aside>', "<p>{m}</p>", 2), ('<aside class="sidebar">', "<h3>{s}</h3><p>{l}</p>", 2), ('<div class="sidebar">', "<div>{m}</div>", 3), ('<div id="right-column" class="widget">', "<li>{m}</li>", 3),
    ('<aside class="related">', "<li><a href=#>{m}</a></li>", 4), ('<div class="related-posts">', "<h4><a href=#>{m}</a></h4>", 3),
    ('<div class="cookie-notice">', "<p>{m}</p>", 1), ('<div class="notice">', "{m}", 1), ('<div id="cookie-banner" role="alert">', "<p>{m}</p>", 1), ('<div class="alert consent">', "<div>{l}</div>", 1),
    ('<div class="ad">', "{m}", 1), ('<div class="ads advert">', "<p>{l}</p>", 1), ('<div class="advertisement">', "<a href=#>{m}</a>", 1), ('<ins class="adsbygoogle">', "{m}", 1), ('<div class="banner promo sponsored">', "<p>{m}</p>", 1),
    ('<form>', "<label>{s}</label><input>", 3), ('<form class="search"><fieldset>', "<p>{s}</p>", 2), ('<div class="newsletter subscribe"><form>', "<p>{m}</p>", 1), ('<form id="login">', "<div>{s}</div>", 2),
    ('<section id="comments">', "<p>{l}</p>", 3), ('<div class="comments">', "<div class=comment><p>{l}</p></div>", 3), ('<ol class="commentlist">', "<li class=comment>{l}</li>", 4), ('<section class="comments reader-comments">', "<h3>{s}</h3><p>{l}</p>", 3),
    ('<div class="share social">', "<a href=#>{s}</a> ", 3), ('<div class="pagination">', "<a href=#>{s}</a> ", 3), ('<dialog class="popup modal">', "<p>{m}</p>", 1),
)
CLOSED = re.compile(r"<([a-z0-9]+)")


def _ends(opening: str) -> str:
    return "".join(f"</{name}>" for name in reversed(CLOSED.findall(opening)))


def invented_pages(texts: list[str], count: int, seed: int) -> list[tuple[str, str]]:
    """(html, main text) of pages made of the given texts in random layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(len(of)))]
    words = [t.split() for t in texts if t.split()] or [["text"]]

    def some(low: int, high: int) -> str:
        have = pick(words)
        size = int(rng.integers(low, high + 1))
        at = int(rng.integers(max(1, len(have) - size + 1)))
        return " ".join(have[at : at + size])

    def outside() -> str:
        opening, item, most = pick(OUTSIDE)
        filled = "".join(item.format(s=some(1, 3), m=some(3, 14), l=some(8, 60)) for _ in range(1 + int(rng.integers(most))))
        return opening + filled + _ends(opening)

    pages = []
    for _ in range(count):
        kept, body = [], []
        for i in range(1 + int(rng.integers(14))):
            text = some(1, 12) if i == 0 or rng.random() < 0.12 else some(1, 4) if rng.random() < 0.15 else some(10, 120)
            kept.append(text)
            kind = "h1" if i == 0 and rng.random() < 0.8 else "h2" if len(text) < 60 and rng.random() < 0.5 else pick(["p", "p", "p", "p", "blockquote", "div", "li", "pre"])
            body.append(pick([f"<{kind}>{text}</{kind}>", f"<{kind}><b>{text}<br>" if kind == "p" else f"<{kind}>{text}</{kind}>", f"<{kind}>{text}</{kind}>"]))
            if rng.random() < 0.05:
                body.append(outside())
        opening = pick(ARTICLES)
        if rng.random() < 0.15:
            body.append(outside())
        around = "".join(outside() for _ in range(int(rng.integers(4)))), "".join(outside() for _ in range(int(rng.integers(5))))
        wrap = pick([("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper container">', "</div>")])
        head = f"<!DOCTYPE html><html><head><title>{kept[0]}</title><style>p{{margin:0}}</style></head><body>"
        pages.append((head + wrap[0] + around[0] + opening + "".join(body) + _ends(opening.replace("<body>", "")) + around[1] + wrap[1] + "</body></html>", kept))
    return pages


def _matched(page: list[Block], kept: list[str]) -> np.ndarray:
    """1 for the blocks that are the kept texts, in order; the layouts never repeat a text beside the article by design of length."""
    labels, at = np.zeros(len(page)), 0
    for i, block in enumerate(page):
        if at < len(kept) and block.text == kept[at]:
            labels[i], at = 1, at + 1
    return labels


ARTICLE_CELL = zlib.crc32(b"article") % PATH_CELLS


def fit(pages: DataFrame, html_col: str = "html", *, sample: int = 300, invented: int = 700, rounds: int = 6) -> Labeller:
    """A labeller trained on ``sample`` pages drawn by a hash and ``invented`` layouts of their texts.

    Blocks of a drawn page are labelled by its article mark; pages without
    one lend their texts only. Both bounds hold at any size of the table.
    """
    rows = drawn(pages.where(F.col(html_col).isNotNull()).select(html_col), sample, [html_col]).collect()
    real = [found for r in rows if (found := blocks(r[0]))]
    texts = [b.text for page in real for b in page if len(b.text) > 20]
    marked = [page for page in real if any(ARTICLE_CELL in b.path for b in page)]
    made = [(blocks(html), kept) for html, kept in invented_pages(texts, invented, 11)]
    labels = [np.array([float(ARTICLE_CELL in b.path) for b in page]) for page in marked] + [_matched(page, kept) for page, kept in made]
    labeller = Labeller()
    labeller.train(marked + [page for page, _ in made], labels, rounds)
    return labeller


def extract(pages: DataFrame, labeller: Labeller, html_col: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns and ``text``: the blocks labelled as article, joined by one line feed.

    A null or empty page, and one without article blocks, gives an empty text.
    Repeated rows give equal texts; every row gives one.
    """
    source = pages.select(*[F.col(f"`{c}`").alias(f"__sm_col_{i}") for i, c in enumerate(columns)], F.col(f"`{html_col}`").alias("__sm_html"))
    names = [f"__sm_col_{i}" for i in range(len(columns))] + ["__sm_text"]
    schema = source.withColumn("__sm_text", F.lit("")).drop("__sm_html").schema
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(batch.num_columns - 1))
            for start, stop in slices(offsets, SLICE):
                part = batch.slice(start, stop - start)
                found = [blocks(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
                main = iter((shared.value.odds(Pages(found)) > 0).tolist())
                texts = ["\n".join(b.text for b in page if next(main)) for page in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    rows = source.mapInArrow(run, schema)
    return rows.select(*[F.col(f"__sm_col_{i}").alias(c) for i, c in enumerate(columns)], F.col("__sm_text").alias("text"))


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rows = extract(pages, fit(pages))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
