"""Blocks on hand-made markup; the network's slopes numerically; main texts on pages it has not seen."""

import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.common import table
from shelfmark.llm.html_main import Labeller, Pages, _matched, _sigmoid, blocks, extract, fit, invented_pages, op2_html_extraction


@pytest.fixture(scope="module")
def labeller(spark):
    return fit(table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []), ("  \n", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a <b>b<br>c</b>\n\t d<p>e", ["a b c d", "e"]),
        ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", ["x"]), ("<!-- <p>no</p> --><p>&lt;b&gt; &am &#233;&nbsp;z</p>", ["<b> &am é z"]),
        ('<a title="a > b">l</a>ink<div>t</div>u', ["link", "t", "u"]), ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>cut <b cla", ["cut"]), ("a < b and <3", ["a < b and <3"]), ("<p class='x>y</p>", ["y"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


@pytest.mark.parametrize("name", ["button", "select", "svg", "object", "noscript", "template"])
def test_unclosed_silent_element_keeps_the_page(name):
    assert [b.text for b in blocks(f"<nav>a</nav><{name}><p>x</p><p>y</p>")] == ["a", "x", "y"]
    assert [b.text for b in blocks("<p>x</p><script>var t = 1;<p>y</p>")] == ["x"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p>a</p><script src="a.js"/>var x=1;</script><p>y</p>', ["a", "y"]), ("<iframe src=http://a.com/>no</iframe><p>y</p>", ["y"]),
        ("<template><template>a</template>b</template><p>y</p>", ["y"]), ("<svg/><p>y</p>", ["y"]), ("<svg><svg/>t</svg><p>y</p>", ["y"]),
        ("<button>a<button>b</button>c<p>y</p>", ["a c", "y"]), ("<object data='a>b'><object></object>x</object><p>y</p>", ["y"]),
    ],
)
def test_silent_elements_nest_and_ignore_the_slash(html, want):
    assert [b.text for b in blocks(html)] == want


def test_time_grows_with_the_page():
    def seconds(html):
        start = time.perf_counter()
        found = len(blocks(html))
        return time.perf_counter() - start, found

    for make in (lambda n: "<button>x" * n, lambda n: "<div class=a>x" * n, lambda n: "<template>" * n + "</template>" * (n // 2)):
        small, large = seconds(make(2_000))[0], seconds(make(16_000))[0]
        assert large < 40 * max(small, 0.005)


def test_slopes_agree_with_differences():
    rng = np.random.default_rng(0)
    pages = [blocks(html) for html, _ in invented_pages(["one two three four five six seven"], 4, 1)]
    flat, labels = Pages(pages), rng.integers(0, 2, sum(map(len, pages))).astype(np.float32)
    net = Labeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    slope = net._slopes(flat, labels)

    def loss():
        p = _sigmoid(net.odds(flat).astype(np.float64))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, weight in net.weights.items():
        at = tuple(rng.integers(n) for n in weight.shape) if name not in ("path", "word") else (int(np.abs(slope[name]).sum(axis=1).argmax()), 2)
        old = weight[at]
        weight[at] = old + 1e-2
        up = loss()
        weight[at] = old - 1e-2
        down = loss()
        weight[at] = old
        assert abs((up - down) / 2e-2 - slope[name][at]) < 2e-4, name


def test_unseen_layouts(labeller):
    made = [(blocks(html), kept) for html, kept in invented_pages(["lorem ipsum dolor sit amet " * 30, "Der Hund. Die Katze schläft gern. " * 20], 150, 77)]
    labels = np.concatenate([_matched(page, kept) for page, kept in made])
    assert ((labeller.odds(Pages([page for page, _ in made])) > 0) == labels).mean() > 0.97


def article(html):
    """The marked article of the tables' pages, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    pieces = re.split(r"</?(?:h1|p)>", inner.group(1)) if inner else []
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in pieces]
    return "\n".join(t for t in texts if t)


def test_query_on_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, folder, "pages").collect()}
    rows = op2_html_extraction(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
    assert sum(r.text == article(pages[r.page_id].html) for r in rows) >= 0.99 * len(rows)


def test_nulls_repeats_clashes_and_empty_tables(spark, labeller):
    page = "<nav><a>x</a></nav><article><h1>T</h1><p>Some text, which is long enough to be one.</p></article><footer>f</footer>"
    frame = spark.createDataFrame([(1, page, "a"), (1, page, "a"), (None, None, None), (2, "", "a")], "page_id long, html string, text string")
    got = sorted((str(r.page_id), r.text) for r in extract(frame, labeller, columns=("page_id",)).collect())
    want = "T\nSome text, which is long enough to be one."
    assert got == [("1", want), ("1", want), ("2", ""), ("None", "")]
    assert extract(frame.where("false"), labeller, columns=("page_id",)).count() == 0
    assert fit(frame.where(F.lit(False))).odds(Pages([blocks(page)])).shape == (4,)
