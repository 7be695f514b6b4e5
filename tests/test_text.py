import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.functions import html as markup
from shelfmark.functions import text as tx
from shelfmark.operators import chunking as ch
from shelfmark.operators.records import parse_model_reply, rich_text


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


def test_split_questions(spark):
    run = lambda v: one(spark, v, tx.split_questions)
    assert run("Regal bestellen und Rechnung ablegen") == ["Regal bestellen und Rechnung ablegen", "Regal bestellen", "Rechnung ablegen"]
    assert run("How? Yes and No") == ["How? Yes and No"]
    assert run("   ") == []
    assert len(run("first part? second part? third part? fourth part? fifth part? sixth part?")) == 5
    assert run("grundlegend mundart") == ["grundlegend mundart"]


def test_german(spark):
    for text, expected in [("Wie geht das", True), ("Größe", True), ("What is this", False), ("under the wider sky", False)]:
        assert one(spark, text, tx.is_probably_german) is expected


def test_token_estimate_and_log_text(spark):
    assert one(spark, "abcde", tx.estimate_tokens) == 2
    assert one(spark, None, tx.estimate_tokens) == 0
    assert one(spark, "x" * 201, tx.truncate_for_log) == "x" * 200 + "…"


def test_budget(spark):
    blocks = ["a" * 60, "b" * 60, "c" * 60]
    run = lambda b, n: one(spark, "|".join(b), lambda v: tx.trim_to_budget(F.split(v, r"\|"), n))
    assert run(blocks, 35) == tx.BLOCK_SEPARATOR.join(blocks[:2]) + tx.TRUNCATED_MARK
    assert run(blocks, 1000) == tx.BLOCK_SEPARATOR.join(blocks)
    assert run(["x" * 100], 10) == "x" * 40 + tx.TRUNCATED_MARK
    assert run(blocks, 0) == ""


def test_markdown(spark):
    text = "# A <b>\n\nline & more\n####### seven\n```py\nx = 1\n\ny\n```\ntail\n```\nopen"
    assert one(spark, text, tx.markdown_to_html) == (
        "<h1>A &lt;b&gt;</h1>\n<p>line &amp; more</p>\n<p>####### seven</p>\n<pre><code>x = 1\n\ny</code></pre>\n<p>tail</p>\n"
        "<pre><code>open</code></pre>"
    )
    assert one(spark, "```\n```", tx.markdown_to_html) == "<pre><code></code></pre>"


def test_vector_text(spark):
    literal = one(spark, "[1, 2.5, -3]", lambda v: tx.vector_to_literal(tx.vector_from_literal(v)))
    assert literal == "[1,2.5,-3]"


def test_fixed_rounds_like_the_exact_binary_value(spark):
    value = spark.sql("SELECT 0.07375D AS v").select(tx.fixed(F.col("v"), 4).alias("r")).first()["r"]
    assert value == f"{0.07375:.4f}"


def test_html_to_text_rules():
    assert markup.to_text("<p>Hello <b>big</b> world</p>") == "Hellobigworld\n\n"
    assert markup.to_text("<ul><li>a<li>b</ul>") == "• a\n• b\n"
    assert markup.to_text("<h2>T</h2>") == "\n## T\n\n"
    assert markup.to_text("a<br>b<hr>") == "a\nb\n---\n"
    assert markup.to_text("<pre><code>x\n y</code></pre>") == "\n```\nx\n y\n```\n"
    assert markup.to_text("use <code>ls</code>") == "use`ls`"
    assert markup.to_text("<table><tr><th>A<th>B<tr><td>1<td>2</table>") == "\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"
    assert markup.to_text("<table><tr><td>1</td></tr></table>") == "\n| 1 |\n\n"
    assert markup.to_text("<p></p><!-- c --><div></div>") == ""
    assert markup.to_text("<html><head><title>t</title></head><body>x</body></html>") == "x"


def sections_of(spark, html, descend=()):
    rows = ch.html_sections(spark.createDataFrame([(1, html)], "page_id int, html string"), {"descend": descend}).orderBy("chunk_index").collect()
    return [(r["header_path"], r["content"], r["content_type"]) for r in rows]


def test_sections_follow_stack_depth_not_level(spark):
    paths = lambda html: [p for p, _, _ in sections_of(spark, html)]
    assert paths("<h1>Guide</h1><h2>Install</h2><p>x</p>") == [["Guide", "Install"]]
    assert paths("<h3>a</h3><p>x</p><h3>b</h3><p>y</p>") == [["a"], ["a", "b"]]
    assert paths("<h1>a</h1><p>x</p><h3>b</h3><p>y</p><h2>c</h2><p>z</p>") == [["a"], ["a", "b"], ["a", "c"]]
    assert paths("<article><h1>a</h1><p>x</p></article>") == [[]]
    assert [k for _, _, k in sections_of(spark, "<pre>x</pre><table><tr><td>1</table>")] == ["mixed"]
    assert [k for _, _, k in sections_of(spark, "<p>x</p><table><tr><td>1</table>")] == ["table"]
    assert sections_of(spark, "  <!-- x -->") == [] and sections_of(spark, None) == []
    assert sections_of(spark, "a<article><h2>b</h2> c <p>d</p></article>", ("article",)) == [([], "a", "text"), (["b"], " c d\n\n", "text")]


def test_deep_nesting_and_bad_pages_do_not_end_the_job(spark):
    deep = "<div>" * 20_000 + "x"
    assert markup.to_text(deep).startswith("x\n\n")
    frame = spark.createDataFrame([(1, "<p>fine</p>"), (2, "<p>bad</p>"), (3, None)], "page_id int, html string")

    def read(page, descend):
        if page and "bad" in page:
            raise ValueError("broken page")
        return markup.items(page, descend)

    rows = {r["page_id"]: r for r in ch.read_items(frame, read=read).collect()}
    assert rows[2]["parse_error"] == "ValueError: broken page" and rows[2]["items"] == []
    assert rows[1]["items"][0]["text"] == "fine\n\n" and rows[1]["parse_error"] is None and rows[3]["items"] == []


def pages(spark, html):
    return spark.createDataFrame([("page-1", "T", ["A", "B"], html)], "page_id string, title string, ancestors array<string>, html string")


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("chunker", ["html_section", "fixed_size", "recursive"])
def test_chunks_are_numbered_and_prefixed(spark, chunker):
    html = "".join(f"<p>{words(400)}</p>" for _ in range(3))
    params = {"max_tokens": 200, "overlap_tokens": 50, "chunk_size": 500, "chunk_overlap": 50}
    rows = ch.chunk_pages(pages(spark, html), chunker, params).orderBy("chunk_index").collect()
    assert len(rows) > 1
    assert [r["chunk_id"] for r in rows] == [f"page-1_{i}" for i in range(len(rows))]
    assert {r["total_chunks"] for r in rows} == {len(rows)}
    assert all(r["content"].startswith("Page: T\nPath: A > B\n\n") for r in rows)
    assert ch.chunk_pages(pages(spark, "  "), chunker, params).count() == 0


def test_packing_keeps_paragraphs_whole_and_repeats_the_tail(spark):
    count = lambda text: tx.count_tokens(text, "words")
    content = "One two three. Four five six.\n\n" + "Seven eight nine.\n\n" + words(12)
    pieces = one(spark, content, lambda v: ch.packed(v, 8, 3, count))
    assert pieces[0] == "One two three. Four five six."
    assert pieces[1].endswith("Seven eight nine.") and pieces[-1].endswith(words(12))
    assert one(spark, "short", lambda v: ch.packed(v, 8, 3, count)) == ["short"]


def test_tail_starts_after_a_sentence_or_a_word(spark):
    for text, want in (
        ("Intro. " + "x" * 30, "x" * 16), ("word " + "y" * 100, "y" * 16), ("a. b. " + "c" * 12 + ".", "c" * 12 + "."), ("short", "short"),
        ("mm " * 9, "mm " * 5),
    ):
        assert one(spark, text, lambda v: tx.overlap_tail(v, 4)) == want


def test_windows_cover_all_words_and_bad_overlap_fails(spark):
    got = one(spark, words(25), lambda v: ch.token_windows(v, 10, 3))
    assert [w.split()[0] for w in got] == ["w0", "w7", "w14", "w21"][: len(got)]
    assert got[-1].split()[-1] == "w24" and len(got) == 4
    assert one(spark, words(10), lambda v: ch.token_windows(v, 10, 3)) == [words(10)]
    with pytest.raises(ValueError, match="smaller"):
        ch.token_windows(F.lit("x"), 3, 3)


def test_recursive_split_respects_size_and_loses_nothing():
    text = "\n\n".join(words(40) for _ in range(5)) + "\n\n" + "q" * 700
    parts = markup.split_recursive(text, 200, 0)
    assert max(map(len, parts)) <= 200
    assert "".join("".join(parts).split()) == "".join(text.split())
    overlapped = markup.split_recursive(words(200), 100, 30)
    assert all(b.split()[0] in a.split() for a, b in zip(overlapped, overlapped[1:]))


def test_unknown_chunker():
    with pytest.raises(ValueError, match="fixed_size"):
        ch.get_chunker("nope")


def test_model_replies(spark):
    run = lambda v, n=None: one(spark, v, lambda c: parse_model_reply(c, n))
    item = '{"question": " a? ", "rationale": "b"}'
    fenced = run(f'```json\n{{"questions": [{item}]}}\n```')
    assert fenced["error"] is None and fenced["questions"][0]["question"] == "a?"
    assert run(f"Sure: {item} bye")["questions"][0]["rationale"] == "b"
    assert len(run(f'{{"questions": [{item},{item},{item}]}}', 2)["questions"]) == 2
    for bad in ("no", "[1]", '{"questions": []}', '{"questions": 5}', '{"question": 1, "rationale": "b"}', '{"question": "a"}'):
        assert run(bad)["error"] is not None, bad


def test_rich_text(spark):
    tree = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"},{"type":"hardBreak"},{"type":"text","text":"b"}]},{"type":"paragraph","content":[]},{"type":"paragraph","content":[]},{"type":"heading","content":[{"type":"text","text":"c"}]}]}'
    assert one(spark, tree, rich_text) == "a\nb\n\nc"
    assert one(spark, '"  plain "', rich_text) == "plain"
    assert one(spark, None, rich_text) == ""


def test_hashed_words_take_texts_a_few_bytes_at_a_time():
    from shelfmark.operators.embedding import slices_of

    texts = ["a b", None, "", "x" * 50, "ää ö", "b"] * 20
    batch = pa.RecordBatch.from_pydict({"i": range(len(texts)), "t": texts})
    parts = list(slices_of(batch, "t", 16))
    assert [i for part in parts for i in part.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len((t or "").encode()) for t in part.column(1).to_pylist()) <= 16 or part.num_rows == 1 for part in parts)
    assert len(list(slices_of(batch, "t"))) == 1 and list(slices_of(batch.slice(0, 0), "t")) == []
