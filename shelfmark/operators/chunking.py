"""Pages to chunks with swappable strategies.

A strategy turns page rows into piece rows; ids and the context prefix are
added the same way for all of them. Nothing is shuffled, because a page's
pieces all come from its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import html as markup
from shelfmark.functions import text as tx
from shelfmark.operators.spread import explode_once, spread

PIECE_FIELDS = [
    T.StructField("header_path", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("total_chunks", T.LongType()),
]

Strategy = Callable[[DataFrame, Mapping[str, Any]], DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register_chunker(name: str, strategy: Strategy) -> None:
    """Add a strategy: pages with ``html`` become rows with the PIECE_FIELDS."""
    _STRATEGIES[name] = strategy


def get_chunker(name: str) -> Strategy:
    if name not in _STRATEGIES:
        known = ", ".join(sorted(_STRATEGIES)) or "none"
        raise ValueError(f"unknown chunker {name!r}; known: {known}")
    return _STRATEGIES[name]


ITEMS = "array<struct<level: int, title: string, text: string, kind: string>>"
Reader = Callable[[str | None, tuple[str, ...]], list[markup.Item]]


def read_items(pages: DataFrame, descend: tuple[str, ...] = (), read: Reader = markup.items) -> DataFrame:
    """Page rows with ``items`` (their top-level parts) and ``parse_error`` in place of ``html``.

    A page that cannot be read has no items and says why; the others go on.
    """
    rest = [c for c in pages.columns if c != "html"]
    schema = pages.select(*rest, F.lit(None).cast(ITEMS).alias("items"), F.lit(None).cast("string").alias("parse_error")).schema
    kind = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            errors: list[str | None] = []
            for page in batch.column(batch.schema.get_field_index("html")).to_pylist():
                try:
                    found.append([dict(zip(("level", "title", "text", "kind"), item)) for item in read(page, descend)])
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - the page is reported, the job goes on
                    found.append([])
                    errors.append(f"{type(error).__name__}: {error}")
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(errors, pa.string())], names=[*rest, "items", "parse_error"])

    return spread(pages).mapInArrow(run, schema)


def sections(items: Column) -> Column:
    """Array of (path, content, kind): the parts between headings; blank ones are left out.

    A heading keeps one entry of the path before it for every level above its
    own, as far as there are any. ``kind`` is what the part holds besides text.
    """

    def build(parts: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i)["level"] > 0)
        headings = F.filter(parts, lambda p: p["level"] > 0)
        below = lambda path, h: F.concat(F.slice(path, F.lit(1), h["level"] - 1), F.array(h["title"]))
        paths = F.aggregate(
            headings, F.array(F.array().cast("array<string>")), lambda paths, h: F.concat(paths, F.array(below(F.element_at(paths, -1), h)))
        )

        def part(edge: Column) -> Column:
            inside = F.slice(parts, edge["start"] + 1, edge["stop"] - edge["start"])
            kinds = F.array_distinct(F.filter(F.transform(inside, lambda i: i["kind"]), lambda k: k.isNotNull()))
            kind = F.when(F.size(kinds) == 0, "text").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")
            return F.struct(edge["path"].alias("path"), F.array_join(F.transform(inside, lambda i: i["text"]), "").alias("content"), kind.alias("kind"))

        starts = F.concat(F.array(F.lit(0)), heads)
        stops = F.concat(F.transform(heads, lambda h: h - 1), F.array(F.size(parts)))
        edges = F.arrays_zip(starts.alias("start"), stops.alias("stop"), paths.alias("path"))
        return F.filter(F.transform(edges, part), lambda s: F.length(tx.strip(s["content"])) > 0)

    empty = F.array().cast("array<struct<path: array<string>, content: string, kind: string>>")
    return F.when(F.size(items) > 0, tx.let(items, build)).otherwise(empty)


def packed(content: Column, most: int, overlap: int, count: Callable[[Column], Column]) -> Column:
    """Whole paragraphs packed into texts of ``most`` tokens; each begins with the end of the one before.

    A paragraph is never broken, so a long one makes a long text.
    """

    def add(state: Column, paragraph: Column) -> Column:
        cost = count(paragraph)
        full = (F.length(state["held"]) > 0) & (state["used"] + cost > most)
        again = F.concat(tx.overlap_tail(state["held"], overlap), paragraph, F.lit("\n\n"))
        return F.when(
            full, F.struct(F.concat(state["done"], F.array(tx.strip(state["held"]))).alias("done"), again.alias("held"), count(again).alias("used"))
        ).otherwise(
            F.struct(state["done"].alias("done"), F.concat(state["held"], paragraph, F.lit("\n\n")).alias("held"), (state["used"] + cost).alias("used"))
        )

    def last(state: Column) -> Column:
        return F.filter(F.concat(state["done"], F.array(tx.strip(state["held"]))), lambda text: F.length(text) > 0)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).cast("long").alias("used"))
    folded = F.aggregate(F.split(content, "\n\n+", -1), start, add, last)
    return F.when(count(content) <= most, F.array(content)).otherwise(folded)


def _piece_rows(pages: DataFrame, pieces: Column) -> DataFrame:
    """One row per (path, content, kind) in ``pieces``, an array over the column ``items``."""
    rest = [c for c in pages.columns if c not in ("items", "parse_error")]
    staged = pages.select(*rest, tx.let(pieces, lambda all_: F.struct(all_.alias("all"), F.size(all_).cast("long").alias("total"))).alias("__pieces"))
    rows = explode_once(staged.select(*rest, F.col("__pieces.total").alias("total_chunks"), F.col("__pieces.all").alias("__all")), [*rest, "total_chunks"], F.col("__all"), "chunk_index", "__piece")
    return rows.select(
        *rest, F.col("__piece.path").alias("header_path"), F.col("__piece.content").alias("content"), F.col("__piece.kind").alias("content_type"),
        F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks",
    )


def pieces_of_array(pages: DataFrame, texts: str) -> DataFrame:
    """Piece rows from a column that already holds the pieces as an array of texts."""
    rest = [c for c in pages.columns if c not in (texts, "html")]
    # The size is taken first, so that the array itself is not repeated for every piece.
    sized = pages.select(*rest, F.size(texts).cast("long").alias("total_chunks"), texts)
    rows = explode_once(sized, [*rest, "total_chunks"], F.col(texts), "chunk_index", "content")
    return rows.select(
        *rest,
        F.array().cast("array<string>").alias("header_path"),
        "content",
        F.lit("text").alias("content_type"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "total_chunks",
    )


def _counter(params: Mapping[str, Any]) -> Callable[[Column], Column]:
    """``counter`` is a name or a function of Columns, which allows any tokenizer."""
    chosen = params.get("counter", "words")
    return chosen if callable(chosen) else lambda text: tx.count_tokens(text, chosen)


def html_to_text(pages: DataFrame, name: str = "text") -> DataFrame:
    """Adds the page's readable text; null for a page that cannot be read."""

    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            try:
                return markup.to_text(page)
            except Exception:  # noqa: BLE001 - one page must not end the job; read_items says why
                return None

        return column.map(one)

    return spread(pages).withColumn(name, convert(F.col("html")))


def html_sections(pages: DataFrame, params: Mapping[str, Any] | None = None) -> DataFrame:
    """The parts between top-level headings as piece rows, unsplit."""
    descend = tuple((params or {}).get("descend", ()))
    return _piece_rows(read_items(pages, descend), sections(F.col("items")))


def _sections_packed(pages: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    most = int(params.get("max_tokens", 800))
    overlap = int(params.get("overlap_tokens", 100))
    count = _counter(params)

    def cut(section: Column) -> Column:
        texts = packed(section["content"], most, overlap, count)
        return F.transform(texts, lambda t: F.struct(section["path"].alias("path"), t.alias("content"), section["kind"].alias("kind")))

    read = read_items(pages, tuple(params.get("descend", ())))
    return _piece_rows(read, F.flatten(F.transform(sections(F.col("items")), cut)))


def token_windows(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Overlapping windows of words as an array of texts, entirely in the JVM.

    The last window is the first one that reaches the end of the text. White
    space inside a window is kept as it was.
    """
    if overlap_tokens >= max_tokens:
        raise ValueError("overlap_tokens must be smaller than max_tokens")
    step = max_tokens - overlap_tokens

    def cut(tokens: Column) -> Column:
        beyond = F.greatest(F.size(tokens) - F.lit(max_tokens), F.lit(0))
        last = F.ceil(beyond / F.lit(step)).cast("int")
        windows = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: tx.strip(F.array_join(F.slice(tokens, i * step + 1, F.lit(max_tokens)), "")),
        )
        return F.when(F.size(tokens) > 0, windows).otherwise(F.array().cast("array<string>"))

    return tx.let(F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1)), cut)


def _fixed_size(pages: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    windows = token_windows(
        F.col("__text"), int(params.get("max_tokens", 800)), int(params.get("overlap_tokens", 100))
    )
    texts = html_to_text(pages, "__text").drop("html")
    return pieces_of_array(texts.withColumn("__windows", windows).drop("__text"), "__windows")


def _recursive(pages: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    size = int(params.get("chunk_size", 2000))
    overlap = int(params.get("chunk_overlap", 200))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: markup.split_recursive((text or "").strip(), size, overlap))

    texts = html_to_text(pages, "__text").drop("html")
    return pieces_of_array(texts.withColumn("__parts", cut("__text")).drop("__text"), "__parts")


register_chunker("html_section", _sections_packed)
register_chunker("fixed_size", _fixed_size)
register_chunker("recursive", _recursive)


def chunks_of(pieces: DataFrame) -> DataFrame:
    """Piece rows to chunk rows: an id and content with the context prefix."""
    page = F.col("page_id").cast("string")
    prefix = tx.context_prefix(F.col("title"), F.col("ancestors"), F.col("header_path"))
    added = {
        "chunk_id": F.concat(page, F.lit("_"), F.col("chunk_index").cast("string")),
        "content": F.concat(prefix, tx.strip(F.col("content"))),
    }
    return pieces.withColumns(added)


def chunk_pages(pages: DataFrame, chunker: str = "html_section", params: Mapping[str, Any] | None = None) -> DataFrame:
    """Chunk rows of pages with page_id, title, ancestors and html columns."""
    return chunks_of(get_chunker(chunker)(pages, dict(params or {})))


def caption_chunks(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """One chunk per captioned image, next to its page's text chunks."""
    images = attachments.where(F.length("caption") > 0).select("page_id", "attachment_id", "filename", "caption")
    joined = pages.join(images, "page_id")
    page = F.col("page_id").cast("string")
    return joined.select(
        F.concat(page, F.lit("_att_"), F.col("attachment_id").cast("string")).alias("chunk_id"),
        "page_id",
        "title",
        F.concat(
            F.lit("Page: "), F.col("title"), F.lit("\nImage: "), F.col("filename"), F.lit("\n\n"), F.col("caption")
        ).alias("content"),
        F.lit("image").alias("content_type"),
        "attachment_id",
    )
