"""Text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a plain trim removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# German function words that mark a text as German.
GERMAN_WORDS = (
    "der", "die", "das", "und", "oder", "nicht", "ich", "ist", "sind", "wie", "was", "wer", "wo", "kann", "könnte", "bitte", "für", "mit",
    "ein", "eine", "auf", "wird", "werden", "muss", "habe", "gibt", "welche", "wenn",
)
GERMAN_LETTERS = "äöüßÄÖÜ"

# Separators and limits of the prompt format.
BLOCK_SEPARATOR = "\n\n---\n\n"
TRUNCATED_MARK = "\n...[truncated]"
CHARS_PER_TOKEN = 4
MAX_QUESTION_CHARS = 8000
MAX_SUB_QUERIES = 5
MIN_SUB_QUERY_CHARS = 5

# Java counts accented letters as word characters, the original rules do not.
_NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"


def whole_word(pattern: str) -> str:
    """Wrap a pattern in ASCII word boundaries."""
    return f"{_NOT_AFTER_WORD}(?:{pattern}){_NOT_BEFORE_WORD}"


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times in ``build``.

    Spark does not share common parts inside the lambdas of array functions.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def fixed(value: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals, rounded from its exact binary value."""
    return F.replace(F.format_number(value.cast("double"), decimals), F.lit(","), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """Four characters make one token, rounded up; null counts as empty."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def count_tokens(text: Column, counter: str = "words") -> Column:
    """Token count by white-space words, or by the four-characters estimate."""
    if counter == "words":
        return F.size(words(text)).cast("long")
    if counter == "chars4":
        return estimate_tokens(text)
    raise ValueError(f"unknown token counter {counter!r}; use 'words' or 'chars4'")


def is_probably_german(text: Column) -> Column:
    pattern = f"[{GERMAN_LETTERS}]|(?i:{whole_word('|'.join(GERMAN_WORDS))})"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def language_of(text: Column) -> Column:
    return F.when(is_probably_german(text), F.lit("de")).otherwise(F.lit("en"))


def safe_language(proposed: Column, prior: Column) -> Column:
    """A language tag from outside is taken only when it looks like one."""
    return F.when(proposed.rlike(r"\A[a-z]{2}(-[A-Za-z]{2})?\z"), proposed).otherwise(prior)


def normalize_question(summary: Column, description: Column, limit: int = MAX_QUESTION_CHARS) -> Column:
    joined = F.concat(F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.coalesce(description, F.lit("")))
    return F.left(strip(F.regexp_replace(joined, r"[ \t]+", " ")), F.lit(limit))


def split_questions(
    message: Column, most: int = MAX_SUB_QUERIES, shortest: int = MIN_SUB_QUERY_CHARS
) -> Column:
    """The message itself, then its parts between question marks and conjunctions."""
    trimmed = strip(message)
    parts = F.split(trimmed, rf"(?i)\?+|{whole_word('und|and')}", -1)
    parts = F.filter(F.transform(parts, strip), lambda part: F.length(part) >= shortest)
    every = F.array_distinct(F.concat(F.array(trimmed), parts))
    return F.when(F.length(trimmed) > 0, F.slice(every, 1, most)).otherwise(
        F.array().cast("array<string>")
    )


def overlap_tail(content: Column, overlap_tokens: int) -> Column:
    """The last part of a chunk, cut after a sentence end, else after a word."""
    size = overlap_tokens * CHARS_PER_TOKEN
    tail = F.right(content, F.lit(size)) if size > 0 else F.lit("")
    sentence, word = r"\A[^.!?]*[.!?]\s*", r"\A\S*\s+"
    cut = (
        F.when(tail.rlike(sentence), F.regexp_replace(tail, sentence, ""))
        .when(tail.rlike(word), F.regexp_replace(tail, word, ""))
        .otherwise(tail)
    )
    return F.when(F.length(content) <= size, content).otherwise(cut)


def context_prefix(title: Column, ancestors: Column, header_path: Column) -> Column:
    """The head every chunk starts with, so that it can be read on its own."""

    def line(label: str, parts: Column) -> Column:
        joined = F.concat(F.lit(label), F.array_join(parts, " > "))
        return F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) > 0, joined)

    page = F.concat(F.lit("Page: "), F.coalesce(title, F.lit("")))
    lines = F.concat_ws("\n", page, line("Path: ", ancestors), line("Section: ", header_path))
    return F.concat(lines, F.lit("\n\n"))


def escape_markup(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def text_to_html(text: Column) -> Column:
    """One paragraph per block between blank lines."""
    blocks = F.filter(F.transform(F.split(text, r"\n\n+", -1), strip), lambda b: F.length(b) > 0)
    return F.array_join(
        F.transform(blocks, lambda b: F.concat(F.lit("<p>"), escape_markup(b), F.lit("</p>"))), "\n"
    )


_FENCE_LINE = r"(?md)^```[^\n]*(\n|\z)"


def markdown_to_html(text: Column) -> Column:
    """Headings, paragraphs and fenced code.

    Splitting at the fence lines leaves prose at even and code at odd places,
    so no state has to be carried from line to line.
    """

    def prose_line(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"\A(#{1,6})\s+.+", 1))
        title = F.regexp_extract(line, r"\A#{1,6}\s+(.+)", 1)
        heading = F.concat(
            F.lit("<h"), level, F.lit(">"), escape_markup(title), F.lit("</h"), level, F.lit(">")
        )
        paragraph = F.concat(F.lit("<p>"), escape_markup(line), F.lit("</p>"))
        return F.when(level > 0, heading).when(F.length(strip(line)) > 0, paragraph)

    def prose(section: Column) -> Column:
        lines = F.array_compact(F.transform(F.split(section, "\n", -1), prose_line))
        return F.nullif(F.array_join(lines, "\n"), F.lit(""))

    def code(section: Column, closed: Column) -> Column:
        body = F.when(closed, F.regexp_replace(section, r"\n\z", "")).otherwise(section)
        block = F.concat(F.lit("<pre><code>"), escape_markup(body), F.lit("</code></pre>"))
        return F.when(closed | (F.length(section) > 0), block)

    def convert(sections: Column) -> Column:
        last = F.size(sections) - 1
        parts = F.transform(
            sections, lambda s, place: F.when(place % 2 == 0, prose(s)).otherwise(code(s, place < last))
        )
        return F.array_join(F.array_compact(parts), "\n")

    return let(F.split(text, _FENCE_LINE, -1), convert)


def local_page_id(relative_path: Column) -> Column:
    return F.concat(F.lit("local_"), F.left(F.md5(relative_path), F.lit(12)))


def path_ancestors(relative_path: Column) -> Column:
    parts = F.split(relative_path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def truncate_for_log(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(limit)), F.lit("…"))
    )


def vector_from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_to_literal(vector: Column) -> Column:
    """Bracketed numbers; whole numbers are written without a decimal point."""
    def number(x: Column) -> Column:
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))

    return F.concat(F.lit("["), F.array_join(F.transform(vector, number), ","), F.lit("]"))


def valid_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def hit_block(title: Column, score: Column, url: Column, content: Column, rank: Column) -> Column:
    """One search hit as text for a model's context."""
    return F.concat(
        F.lit("### "),
        F.coalesce(title, F.concat(F.lit("Result "), rank.cast("string"))),
        F.lit(" (score="),
        fixed(score, 3),
        F.lit(")"),
        F.when(F.length(url) > 0, F.concat(F.lit("\nSource: "), url)).otherwise(F.lit("")),
        F.lit("\n"),
        F.coalesce(content, F.lit("")),
    )


def trim_to_budget(blocks: Column, budget_tokens: int, separator: str = BLOCK_SEPARATOR) -> Column:
    """Keep whole blocks from the front while they fit, else cut the first one.

    ``blocks`` is an array holding at most one search's hits, so this is a
    short fold inside the row.
    """
    return let(blocks, lambda b: _trim(b, budget_tokens, separator))


def _trim(blocks: Column, budget_tokens: int, separator: str) -> Column:
    most = budget_tokens * CHARS_PER_TOKEN
    full = F.array_join(blocks, separator)
    gap = len(separator)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(state: Column, block: Column) -> Column:
        cost = F.length(block) + F.when(state["kept"] > 0, F.lit(gap)).otherwise(F.lit(0))
        fits = state["open"] & (state["used"] + cost <= most)
        return F.struct(
            F.when(fits, state["used"] + cost).otherwise(state["used"]).alias("used"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
            fits.alias("open"),
        )

    kept = F.aggregate(blocks, start, step)["kept"]
    cut = F.when(kept == 0, F.left(full, F.lit(most))).otherwise(
        F.array_join(F.slice(blocks, F.lit(1), kept), separator)
    )
    return (
        F.when(F.lit(budget_tokens <= 0), F.lit(""))
        .when(F.length(full) <= most, full)
        .otherwise(F.concat(cut, F.lit(TRUNCATED_MARK)))
    )
