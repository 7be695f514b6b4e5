"""Reading HTML: the top-level items of a page, each with its readable text.

The standard library's tokenizer gives an event stream; open elements are kept
on a stack and every element's text is made by the rule of its tag when it
closes, so nesting of any depth is read in one pass. Packing, overlap and
header paths are Column expressions in ``operators.chunking``.

Recovery: a block element ends an open paragraph, list items and table cells
end their open siblings, an end tag without a start is ignored, and everything
open ends with its parent or the page. ``<head>`` is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple


class Item(NamedTuple):
    """A top-level part of a page. ``level`` is that of a heading, else 0; bare text stands in no element."""

    level: int
    title: str | None
    text: str
    kind: str | None  # code or table
    bare: bool = False


class _Open:
    """An element that has not ended: its text by the rules, its text as written, its table rows."""

    __slots__ = ("cell", "raw", "rows", "shown", "tag", "wrapper")

    def __init__(self, tag: str, wrapper: bool) -> None:
        self.tag, self.wrapper = tag, wrapper
        self.shown: list[str] = []
        self.raw: list[str] = []
        self.rows: list[list[list[str]]] = []
        self.cell: list[list[str]] = []


def _grid(element: _Open) -> str:
    """Rows between bars; a rule below the first of several."""
    lines = ["| " + " | ".join(text for (text,) in row) + " |" for row in element.rows]
    if len(lines) > 1:
        lines.insert(1, "| " + " | ".join("---" for _ in element.rows[0]) + " |")
    return "\n" + "\n".join(lines) + "\n\n" if lines else ""


def _around(before: str, after: str, *, if_any: bool = False, raw: bool = False) -> Callable[[_Open], str]:
    def show(element: _Open) -> str:
        text = "".join(element.raw).strip() if raw else "".join(element.shown)
        return text if if_any and not text else before + text + after

    return show


LEVELS = {f"h{n}": n for n in range(1, 7)}
RULES: dict[str, Callable[[_Open], str]] = {
    "table": _grid, "pre": _around("\n```\n", "\n```\n", raw=True), "code": _around("`", "`", raw=True), "li": _around("• ", "\n"),
    "p": _around("", "\n\n", if_any=True), "div": _around("", "\n\n", if_any=True),
} | {tag: _around("\n" + "#" * n + " ", "\n\n") for tag, n in LEVELS.items()}
ALONE = {"br": "\n", "hr": "\n---\n"}
EMPTY = frozenset(("area", "base", "col", "embed", "img", "input", "link", "meta", "source", "track", "wbr", *ALONE))
KINDS = {"pre": "code", "code": "code", "table": "table"}

_BLOCKS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre",
    "section", "table", "ul", *LEVELS,
)
#: A start tag ends the nearest open element of the first set, looking no further than one of the second.
ENDS: dict[str, list[tuple[frozenset[str], frozenset[str]]]] = {
    tag: [(frozenset(("p",)), frozenset(("td", "th", "li", "div", "article", "section", "table")))] for tag in _BLOCKS
}
for _tag, _open, _within in (
    ("li", "li", "ul ol"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"),
    ("th", "td th", "tr table"), ("option", "option", "select"),
):
    ENDS.setdefault(_tag, []).append((frozenset(_open.split()), frozenset(_within.split())))


class _Reader(HTMLParser):
    def __init__(self, descend: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.descend = descend
        self.items: list[Item] = []
        self.open: list[_Open] = []
        self.pending: list[str] = []
        self.head = False

    def _put(self, shown: str, raw: str = "", tag: str | None = None) -> None:
        """Hand text to the element around it, or make it an item of the page."""
        if self.open and not self.open[-1].wrapper:
            self.open[-1].shown.append(shown)
            self.open[-1].raw.append(raw)
        elif tag in LEVELS:
            self.items.append(Item(LEVELS[tag], raw.strip(), shown, None))
        else:
            self.items.append(Item(0, None, shown, KINDS.get(tag)))

    def _flush(self) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if text.strip():
            inside = self.open and not self.open[-1].wrapper
            if inside:
                self._put(text.strip(), text)
            else:
                self.items.append(Item(0, None, text, None, True))
        elif text and self.open and not self.open[-1].wrapper:
            self.open[-1].raw.append(text)

    def _end(self, count: int) -> None:
        """End the innermost elements until ``count`` are open."""
        while len(self.open) > count:
            element = self.open.pop()
            raw = "".join(element.raw)
            for slot in element.cell:
                slot.append(raw.strip())
            if not element.wrapper:
                self._put(RULES.get(element.tag, _around("", ""))(element), raw, element.tag)

    def _end_nearest(self, tags: frozenset[str], within: frozenset[str] = frozenset()) -> None:
        for place in reversed(range(len(self.open))):
            if self.open[place].tag in tags:
                self._end(place)
                return
            if self.open[place].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("head", "body"):
            self.head = tag == "head"
        if self.head or tag in ("html", "body"):
            return
        self._flush()
        for tags, within in ENDS.get(tag, ()):
            self._end_nearest(tags, within)
        if tag in ALONE:
            self._put(ALONE[tag])
        if tag in EMPTY:
            return
        element = _Open(tag, tag in self.descend and all(e.wrapper for e in self.open))
        for table in (e for e in self.open if e.tag == "table"):
            if tag == "tr":
                table.rows.append([])
            elif tag in ("td", "th") and table.rows:
                element.cell.append([])
                table.rows[-1].append(element.cell[-1])
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        elif not self.head and any(element.tag == tag for element in self.open):
            self._flush()
            self._end_nearest(frozenset((tag,)))

    def handle_data(self, data: str) -> None:
        if not self.head:
            self.pending.append(data)


def items(html: str | None, descend: tuple[str, ...] = ()) -> list[Item]:
    """Top-level items in page order; ``descend`` names wrappers whose children count as top level."""
    reader = _Reader(descend)
    reader.feed(html or "")
    reader.close()
    reader._flush()
    reader._end(0)
    return reader.items


def to_text(html: str | None) -> str:
    """Readable text of a page."""
    return "".join(i.text.strip() if i.bare else i.text for i in items(html))


def split_recursive(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
) -> list[str]:
    """Cut at the coarsest separator that occurs, finer ones for long parts."""
    place = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[place], separators[place + 1 :]
    if separator:
        cut = text.split(separator)
        parts = [cut[0], *(separator + piece for piece in cut[1:])]
    else:
        parts = list(text)
    parts = [part for part in parts if part]

    result: list[str] = []
    window: list[str] = []

    def emit() -> None:
        joined = "".join(window).strip()
        if joined:
            result.append(joined)

    length = 0
    for part in parts:
        if len(part) >= size and finer:
            if window:
                emit()
                window, length = [], 0
            result.extend(split_recursive(part, size, overlap, finer))
            continue
        if window and length + len(part) > size:
            emit()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    if window:
        emit()
    return result
