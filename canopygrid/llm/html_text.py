"""Operator 3, HTML extraction: layout-aware rendering of all visible text.

A page is cut into tags and texts.  Open elements form a stack; tags that HTML
implies are closed or supplied (paragraphs before blocks, list items, table
rows and cells, the end of the head).  An element is rendered when it closes:
inline content joins its parent's line, blocks become lines of their own, with
blank lines around paragraphs, headings, lists and tables; list items carry markers and are indented;
table cells are padded so that columns line up; ``pre`` keeps its spaces.

Not visible are the head, comments, scripts, styles, templates, ``noscript``, elements
with ``hidden`` or with ``display:none`` or ``visibility:hidden`` in their style, and
what a closed ``details`` or ``dialog`` holds.

Edge cases: a null or empty page has an empty text; unclosed tags close at the end;
end tags without a start are ignored; any depth of nesting works, as nothing is
recursive; repeated rows are rendered one by one; other columns are ignored, so their
names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas svg math title".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav option section summary tr thead tbody tfoot optgroup search".split())
CLOSES_P = BLOCKS - frozenset("body html li option optgroup tr thead tbody tfoot caption legend dd dt".split()) | {"li", "dd", "dt"}
HEAD_PARTS = frozenset("base link meta script style title template noscript".split())
LISTS = frozenset(("ul", "ol", "menu"))
#: Which open elements a start tag closes, and at which ones the search for them stops.
IMPLIED = {
    "li": (frozenset(("li",)), LISTS | {"table", "td", "th"}),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "a": (frozenset(("a",)), frozenset(("table", "td", "th"))),
    **{f"h{i}": (frozenset(f"h{k}" for k in range(1, 7)), BLOCKS - frozenset(f"h{k}" for k in range(1, 7)) - {"p"}) for i in range(1, 7)},
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["thead"]
#: End tags do not reach beyond these, unless they name one of them.
WALLS = frozenset(("table", "td", "th", "caption", "html", "body"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BREAK = "\n"


class Block:
    """Rendered lines, and whether a blank line stands above and below them."""

    __slots__ = ("above", "below", "lines")

    def __init__(self, lines: list[str], above: bool, below: bool) -> None:
        self.lines, self.above, self.below = lines, above, below


class Row:
    """Cells of a table row: lines and number of columns of each."""

    __slots__ = ("cells",)

    def __init__(self, cells: list[tuple[list[str], int]]) -> None:
        self.cells = cells


class Cell:
    __slots__ = ("lines", "span")

    def __init__(self, lines: list[str], span: int) -> None:
        self.lines, self.span = lines, span


class Element:
    """An open element and what it holds so far."""

    __slots__ = ("attributes", "count", "hidden", "items", "pre", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], hidden: bool, pre: bool) -> None:
        self.tag, self.attributes, self.hidden, self.pre = tag, attributes, hidden, pre
        self.items: list = []
        self.count = 0


def flow(items: list) -> Block:
    """Inline texts and blocks in order; blank lines at the edges are left to the parent."""
    lines: list[str] = []
    inline: list[str] = []
    above = apart = False

    def write(more: list[str], before: bool, after: bool) -> None:
        nonlocal above, apart
        if not more:
            return
        if not lines:
            above = before
        elif before or apart:
            lines.append("")
        lines.extend(more)
        apart = after

    def end_line() -> None:
        if inline:
            found = [_SPACES.sub(" ", x).strip(" ") for x in "".join(inline).split(_BREAK)]
            while found and not found[0]:
                found.pop(0)
            while found and not found[-1]:
                found.pop()
            write(found, False, False)
            inline.clear()

    for item in items:
        if isinstance(item, str):
            inline.append(item)
            continue
        end_line()
        if isinstance(item, Block):
            write(item.lines, item.above, item.below)
        elif isinstance(item, Row):
            write(table([item]), False, False)
        else:
            write(item.lines, False, False)
    end_line()
    return Block(lines, above, apart)


def table(rows: list[Row]) -> list[str]:
    """Rows as lines with aligned columns, two blanks between columns."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row.cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
            at += span
    out = []
    for row in rows:
        height = max((len(lines) for lines, _ in row.cells), default=0)
        for i in range(height):
            at, parts = 0, []
            for lines, span in row.cells:
                width = sum(widths.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(width))
                at += span
            out.append("  ".join(parts).rstrip())
    return out


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self, page: str) -> None:
        self.stack = [Element("", {}, False, False)]
        at = 0
        size = len(page)
        while at < size:
            tag = _TAG.search(page, at)
            if tag is None:
                self.text(page[at:])
                break
            if tag.start() > at:
                self.text(page[at : tag.start()])
            at = tag.end()
            if tag[2] is None:
                continue
            name = tag[2].lower()
            if tag[1]:
                self.end(name)
                continue
            self.start(name, tag[3] or "")
            if name in RAW and self.stack[-1].tag == name:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                inside = page[at : close.start()] if close else page[at:]
                if not self.stack[-1].hidden:
                    self.stack[-1].items.append(_SPACES.sub(" ", unescape(inside) if name in ("textarea", "title") else inside))
                self.pop()
                at = close.end() if close else size
        while len(self.stack) > 1:
            self.pop()

    def render(self) -> str:
        return "\n".join(flow(self.stack[0].items).lines)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and not raw.isspace():
            self.pop()
            top = self.stack[-1]
        if top.hidden:
            return
        text = unescape(raw) if "&" in raw else raw
        if top.pre:
            top.items.append(text)
        elif top.tag in ("table", "thead", "tbody", "tfoot", "tr") and text.isspace():
            return
        else:
            top.items.append(_SPACES.sub(" ", text))

    def start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body") and any(e.tag == tag for e in self.stack):
            return
        if any(e.tag == "head" for e in self.stack[-2:]) and tag not in HEAD_PARTS and tag != "head":
            while any(e.tag == "head" for e in self.stack):
                self.pop()
        if tag in CLOSES_P:
            self.close_until({"p"}, WALLS | {"button", "object"})
        if tag in IMPLIED:
            names, walls = IMPLIED[tag]
            while self.close_until(names, walls):
                pass
        parent = self.stack[-1]
        if tag in ("td", "th") and parent.tag in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", {})
            parent = self.stack[-1]
        if tag == "br":
            if not parent.hidden:
                parent.items.append(_BREAK)
            return
        if tag == "hr" and not parent.hidden:
            parent.items.append(Block(["---"], True, True))
            return
        if tag in VOID:
            return
        found = {}
        if raw.strip(" /\n\t\r"):
            for name, a, b, plain in _ATTRIBUTE.findall(raw):
                found.setdefault(name.lower(), unescape(a or b or plain))
        self.push(tag, found)

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        parent = self.stack[-1]
        hidden = parent.hidden or tag in HIDDEN or "hidden" in attributes or bool(_INVISIBLE.search(attributes.get("style", "")))
        hidden |= tag == "dialog" and "open" not in attributes
        # Of a closed ``details`` only the summary shows.
        hidden |= parent.tag == "details" and "open" not in parent.attributes and tag != "summary"
        self.stack.append(Element(tag, attributes, hidden, parent.pre or tag in ("pre", "xmp")))

    def close_until(self, names, walls) -> bool:
        """Close the innermost open element of ``names`` above any of ``walls``, with all in it."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in names:
                while len(self.stack) > i:
                    self.pop()
                return True
            if tag in walls:
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not any(e.tag == "p" for e in self.stack):
            self.start("p", "")
            self.pop()
        else:
            walls = WALLS - {tag}
            if tag in ("table", "html", "body"):
                walls = frozenset(("table",)) - {tag}
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                walls = frozenset(("table",))
            self.close_until({tag}, walls)

    def pop(self) -> None:
        element = self.stack.pop()
        if element.hidden:
            return
        parent, tag, items = self.stack[-1], element.tag, element.items
        if tag == "details" and "open" not in element.attributes:
            items = [x for x in items if not isinstance(x, str)]
        if tag in ("td", "th"):
            span = element.attributes.get("colspan", "1")
            parent.items.append(Cell(flow(items).lines, int(span) if re.fullmatch(r"[1-9]\d{0,2}", span) else 1))
        elif tag == "tr":
            parent.items.append(Row([(x.lines, x.span) if isinstance(x, Cell) else (flow([x]).lines, 1) for x in items]))
        elif tag in ("thead", "tbody", "tfoot"):
            parent.items.extend(items)
        elif tag == "table":
            rows = [x for x in items if isinstance(x, Row)]
            others = flow([x for x in items if not isinstance(x, Row)]).lines
            parent.items.append(Block(others + table(rows), True, True))
        elif tag == "pre":
            lines = "".join(x if isinstance(x, str) else "\n".join(x.lines) if not isinstance(x, Row) else "\n".join(table([x])) for x in items).split("\n")
            parent.items.append(Block([x.rstrip() for x in lines[not lines[0] : len(lines) - (not lines[-1])]], True, True))
        elif tag == "li":
            parent.count += 1
            mark = f"{parent.count}. " if parent.tag == "ol" else "- "
            lines = flow(items).lines
            parent.items.append(Block([(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)] or [mark.rstrip()], False, False))
        elif tag in LISTS:
            nested = any(e.tag == "li" for e in self.stack)
            parent.items.append(Block(flow(items).lines, not nested, not nested))
        elif tag == "dd" or tag == "blockquote":
            parent.items.append(Block([f"  {x}" if x else "" for x in flow(items).lines], tag == "blockquote", tag == "blockquote"))
        elif tag in BLOCKS:
            block = flow(items)
            parent.items.append(Block(block.lines, block.above or tag in PARAGRAPHS, block.below or tag in PARAGRAPHS))
        else:
            parent.items.extend(items)


def visible_text(page: str | None) -> str:
    """All visible text of a page."""
    return Page(page).render() if page else ""


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every row."""
    c.small_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return pages.mapInArrow(_batches, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")
