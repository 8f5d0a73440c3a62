"""Visible text of web pages as a simple text browser lays it out.

A tree builder adds what HTML lets authors leave out (end tags of paragraphs, list items, rows
and cells; stray end tags are dropped). A walk over the tree then emits all visible text:
block elements begin new lines, paragraphs and the like stand between empty lines, list items
have a marker and the indentation of their depth, and the cells of a table are aligned in
columns, those that span rows or columns included. A column is at most `ALIGN_UP_TO` wide; a
cell that doesn't fit stands whole, and what follows it in its row begins a line further down,
at its own column. White space collapses outside `pre`.

Hidden is what a browser doesn't show: head, scripts, styles, templates, comments, elements
with `hidden` or display:none, closed dialogs, and text whose nearest element with a visibility
is hidden (an element inside may be visible again). Of styles, the attribute counts. The
content of `details` is kept, whether open or not. Formulas (`math`) show the text of their
elements without annotations; drawings (`svg`) that of their `text` and `foreignObject`
elements, each set apart, in the order of the page. What `defs` and `symbol` hold shows once,
where it stands, if a `use` names it.

Null and empty pages give an empty text. Nothing is recursive, so depth is no limit. Rows are
independent; repeated rows repeat; extra columns are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from argentum.llm.words import map_blocks

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object canvas audio video datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset menu".split())
BLOCK = SPACED | frozenset(
    "html body div section article nav aside header footer main address li dt dd tr caption figcaption details summary legend option optgroup dialog search hgroup".split()
)
CLOSES_P = SPACED | frozenset("div section article nav aside header footer main address li dt dd details summary figcaption hgroup search dialog".split())
#: An opening tag ends these open elements, looked for up to the boundary elements.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What an open head can hold; anything else ends it, as text does.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
#: Opening tags that end an open svg or math element.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of svg and math that hold HTML.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SVG_HIDDEN = frozenset("desc metadata clippath mask pattern marker lineargradient radialgradient filter".split())
VISIBILITY = {"visible": False, "initial": False, "hidden": True, "collapse": True}  # whether it hides; others are inherited
SCOPE = frozenset("table td th caption button object html".split())  # a paragraph isn't ended from inside these

#: Columns of a table are padded up to this width; what follows a longer cell stands below it.
ALIGN_UP_TO = 60

#: Comments, strings and brackets of a style, in which a semicolon ends nothing.
_ENCLOSED = re.compile(r"""/\*.*?\*/|"[^"]*"|'[^']*'|\([^)]*\)""", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree of a page; `open` is the path to the current element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.n_open: dict[str, int] = {}
        self.used: set[str] = set()  # ids that `use` elements name

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers of tags aren't needed

    def _pop(self) -> None:
        self.n_open[self.open.pop().tag] -= 1

    def _pop_tag(self) -> str:
        tag = self.open[-1].tag
        self._pop()
        return tag

    def _close_up_to(self, tags: set[str] | frozenset[str], boundary: set[str] | frozenset[str]) -> None:
        """End the outermost open element of `tags` inside the nearest boundary, and all in it."""
        if not any(self.n_open.get(t) for t in tags):
            return
        last = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in boundary:
                break
            if self.open[k].tag in tags:
                last = k
        while last is not None and len(self.open) > last:
            self._pop()

    def _in_foreign(self) -> bool:
        """Whether the current element belongs to svg or math."""
        if not (self.n_open.get("svg") or self.n_open.get("math")):
            return False
        for node in reversed(self.open):
            if node.tag in ("svg", "math"):
                return True
            if node.tag in HOLDS_HTML:
                return False
        return False

    def _end_head(self, tag: str | None) -> None:
        """End an open head that can't hold this tag, or (None) text."""
        if self.n_open.get("head") and not self.n_open.get("template") and not self.n_open.get("noscript"):
            if tag in BLOCK or (self.open[-1].tag == "head" and tag not in IN_HEAD):
                self._close_up_to({"head"}, set())

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS_OUT and self._in_foreign():
            while self._pop_tag() not in ("svg", "math"):
                pass
        if tag in CLOSES_P:
            self._close_up_to({"p"}, SCOPE)
        if tag in ENDS:
            self._close_up_to(*ENDS[tag])
        else:
            self._end_head(tag)
        if tag in ("td", "th") and self.n_open.get("table") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])  # an implied row
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag == "use":
            self.used.update(x[1:] for x in (node.attrs.get("href"), node.attrs.get("xlink:href")) if x)
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("svg", "math") or self._in_foreign()):
            self._pop()

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and self._in_foreign():
            self.handle_data(data[6:])

    def handle_endtag(self, tag):
        if not self.n_open.get(tag):
            if tag == "p":  # a stray end tag stands for an empty paragraph
                self.open[-1].children.append(Node("p", {}))
            return
        stop = SCOPE if tag not in SCOPE else frozenset(("table",)) - {tag}
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k].tag in stop:
                return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and _SPACE.sub("", data):
            self._end_head(None)
        self.open[-1].children.append(data)


def styled(node: Node) -> dict[str, str]:
    """The `display` and `visibility` that an element's own style declares: the last of each, important ones first."""
    style = (node.attrs.get("style") or "").lower()
    if "display" not in style and "visibility" not in style:
        return {}
    found: dict[str, tuple[bool, str]] = {}
    for declaration in _ENCLOSED.sub(" ", style).split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip()
        if name in ("display", "visibility"):
            value, _, mark = value.partition("!")
            important = mark.strip() == "important"
            if value.strip() and (important or not found.get(name, (False, ""))[0]):
                found[name] = important, value.strip()
    return {name: value for name, (_, value) in found.items()}


def displayed(node: Node, display: str | None) -> bool:
    """Whether an element has a place on the page, with the display of its style."""
    attrs = node.attrs
    if node.tag in HIDDEN or display == "none":
        return False
    if node.tag == "input" and (attrs.get("type") or "").lower() == "hidden":
        return False
    return display is not None or not ("hidden" in attrs or (node.tag == "dialog" and "open" not in attrs))


class Flow:
    """Lines of one flow of text: a page, or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.prefix: list[str] = []  # indentation of open list items
        self.marker: str | None = None
        self.space = self.gap = False

    def word_space(self) -> None:
        self.space = bool(self.parts)

    def text(self, data: str, raw: bool) -> None:
        if raw:
            head, *rest = data.split("\n")
            self._add(head)
            for line in rest:
                self._end_line(keep_empty=True)
                self._add(line)
            return
        data = _SPACE.sub(" ", data)
        if data.startswith(" "):
            self.word_space()
        self._add(data.strip(" "))
        if data.endswith(" "):
            self.word_space()

    def _add(self, word: str) -> None:
        if word:
            if self.space:
                self.parts.append(" ")
            self.parts.append(word)
            self.space = False

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.prefix)
        if self.marker is not None:
            indent, self.marker = "".join(self.prefix[:-1]) + self.marker, None
        self.lines.append((indent + line).rstrip())

    def _end_line(self, keep_empty: bool = False) -> None:
        if self.parts or keep_empty:
            self._put("".join(self.parts))
        self.parts, self.space = [], False

    def new_line(self, blank: bool = False) -> None:
        self._end_line()
        self.gap |= blank

    def line_break(self) -> None:
        self._end_line(keep_empty=True)

    def block(self, lines: list[str]) -> None:
        self.new_line(blank=True)
        for line in lines:
            self._put(line)
        self.gap = True

    def result(self) -> list[str]:
        self._end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines = lines[:-1]
        start = next((k for k, x in enumerate(lines) if x), len(lines))
        return lines[start:]


def width(text: str) -> int:
    """Columns on a screen: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Cell(NamedTuple):
    lines: list[str]
    columns: int = 1  # that it spans
    rows: int = 1  # 0: all that are left of its group


class _Table:
    def __init__(self):
        self.groups: list[list[list[Cell]]] = [[]]  # rows of head, bodies and foot
        self.captions: list[str] = []

    def add_row(self) -> None:
        self.groups[-1].append([])

    def add_cell(self, cell: Cell) -> None:
        if not self.groups[-1]:
            self.add_row()
        self.groups[-1][-1].append(cell)


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Cells of one group of rows with their first columns: those that a cell of a row above holds are left out."""
    held: dict[int, float] = {}  # column: the row at which it is free again
    out = []
    for r, row in enumerate(rows):
        at, line = 0, []
        for cell in row:
            while held.get(at, 0) > r:
                at += 1
            line.append((at, cell))
            if cell.rows != 1:
                held.update(dict.fromkeys(range(at, at + cell.columns), r + cell.rows if cell.rows else float("inf")))
            at += cell.columns
        out.append(line)
    return out


def aligned(groups: list[list[list[Cell]]], most: int = ALIGN_UP_TO) -> list[str]:
    """Lines of a table: every cell begins at the place of its first column."""
    rows = [row for group in groups for row in placed(group)]
    widths = [0] * max((at + cell.columns for row in rows for at, cell in row), default=0)
    for row in rows:
        for at, cell in row:
            if cell.columns == 1:
                widths[at] = max(widths[at], min(most, max(map(width, cell.lines), default=0)))
    places = list(accumulate((w + 2 for w in widths), initial=0))
    out = []
    for row in rows:
        lines: list[str] = []
        ends: list[int] = []
        top = 0
        for at, cell in row:
            # not above the cell before, and below all lines of the row that reach into the cell's column
            k = top
            while k < min(len(ends), top + len(cell.lines)):
                if ends[k] and ends[k] + 2 > places[at]:
                    top = k + 1
                k += 1
            for k, text in enumerate(cell.lines, top):
                if k == len(lines):
                    lines.append("")
                    ends.append(0)
                if text:
                    lines[k] += " " * (places[at] - ends[k]) + text
                    ends[k] = places[at] + width(text)
        out.extend(line.rstrip() for line in lines)
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and value.strip().isdecimal() and len(value.strip()) < 6 else default


def _of_drawing(node: Node, place: str, used: set[str] | frozenset[str]) -> bool:
    """Whether an element inside svg or math (`place`: the nearest of them) is shown."""
    attrs = node.attrs
    if place == "math":
        return node.tag not in ("annotation", "annotation-xml", "mphantom")
    if (attrs.get("display") or "").strip() == "none":
        return False
    return node.tag not in SVG_HIDDEN and (node.tag != "symbol" or attrs.get("id") in used)


def render(root: Node, used: set[str] | frozenset[str] = frozenset()) -> str:
    """All visible text under a node."""
    flow = Flow()
    flows: list[Flow] = [flow]
    tables: list[_Table] = []
    lists: list[list] = []  # [ordered, next number]
    raw = 0
    drawn: list[str] = []  # open svg, math, text and foreignobject elements
    veils: list[tuple[Node | None, bool]] = [(None, False)]  # open elements with a visibility, and whether they are hidden
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not veils[-1][1] and (not drawn or drawn[-1] != "svg"):
                flow.text(node, bool(raw))
            continue
        tag = node.tag
        if not leaving:
            style = styled(node)
            if not displayed(node, style.get("display")) or (drawn and drawn[-1] != "foreignobject" and not _of_drawing(node, "math" if drawn[-1] == "math" else "svg", used)):
                continue
            said = VISIBILITY.get(style.get("visibility") or ((node.attrs.get("visibility") or "").strip() if drawn or tag == "svg" else ""))
            hidden = veils[-1][1] if said is None else said
            if said is not None and tag not in VOID and tag != "defs":
                veils.append((node, hidden))
            if tag in ("svg", "math") or (drawn and drawn[-1] == "svg" and tag in ("text", "foreignobject")):
                drawn.append(tag)
                if tag != "math":
                    flow.word_space()
                stack.append((node, True))
                stack.extend((child, False) for child in reversed(node.children))
                continue
            if tag == "defs" and drawn and drawn[-1] == "svg":
                stack.extend((child, False) for child in reversed(node.children) if isinstance(child, Node) and child.attrs.get("id") in used)
                continue
            if tag == "br":
                if not hidden:
                    flow.line_break()
                continue
            if tag in VOID:
                if tag == "hr":
                    flow.new_line(blank=True)
                elif hidden:
                    pass
                elif tag == "img" and (node.attrs.get("alt") or "").strip():
                    flow.text(node.attrs["alt"], False)
                elif tag == "input" and (node.attrs.get("type") or "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                    flow.text(node.attrs["value"], False)
                continue
            if tag == "table":
                flow.new_line(blank=True)
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].add_row()
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].groups.append([])
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu"):
                flow.new_line(blank=not lists)
                lists.append([tag == "ol", _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                flow.new_line()
                if not lists:
                    lists.append([False, 1])
                    stack.append((Node("#list", {}), True))
                ordered, n = lists[-1]
                lists[-1][1] = n + 1
                flow.marker = f"{n}. " if ordered else "- "
                if hidden:
                    flow.marker = " " * len(flow.marker)
                flow.prefix.append(" " * len(flow.marker))
            elif tag == "dd":
                flow.new_line()
                flow.prefix.append("    ")
            elif tag == "blockquote":
                flow.new_line(blank=True)
                flow.prefix.append("> ")
            elif tag in BLOCK:
                flow.new_line(blank=tag in SPACED)
            if tag in ("pre", "textarea"):
                raw += 1
            stack.append((node, True))
            stack.extend((child, False) for child in reversed(node.children))
            continue
        if veils[-1][0] is node:
            veils.pop()
        if drawn and tag == drawn[-1]:
            drawn.pop()
            if tag != "math":
                flow.word_space()
            continue
        if tag in ("pre", "textarea"):
            raw -= 1
        if tag == "table":
            done = tables.pop()
            lines = done.captions + aligned(done.groups)
            if lines:
                flow.block(lines)
        elif tag in ("td", "th") and tables and len(flows) > 1:
            cell = flows.pop().result()
            tables[-1].add_cell(Cell(cell, max(1, min(_number(node.attrs.get("colspan"), 1), 1000)), _number(node.attrs.get("rowspan"), 1)))
        elif tag == "caption" and tables and len(flows) > 1:
            tables[-1].captions += flows.pop().result()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            flow.new_line(blank=not lists)
        elif tag == "#list":
            lists.pop()
        elif tag == "li":
            flow.new_line()
            flow.marker = None
            flow.prefix.pop()
        elif tag == "dd":
            flow.new_line()
            flow.prefix.pop()
        elif tag == "blockquote":
            flow.new_line(blank=True)
            flow.prefix.pop()
        elif tag in BLOCK and not (tag == "tr" and tables):
            flow.new_line(blank=tag in SPACED)
    return "\n".join(flows[0].result())


def page_text(html: str | None) -> str:
    """Visible text of one page."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root, builder.used)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Key, text, and its numbers of lines and characters."""
    kind = pages.schema[key].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            texts = [page_text(x) for x in block.column(1).to_pylist()]
            n_lines = [len(x.split("\n")) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array([len(x) for x in texts], pa.int64())], names=[key, "text", "n_lines", "n_chars"])

    return map_blocks(pages.select(key, html), make, f"`{key}` {kind}, text string, n_lines long, n_chars long", html)
