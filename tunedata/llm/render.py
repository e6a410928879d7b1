"""Visible text of web pages, laid out as a browser without styles would show it.

A page becomes a tree: tags that HTML lets one leave out are implied, unknown closings are ignored,
and what never shows (scripts, styles, hidden elements) is kept apart. The tree is then rendered:
blocks on lines of their own with blank lines between paragraphs, list items with their mark and
indent, and table rows with cells padded to the width of their column.

Pages may nest as deep as they are long: the open elements are a list with the places of each tag, and
rendering is a stack of steps, so neither recursion nor a limit of depth comes in.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object audio video canvas datalist title noembed noframes desc metadata defs annotation annotation-xml".split())
#: Kinds of input whose value is not shown as text.
WORDLESS = frozenset("hidden checkbox radio file image range color password".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav section summary caption tr search".split())
#: An opening tag ends open elements of these names, up to the nearest element that bounds them.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("td", "th", "tr", "caption", "colgroup", "thead", "tbody", "tfoot"), "body": ("head",),
} | {part: ("td", "th", "tr", "caption", "colgroup", "thead", "tbody", "tfoot") for part in ("tbody", "tfoot")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)} | {t: ("table",) for t in ("tr", "td", "th", "thead", "tbody", "tfoot")}
#: Elements that are no part of a page's head and so end it, and blocks that end a paragraph.
_HEAD = frozenset("head base link meta title style script noscript template html".split())
_CLOSES_P = BLOCK - {"html", "body", "caption", "tr", "legend", "summary"} | {"hr"}
_P_BOUND = frozenset(("table", "td", "th", "caption", "button", "object"))
#: Columns beyond which nested quotes and lists are not indented further.
INDENT = 100

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: The rest of a tag; quotes hold a ``>`` only in a value. A tag that never ends takes the rest of the page.
_REST = re.compile(r"((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element. ``hidden``: neither it nor what is in it shows; ``shows``: its visibility, None as around it."""

    __slots__ = ("tag", "attributes", "children", "hidden", "shows")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        style = attributes.get("style", "")
        kind = attributes.get("type", "").lower() if tag == "input" else ""
        self.hidden = tag in HIDDEN or "hidden" in attributes or kind == "hidden" or bool(style and _UNSEEN.search(style))
        seen = _VISIBILITY.findall(style) if style else []
        self.shows = seen[-1].lower() == "visible" if seen else None


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


class _Stack(list):
    """Open elements, and the places of those of each tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self))
        self.append(node)

    def cut(self, i: int) -> None:
        for node in self[i:]:
            self.places[node.tag].pop()
        del self[i:]

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def _close(stack: _Stack, names: tuple[str, ...], bounds: tuple[str, ...] | frozenset[str]) -> None:
    """End the open elements of these names, with all inside them, as far as the nearest bound."""
    if not any(stack.places.get(n) for n in names):
        return
    bound = stack.last(bounds)
    inside = [stack.places[n][at] for n in names if (at := bisect_right(stack.places.get(n, ()), bound)) < len(stack.places.get(n, ()))]
    if inside:
        stack.cut(min(inside))


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack, at, size = _Stack(root), 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        text = html[at:token.start() if token else size]
        if text:
            if stack[-1].tag == "head" and text.strip():
                stack.cut(len(stack) - 1)
            stack[-1].children.append(unescape(text))
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag, rest = token[2].lower(), _REST.match(html, at)
        at = rest.end()
        if not html.endswith(">", 0, at):
            break
        if token[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            at_tag = stack.last((tag,))
            inner = tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th")
            if at_tag and (inner or at_tag > stack.last(("table", "td", "th"))):
                stack.cut(at_tag)
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in _HEAD:
            stack.cut(len(stack) - 1)
        if tag in ENDS:
            _close(stack, ENDS[tag], BOUNDS.get(tag, ()))
        if tag in _CLOSES_P:
            _close(stack, ("p",), _P_BOUND)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.push(row)
        node = Node(tag, _attributes(rest[1]) if rest[1].strip(" /\t\n") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            content = html[at:end.start()]
            node.children.append(unescape(content) if tag in ("textarea", "title") else content)
            at = end.end()
        elif tag not in VOID and not (rest[1].rstrip().endswith("/") and stack.last(("svg", "math", tag if tag in ("svg", "math") else "svg"))):
            stack.push(node)
    return root


def width(text: str) -> int:
    """Columns of a text in a fixed-width layout."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines written so far, and the line being written."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.lead, self.gap = [], False, "", False

    def words(self, text: str) -> None:
        parts = _SPACE.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self.line.append(part)

    def preformatted(self, text: str) -> None:
        first, *others = text.split("\n")
        self.line.append(first)
        for other in others:
            self.end(True)
            self.line.append(other)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one is left out unless it is to be kept."""
        text = "".join(self.line).rstrip()
        if text or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.lead + text if text else "")
            self.lead = " " * len(self.lead)
        self.line, self.space = [], False

    def block(self, lines: list[str]) -> None:
        """Whole lines, as of a table, which may be taken over as they are."""
        self.end()
        self.gap = True
        if not self.lines and not self.lead:
            self.lines = lines
        else:
            for line in lines:
                self.line.append(line)
                self.end(True)
        self.gap = True


#: A step of rendering: it yields the steps it needs done first and is sent what they return.
Step = Generator["Step", object, object]


def _done(step: Step) -> object:
    """Run a step and all it needs, one inside the other, on a list of its own."""
    waiting, value = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as end:
            waiting.pop()
            value = end.value
    return value


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text) else otherwise


def _options(select: Node) -> list[str]:
    """What a drop-down or list box shows: the chosen option (the first if none is), or all of a list."""
    found, waiting = [], list(reversed(select.children))
    while waiting:
        node = waiting.pop()
        if isinstance(node, Node) and not node.hidden:
            if node.tag == "option":
                found.append(node)
            else:
                waiting.extend(reversed(node.children))
    listed = "multiple" in select.attributes or _number(select.attributes.get("size"), 1) > 1
    if not listed:
        found = ([o for o in found if "selected" in o.attributes][-1:] or [o for o in found if "disabled" not in o.attributes][:1])
    return [o.attributes.get("label") or " ".join(c for c in o.children if isinstance(c, str)) for o in found]


def _render(node: Node, page: _Page, pre: bool, shown: bool) -> Step:
    counter = _number(node.attributes.get("start"), 1) - 1 if node.tag == "ol" else 0
    for child in node.children:
        if isinstance(child, str):
            if shown:
                page.preformatted(child) if pre else page.words(child)
            continue
        tag = child.tag
        if child.hidden:
            continue
        seen = shown if child.shows is None else child.shows
        if tag == "br":
            page.end(True)
        elif tag == "hr":
            page.end()
            page.gap = True
        elif tag in ("img", "area"):
            page.words(child.attributes.get("alt", "") if seen else "")
        elif tag == "input":
            kind = child.attributes.get("type", "text").lower()
            shows = child.attributes.get("alt" if kind == "image" else "value", "") if kind == "image" or kind not in WORDLESS else ""
            page.words(f" {shows} " if seen else "")
        elif tag == "select":
            for option in _options(child) if seen else ():
                page.words(f" {option} ")
        elif tag == "table":
            page.block((yield _table(child, seen)))
        elif tag in BLOCK:
            page.end()
            page.gap |= tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
            lead = page.lead
            if tag == "li":
                counter = _number(child.attributes.get("value"), counter + 1)
                page.lead = " " * min(len(lead), INDENT) + (f"{counter}. " if node.tag == "ol" else "* ") if seen else lead
            elif tag in ("dd", "blockquote"):
                page.lead = " " * min(len(lead) + 4, max(INDENT, len(lead)))
            yield _render(child, page, pre or tag == "pre", seen)
            page.end()
            page.lead = " " * len(lead) if page.lead != lead else lead
            page.gap |= tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
        else:
            yield _render(child, page, pre or tag in ("textarea", "xmp", "listing", "plaintext"), seen)


def _lines(node: Node, shown: bool) -> Step:
    page = _Page()
    yield _render(node, page, node.tag == "pre", shown)
    page.end()
    return page.lines


def _rows(table: Node, shown: bool) -> tuple[Node, list[tuple[Node, bool]]]:
    """Visible rows of a table and whether their text shows, head first and foot last, and what else stands in it."""
    parts: dict[int, list[tuple[Node, bool]]] = {0: [], 1: [], 2: []}
    rest = Node("div", {})
    waiting = [(child, 1, shown) for child in reversed(table.children)]
    while waiting:
        child, part, seen = waiting.pop()
        if isinstance(child, str):
            rest.children.append(child)
            continue
        if child.hidden:
            continue
        seen = seen if child.shows is None else child.shows
        if child.tag in ("thead", "tbody", "tfoot"):
            part = {"thead": 0, "tfoot": 2}.get(child.tag, 1)
            waiting.extend((c, part, seen) for c in reversed(child.children))
        elif child.tag == "tr":
            parts[part].append((child, seen))
        else:
            rest.children.append(child)
    return rest, parts[0] + parts[1] + parts[2]


def _spanned(text: str | None, most: int) -> int:
    return max(1, min(int(text), most)) if text and re.fullmatch(r"\d{1,5}", text) else 1


def _table(table: Node, shown: bool) -> Step:
    """A table's lines: what is outside its rows first, then rows whose cells stand under each other.

    A cell over several rows or columns shows in the first of them, and the others stay empty.
    """
    rest, rows = _rows(table, shown)
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # columns that cells from above still hold, and for how many rows
    for n, (row, seen) in enumerate(rows):
        cells: dict[int, list[str]] = {}
        column, below = 0, {c: left - 1 for c, left in taken.items() if left > 1}
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    rest.children.append(cell)
                continue
            if cell.hidden:
                continue
            while taken.get(column, 0) > 0:
                column += 1
            cells[column] = yield _lines(cell, seen if cell.shows is None else cell.shows)
            down = cell.attributes.get("rowspan")
            deep = len(rows) - n if down == "0" else min(_spanned(down, 65534), len(rows) - n)
            for c in range(column, column + _spanned(cell.attributes.get("colspan"), 1000)):
                if deep > 1:
                    below[c] = max(below.get(c, 0), deep - 1)
                column = c + 1
        taken = below
        grid.append(cells)
    out = yield _lines(rest, shown)
    if not out and len(grid) == 1 and len(grid[0]) == 1:
        return next(iter(grid[0].values()))  # a frame around one cell
    widths: dict[int, int] = {}
    for cells in grid:
        for i, cell in cells.items():
            widths[i] = max(widths.get(i, 0), max(map(width, cell), default=0))
    columns = range(max(widths, default=-1) + 1)
    for cells in grid:
        for n in range(max(map(len, cells.values()), default=0)):
            line = []
            for i in columns[:max(cells) + 1]:
                text = cells[i][n] if i in cells and n < len(cells[i]) else ""
                line.append(text + " " * (widths.get(i, 0) - width(text)))
            out.append("  ".join(line).rstrip())
    return out


def visible_text(html: str | None) -> str | None:
    """All text of a page that shows, laid out; null for null."""
    if html is None:
        return None
    return "\n".join(_done(_lines(parse(html), True))).strip("\n")


def with_visible_text(pages: DataFrame, html_col: str = "html", into: str = "visible_text") -> DataFrame:
    """Adds the laid-out visible text of each page; a column named ``into`` is replaced.

    Null pages give null, empty ones and such without visible text an empty text. Rows, other columns
    and repeats stay as they are. Elements may be nested to any depth; only the indent of quotes and
    lists ends at ``INDENT`` columns.
    """
    @F.pandas_udf("string")
    def rendered(html: pd.Series) -> pd.Series:
        return pd.Series([visible_text(h) for h in html], dtype=object)

    return pages.withColumn(into, rendered(F.col(html_col)))
