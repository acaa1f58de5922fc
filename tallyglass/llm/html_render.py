"""The visible text of HTML pages, laid out: block spacing, lists, aligned table cells.

A page becomes a tree first (with the end tags that authors leave out), then text.  Elements may be nested
to any depth: no step recurses or searches the open elements.  Only layout ends somewhere, as the white space
would grow with the square of the page: below ``MAX_LEVELS`` lists and quotes indent no further, below
``MAX_TABLES`` tables each cell has lines of its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 150
MAX_TABLES = 50
# A cell is padded to its column's width, up to this many characters.
MAX_PAD = 60

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("area audio base canvas col colgroup datalist embed head iframe link map meta noembed noframes noscript object param rp script source style svg template title track video".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li listing main nav optgroup option search section summary tbody td tfoot th thead tr".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
# For each start tag: the open elements it ends, and those it does not look beyond.
IMPLIED = {
    "li": ({"li"}, LISTS | {"table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "caption": ({"caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
P_STOPS = frozenset("button caption td th table object".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_HIDES = re.compile(r"(?:^|;)\s*(display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SHOWS = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


# ---------------------------------------------------------------- tree


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place behind the tag; the page's end if the tag never ends."""
    attrs: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return attrs, end + 1 if end >= 0 else len(page)
        at, value = m.end(), ""
        if page[m.end(1) : at].strip() == "=":
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return attrs, len(page)
                value, at = page[at + 1 : end], end + 1
            else:
                value = _VALUE.match(page, at)[0]
                at += len(value)
        attrs.setdefault(m[1].lower(), value)


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        # The open elements, and their places by tag.
        self.stack, self.open = [self.root], defaultdict(list)

    def pop(self, to: int) -> None:
        for node in self.stack[to:]:
            self.open[node.tag].pop()
        del self.stack[to:]

    def innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close(self, tags, stops) -> bool:
        """Ends the innermost open element of ``tags`` above the first of ``stops``."""
        at = self.innermost(tags)
        if at and at >= self.innermost(stops):
            self.pop(at)
            return True
        return False

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if (tag in ("html", "body") and self.open[tag]) or (tag in TABLE_PARTS and tag != "table" and not self.open["table"]):
            return
        if tag in CLOSES_P:
            self.close(("p",), P_STOPS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag in IMPLIED:
            ended, stops = IMPLIED[tag]
            while self.close(ended, stops):
                pass
        if tag in ("td", "th") and self.open["table"] and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        if tag in BLOCK and self.open["head"] and tag not in ("head", "html"):
            self.close(("head",), ())
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if not empty and tag not in VOID:
            self.open[tag].append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
        elif not self.close((tag,) if tag not in HEADINGS else HEADINGS, {"table"} if tag in TABLE_PARTS and tag != "table" else () if tag == "table" else ("td", "th", "caption")) and tag == "p":
            self.stack[-1].children.append(Node("p"))


def parse(page: str) -> Node:
    tree, at, n = _Builder(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            tree.stack[-1].children.append(page[at:lt])
        if lt == n:
            break
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
        elif after in ("!", "?") or (after == "/" and not _NAME.match(page, lt + 2)):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif after == "/":
            name = _NAME.match(page, lt + 2)
            end = page.find(">", name.end())
            tree.end(name[0].lower())
            at = end + 1 if end >= 0 else n
        elif name := _NAME.match(page, lt + 1):
            tag = name[0].lower()
            attrs, at = _attributes(page, name.end())
            if at == n and page[n - 1 : n] != ">":
                break  # a tag that never ends is not shown
            tree.start(tag, attrs, tag not in BLOCK and page[at - 2 : at] == "/>" and tag in ("svg", "path"))
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    tree.stack[-1].children.append(page[at:stop])
                at = stop
        else:
            tree.stack[-1].children.append("<")
            at = lt + 1
    return tree.root


# ---------------------------------------------------------------- text


class _Page:
    """Lines of text under way: one that is being filled, and the blank line that may be due before it."""

    def __init__(self, tables: int = 0):
        # Tables and levels of indentation around what is being written.
        self.tables, self.levels = tables, 0
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.indent, self.marker = "", ""

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.parts or self.parts[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.parts.append(text)

    def line(self, keep_empty: bool = False) -> None:
        text = "".join(self.parts)
        self.parts = []
        self.put(text.rstrip(" "), keep_empty)

    def put(self, text: str, keep_empty: bool = False) -> None:
        if text or keep_empty:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.marker + text).rstrip(" ") if text else "")
            if text:
                self.indent, self.marker = self.indent + " " * len(self.marker) * (self.levels <= MAX_LEVELS), ""

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap |= spaced


def _visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether the element is laid out, and whether its text shows."""
    attrs = node.attrs
    if node.tag in HIDDEN or ("hidden" in attrs and attrs["hidden"].lower() != "until-found") or (node.tag == "dialog" and "open" not in attrs):
        return False, shown
    style = attrs.get("style", "")
    for m in _HIDES.finditer(style):
        if m[1].lower().startswith("display"):
            return False, shown
        shown = False
    return True, shown or bool(_SHOWS.search(style))


def _number(text: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return max(-most, min(most, int(m[1]))) if m else default


# What lays out elements yields the layout of the elements inside and is sent its result.
Layout = Generator["Layout", list[str] | None, list[str] | None]


def _run(layout: Layout) -> None:
    stack, result = [layout], None
    while stack:
        try:
            inner = stack[-1].send(result)
        except StopIteration as done:
            stack.pop()
            result = done.value
        else:
            stack.append(inner)
            result = None


def _render(node: Node, page: _Page, shown: bool, pre: bool) -> Layout:
    number = _number(node.attrs.get("start"), 1, 10**9)
    closed = node.tag == "details" and "open" not in node.attrs
    seen_summary = False
    for child in node.children:
        if isinstance(child, str):
            if not closed and shown:
                text = entities.unescape(child) if "&" in child and node.tag != "xmp" else child
                if pre:
                    first, *rest = text.replace("\r\n", "\n").split("\n")
                    page.parts.append(first)
                    for more in rest:
                        page.line(keep_empty=True)
                        page.parts.append(more)
                else:
                    page.write(text)
            continue
        laid_out, show = _visible(child, shown)
        if not laid_out:
            continue
        tag = child.tag
        if closed:
            if tag != "summary" or seen_summary:
                continue
            seen_summary = True
        if tag == "br":
            page.line(keep_empty=True)
        elif tag == "input":
            if show and child.attrs.get("type", "text").lower() in ("text", "search", "url", "email", "tel", "number", "submit", "reset", "button"):
                page.write(entities.unescape(child.attrs.get("value", "")))
        elif tag == "table" and page.tables < MAX_TABLES:
            page.block(True)
            yield _table(child, page, show)
            page.block(True)
        elif tag == "select":
            options = [o for o in _walk(child, "option") if _visible(o, show)[0]]
            chosen = [o for o in options if "selected" in o.attrs] or options[:1]
            for o in chosen if "multiple" not in child.attrs else options:
                page.write(" ")
                yield _render(o, page, show, False)
            page.write(" ")
        elif tag == "li":
            page.block(False)
            marker = "- "
            if node.tag == "ol":
                number = _number(child.attrs.get("value"), number, 10**9)
                marker, number = f"{number}. ", number + (-1 if "reversed" in node.attrs else 1)
            yield _indented(child, page, show, marker)
        elif tag in BLOCK or tag == "textarea":
            nested = tag in LISTS and node.tag in ("li", *LISTS)
            spaced = tag in SPACED and not nested
            page.block(spaced)
            if tag in ("dd", "blockquote"):
                yield _indented(child, page, show, "    " if tag == "dd" else "  ", blank=True)
            else:
                yield _render(child, page, show, pre or tag in ("pre", "textarea", "listing", "xmp"))
            page.block(spaced)
        else:
            yield _render(child, page, show, pre)


def _indented(node: Node, page: _Page, shown: bool, marker: str, blank: bool = False) -> Layout:
    indent, outer = page.indent, page.marker
    page.levels += 1
    if not blank:
        page.marker = outer + marker if page.levels <= MAX_LEVELS else outer or marker
    elif page.levels <= MAX_LEVELS:
        page.indent += marker
    yield _render(node, page, shown, False)
    page.block(False)
    page.levels -= 1
    page.indent = indent
    page.marker = outer if page.marker and not blank else ""


def _walk(node: Node, tag: str) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == tag:
                yield child
            elif child.tag == "optgroup":
                yield from _walk(child, tag)


def _cell(node: Node, shown: bool, tables: int) -> Layout:
    page = _Page(tables)
    yield _render(node, page, shown, False)
    page.line()
    return page.lines


def _table(table: Node, page: _Page, shown: bool) -> Layout:
    """Captions and stray content first, then the rows: head, bodies, foot."""
    parts: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
    for child in table.children:
        if isinstance(child, str):
            if child.strip() and shown:
                page.write(entities.unescape(child))
            continue
        laid_out, show = _visible(child, shown)
        if not laid_out:
            continue
        if child.tag == "tr":
            parts["tbody"].append((child, show))
        elif child.tag in parts:
            for row in child.children:
                if isinstance(row, Node):
                    laid_out, row_show = _visible(row, show)
                    if laid_out:
                        parts[child.tag].append((row, row_show))
                elif row.strip() and show:
                    page.write(entities.unescape(row))
        else:
            page.block(False)
            yield _render(child if child.tag == "caption" else _wrap(child), page, show, False)
            page.block(False)
    page.line()
    rows, widths, taken = [], Counter(), {}
    for row, show in parts["thead"] + parts["tbody"] + parts["tfoot"]:
        if row.tag != "tr":
            row = _wrap(row)
        cells, column = [], 0
        for child in row.children:
            if isinstance(child, str):
                if not child.strip():
                    continue
                child = _wrap(child)
            laid_out, cell_show = _visible(child, show)
            if not laid_out:
                continue
            while taken.get(column, 0) > 0:
                taken[column] -= 1
                column += 1
            lines = yield _cell(child if child.tag in ("td", "th") else _wrap(child), cell_show, page.tables + 1)
            span = max(1, _number(child.attrs.get("colspan"), 1, 1000))
            deep = max(1, _number(child.attrs.get("rowspan"), 1, 65534))
            cells.append((column, span, lines))
            if span == 1:
                widths[column] = max(widths[column], max(map(len, lines), default=0))
            if deep > 1:
                taken.update({c: deep for c in range(column, column + span)})
                taken = {c: left - (column <= c < column + span) for c, left in taken.items()}
            column += span
        for c in [c for c in taken if c >= column and taken[c] > 0]:
            taken[c] -= 1
        rows.append(cells)
    starts, at = {}, 0
    for column in sorted(c for c in widths if widths[c]):
        starts[column] = at
        at += min(widths[column], MAX_PAD) + 2
    columns = sorted(starts)
    for cells in rows:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            text = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    place = starts.get(column)
                    if place is None:
                        place = next((starts[c] for c in columns if c >= column), len(text) + 2 if text else 0)
                    text += " " * max(place - len(text), 2 if text else 0) + lines[i]
            page.put(text)


def _wrap(content: Node | str) -> Node:
    node = Node("td")
    node.children.append(content)
    return node


def page_text(page: str | None) -> str:
    """All visible text of a page; empty for NULL and for a page that shows none."""
    if not page:
        return ""
    out = _Page()
    _run(_render(parse(page.replace("\x00", "")), out, True, False))
    out.line()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def render(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id, text`` of every row.  NULL and empty pages have an empty text; repeated rows come back as
    often as they came; other columns are ignored; an empty table gives an empty result."""
    kind = pages.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(p) for p in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return pages.select(F.col(id_column), F.col(html_column).alias("_html")).mapInArrow(work, f"`{id_column}` {kind}, text string")
