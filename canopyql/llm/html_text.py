"""Layout-aware text of HTML pages.

A tokenizer cuts the source into tags, text, comments and raw text; a tree builder supplies implied tags (p, li, dt, dd, tr, td, th,
option, html/head/body parts) and closes what a block or an end tag closes; a renderer walks the tree and emits every visible text:
blocks on lines of their own with the spacing of their kind, list items with bullets or numbers indented by depth, table rows with cells
padded to the columns' widths (colspan and rowspan take their places), preformatted text unchanged. Not visible are head, scripts, styles, templates
and the like, comments, ``hidden`` attributes, ``display:none``, and ``visibility:hidden`` until a descendant is ``visible``. The first text or
tag that can't stand in a head ends it. Options, formulas and the text of drawings are visible; their descriptions and annotations aren't.

Cases: null or empty pages give the empty text; unclosed, crossed and unknown tags never raise; a tag that the source's end cuts off
isn't visible; a quote without its partner belongs to the next attribute's name; a document without markup is its own text; repeated rows are rendered each; an empty table gives
no rows; extra columns are ignored. Very long pages: building and rendering use explicit stacks, so depth is bounded by memory only, and time is linear in the source;
lists are indented up to ``DEEPEST`` levels, and tables within as many others are laid out as blocks (their text is all there).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DEEPEST = 24
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas title desc metadata defs annotation annotation-xml".split())
#: What may stand in a head; any other tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Blank lines before and after; 0: only a line of its own.
BLOCKS = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split(), 1),
    **dict.fromkeys(
        "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav section summary tr thead tbody tfoot option optgroup xmp".split(), 0
    ),
}
#: An opening tag closes these open elements, looking no further up than the bound.
CLOSES = {
    **{t: (("li",), ("ul", "ol", "menu", "dir")) for t in ("li",)},
    **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")},
    **{t: (("td", "th"), ("table", "tr")) for t in ("td", "th")},
    **{t: (("tr", "td", "th"), ("table",)) for t in ("tr",)},
    **{t: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
}
_P_SCOPE = tuple("td th caption li dd dt button table html body".split())
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|<", re.S)
#: One attribute, or the end of the tag. Each sign is read once; a quote that never closes fails at most once for each kind.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?)")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Tree:
    """The open elements, and for each tag the places where it stands among them, so that no search walks the stack."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack: list[Node] = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.places[x.tag].pop()
        del self.stack[k:]

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of some tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, tags: tuple[str, ...], bound: tuple[str, ...]) -> None:
        """Closes up to the outermost open element of tags within the bound."""
        if any(self.places[t] for t in tags):
            top = self.last(bound)
            inside = [p[i] for t in tags if (i := bisect_right(p := self.places[t], top)) < len(p)]
            if inside:
                self.cut(min(inside))

    def text(self, s: str) -> None:
        if not s:
            return
        if self.stack[-1].tag == "head" and not s.isspace():
            self.cut(len(self.stack) - 1)
        self.stack[-1].children.append(s)

    def end(self, tag: str) -> None:
        place = self.last((tag,))
        if not place:
            if tag == "p":
                self.stack[-1].children.append(Node("p", {}))
        elif tag == "table" or self.last(("table",)) < place:  # a stray end tag closes nothing beyond a table
            self.cut(place)

    def start(self, tag: str) -> None:
        """Closes what an opening tag closes, and opens what it implies."""
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.stack) - 1)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in BLOCKS and tag not in ("option", "optgroup") and (p := self.last(("p",))) > self.last(_P_SCOPE):
            self.cut(p)
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr", {}))


def parse(source: str) -> Node:
    """The tree of a page."""
    tree, at, n = _Tree(), 0, len(source)
    while at < n:
        m = _MARK.search(source, at)
        if not m:
            tree.text(html.unescape(source[at:]))
            break
        if m.start() > at:
            tree.text(html.unescape(source[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0] == "<":
                tree.text("<")
            continue
        attributes, closed, last = {}, False, ""
        while a := _ATTRIBUTE.match(source, at):
            at = a.end()
            if a[1]:
                closed, last = True, source[at - 2]
                break
            attributes.setdefault(a[2].lower(), html.unescape(a[3] or a[4] or a[5] or ""))
        if not closed:  # the source ends within the tag
            break
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        tree.start(tag)
        node = Node(tag, attributes)
        if tag in VOID or last == "/":
            tree.stack[-1].children.append(node)
        elif tag in RAW:
            tree.stack[-1].children.append(node)
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            text = source[at : end.start()] if end else source[at:]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else n
        else:
            tree.push(node)
    return tree.root


def displayed(node: Node) -> bool:
    a = node.attributes
    return node.tag not in HIDDEN and "hidden" not in a and not ("style" in a and _NO_DISPLAY.search(a["style"])) and not (node.tag == "input" and a.get("type", "").lower() == "hidden")


def shown(node: Node, above: bool) -> bool:
    """Whether text in the node is visible, by its own style or else as above it."""
    style = node.attributes.get("style")
    said = _VISIBILITY.findall(style) if style else None
    return said[-1].lower() == "visible" if said else above


class _Out:
    """Lines of text: inline text collects in a line, blocks end it and ask for blank lines between."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.prefix = [], 0, False, ""

    def text(self, s: str) -> None:
        parts = _BLANK.split(s)
        lead, trail = parts[0] == "", parts[-1] == ""
        words = [p for p in parts if p]
        if not words:
            self.space = self.space or bool(s)
            return
        if self.line and (lead or self.space):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = trail

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.lines.append(self.prefix + "".join(self.line))
            self.prefix = " " * len(self.prefix) if self.prefix.strip() else self.prefix
            self.line, self.gap = [], 0
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)


def _span(node: Node, name: str, most: int) -> int:
    """A span as the standard reads it: 1 if it isn't a number, at most `most`."""
    digits = node.attributes.get(name, "1").strip()[:9]
    return min(max(int(digits), 1), most) if digits.isdecimal() else 1


class _Grid:
    """Cells by row and column. Cells of a row take the next columns that no cell of a row above spans.

    What spans down is kept as disjoint ranges of columns, each with the row after it; chains of ranges are remembered, so that a row doesn't walk them again."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.captions: list[str] = []
        self.column = 0
        self.starts: list[int] = []
        self.ranges: dict[int, tuple[int, int]] = {}  # start: (column after, row after)
        self.chains: dict[int, tuple[int, int]] = {}

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def free(self, column: int) -> int:
        """The next column that is free in this row."""
        now, i = len(self.rows) - 1, bisect_right(self.starts, column) - 1
        at = self.starts[i] if i >= 0 else column
        if at not in self.ranges or self.ranges[at][0] <= column or self.ranges[at][1] <= now:
            return column
        first, until = at, self.ranges[at][1]
        while (found := self.chains.get(at)) and found[1] > now or (found := self.ranges.get(at)) and found[1] > now:
            at, until = found[0], min(until, found[1])
        self.chains[first] = (at, until)
        return at

    def reserve(self, start: int, end: int, until: int) -> None:
        """Takes the columns up to a row; where ranges overlap the later row counts."""
        now, at, new = len(self.rows) - 1, start, []
        i = bisect_right(self.starts, start)
        if i and self.ranges[self.starts[i - 1]][0] > start:  # has ended, since start is free
            i -= 1
            if self.starts[i] < start:
                new.append((self.starts[i], start, self.ranges[self.starts[i]][1]))
        j = i
        while j < len(self.starts) and self.starts[j] < end:
            a = self.starts[j]
            b, row = self.ranges.pop(a)
            j += 1
            if row > now and b > at:
                new += [(at, a, until), (max(a, at), min(b, end), max(row, until)), (end, b, row)]
                at = b
        new.append((at, end, until))
        new = [x for x in new if x[0] < x[1]]
        self.starts[i:j] = [a for a, _, _ in new]
        for a, b, row in new:
            self.ranges[a] = (b, row)

    def cell(self, node: Node, text: str) -> None:
        if not self.rows:
            self.row()
        column = self.free(self.column)
        self.column = column + _span(node, "colspan", 1000)
        self.rows[-1].append((column, text.split("\n")))
        if (down := _span(node, "rowspan", 65534)) > 1:
            self.reserve(column, self.column, len(self.rows) - 1 + down)

    def lines(self) -> list[str]:
        """Rows padded to the widths of the columns that hold text."""
        width: dict[int, int] = {}
        for row in self.rows:
            for column, lines in row:
                if most := max(map(len, lines)):
                    width[column] = max(width.get(column, 0), most)
        place, at = {}, 0
        for column in sorted(width):
            place[column] = at
            at += width[column] + 2
        out = [x for c in self.captions for x in c.split("\n")]
        for row in self.rows:
            for y in range(max((len(lines) for _, lines in row), default=0)):
                line, size = [], 0
                for column, lines in row:
                    if y < len(lines) and lines[y]:
                        line += [" " * (place[column] - size), lines[y]]
                        size = place[column] + len(lines[y])
                out.append("".join(line).rstrip())
        return out


def render(root: Node) -> str:
    """Visible text of a tree. The stack holds (step, node, visible); tables and cells render into outputs of their own."""
    outs = [_Out()]
    lists: list[list] = []
    tables: list[_Grid | None] = []  # None: so deep that it is laid out as blocks
    pre = 0
    stack: list[tuple] = [("open", root, True)]
    while stack:
        step, node, seen = stack.pop()
        out = outs[-1]
        if step == "open":
            if isinstance(node, str):
                if not seen:
                    continue
                if pre:
                    first, *rest = node.split("\n")
                    out.line.append(first)
                    for x in rest:
                        out.end_line(True)
                        out.line.append(x)
                else:
                    out.text(node)
                continue
            if node.tag != "#root" and not displayed(node):
                continue
            tag, seen = node.tag, shown(node, seen)
            if tag == "br":
                out.end_line(True)
                continue
            if tag == "hr":
                out.block(1)
                continue
            if tag == "img":
                if seen and (alt := node.attributes.get("alt", "").strip()):
                    out.text(f" {alt} ")
                continue
            if tag == "input":
                if seen and node.attributes.get("type", "").lower() in ("submit", "button", "reset") and (v := node.attributes.get("value")):
                    out.text(f" {v} ")
                continue
            grid = tables[-1] if tables else None
            if tag in BLOCKS and not (tag == "tr" and grid):
                nested = tag in ("ul", "ol") and len(lists) > 0
                out.block(0 if nested else BLOCKS[tag])
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1").strip()
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,18}", start, re.A) else 1, out.prefix])
            elif tag == "li":
                kind = lists[-1] if lists else [False, 1, ""]
                out.prefix = "  " * min(max(len(lists) - 1, 0), DEEPEST) + (f"{kind[1]}. " if kind[0] else "- ")
                kind[1] += 1
            elif tag == "dd":
                lists.append([False, 1, out.prefix])
                out.prefix = " " * min(len(out.prefix) + 2, 2 * DEEPEST)
            elif tag == "table":
                tables.append(_Grid() if len(tables) < DEEPEST else None)
            elif tag == "tr" and grid:
                grid.row()
            elif tag in ("td", "th", "caption") and grid:
                outs.append(_Out())
            elif tag in ("td", "th"):
                out.text(" ")
            elif tag == "pre":
                pre += 1
            stack.append(("close", node, seen))
            stack.extend(("open", c, seen) for c in reversed(node.children))
            continue
        tag = node.tag
        grid = tables[-1] if tables else None
        if tag in ("td", "th", "caption") and grid:
            out.end_line()
            outs.pop()
            text = "\n".join(out.lines)
            if tag == "caption":
                grid.captions.append(text)
            else:
                grid.cell(node, text)
        elif tag == "table":
            out.end_line()  # text of the table outside its cells stands before it
            if tables.pop():
                for line in grid.lines():
                    out.line.append(line)
                    out.end_line(True)
            out.block(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.end_line()
            out.prefix = lists.pop()[2]
            out.block(0 if lists else 1)
        elif tag == "dd":
            out.end_line()
            out.prefix = lists.pop()[2] if lists else ""
        elif tag == "li":
            if out.prefix.strip() and not out.line:
                out.prefix = ""
            out.end_line()
            out.prefix = lists[-1][2] if lists else ""
        elif tag in BLOCKS and not (tag == "tr" and grid):
            if tag == "pre":
                pre = max(pre - 1, 0)
            out.block(BLOCKS[tag])
    while len(outs) > 1:
        outs[-1].end_line()
        outs[-2].lines += outs.pop().lines
    outs[0].end_line()
    return "\n".join(x.rstrip() for x in outs[0].lines).strip("\n")


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """page_id, text, and the numbers of its lines and characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(1)]
            out = [batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["page_id", "text", "n_lines", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", f"`{source}`").mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
