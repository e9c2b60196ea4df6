"""HTML extraction: a tree builder with implied tags and a layout-aware renderer of all visible text.

The builder knows void and raw-text elements, the end tags that HTML lets authors omit, the boundary of head and
body, and misnested end tags. The renderer applies visibility (elements that are never shown, `hidden`, inline
`display:none`, `visibility:hidden` with its inherited override, closed `details` and `dialog`), collapses white
space as browsers do, separates blocks by line breaks and paragraphs by an empty line, marks and indents list
items, keeps preformatted text, and aligns the cells of each table in columns, colspan and rowspan included.
Visibility is inherited by tables, row groups, rows and cells; `collapse` counts as `hidden`.

Defined cases: null html gives an empty text; markup that is cut off or never closed is closed at the end; text
without markup is rendered as one block; tables nested deeper than MAX_TABLES and columns wider than MAX_PAD
lose their alignment, never their text. Each page is one row and one task's work: no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.common import sub_batches

MAX_TABLES, MAX_PAD, MAX_GAP, MAX_ROWS = 20, 60, 10_000, 65_534

# Fixed values of the HTML standard: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
NEVER_SHOWN = frozenset("area audio base canvas col colgroup datalist embed frameset head iframe link meta noembed noframes noscript object param rp script source style template title track video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html body caption tr thead tbody tfoot legend optgroup option td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
#: An opening tag -> the open elements that it ends, and the elements that shield those above them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        if value[:1] in "\"'" and value:
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        found.setdefault(name.lower(), unescape(value))
    return found


class TreeBuilder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of open elements: what is not open needs no search

    def _cut(self, at: int) -> None:
        self.count.subtract(n.tag for n in self.open[at:])
        del self.open[at:]

    def _add(self, node: Node | str) -> None:
        self.open[-1].kids.append(node)

    def _leave_head(self) -> None:
        if self.count["head"]:
            self._cut(next(at for at, n in enumerate(self.open) if n.tag == "head"))

    def _end(self, tags: set[str], shields: set[str]) -> None:
        """Close the outermost open element of `tags` that no shield protects."""
        if not any(self.count[t] for t in tags):
            return
        at, found = len(self.open) - 1, None
        while at > 0 and self.open[at].tag not in shields:
            if self.open[at].tag in tags:
                found = at
            at -= 1
        if found:
            self._cut(found)

    def text(self, data: str) -> None:
        if not data:
            return
        if self.open[-1].tag == "head":
            if not data.strip(" \t\n\f\r"):
                return
            self._leave_head()
        self._add(data)

    def start(self, tag: str, attrs: dict[str, str]) -> Node | None:
        if tag in ("html", "body"):
            self._leave_head()
            return None
        if tag not in HEAD_ONLY and tag != "head":
            self._leave_head()
        if tag in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        parent = self.open[-1].tag
        if tag in ("td", "th") and parent in ("table", "thead", "tbody", "tfoot"):  # an implied row
            self._open(Node("tr"))
        node = Node(tag, attrs)
        if tag in VOID:
            self._add(node)
        else:
            self._open(node)
        return node

    def _open(self, node: Node) -> None:
        self._add(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self._add(Node("br"))
            return
        if tag in ("html", "body") or not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            here = self.open[at].tag
            if here == tag:
                self._cut(at)
                return
            if here in ("td", "th", "caption", "table") and tag not in TABLE_PARTS:
                return  # an end tag does not reach out of its cell


def build(html: str) -> Node:
    tree, at = TreeBuilder(), 0
    while m := TOKEN.search(html, at):
        tree.text(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        node = tree.start(tag, _attributes(m[3]) if m[3] and not m[3].isspace() else {})
        if tag in RAW and node is not None:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            stop = close.start() if close else len(html)
            inner = html[at:stop]
            node.kids.append(unescape(inner) if tag in ("textarea", "title") else inner)
            tree._cut(len(tree.open) - 1)
            at = close.end() if close else len(html)
    tree.text(unescape(html[at:]))
    return tree.root


def _style(node: Node) -> dict[str, str]:
    """The declarations of the style attribute; the last of a property counts, an important one before all others."""
    plain, important = {}, {}
    for part in node.attrs.get("style", "").split(";"):
        name, _, value = part.partition(":")
        value, mark, rest = value.strip().lower().rpartition("!")
        urgent = mark and rest.strip() == "important"
        (important if urgent else plain)[name.strip().lower()] = value.strip() if urgent else f"{value}{mark}{rest}"
    return plain | important


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Writer:
    """Lines of text with collapsed white space and collapsed margins."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = ""
        self.marker = ""

    def put(self, text: str) -> None:
        parts = SPACES.sub(" ", text)
        if parts[:1] == " ":
            self.space, parts = True, parts[1:]
        trailing = parts[-1:] == " "
        parts = parts.rstrip(" ")
        if parts:
            if self.now:
                self.now.append(" " + parts if self.space else parts)
            else:
                self._open_line()
                self.now.append(parts)
            self.space = trailing
        elif trailing:
            self.space = True

    def _open_line(self) -> None:
        if self.lines and self.margin > 1 and self.lines[-1] != "":
            self.lines.append("")
        self.margin = 0
        if self.marker:
            self.now.append(self.marker)
            self.marker = ""
        else:
            self.now.append(self.indent)

    def line_break(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line_break()
        self.margin = max(self.margin, 2 if spaced else 1)

    def br(self) -> None:
        if self.now:
            self.line_break()
        else:
            self.lines.append("")

    def verbatim(self, lines: list[str]) -> None:
        self.line_break()
        for line in lines:
            self._open_line()
            self.now.append(line)
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []

    def result(self) -> list[str]:
        self.line_break()
        full = [i for i, line in enumerate(self.lines) if line]
        return self.lines[full[0] : full[-1] + 1] if full else []


def render(root: Node, depth: int = 0, visible: bool = True) -> list[str]:
    """Lines of the visible text of a tree, by a walk with its own stack; `visible` is what the root inherits."""
    out = Writer()
    stack: list[tuple] = [("enter", root, visible, False, 0)]
    counters: list[list[int]] = []
    while stack:
        step, node, visible, pre, level = stack.pop()
        if step == "do":
            node()
            continue
        if isinstance(node, str):
            if visible:
                if pre:
                    first, *rest = node.split("\n")
                    if first:
                        _put_pre(out, first)
                    for line in rest:
                        out.br()
                        if line:
                            _put_pre(out, line)
                else:
                    out.put(node)
            continue
        tag, style = node.tag, _style(node)
        if node is not root or tag == "html":
            if tag in NEVER_SHOWN or "hidden" in node.attrs or style.get("display") == "none" or (tag == "dialog" and "open" not in node.attrs):
                continue
            if tag == "input":
                if visible and node.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel"):
                    out.put(node.attrs.get("value", ""))
                continue
            if "visibility" in style:
                visible = style["visibility"] not in ("hidden", "collapse")
            if "white-space" in style:
                pre = style["white-space"].startswith("pre")
        if tag == "br":
            if visible:
                out.br()
            continue
        if tag == "table" and depth < MAX_TABLES and node is not root:
            lines = _table(node, depth + 1, visible)
            if visible or lines:
                out.block(True)
                out.verbatim(lines)
                out.block(True)
            continue
        block = (tag in BLOCK and "inline" not in style.get("display", "")) or style.get("display") in ("block", "flex", "grid", "list-item")
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and level)
        if tag == "pre" or tag == "textarea" or tag == "xmp":
            pre = True
        after: list = []
        if block:
            out.block(spaced)
            after.append(lambda s=spaced: out.block(s))
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1")
            items = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
            back = tag == "ol" and "reversed" in node.attrs
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) and "start" in node.attrs else items if back else 1
            counters.append([first, (-1 if back else 1) if tag == "ol" else 0])
            after.append(counters.pop)
            level += 1
        elif tag == "li":
            number = counters[-1] if counters else [1, 0]
            if number[1]:
                value = node.attrs.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    number[0] = int(value)
                mark = f"{number[0]}. "
                number[0] += number[1]
            else:
                mark = "- "
            was = out.indent
            out.marker, out.indent = was + mark, was + " " * len(mark)
            after.append(lambda was=was: (setattr(out, "indent", was), setattr(out, "marker", "")))
        elif tag in ("dd", "blockquote"):
            was = out.indent
            out.indent = was + "  "
            after.append(lambda was=was: setattr(out, "indent", was))
        elif tag in ("td", "th"):
            after.append(lambda: out.put(" "))
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag in ("pre", "textarea") and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        for f in after:  # popped in reverse: the last pushed runs first
            stack.append(("do", f, None, None, None))
        stack.extend(("enter", k, visible, pre, level) for k in reversed(kids))
    return out.result()


def _put_pre(out: Writer, text: str) -> None:
    if not out.now:
        out._open_line()
    out.now.append(text.replace("\t", "    "))
    out.space = False


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1")
    return min(1000, max(1, int(value.lstrip("0")[:5] or 0))) if value.isascii() and value.isdigit() else 1


def _rows_of(node: Node) -> int:
    """Rows that a cell takes; 0 means to the end of its row group."""
    value = node.attrs.get("rowspan", "1")
    return min(MAX_ROWS, int(value) or MAX_ROWS) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _shown(node: Node, visible: bool) -> bool:
    own = _style(node).get("visibility")
    return visible if own is None else own not in ("hidden", "collapse")


def _table(table: Node, depth: int, visible: bool) -> list[str]:
    """Caption and rows with aligned columns; a cell with several lines takes several lines of its row. Columns that a
    cell above spans stay free, within its row group. Hidden cells keep their column."""
    above, rows = [], []
    taken: dict[int, tuple[int, int]] = {}  # column -> first row that is free again, first column behind the cell
    group = None
    stack = [(k, table, visible) for k in reversed(table.kids)]
    while stack:
        k, parent, seen = stack.pop()
        if isinstance(k, str):
            if k.strip():
                above += render(_wrap(k), depth, seen)
        elif _gone(k):
            continue
        elif k.tag in ("thead", "tbody", "tfoot"):
            seen = _shown(k, seen)
            stack.extend((kid, k, seen) for kid in reversed(k.kids))
        elif k.tag == "tr":
            if parent is not group:
                group = parent
                taken.clear()
            seen, row, at = _shown(k, seen), [], 0
            for cell in k.kids:
                if isinstance(cell, str):
                    if not cell.strip():
                        continue
                    lines, span, down = render(_wrap(cell), depth, seen), 1, 1
                elif _gone(cell):
                    continue
                else:
                    lines = render(_wrap(*cell.kids) if cell.tag in ("td", "th") and not cell.attrs else _wrap(cell), depth, seen)
                    span, down = _span(cell, "colspan"), _rows_of(cell)
                while at in taken and taken[at][0] > len(rows):
                    at = taken[at][1]
                row.append((at, lines, span))
                if down > 1:
                    for c in range(at, at + span):
                        taken[c] = (len(rows) + down, at + span)
                at += span
            rows.append(row)
        else:
            above += render(_wrap(k), depth, seen)
    widths: dict[int, int] = {}
    for row in rows:
        for at, lines, span in row:
            if span == 1:
                w = max(map(_width, lines), default=0)
                if w <= MAX_PAD:
                    widths[at] = max(widths.get(at, 0), w)
    out = list(above)
    for row in rows:
        for n in range(max((len(lines) for _, lines, _ in row), default=0)):
            end, line = 0, ""
            for i, (at, lines, span) in enumerate(row):
                if at > end:
                    line += " " * min(MAX_GAP, sum(widths.get(c, 0) for c in range(end, at)) + 2 * (at - end))
                text = lines[n] if n < len(lines) else ""
                room = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                line += text + (" " * (max(0, room - _width(text)) + 2) if i + 1 < len(row) else "")
                end = at + span
            out.append(line.rstrip(" "))
    return out


def _gone(node: Node) -> bool:
    return node.tag in NEVER_SHOWN or "hidden" in node.attrs or _style(node).get("display") == "none"


def _wrap(*kids: Node | str) -> Node:
    box = Node("body")
    box.kids = list(kids)
    return box


def html_to_text(html: str | None) -> str:
    return "\n".join(render(build(html))) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""

    def run(batches):
        for whole in batches:
            for part in sub_batches(whole):
                texts = [html_to_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
