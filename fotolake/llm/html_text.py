"""Visible text of HTML, laid out: a tree builder with implied tags, visibility rules, and a renderer of blocks.

Builder: tags, comments, raw-text elements and entities are read as the HTML standard has it in the common cases. Elements
that may be left open are closed by what follows (paragraphs, list items, definition terms, options, table parts, head);
cells outside a row and rows outside a body get their parents; end tags close up to their element within its scope, and the
misnested ends of formatting elements close only those.

Visibility: head, script, style, template and other elements without a box are left out (of SVG and MathML: titles,
descriptions, definitions and annotations), and so are elements with
`hidden` or `display: none`, closed details but for their summary, closed dialogs, and texts under `visibility: hidden` unless a
descendant is made visible again. Scripts are not run and objects not loaded, so `noscript` and what stands in for an object are
seen. Rules of style sheets are not applied, only `style` attributes.

Layout: white space collapses except in preformatted text and textareas; options and labels of
SVG are lines; blocks start lines, and paragraphs, headings, lists, tables
and the like are set off by one blank line; list items get `-` or their number and are indented by depth, to INDENTS levels (deeper ones keep that indent, and all of their text); table cells are
padded to their columns' widths and joined by ` | `, with column and row spans, and nested tables laid out in their cells.

Buttons show their text, `input` buttons their value.

Nulls: null or empty html gives an empty text, very long pages are read whole, an empty table gives an empty result; other columns than the id are not read; ids may be null or repeat. Nesting
may be of any depth: nothing recurses.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, texts

#: Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe audio video canvas datalist area defs desc metadata symbol clippath lineargradient radialgradient annotation annotation-xml".split())
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
FORMAT = frozenset("a b big code em font i nobr s small span strike strong tt u mark sub sup abbr cite q label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an end tag or an implied end does not reach beyond.
SCOPE = frozenset("html table td th caption template object button".split())
#: A start tag ends open elements of the first set, up to one of the second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | SCOPE),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset("select datalist".split()) | SCOPE),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"]) | SCOPE),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), frozenset(["table"])),
    "a": (frozenset(["a"]), SCOPE),
    "button": (frozenset(["button"]), SCOPE),
}
#: Blank lines around blocks: 1 for those set off, 0 for those that only start a line.
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure hr fieldset ul ol menu dir".split(), 1) | dict.fromkeys("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav option optgroup search select text textarea section summary tr caption".split(), 0)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Levels of lists and quotations that are indented.
INDENTS = 40
GONE, SEEN = re.compile(r"display\s*:\s*none", re.I), re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Flow:
    """Lines of one box: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indents, self.marker, self.space = 0, [], "", False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").expandtabs().split("\n")
            self.line.append(first)
            for x in rest:
                self.end(True)
                self.line.append(x)
            self.space = False
            return
        s = SPACE.sub(" ", s)
        if s[0] == " " and (not self.line or self.space):
            s = s[1:]
        if s:
            self.line.append(s)
            self.space = s[-1] == " "

    def end(self, keep: bool = False) -> None:
        """Ends the line; an empty one counts only if `keep`."""
        line = "".join(self.line).replace("\xa0", " ").rstrip()
        self.line, self.space = [], False
        if not (line or keep):
            return
        lead = "".join(self.indents[:INDENTS])
        if line and self.marker:
            lead, self.marker = lead[: max(0, len(lead) - len(self.marker))] + self.marker, ""
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        self.lines.append((lead + line) if line else "")

    def block(self, margin: int) -> None:
        self.end()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Rows of (lines, columns spanned, rows spanned)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        placed, taken, wide = [], {}, []
        for row in self.rows:
            at, cells = 0, []
            busy = dict(taken)
            taken = {c: n - 1 for c, n in busy.items() if n > 1}
            for lines, across, down in row:
                while at in busy:
                    at += 1
                cells.append((at, across, lines))
                if down > 1:
                    taken.update(dict.fromkeys(range(at, at + across), down - 1))
                at += across
            placed.append(cells)
            wide += [0] * (max([at, *(c + 1 for c in busy)]) - len(wide))
            for start, across, lines in cells:
                if across == 1:
                    wide[start] = max([wide[start], *map(len, lines)])
        for cells in placed:
            for start, across, lines in cells:
                have = sum(wide[start : start + across]) + 3 * (across - 1)
                wide[start + across - 1] += max(0, max([0, *map(len, lines)]) - have)
        out = []
        for cells in placed:
            if not any(lines for _, _, lines in cells):
                continue
            for i in range(max(len(lines) for _, _, lines in cells)):
                parts, at = [], 0
                for start, across, lines in cells:
                    parts += [" " * w for w in wide[at:start]]
                    width = sum(wide[start : start + across]) + 3 * (across - 1)
                    parts.append((lines[i] if i < len(lines) else "").ljust(width))
                    at = start + across
                out.append(" | ".join(parts).rstrip())
        return out


class Page:
    """Builds the tree as its open elements and renders them as they come."""

    def __init__(self) -> None:
        self.open: list[tuple | None] = []  # (tag, shown, visible, pre, payload); None where one was closed amid others
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.flows, self.tables, self.head_over = [Flow()], [], False

    def shown(self) -> bool:
        return not self.open or self.open[-1][1]

    def last(self, tags: frozenset[str] | set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def find(self, tags: frozenset[str] | set[str], scope: frozenset[str]) -> int:
        """The place of the innermost open element of `tags`, -1 if there is none or one of `scope` lies within it."""
        i = self.last(tags)
        return i if i >= 0 and i >= self.last(scope) else -1

    def push(self, element: tuple) -> None:
        self.places.setdefault(element[0], []).append(len(self.open))
        self.open.append(element)

    def close_to(self, i: int) -> None:
        while len(self.open) > i:
            element = self.open.pop()
            if element:
                self.places[element[0]].pop()
                self.leave(element)
        while self.open and not self.open[-1]:
            self.open.pop()

    def close_amid(self, i: int) -> None:
        """Closes the innermost element of its tag, but not those within it."""
        element, self.open[i] = self.open[i], None
        self.places[element[0]].pop()
        self.leave(element)
        self.close_to(len(self.open))

    def leave(self, element: tuple) -> None:
        tag, shown, _, _, payload = element
        if not shown:
            return
        flow = self.flows[-1]
        if tag in ("td", "th"):
            if payload:
                self.flows.pop()
                self.tables[-1].rows[-1].append((flow.done(), *payload))
            return
        if tag == "table":
            flow.end()
            table = self.tables.pop()
            rows = table.lines()
            if rows:
                flow.gap = max(flow.gap, 1)
            for x in rows:
                flow.line.append(x)
                flow.end()
            flow.block(1)
            return
        if tag in MARGIN:
            flow.block(self.margin(tag))
        if tag in ("li", "dd", "blockquote"):
            flow.indents.pop()
            flow.marker = ""
        if tag == "q":
            flow.text('"', False)

    def margin(self, tag: str) -> int:
        if tag in ("ul", "ol", "menu", "dir"):
            return 0 if self.places.get("li") else 1
        return MARGIN[tag]

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "body" or (tag == "head" and self.head_over):
                self.end_head()
                if tag == "head":
                    return
            if self.places.get(tag):
                return
        elif tag not in IN_HEAD:
            self.end_head()
        if tag in ENDS_P and (i := self.find({"p"}, SCOPE)) >= 0:
            self.close_to(i)
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.close_to(len(self.open) - 1)
        if tag in IMPLIED:
            tags, scope = IMPLIED[tag]
            while (i := self.find(tags, scope)) >= 0:
                self.close_to(i)
        if tag in ("td", "th", "tr") and self.tables:
            if tag != "tr" and self.last({"tr"}) < self.last({"table"}):
                self.start("tr", "")
        got = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        style = got.get("style", "")
        _, shown, visible, pre, _ = self.open[-1] if self.open else ("", True, True, False, None)
        shown = shown and tag not in UNSEEN and "hidden" not in got and not GONE.search(style)
        if shown and tag != "summary" and self.open and self.open[-1][0] == "details" and not self.open[-1][4]:
            shown = False
        if m := SEEN.search(style):
            visible = m[1].lower() == "visible"
        if tag == "dialog" and "open" not in got:
            shown = False
        pre = pre or tag in ("pre", "listing", "xmp", "textarea") or "white-space:pre" in style.replace(" ", "").lower()
        payload = None
        flow = self.flows[-1]
        if shown:
            if tag == "br":
                flow.end(True) if flow.line else flow.end(bool(flow.lines))
            elif tag in MARGIN:
                flow.block(self.margin(tag))
            if tag == "table":
                self.tables.append(Table())
            elif tag == "tr" and self.tables:
                self.tables[-1].rows.append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1].rows:
                number = lambda k: int(got[k]) if re.fullmatch(r"[1-9]\d{0,2}", got.get(k, "")) else 1
                payload = (number("colspan"), number("rowspan"))
                self.flows.append(Flow())
            elif tag in ("ol", "ul", "menu", "dir"):
                start = got.get("start", "1")
                payload = [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else []
            elif tag == "li":
                i = self.find({"ol", "ul", "menu", "dir"}, SCOPE)
                count = self.open[i][4] if i >= 0 else []
                if count:
                    if re.fullmatch(r"-?\d{1,9}", got.get("value", "")):
                        count[0] = int(got["value"])
                    mark = f"{count[0]}. "
                    count[0] += 1
                else:
                    mark = "- "
                flow.indents.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag == "details":
                payload = "open" in got
            elif tag == "q":
                flow.text('"', False)
            elif tag == "input" and visible and got.get("type", "").lower() in ("submit", "button", "reset") and got.get("value"):
                flow.text(got["value"], False)
        closed = attributes.endswith("/") and bool(self.places.get("svg") or self.places.get("math"))
        if tag not in VOID and not closed:
            self.push((tag, shown, visible, pre, payload))

    def end_head(self) -> None:
        if not self.head_over:
            self.head_over = True
            if (i := self.find({"head"}, frozenset())) >= 0:
                self.close_to(i)

    def end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.start("br", "")
            return
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            scope = frozenset(["table"])
        else:
            scope = frozenset() if tag in ("table", "template", "object", "button") else SCOPE
        tags = HEADINGS if tag in HEADINGS else {tag}
        i = self.find(tags, scope)
        if i < 0:
            if tag == "p" and self.shown():
                self.flows[-1].block(1)
            return
        if tag in FORMAT:
            self.close_amid(i)
        else:
            self.close_to(i)

    def text(self, s: str) -> None:
        if not s:
            return
        if not self.head_over and not s.isspace() and (not self.open or self.open[-1][0] in ("html", "head")):
            self.end_head()
        if not self.open:
            self.flows[-1].text(s, False)
            return
        tag, shown, visible, pre, _ = self.open[-1]
        if shown and visible and not (tag == "details" and not self.open[-1][4]):
            if tag in ("pre", "textarea") and s[:1] == "\n" and not self.flows[-1].line:
                s = s[1:]
            if s:
                self.flows[-1].text(s, pre)


def render(source: str) -> str:
    """The visible text of an HTML document."""
    page, at, low = Page(), 0, None
    for m in iter(lambda: TAG.search(source, at), None):
        if m.start() > at:
            page.text(html.unescape(source[at : m.start()]) if "&" in source[at : m.start()] else source[at : m.start()])
        at = m.end()
        if m[1]:
            page.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            page.start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                low = low or source.lower()
                if len(low) != len(source):  # a letter whose lower case is longer
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in source)
                stop = low.find(f"</{tag}", at)
                stop = len(source) if stop < 0 else stop
                page.text(source[at:stop] if tag in ("xmp", "script", "style") else html.unescape(source[at:stop]))
                at = stop
    page.text(html.unescape(source[at:]))
    page.close_to(0)
    return "\n".join(page.flows[0].done())


def _render(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, pages in texts(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(map(render, pages), pa.string())], ["id", "text"])


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = pages.select(col(id_col).alias("id"), col(html_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    return src.mapInArrow(functools.partial(_render, kind=to_arrow_type(kind)), schema).select(F.col("id").alias(id_col), "text")
