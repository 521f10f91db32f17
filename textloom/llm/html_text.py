"""Visible text of web pages: tree building with implied tags, then layout.

The builder turns markup into well-formed open, text and close events (end tags
that HTML leaves out are implied, stray ones dropped); the renderer follows
them with a stack of flows, one for the page and one for each open table cell.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.common import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist map meta link base annotation annotation-xml desc defs metadata".split())
#: Blocks, and the blank lines that their margins leave.
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure menu hr".split(), 1)
BLOCK = MARGIN | dict.fromkeys("address article aside body center caption dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav search section summary tbody td tfoot th thead tr optgroup option text".split(), 0)
CLOSES_P = frozenset(BLOCK) - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend li dd dt".split()) | {"li", "dd", "dt"}
#: What an opening tag ends, and what shields an outer element from that.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",))),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)), "body": (("head",), ()),
}
PARTS = frozenset("caption tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("head base link meta noscript script style template title html".split())
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
LONG_REFERENCE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Cells wider than this are not padded to; bounds of colspan, rowspan and of the columns that a rowspan keeps free.
WIDEST, MOST_COLUMNS, MOST_ROWS, KEPT_FREE = 80, 200, 65_534, 200
#: Blanks that align a table, as a multiple of its text and besides; a table that takes more is not aligned.
PADDING, PADDING_FREE = 8, 1 << 16
#: Tables within tables; parts of deeper ones are plain blocks.
NESTED = 64


def unescaped(text: str) -> str:
    """Character references resolved; numbers that are no character, however long, are U+FFFD."""
    return html.unescape(LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def tokens(markup: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, closing) of each tag, comments and the like with an empty name, in one pass.

    Send the place to go on from after an element whose content is no markup.
    A quote without a partner is a character like any other; a tag or comment
    that never ends takes the rest of the page.
    """
    n, at = len(markup), 0
    last = {q: markup.rfind(q) for q in "\"'"}
    while (start := markup.find("<", at)) >= 0:
        m = NAME.match(markup, start + 1)
        if m:
            at = m.end()
            while (stop := STOP.search(markup, at)) and stop[0] != ">":
                at = stop.end() if stop.start() == last[stop[0]] else markup.find(stop[0], stop.end()) + 1
            at = stop.end() if stop else n
            token = (start, at, m[1].lower(), markup[m.end() : at - 1], m[0][0] == "/") if stop else (start, n, "", "", False)
        elif markup.startswith(("!", "?", "/"), start + 1):
            comment = markup.startswith("!--", start + 1)
            end = markup.find("-->" if comment else ">", start + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            token = (start, at, "", "", False)
        else:
            at = start + 1
            continue
        at = (yield token) or at


def events(markup: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """('open', tag, attributes), ('text', text, {}) and ('close', tag, {}), well nested."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where on the stack each tag stands

    def close_to(depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(stack) > depth:
            tag = stack.pop()
            places[tag].pop()
            yield "close", tag, {}

    def depth_of(tags: tuple[str, ...], shields: tuple[str, ...], last: bool) -> int:
        """Stack depth of the outermost (last: innermost) of the tags inside the shields, or -1."""
        own = [at for t in tags if (at := places.get(t))]
        if not own:
            return -1
        shield = max((at[-1] for t in shields if (at := places.get(t))), default=-1)
        found = [at[-1] if last else at[bisect_right(at, shield)] for at in own if at[-1] > shield]
        return (max if last else min)(found, default=-1)

    lower_markup = None
    scan, pos, resume = tokens(markup), 0, None
    while True:
        try:
            start, end, tag, raw, closing = scan.send(resume)
        except StopIteration:
            break
        resume = None
        if start > pos:
            text = markup[pos:start]
            if places.get("head") and text.strip():
                yield from close_to(depth_of(("head",), (), True))
            yield "text", unescaped(text), {}
        pos = end
        if not tag:
            continue
        if closing:
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif places.get(tag):
                k = depth_of((tag,), ("table",) if tag not in ("table", "html", "body") else (), True)
                if k >= 0:
                    yield from close_to(k)
            continue
        if places.get("head") and tag not in IN_HEAD and not any(places.get(t) for t in ("template", "noscript")):
            yield from close_to(depth_of(("head",), (), True))
        if tag in CLOSES_P and places.get("p"):
            k = depth_of(("p",), ("td", "th", "table", "button", "caption"), True)
            if k >= 0:
                yield from close_to(k)
        if tag in ENDS:
            k = depth_of(*ENDS[tag], False)
            if k >= 0:
                yield from close_to(k)
        if tag == "select" and places.get("select"):
            yield from close_to(places["select"][-1])
        if tag[0] == "h" and len(tag) == 2 and stack and stack[-1][0] == "h" and len(stack[-1]) == 2 and tag != "hr":
            yield from close_to(len(stack) - 1)
        attrs = {k.lower(): unescaped(a or b or c) for k, a, b, c in ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}
        yield "open", tag, attrs
        if tag in VOID:
            yield "close", tag, {}
        elif tag in RAW:
            if lower_markup is None:
                lower_markup = markup.lower()
                lower_markup = lower_markup if len(lower_markup) == len(markup) else markup
            end = lower_markup.find("</" + tag, pos)
            end = len(markup) if end < 0 else end
            if end > pos:
                body = markup[pos:end]
                yield "text", unescaped(body) if tag in ("textarea", "title") else body, {}
            yield "close", tag, {}
            gt = markup.find(">", end)
            pos = resume = len(markup) if gt < 0 else gt + 1
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
    if pos < len(markup):
        yield "text", unescaped(markup[pos:]), {}
    yield from close_to(0)


class Flow:
    """Lines of one formatting context: collapsed blanks, collapsed margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a collapsed blank waits for text
        self.gap = 0  # blank lines that wait for text
        self.indent = ""
        self.mark = ""  # list marker that waits for text
        self.marked = False

    def text(self, text: str) -> None:
        words = BLANKS.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.blank, words = True, words[1:]
        if not words:
            return
        tail = words[-1] == " "
        if tail:
            words = words[:-1]
        self.line.append((" " if self.blank and self.line else "") + words)
        self.blank = tail

    def verbatim(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for x in more:
            self.end(keep=True)
            self.line.append(x)

    def end(self, keep: bool = False) -> None:
        if self.line or keep:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append((self.indent + self.mark + "".join(self.line)).rstrip())
            self.mark = ""
        self.line, self.blank = [], False

    def block(self, margin: int) -> None:
        self.end()
        self.gap = max(self.gap, margin)

    def put(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self.line = [x] if x else []
            self.end(keep=True)

    def result(self) -> list[str]:
        self.end()
        return self.lines


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "1")
    return max(1, min(most, int(value))) if value.isascii() and value.isdigit() and len(value) < 6 else 1


class Table:
    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.until: dict[int, int] = {}  # column: last row in which a cell from above still holds it
        self.column = 0

    def row(self) -> None:
        self.rows.append({})
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        row = len(self.rows) - 1
        while self.until.get(self.column, -1) >= row:
            self.column += 1
        self.rows[-1][self.column] = lines
        if down > 1:
            for c in range(self.column, min(self.column + across, KEPT_FREE)):
                self.until[c] = row + down - 1
        self.column += across

    def lines(self) -> list[str]:
        columns = sorted({c for r in self.rows for c, lines in r.items() if any(lines)})
        if len(columns) <= 1:
            return [x for r in self.rows for _, lines in sorted(r.items()) for x in lines]
        width = dict.fromkeys(columns, 0)
        for r in self.rows:
            for c in r.keys() & width.keys():
                width[c] = min(WIDEST, max(width[c], max(map(len, r[c]), default=0)))
        before = [0, *accumulate(width[c] + 2 for c in columns)]
        height = [max((len(x) for x in r.values()), default=0) for r in self.rows]
        ends = [bisect_right(columns, max(r, default=-1)) for r in self.rows]
        text = sum(len(x) for r in self.rows for lines in r.values() for x in lines)
        aligned = sum(h * before[e] for h, e in zip(height, ends, strict=True)) <= PADDING * text + PADDING_FREE
        out = []
        for r, h, e in zip(self.rows, height, ends, strict=True):
            if aligned:
                for k in range(h):
                    out.append("  ".join((r[c][k] if c in r and k < len(r[c]) else "").ljust(width[c]) for c in columns[:e]).rstrip())
            else:
                out += ["  ".join(x for _, lines in sorted(r.items()) for x in lines)] if h == 1 else [x for _, lines in sorted(r.items()) for x in lines]
        return out


def render(markup: str | None) -> str:
    """Visible text of one page; null and blank pages give the empty text.

    Blocks begin lines and keep their margins as one blank line, lists have
    markers and indents, cells of a table row stand side by side in aligned
    columns, pre keeps its blanks. Elements that are never shown, or carry
    hidden, display:none or visibility:hidden, are left out with all within.
    Of a select the options that a browser shows closed are text.

    Some layout has bounds, beyond which no text goes: columns are padded to
    WIDEST characters, colspan counts to MOST_COLUMNS and rowspan to MOST_ROWS
    in the first KEPT_FREE columns, a table whose blanks would exceed PADDING
    times its text has its cells one after another, and parts of tables that
    are nested more than NESTED deep are plain blocks.
    """
    if not markup:
        return ""
    flows, tables, lists = [Flow()], [], []
    cells: list[tuple[int, int]] = []
    selects: list[tuple[bool, list[tuple[bool, str]]]] = []  # whether all options show, and the options
    unseen = pre = deep = 0
    marks: list[tuple[str, bool]] = []  # one for each open element: what its end undoes
    for kind, what, attrs in events(markup):
        flow = flows[-1]
        if kind == "text":
            if not unseen:
                if pre:
                    flow.verbatim(what)
                else:
                    flow.text(what)
            continue
        if kind == "open":
            if unseen or what in HIDDEN or "hidden" in attrs or what == "input" and attrs.get("type", "").lower() == "hidden" or "style" in attrs and UNSEEN.search(attrs["style"]):
                unseen += 1
                marks.append(("", True))
                continue
            undo = ""
            if what == "br":
                flow.end(keep=True)
            elif what in PARTS and (not tables or len(tables) == NESTED and deep):
                if tables:
                    flow.block(0)
                undo = "inline"  # table parts outside of a table are nothing
            elif what in ("td", "th"):
                if not tables[-1].rows:
                    tables[-1].row()
                cells.append((_span(attrs, "colspan", MOST_COLUMNS), _span(attrs, "rowspan", MOST_ROWS)))
                flows.append(Flow())
                undo = "cell"
            elif what == "table" and len(tables) == NESTED:
                flow.block(1)
                deep += 1
                undo = "deep"
            elif what == "table":
                flow.block(1)
                tables.append(Table())
                undo = "table"
            elif what == "tr":
                tables[-1].row()
            elif what == "select":
                selects.append(("multiple" in attrs or attrs.get("size", "1") not in ("", "0", "1"), []))
                undo = "select"
            elif what == "option" and selects:
                selects[-1][1].append(("selected" in attrs, ""))
                flows.append(Flow())
                undo = "option"
            elif what in BLOCK:
                flow.block(MARGIN.get(what, 0) if not (lists and what in ("ul", "ol", "menu")) else 0)
                if what in ("ul", "ol", "menu"):
                    start = attrs.get("start", "1")
                    lists.append([what, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, flow])
                    undo = "list"
                elif what == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
                    flow.indent, flow.mark = "  " * (min(len(lists), 20) - 1) if lists else "", mark
                    undo = "item"
                elif what in ("dd", "blockquote"):
                    flow.indent += "  " if len(flow.indent) < 40 else ""
                    undo = "indent"
                elif what == "pre":
                    pre += 1
                    undo = "pre"
                elif what == "hr":
                    flow.line.append("---")
            marks.append((undo, False))
            continue
        undo, was_unseen = marks.pop()
        if was_unseen:
            unseen -= 1
            continue
        if undo == "cell":
            lines = flows.pop().result()
            across, down = cells.pop()
            tables[-1].cell(lines, across, down)
        elif undo == "option":
            selects[-1][1][-1] = (selects[-1][1][-1][0], " ".join(flows.pop().result()))
        elif undo == "select":
            every, options = selects.pop()
            chosen = options if every else [o for o in options if o[0]][-1:] or options[:1]
            for _, x in chosen:
                flow.text(f" {x} ")
        elif undo == "deep":
            flow.block(1)
            deep -= 1
        elif undo == "table":
            flows[-1].put(tables.pop().lines())
            flows[-1].block(1)
        elif what in BLOCK and what != "tr" and undo != "inline":
            flow.block(MARGIN.get(what, 0) if undo != "list" or len(lists) == 1 else 0)
            if undo == "list":
                lists.pop()
            elif undo == "item":
                flow.mark, flow.indent = "", "  " * (min(len(lists), 20) - 1) if lists else ""
            elif undo == "indent":
                flow.indent = flow.indent[:-2]
            elif undo == "pre":
                pre -= 1
    return "\n".join(flows[0].result()).strip("\n")


@F.pandas_udf(StringType())
def _rendered(markup: pd.Series) -> pd.Series:
    return pd.Series([render(x) for x in markup], dtype=object)


def visible_text(markup: Column) -> Column:
    """Column of rendered pages."""
    return _rendered(markup)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars, n_lines of every page, in one narrow pass.

    Null and empty pages have the empty text and 0 lines; repeated rows and
    null ids give a result each; broken markup is rendered as far as it goes.
    Other columns are ignored. An empty table gives an empty table.
    """
    bound_batches(pages.sparkSession)
    out = pages.select(pages[id_col].alias(id_col), visible_text(pages[html_col]).alias("text"))
    return out.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")})
