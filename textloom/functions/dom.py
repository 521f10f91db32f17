"""A page as a tree, paths of selectors over it, and the text block that carries most of it.

The tree is a list of nodes in document order, so that what lies in a node is
the stretch that follows it. CSS selectors and XPath both become steps: an
axis, a tag, tests on attributes and on places among siblings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without content, elements whose text is none, and elements that end a line. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript head title".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br".split())
#: An open element that the start of another closes, up to the element that shields it. Fixed values of HTML.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "body", "dd", "dt", "li"}


@dataclass(slots=True)
class Node:
    """tag "" is text; end: the place after its last descendant; place: among the elements of its parent; elements: how many it has."""

    tag: str
    parent: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    end: int = 0
    children: list[int] = field(default_factory=list)
    place: int = 0
    elements: int = 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.nodes = [Node("#root", -1)]
        self.open = [0]

    def add(self, node: Node) -> int:
        self.nodes.append(node)
        if node.tag:
            above = self.nodes[node.parent]
            above.elements += 1
            node.place = above.elements
        self.nodes[node.parent].children.append(len(self.nodes) - 1)
        return len(self.nodes) - 1

    def close(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.nodes[i].end = len(self.nodes)
        del self.open[depth:]

    def close_open(self, tags: set[str] | frozenset[str], shields: set[str]) -> None:
        last = None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in shields:
                break
            if tag in tags:
                last = depth
        if last is not None:
            self.close(last)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        elif tag in ENDS_PARAGRAPH:
            self.close_open({"p"}, {"table", "button", "object"})
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        i = self.add(Node(tag, self.open[-1], named))
        if tag in VOID:
            self.nodes[i].end = len(self.nodes)
        else:
            self.open.append(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the stroke means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                self.close(depth)
                break

    def handle_data(self, data: str) -> None:
        i = self.add(Node("", self.open[-1], text=data))
        self.nodes[i].end = len(self.nodes)


def tree(html: str | None) -> list[Node]:
    """Nodes of a page in document order, the root first; whatever is broken is closed somewhere."""
    builder = _Builder()
    builder.feed(html or "")
    HTMLParser.close(builder)
    _Builder.close(builder, 0)
    return builder.nodes


def content(nodes: list[Node], at: int) -> str:
    """All text in a node, as it stands."""
    return "".join(n.text for n in nodes[at : nodes[at].end] if n.tag == "")


def readable(nodes: list[Node], at: int, skip: frozenset[int] = frozenset()) -> str:
    """Text in a node without scripts and the like, blocks apart, blanks collapsed; skip: nodes that are left out whole."""
    parts, i, end = [], at, nodes[at].end
    while i < end:
        node = nodes[i]
        if i in skip or (node.tag in SILENT and i != at):
            i = node.end
            parts.append(" ")
            continue
        if node.tag == "":
            parts.append(node.text)
        elif node.tag in BLOCKS:
            parts.append(" ")
        if node.end == i + 1 or i + 1 == end or nodes[i + 1].parent != i:
            above = node.parent
            while above > at and nodes[above].end == i + 1:
                if nodes[above].tag in BLOCKS:
                    parts.append(" ")
                above = nodes[above].parent
        i += 1
    return " ".join("".join(parts).split())


# selectors ---------------------------------------------------------------------------------


@dataclass(slots=True)
class Step:
    """axis: child, inside (any depth), next, after (siblings). tests: (attribute, relation, value). nth: among the siblings that a step finds (XPath) or among all (CSS), negative from the end."""

    axis: str
    tag: str = "*"
    tests: list[tuple[str, str, str]] = field(default_factory=list)
    nth: list[tuple[str, int]] = field(default_factory=list)


@dataclass(slots=True)
class Path:
    """Steps from the root, and what is taken of the nodes: their text, "@name" or "text()"."""

    steps: list[Step]
    take: str = ""


_CSS_PART = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<rel>[~^$*|]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<bare>[\w-]+)))?\s*\]|:(?P<first>first-child)|:(?P<last>last-child)|:nth-child\(\s*(?P<nth>\d+)\s*\)""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_XPATH_STEP = re.compile(r"(?P<axis>//?)(?:@(?P<attr>[\w:-]+)|(?P<text>text\(\))|(?P<tag>\*|[a-zA-Z][\w-]*))")
_XPATH_TEST = re.compile(r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|@(?P<attr>[\w:-]+)\s*(?:=\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'))?|(?P<fn>contains|starts-with)\(\s*@(?P<on>[\w:-]+)\s*,\s*(?:"(?P<fq>[^"]*)"|'(?P<fa>[^']*)')\s*\))\s*\]""")
_AXES = {">": "child", "+": "next", "~": "after", None: "inside"}


def css(selector: str) -> list[Path]:
    """Paths of a selector, one for each part between commas; ValueError for what is not understood."""
    paths = []
    for part in re.split(r",(?![^\[]*\])", selector):
        text, at, steps = part.strip(), 0, [Step("inside")]
        fresh = True
        if not text:
            raise ValueError(f"empty selector in {selector!r}")
        while at < len(text):
            if m := _CSS_PART.match(text, at):
                step = steps[-1]
                if m["tag"]:
                    if not fresh:
                        raise ValueError(selector)
                    step.tag = m["tag"].lower()
                elif m["id"]:
                    step.tests.append(("id", "=", m["id"]))
                elif m["cls"]:
                    step.tests.append(("class", "~=", m["cls"]))
                elif m["attr"]:
                    step.tests.append((m["attr"].lower(), m["rel"] or "", next((v for v in (m["q"], m["a"], m["bare"]) if v is not None), "")))
                else:
                    step.nth.append(("all", 1 if m["first"] else -1 if m["last"] else int(m["nth"])))
                fresh = False
            elif not fresh and (m := _COMBINATOR.match(text, at)):
                steps.append(Step(_AXES[m[1]]))
                fresh = True
            else:
                raise ValueError(f"selector {selector!r} at {at}")
            at = m.end()
        if fresh:
            raise ValueError(selector)
        paths.append(Path(steps))
    return paths


def xpath(expression: str) -> list[Path]:
    """The path of a location path with attribute, contains, starts-with and place tests; ValueError for what is not understood."""
    text, at, steps, take = expression.strip(), 0, [], ""
    while at < len(text):
        m = _XPATH_STEP.match(text, at)
        if m is None or take:
            raise ValueError(f"path {expression!r} at {at}")
        at = m.end()
        if m["attr"] or m["text"]:
            take = f"@{m['attr'].lower()}" if m["attr"] else "text()"
            if m["axis"] == "//":
                steps.append(Step("self-inside"))
            continue
        step = Step("child" if m["axis"] == "/" else "inside", m["tag"].lower())
        while t := _XPATH_TEST.match(text, at):
            if t["n"] or t["last"]:
                step.nth.append(("found", int(t["n"]) if t["n"] else -1))
            elif t["fn"]:
                step.tests.append((t["on"].lower(), "*=" if t["fn"] == "contains" else "^=", t["fq"] if t["fq"] is not None else t["fa"]))
            else:
                value = t["q"] if t["q"] is not None else t["a"]
                step.tests.append((t["attr"].lower(), "" if value is None else "=", value or ""))
            at = t.end()
        steps.append(step)
    if not steps and not take:
        raise ValueError("empty path")
    return [Path(steps, take)]


_RELATIONS = {
    "": lambda have, want: True, "=": lambda have, want: have == want, "~=": lambda have, want: want != "" and want in have.split(), "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want), "*=": lambda have, want: want != "" and want in have, "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def fits(nodes: list[Node], i: int, step: Step) -> bool:
    """Tag, attributes and places among all siblings; not the places among what the step finds."""
    node = nodes[i]
    if node.tag in ("", "#root") or (step.tag != "*" and node.tag != step.tag):
        return False
    if not all(a in node.attrs and _RELATIONS[r](node.attrs[a], v) for a, r, v in step.tests):
        return False
    for kind, n in step.nth:
        if kind == "all" and node.place != (n if n > 0 else nodes[node.parent].elements + 1 + n):
            return False
    return True


def _along(nodes: list[Node], found: list[int], step: Step) -> list[int]:
    """Nodes that a step reaches from nodes in document order, in document order."""
    places = [n for kind, n in step.nth if kind == "found"]
    if step.axis in ("inside", "self-inside"):
        reach, upto, own = [], 0, step.axis == "self-inside"
        for i in found:  # stretches that lie in one another are walked once
            begin = max(i if own else i + 1, upto)
            reach += [k for k in range(begin, nodes[i].end) if (nodes[k].tag if own else fits(nodes, k, step))]
            upto = max(upto, nodes[i].end)
        groups = [reach]
        if places:  # a place counts among the children of one parent
            by: dict[int, list[int]] = {}
            for k in reach:
                by.setdefault(nodes[k].parent, []).append(k)
            groups = list(by.values())
    elif step.axis == "child":
        groups = [[c for c in nodes[i].children if fits(nodes, c, step)] for i in found]
    else:
        groups = []
        for i in found:
            later = [c for c in nodes[nodes[i].parent].children if c > i and nodes[c].tag] if nodes[i].parent >= 0 else []
            groups.append([c for c in (later[:1] if step.axis == "next" else later) if fits(nodes, c, step)])
    for n in places:
        groups = [[g[n - 1 if n > 0 else n]] if abs(n) <= len(g) and n else [] for g in groups]
    return sorted({k for g in groups for k in g})


def select(nodes: list[Node], paths: list[Path]) -> list[int]:
    """Nodes on any of the paths, in document order."""
    out: set[int] = set()
    for path in paths:
        found = [0]
        for step in path.steps:
            found = _along(nodes, found, step)
        out |= set(found)
    return sorted(out)


def first_value(nodes: list[Node], paths: list[Path]) -> str | None:
    """Of the first node on the paths its text, attribute or own text, stripped; null without one."""
    found, take = select(nodes, paths), paths[0].take
    if take.startswith("@"):
        values = (nodes[i].attrs[take[1:]] for i in found if take[1:] in nodes[i].attrs)
    elif take:
        values = (nodes[c].text for i in found for c in nodes[i].children if nodes[c].tag == "")
    else:
        values = (content(nodes, i) for i in found)
    value = next(values, None)
    return None if value is None else value.strip()


# the block of the text ---------------------------------------------------------------------

#: Class and id words of page furniture and of bodies.
UNLIKELY = re.compile(r"(?i)\b(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|disqus|footer|header|menu|nav\w*|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|teaser\w*|widget)\b")
LIKELY = re.compile(r"(?i)\b(?:article|body|content|entry|main|page|post|story|text)\b")
#: Elements that are never part of a body.
FURNITURE = frozenset("nav footer aside form button select iframe header figure".split())
#: Letters from which a paragraph counts, and of the weight that its parent and its grandparent get.
PARAGRAPH, SHARES = 25, (1.0, 0.5)


def furniture(nodes: list[Node]) -> frozenset[int]:
    """Nodes that are left out: navigation and the like, by tag, and by class or id where these do not also speak for a body."""
    named = ((i, f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".replace("_", " ").replace("-", " ")) for i, n in enumerate(nodes) if n.tag)
    return frozenset(i for i, words in named if nodes[i].tag in FURNITURE or (nodes[i].tag not in ("body", "html", "article", "main") and UNLIKELY.search(words) and not LIKELY.search(words)))


def scored_body(nodes: list[Node]) -> str:
    """Text of the block that paragraphs speak for, with the blocks beside it that are nearly as good.

    A paragraph (p, pre, td, or a div without blocks in it) of PARAGRAPH letters
    gives 1, a point for each comma and for each hundred letters, three at most,
    whole to its parent and half to its grandparent. A block's points count by
    the share of its text that is not in links.
    """
    skip = furniture(nodes)
    hidden = bytearray(len(nodes))
    for i, n in enumerate(nodes):
        hidden[i] = i in skip or n.tag in SILENT or (n.parent >= 0 and hidden[n.parent])
    letters, linked, blocks = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    in_link = bytearray(len(nodes))
    for i, n in enumerate(nodes):
        in_link[i] = n.tag == "a" or (n.parent >= 0 and in_link[n.parent])
    for i in range(len(nodes) - 1, 0, -1):  # children before parents
        n = nodes[i]
        if n.tag == "" and not hidden[i]:
            letters[i] = len(n.text.strip())
            linked[i] = letters[i] * in_link[i]
        for total in (letters, linked):
            total[n.parent] += total[i]
        blocks[n.parent] += blocks[i] + (n.tag in BLOCKS and n.tag != "br")
    points: dict[int, float] = {}
    for i, n in enumerate(nodes):
        if hidden[i] or not (n.tag in ("p", "pre", "td") or (n.tag == "div" and not blocks[i])) or letters[i] < PARAGRAPH:
            continue
        own, above = 1 + content(nodes, i).count(",") + min(3, letters[i] // 100), n.parent
        for share in SHARES:
            if above > 0:
                points[above] = points.get(above, 0.0) + own * share
                above = nodes[above].parent
    worth = {i: v * (1 - linked[i] / letters[i] if letters[i] else 0) for i, v in points.items()}
    if not worth:
        return ""
    top = min(worth, key=lambda i: (-worth[i], i))
    beside = [c for c in nodes[nodes[top].parent].children if c == top or (not hidden[c] and worth.get(c, 0.0) >= max(10.0, 0.2 * worth[top]))]
    return " ".join(t for t in (readable(nodes, c, skip) for c in beside) if t)


#: Letters of a page and of an extracted text from and under which the block is looked for.
LONG_PAGE, SHORT_TEXT = 5000, 250


def body(html: str | None) -> tuple[str, str]:
    """(text, method) of a page: article, main, paragraphs, or the scored block ("readability") where these are short on a long page that is shaped like an article; else what there is."""
    nodes = tree(html)
    skip = frozenset(i for i, n in enumerate(nodes) if n.tag in FURNITURE)
    best = ("", "page")
    for tag, method in (("article", "article"), ("main", "main"), ("p", "paragraphs")):
        found, upto = [], 0
        for i, n in enumerate(nodes):
            if n.tag == tag and i >= upto:
                found.append(readable(nodes, i, skip))
                upto = n.end
        text = " ".join(t for t in (found[:1] if tag != "p" else found) if t)
        if text and not best[0]:
            best = (text, method)
        if len(text) >= SHORT_TEXT:
            return text, method
    page = html or ""
    if len(page) > LONG_PAGE and ("<article" in page.lower() or "schema.org/Article" in page):
        text = scored_body(nodes)
        if len(text) > len(best[0]):
            return text, "readability"
    return best if best[0] else (readable(nodes, 0), "page")
