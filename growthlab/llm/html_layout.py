"""Layout-aware rendering of HTML to text (operator 10).

A small tree builder closes elements that HTML closes by implication (p, li, dt, dd,
option, table parts), ignores stray end tags and never recurses.  The renderer walks the
tree and emits all text a reader would see: blocks on lines of their own, a blank line
around paragraphs and headings, list markers with indentation, table cells in aligned
columns, preformatted text as it is.  Elements that are not shown are left out: scripts,
styles, templates, the ``hidden`` attribute, ``display: none``, closed details and dialogs,
unselected options.  What ``visibility: hidden`` hides is left out, but its visible
descendants are shown.

Formulas (MathML) are emitted as their text, parts that do not stand in a row (fractions,
scripts, matrix cells) with a space between; annotations and phantoms are left out.  Of
inline SVG the text elements and foreign objects are emitted; titles, descriptions,
metadata and definitions are left out, and references (``use``) are not followed.

Rendering is a map over pages, without a shuffle.

Defined cases: a null or empty page has an empty text and no title; null ids and repeated
rows are rendered alike; an element left open is closed at the end of the page; a page
without markup is rendered as its text; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.llm.common import small_batches

# An attribute as HTML reads it: a quote opens a value only right after the equals sign and is
# an ordinary character elsewhere.  Possessive, so that a broken tag costs no second try.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|["'][^\s>]*)?"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*+)((?:[\s/]|(?:=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*{_VALUE})?)*+)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?)?""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object embed canvas audio video datalist noembed noframes title".split())
BLOCK = frozenset("""address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tr ul caption""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure hr ol pre table ul menu".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "caption", "optgroup", "legend"}
CELLS, PARTS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: Start tag -> open elements that it closes, and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    **{part: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for part in PARTS},
}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)\s*(!\s*important)?", re.I)
# Where the walk is: in HTML, in SVG outside and inside its text elements, in MathML.
HTML, SVG, SVG_TEXT, MATH = range(4)
UNSEEN_IN = {SVG: frozenset("title desc metadata defs".split()), MATH: frozenset("annotation annotation-xml mphantom".split())}
UNSEEN_IN[SVG_TEXT] = UNSEEN_IN[SVG]
SCRIPTS = frozenset("msub msup msubsup munder mover munderover mmultiscripts".split())
PARTED = SCRIPTS | frozenset("mfrac mroot mtable mtr mlabeledtr".split())
#: Start tags that end SVG and MathML, and elements of these that hold HTML.
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta
nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Cells longer than this do not widen their column.
WIDE = 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("", {})
    stack, at = [root], 0
    depth: dict[str, int] = {}  # how many elements of a name are open

    def pop_to(index: int) -> None:
        for node in stack[index:]:
            depth[node.tag] -= 1
        del stack[index:]

    def close(names: set, stops: set) -> None:
        """Closes the innermost open element of those names, unless a stop is nearer."""
        if not any(depth.get(n) for n in names):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in stops:
                break
            if tag in names:
                found = i
                if tag != "td" and tag != "th":
                    break
        if found is not None:
            pop_to(found)

    def break_out() -> None:
        """Closes the SVG and MathML elements that an HTML start tag ends."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in HOLDS_HTML or tag in BREAKOUT or tag in BLOCK:
                break
            if tag in ("svg", "math"):
                found = i
        if found is not None:
            pop_to(found)

    while m := TOKEN.match(html, at):
        at = m.end()
        end, start = m[1], m[2]
        if start:
            tag = start.lower()
            attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3])} if m[3] else {}
            if tag in BREAKOUT and (depth.get("svg") or depth.get("math")):
                break_out()
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "caption"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>?|\Z", re.I).search(html, at)
                if tag in ("textarea", "title"):
                    node.children.append(unescape(html[at: stop.start()]))
                at = stop.end()
            elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK
                                          and (tag in ("svg", "math") or depth.get("svg") or depth.get("math"))):
                stack.append(node)
                depth[tag] = depth.get(tag, 0) + 1
        elif end:
            tag = end.lower()
            if depth.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag not in BLOCK and any(n.tag in BLOCK or n.tag in CELLS for n in stack[i + 1:]):
                            depth[tag] -= 1  # an inline element ends, the blocks opened in it stay open
                            del stack[i]
                        else:
                            pop_to(i)
                        break
                    if stack[i].tag in CELLS and tag not in ("table", "tr", *PARTS, *CELLS):
                        break  # an end tag inside a cell closes nothing outside it
            elif tag == "p":
                stack[-1].children.append(Node("p", {}))  # a stray end tag parts paragraphs
        elif m[0][0] != "<" or m[0] == "<":
            text = unescape(m[0])
            if stack[-1].tag == "pre" and not stack[-1].children and text[:1] == "\n":
                text = text[1:]
            stack[-1].children.append(text)
    return root


class Lines:
    """Lines of text with blank lines, indentation and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space = self.space or (bool(s) and bool(self.now))
            return
        if self.now and (self.space or s[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = s[-1].isspace()

    def exact(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.now.append(first)
        for line in rest:
            self.line(keep=True)
            self.now.append(line)

    def line(self, blank: bool = False, keep: bool = False) -> None:
        """Ends the line; ``blank`` asks for a blank line before what follows."""
        if self.now and (keep or any(self.now)):
            if self.blank and self.lines:
                self.lines.append("")
            lead = "".join(self.indent)
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((lead + "".join(self.now)).rstrip())
            self.blank = False
        self.now, self.space = [], False
        self.blank = self.blank or blank

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _seen(node: Node, place: int) -> bool:
    """Whether anything of the element can be shown."""
    a = node.attrs
    return not (node.tag in UNSEEN or node.tag in UNSEEN_IN.get(place, ()) or "hidden" in a or (node.tag == "dialog" and "open" not in a)
                or (node.tag == "input" and a.get("type", "").lower() == "hidden")
                or (place in (SVG, SVG_TEXT) and a.get("display", "").strip().lower() == "none")
                or ("style" in a and HIDDEN_STYLE.search(a["style"]))
                or ((node.tag == "tr" or node.tag in PARTS) and _visibility(node, place) == "collapse"))


def _visibility(node: Node, place: int) -> str:
    """The element's own visibility: the last declaration, of important ones if there are."""
    found = VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else []
    if found:
        return ([v for v, important in found if important] or [v for v, _ in found])[-1].lower()
    return node.attrs.get("visibility", "").strip().lower() if place in (SVG, SVG_TEXT) else ""


def _place(node: Node, place: int) -> int:
    """Where the children of an element are."""
    if node.tag == "svg":
        return SVG
    if node.tag == "math" and place == HTML:
        return MATH
    if place in (SVG, SVG_TEXT):
        return {"text": SVG_TEXT, "foreignobject": HTML}.get(node.tag, place)
    return place


def _table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Cells side by side, each column as wide as its widest cell of ordinary length."""
    width: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            width += [0] * (at + span - len(width))
            longest = max(map(len, lines), default=0)
            if span == 1 and longest <= WIDE:
                width[at] = max(width[at], longest)
            at += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            at, parts = 0, []
            for lines, span in row:
                room = sum(width[at: at + span]) + 2 * (span - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(room))
                at += span
            out.append("  ".join(parts).rstrip())
    return out


def render(html: str) -> tuple[str, str]:
    """(title, text) of a page."""
    root = parse(html)
    title, out = "", [Lines()]
    tables: list[list] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    todo: list[tuple[object, bool, bool, int]] = [(root, False, True, HTML)]
    while todo:
        node, leaving, shown, place = todo.pop()
        top = out[-1]
        if isinstance(node, str):
            if not shown or place == SVG:
                continue
            if pre:
                top.exact(node)
            else:
                top.text(node)
            continue
        tag = node.tag
        if not leaving:
            if tag == "title" and place == HTML and not title:
                title = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
            if tag == "head":  # for the title only
                todo.extend((c, False, shown, place) for c in reversed(node.children) if isinstance(c, Node) and c.tag == "title")
                continue
            place = _place(node, place) if tag == "svg" else place
            if not _seen(node, place):
                continue
            own = _visibility(node, place)
            if own in ("hidden", "collapse"):
                shown = False
            elif own in ("visible", "initial"):
                shown = True
            if not shown and tag in ("br", "input"):
                continue
            if tag == "br":
                top.now = top.now or [""]
                top.line(keep=True)
                continue
            if tag == "input":
                if node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    top.text(node.attrs.get("value", ""))
                continue
            todo.append((node, True, shown, place))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            elif tag == "select":
                options, rest = [], list(reversed(children))
                while rest:
                    c = rest.pop()
                    if isinstance(c, Node):
                        if c.tag == "option":
                            options.append(c)
                        else:
                            rest.extend(reversed(c.children))
                chosen = [c for c in options if "selected" in c.attrs]
                children = options if "multiple" in node.attrs else chosen[:1] or options[:1]
            elif place == MATH and tag in PARTED:
                children = [x for c in children if isinstance(c, Node) for x in (c, " ")]
                if tag not in SCRIPTS:
                    children.insert(0, " ")
            place = _place(node, place)
            todo.extend((c, False, shown, place) for c in reversed(children))
            if place == SVG_TEXT and (tag == "text" or node.attrs.keys() & {"x", "y", "dy"}):
                top.space = bool(top.now)  # labels stand apart
            if tag in CELLS and tables:
                if not tables[-1]:
                    tables[-1].append([])
                out.append(Lines())
                continue
            if tag in BLOCK or tag == "option":
                top.line(blank=tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0]:
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                top.indent.append(" " * len(marker))
                top.marker = marker
            elif tag in ("dd", "blockquote"):
                top.indent.append("  ")
            elif tag == "pre":
                pre += 1
            continue
        if tag == "text" and place in (SVG, SVG_TEXT):
            top.space = bool(top.now)
        if tag in CELLS and tables:
            lines = out.pop().done()
            span = node.attrs.get("colspan", "1")
            tables[-1][-1].append((lines, min(1000, max(1, int(span))) if re.fullmatch(r"\d{1,5}", span) else 1))
            continue
        if tag == "table":
            rows = [r for r in tables.pop() if r]
            for line in _table_lines(rows):
                top.now.append(line)
                top.line()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "pre":
            pre -= 1
        if tag in BLOCK or tag == "option":
            top.line(blank=tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
        if tag in ("li", "dd", "blockquote"):
            top.indent.pop()
            top.marker = ""
    return title, "\n".join(out[0].done()).strip("\n")


def render_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text), a row per input row."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [render(h.as_py() or "") for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                names=["page_id", "url", "title", "text"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, title string, text string")
