"""Layout-aware rendering of HTML to text.

A lenient tree builder supplies the tags that HTML lets authors leave out, then
the tree is laid out: hidden subtrees are skipped, white space collapses as in
a browser, blocks get lines of their own (and a blank line where they have a
margin), list items their markers and depth, and table cells line up in
columns.  All visible text of the page is emitted; no part of it is judged.
Formulas in MathML and the text elements of SVG count as text; drawings that
SVG's `use` repeats are emitted where they stand, if they are shown there.

Visibility and white space follow `style` attributes and the page's own style
sheets, as far as rules select by tag, class and id.  Time is linear in the
page, however broken its tags are.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .store import ship

START = re.compile(r"<([a-zA-Z][^\s/>]*+)")
TAG_END = re.compile(r"[\s/]*+>")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|</\s*+(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?", re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noembed noframes iframe datalist base link meta param source track audio video object canvas".split()) | frozenset(
    "svg:defs svg:symbol svg:clippath svg:mask svg:marker svg:pattern svg:title svg:desc svg:metadata svg:script svg:style math:annotation math:annotation-xml math:mphantom".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset".split())
BLOCK = MARGIN | frozenset(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav option search section summary tr td th thead tbody tfoot caption optgroup".split()
)
SPECIAL = BLOCK | frozenset("head button select textarea".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup tr td th thead tbody tfoot caption legend".split())
# an open element of the second set ends where the first starts, unless one of the third lies between
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th script style template form".split())
# Of elements of SVG and MathML (their tags stand behind svg: and math:), those whose content is HTML, and HTML tags that end them
HTML_WITHIN = frozenset("svg:foreignobject svg:desc svg:title math:mi math:mo math:mn math:ms math:mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
APART = frozenset("math:mfrac math:mroot math:mtr math:mlabeledtr math:munder math:mover math:munderover".split())  # their parts don't touch
DEEPEST = 400
WIDEST = 60  # where cells are wrapped if blanks would outweigh the text
MOST_PADDING, MOST_BLANKS = 1 << 16, 1 << 26


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def foreign(self) -> bool:
        return ":" in self.tag and self.tag.startswith(("svg:", "math:"))

    def html_within(self) -> bool:
        """Start tags in it are HTML's."""
        return self.tag in HTML_WITHIN or self.tag == "math:annotation-xml" and self.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")


def _declarations(text: str) -> dict[str, tuple[bool, str]]:
    """Of SHOWN properties, whether they are important, and their values; the last important one counts, else the last."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in SHOWN:
            value = value.strip().lower()
            important = value.endswith("important") and "!" in value
            value = value.partition("!")[0].strip()
            if value and (important or not out.get(name, (False, ""))[0]):
                out[name] = important, value
    return out


SHOWN = frozenset(("display", "visibility", "white-space"))
SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
CSS = re.compile(r"([^{};@]*+)\{([^{}]*+)\}")
PARTS = re.compile(r"([.#])([\w-]+)")


class Sheet:
    """Rules of a page's style elements that select by tag, class and id, and set how an element is shown.

    Rules with combinators or other selectors, and those within at-rules, don't count.
    """

    def __init__(self) -> None:
        self.rules: dict[tuple[str, str], list[tuple]] = {}
        self.number = 0

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
        if not any(x in css.lower() for x in SHOWN):
            return
        for selectors, body in CSS.findall(_without_at_rules(css)):
            set_to = _declarations(body)
            for selector in selectors.split(",") if set_to else ():
                m = SELECTOR.fullmatch(selector.strip())
                if not m or not selector.strip():
                    continue
                named = PARTS.findall(m[2])
                ids, classes = [x for kind, x in named if kind == "#"], [x for kind, x in named if kind == "."]
                tag = (m[1] or "*").lower()
                key = ("#", ids[0]) if ids else (".", classes[0]) if classes else ("", tag)
                self.number += 1
                self.rules.setdefault(key, []).append(((len(ids), len(classes), tag != "*", self.number), tag, frozenset(ids), frozenset(classes), set_to))

    def _matching(self, node: Node) -> list[tuple]:
        a = node.attrs
        ids, classes = {a["id"]} if "id" in a else set(), set(a.get("class", "").split())
        keys = [("", "*"), ("", node.tag), *[("#", x) for x in ids], *[(".", x) for x in classes]]
        some = [r for k in keys for r in self.rules.get(k, ())]
        return sorted((r for r in some if r[1] in ("*", node.tag) and r[2] <= ids and r[3] <= classes), key=lambda r: r[0])

    def look(self, node: Node) -> dict[str, str]:
        """Which of the properties SHOWN are set for an element, by the cascade's order."""
        if not node.attrs and not self.rules:
            return {}
        layers = [r[4] for r in self._matching(node)] if self.rules else []
        if "style" in node.attrs:
            layers.append(_declarations(node.attrs["style"]))
        out = {k: v for important in (False, True) for layer in layers for k, (i, v) in layer.items() if i == important}
        if node.foreign():
            for k in ("display", "visibility"):
                if k in node.attrs and k not in out:
                    out[k] = node.attrs[k].strip().lower()
        return out


def _without_at_rules(css: str) -> str:
    if "@" not in css:
        return css
    out, depth, at = [], 0, 0
    for m in re.finditer(r"@|[{};]", css):
        c = m[0]
        if depth == 0 and c == "@":
            out.append(css[at : m.start()])
            depth, at = -1, None  # within the head of an at-rule
        elif depth == -1 and c == ";":
            depth, at = 0, m.end()
        elif depth == -1 and c == "{":
            depth = 1
        elif depth > 0 and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                at = m.end()
    if at is not None:
        out.append(css[at:])
    return "".join(out)


def _gone(node: Node, look: dict[str, str]) -> bool:
    """Neither it nor anything in it is shown."""
    if node.tag in UNSEEN or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return True
    if "display" in look:
        return look["display"] == "none"
    return "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in node.attrs


def _seen(look: dict[str, str], seen: bool) -> bool:
    """Whether its own text is shown: visibility is inherited."""
    set_to = look.get("visibility")
    return seen if set_to in (None, "inherit", "unset") else set_to not in ("hidden", "collapse")


def _shows_some(node: Node, sheet: Sheet) -> bool:
    """Whether anything in a hidden element is made visible again."""
    held = [node]
    while held:
        for child in held.pop().children:
            if isinstance(child, Node):
                look = sheet.look(child)
                if not _gone(child, look):
                    if look.get("visibility") == "visible":
                        return True
                    held.append(child)
    return False


def _attributes(raw: str) -> dict[str, str]:
    return _read_attributes(ATTRIBUTE.finditer(raw))


def _read_attributes(found) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in found:
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def _tag(page: str, at: int) -> tuple[int, dict[str, str], bool] | None:
    """A start tag from behind its name: where it ends, its attributes, whether a slash ends it.  None if it doesn't end."""
    found = []
    while not (end := TAG_END.match(page, at)):
        m = ATTRIBUTE.match(page, at)
        if not m:
            return None
        found.append(m)
        at = m.end()
    return end.end(), _read_attributes(found), page[end.end() - 2] == "/" and end.end() - 2 >= end.start()


class Builder:
    """Open elements as a stack; each start tag first closes what it implies the end of."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]

    def _close_to(self, tags, stop) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                del self.stack[i:]
                return
            if tag in stop or ":" in tag and self.stack[i].html_within():
                return

    def _place(self) -> list:
        """Where content goes: what may not stand in a table goes before it."""
        if self.stack[-1].tag in IN_TABLE:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "table":
                    into = self.stack[i - 1].children
                    into.insert(max(len(into) - 1, 0), holder := Node("div"))
                    return holder.children
        return self.stack[-1].children

    def text(self, text: str) -> None:
        if not text:
            return
        if self.stack[-1].tag == "colgroup" and not text.isspace():
            self.stack.pop()
        if self.stack[-1].tag in IN_TABLE:
            if not text.isspace():
                self._place().append(text)
        else:
            self.stack[-1].children.append(text)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node:
        """`closed`: the tag ends with a slash, which counts in SVG and MathML only."""
        top = self.stack[-1]
        if top.foreign() and (not top.html_within() or top.tag.startswith("math:m") and tag in ("mglyph", "malignmark")) and not (top.tag == "math:annotation-xml" and tag == "svg"):
            if tag not in BREAKOUT and not (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                return self._add_foreign(top.tag.partition(":")[0], tag, attrs, closed)
            self._leave_foreign()
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._close_to({"head"}, set())
            if tag != "head":
                self.stack[-1].attrs |= {k: v for k, v in attrs.items() if k not in self.stack[-1].attrs} if len(self.stack) == 1 else {}
                return self.stack[-1]
        elif len(self.stack) > 1 and self.stack[-1].tag == "head" and tag not in UNSEEN:
            self.stack.pop()  # the body has begun
        if self.stack[-1].tag == "colgroup" and tag not in ("col", "template", "script", "style"):
            self.stack.pop()
        if tag in ("svg", "math"):
            return self._add_foreign(tag, tag, attrs, closed)
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in IMPLIED:
            self._close_to(*IMPLIED[tag])
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self._close_to({"td", "th"}, {"table"})
                if tag != "tr":
                    self._close_to({"tr"}, {"table"})
                    self._close_to(*IMPLIED[tag])
                else:
                    self._close_to(*IMPLIED[tag])
        if tag in ("td", "th") and self.stack[-1].tag in IN_TABLE and self.stack[-1].tag != "tr":
            self.start("tr", {}, False)
        node = Node(tag, attrs)
        inside = self.stack[-1].tag in IN_TABLE
        (self._place() if inside and tag not in TABLE_PARTS else self.stack[-1].children).append(node)
        if tag not in VOID and not (inside and tag == "form") and len(self.stack) < DEEPEST:  # a table's form holds nothing
            self.stack.append(node)
        return node

    def _add_foreign(self, kind: str, tag: str, attrs: dict[str, str], closed: bool) -> Node:
        node = Node(f"{kind}:{tag}", attrs)
        self._place().append(node)
        if not closed and len(self.stack) < DEEPEST:
            self.stack.append(node)
        return node

    def _leave_foreign(self) -> None:
        while self.stack[-1].foreign() and not self.stack[-1].html_within():
            self.stack.pop()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if self.stack[-1].foreign():
            if tag in ("p", "br"):
                self._leave_foreign()
            for i in range(len(self.stack) - 1, 0, -1):
                if not self.stack[i].foreign():
                    break
                if self.stack[i].tag.partition(":")[2] == tag:
                    del self.stack[i:]
                    return
        for i in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[i].tag
            if open_tag == tag or tag in _HEADINGS and open_tag in _HEADINGS:
                del self.stack[i:]
                return
            if ":" in open_tag and self.stack[i].html_within():
                break
            if open_tag in SPECIAL and tag not in SPECIAL or open_tag in ("td", "th", "caption") and tag not in ("tr", "table", "thead", "tbody", "tfoot") or open_tag == "table":
                break
        if tag == "p":
            self.stack[-1].children.append(Node("p"))
        elif tag == "br":
            self.stack[-1].children.append(Node("br"))


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def parse(page: str) -> tuple[Node, Sheet]:
    """The tree of a page, and its style rules.

    Where quotes would keep a tag open to the end of the page, it and all later
    tags end at the next bracket, whatever quotes hold; without a bracket, the
    rest is text.
    """
    builder, sheet, at, n, loose = Builder(), Sheet(), 0, len(page), False
    unescape = html.unescape
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = page[at:lt]
            builder.text(unescape(text) if "&" in text else text)
            at = lt
            continue
        if m := START.match(page, at):
            got = None if loose else _tag(page, m.end())
            if got is None:
                loose = True
                end = page.find(">", m.end())
                if end < 0:
                    builder.text(unescape(page[at:]))
                    break
                got = end + 1, _attributes(page[m.end() : end]), page[end - 1] == "/"
            at, attrs, closed = got
            tag = m[1].lower()
            node = builder.start(tag, attrs, closed)
            if tag in RAW and node.tag == tag:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                body = page[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "style":
                    if attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
                        sheet.add(body)
                elif body and tag in ("textarea", "title", "xmp"):
                    node.children.append(unescape(body) if tag != "xmp" else body)
                if builder.stack[-1] is node:
                    builder.stack.pop()
        elif m := OTHER.match(page, at):
            at = m.end()
            if m["cdata"] is not None:
                builder.text(m["cdata"])
            elif m["end"]:
                builder.end(m["end"].lower())
        else:
            builder.text("<")
            at += 1
    return builder.root, sheet


class _Lines:
    """Lines under way.  `gap` is how many line ends are due before more text."""

    def __init__(self, sheet: Sheet) -> None:
        self.sheet = sheet
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix = ""
        self.marker = ""

    def inline(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = True
            return
        if text[0].isspace():
            self.space = True
        self._begin()
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = text[-1].isspace()

    def kept(self, text: str, spaces: bool = True) -> None:
        """Preformatted text; without its spaces, only lines are kept."""
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line_break()
            if not spaces:
                self.inline(line)
                continue
            if line:
                self._begin()
                self.now.append(line.expandtabs(8))
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def flush(self) -> None:
        if self.now:
            self.lines.append((self.prefix + self.marker + "".join(self.now)).rstrip())
            self.marker = " " * len(self.marker)
        self.now, self.space = [], False

    def block(self, margin: bool) -> None:
        self.gap = max(self.gap, 2 if margin else 1)
        self.flush()

    def line_break(self) -> None:
        if self.now:
            self.flush()
        elif self.lines and self.lines[-1] and not self.gap:
            self.lines.append("")
        self.space = False

    def text(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _number(value: str | None, usual: int) -> int:
    try:
        return int(value or usual)
    except ValueError:
        return usual


def _lay_svg(node: Node, out: _Lines, within: bool, depth: int, seen: bool) -> None:
    """What stands in text elements, and HTML; texts with places of their own don't touch."""
    for child in node.children:
        if isinstance(child, str):
            if within and seen:
                out.inline(child)
            continue
        look = out.sheet.look(child)
        shown = _seen(look, seen)
        if child.tag == "svg:foreignobject":
            out.block(False)
            _lay(child, out, None, depth, shown)
            out.block(False)
        elif not _gone(child, look):
            text = child.tag == "svg:text"
            apart = text or within and bool(child.attrs.keys() & {"x", "y", "dx", "dy"})
            out.space |= apart
            _lay_svg(child, out, within or text, depth, shown)
            out.space |= text


def _space(look: dict[str, str], usual: str | None) -> str | None:
    """How white space is kept: "all", "lines" or not at all."""
    if "white-space" not in look:
        return usual
    return {"pre": "all", "pre-wrap": "all", "break-spaces": "all", "pre-line": "lines", "inherit": usual}.get(look["white-space"])


def _lay(node: Node, out: _Lines, pre: str | None, depth: int, seen: bool = True) -> None:
    count = _number(node.attrs.get("start"), 1) if node.tag == "ol" else 0
    apart = node.tag in APART
    for child in node.children:
        if apart:
            out.space = True
        if isinstance(child, str):
            if seen:
                out.kept(child, pre == "all") if pre else out.inline(child)
            continue
        look = out.sheet.look(child)
        if _gone(child, look):
            continue
        shown = _seen(look, seen)
        if seen and not shown and not _shows_some(child, out.sheet):
            continue
        tag = child.tag
        kept = _space(look, "all" if tag in ("pre", "textarea", "xmp") else pre)
        if tag == "br":
            if seen:
                out.line_break()
        elif tag == "svg:svg":
            _lay_svg(child, out, False, depth, shown)
        elif tag in ("math:mtr", "math:mlabeledtr") or tag == "math:math" and child.attrs.get("display", "").lower() == "block":
            out.block(False)
            _lay(child, out, kept, depth, shown)
            out.block(False)
        elif tag in ("img", "input", "wbr"):
            if shown and tag == "input" and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.inline(child.attrs.get("value", ""))
        elif tag == "table":
            out.block(True)
            rows = _table(child, out.sheet, shown)
            if rows:
                out._begin()
                out.lines += [(out.prefix + " " * len(out.marker) + r).rstrip() for r in rows]
            out.block(True)
        elif tag == "li":
            out.block(False)
            held = out.prefix, out.marker
            out.prefix += " " * len(out.marker)
            count = _number(child.attrs.get("value"), count)
            out.marker = f"{count}. " if node.tag == "ol" else "- "
            count += 1
            _lay(child, out, kept, depth, shown)
            out.block(False)
            out.prefix, out.marker = held
            if out.marker:
                out.marker = " " * len(out.marker)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(depth == 0)
            _lay(child, out, kept, depth + 1, shown)
            out.block(depth == 0)
        elif tag in BLOCK or tag == "textarea":
            margin = tag in MARGIN
            out.block(margin)
            held = out.prefix
            if tag in ("blockquote", "dd"):
                out.prefix += "    "
            _lay(child, out, kept, depth, shown)
            out.block(margin)
            out.prefix = held
        else:
            # an inline element that a style makes a block stands on lines of its own
            apart_block = look.get("display") in ("block", "flex", "grid", "table", "list-item", "flow-root")
            if apart_block:
                out.block(False)
            if tag == "q" and shown:
                out.inline('"')
            _lay(child, out, kept, depth, shown)
            if tag == "q" and shown:
                out.inline('"')
            if apart_block:
                out.block(False)


def _span(value: str | None, most: int, least: int = 1) -> int:
    """A span as HTML reads it: digits at the start, up to a limit; 1 for what isn't one."""
    digits = re.match(r"\s*\+?(\d{1,9})", value or "")
    span = int(digits[1]) if digits else 1
    return min(span, most) if span >= least else 1


def _cells(row: Node, sheet: Sheet, seen: bool) -> list[tuple[list[str], int, int]]:
    """Lines, columns and rows of each cell."""
    out = []
    for cell in row.children:
        if isinstance(cell, Node) and cell.tag != "form" and not _gone(cell, look := sheet.look(cell)):
            lines = _Lines(sheet)
            _lay(cell, lines, _space(look, None), 0, _seen(look, seen))
            text = lines.text()
            out.append((text.split("\n") if text else [""], _span(cell.attrs.get("colspan"), 1000), _span(cell.attrs.get("rowspan"), 65534, 0)))
    return out


def _grid(groups: list[list[list[tuple[list[str], int, int]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """First column, the column after the last and lines of each row's cells: a cell of several rows keeps its columns in those below, up to the end of its group."""
    out = []
    for rows in groups:
        held: list[tuple[int, int, int]] = []  # columns that are taken, and the row from which they are free
        for n, row in enumerate(rows):
            held = [h for h in held if h[2] > n] if row else held
            placed, own, at, k = [], [], 0, 0
            for lines, columns, down in row:
                while k < len(held) and held[k][0] <= at:
                    at = max(at, held[k][1])
                    k += 1
                placed.append((at, at + columns, lines))
                if down != 1:
                    until = n + down if down else len(rows)
                    first = own.pop()[0] if own and own[-1][1:] == (at, until) else at
                    own.append((first, at + columns, until))
                at += columns
            if own:
                held = sorted(held + own)
            out.append(placed)
    return out


def _wrapped(line: str) -> list[str]:
    """Parts of WIDEST characters at most, cut at blanks where there are some."""
    out = []
    while len(line) > WIDEST:
        at = line.rfind(" ", 1, WIDEST + 1)
        at = at if at > 0 and line[:at].strip() else WIDEST
        out.append(line[:at].rstrip())
        line = line[at:].lstrip()
    return [*out, line]


def _places(rows: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where each column that a cell starts in begins: behind the longest line of each cell before it."""
    starts = sorted({at for row in rows for at, _, _ in row})
    number = {at: n for n, at in enumerate(starts)}
    needs: dict[tuple[int, int], int] = {}
    for row in rows:
        for at, end, lines in row:
            cell = number[at], bisect_left(starts, end)
            needs[cell] = max(needs.get(cell, 0), *(len(x) for x in lines))
    # a column begins where all cells that end before it have room
    by_end: dict[int, list[tuple[int, int]]] = {}
    for (first, after), width in needs.items():
        by_end.setdefault(after, []).append((first, width))
    begin = [0]
    for n in range(1, len(starts) + 1):
        begin.append(max([begin[-1] + 2, *(begin[first] + width + 2 for first, width in by_end.get(n, ()))]))
    return {at: begin[n] for at, n in number.items()}


def _table(table: Node, sheet: Sheet, seen: bool) -> list[str]:
    """Caption and rows, cells padded so that columns line up."""
    caption: list[str] = []
    groups: list[list[list[tuple[list[str], int, int]]]] = [[]]

    def collect(parts: list, seen: bool) -> None:
        for part in parts:
            if isinstance(part, str):
                caption.extend(part.split("\n") if seen and part.strip() else [])
                continue
            look = sheet.look(part)
            if _gone(part, look):
                continue
            shown = _seen(look, seen)
            if part.tag == "tr":
                groups[-1].append(_cells(part, sheet, shown))
            elif part.tag in ("thead", "tbody", "tfoot"):
                groups.append([])
                collect(part.children, shown)
                groups.append([])
            elif part.tag in ("form", "colgroup"):
                collect(part.children, shown)
            else:
                lines = _Lines(sheet)
                _lay(part, lines, _space(look, None), 0, shown)
                caption.extend(lines.text().split("\n"))

    collect(table.children, seen)
    rows = _grid(groups)
    places = _places(rows)
    size = sum(len(x) for row in rows for _, _, lines in row for x in lines)
    if _padded(rows, places) > 8 * size + MOST_PADDING:
        rows = [[(at, end, [y for x in lines for y in _wrapped(x)]) for at, end, lines in row] for row in rows]
        places = _places(rows)
        if _padded(rows, places) > MOST_BLANKS:
            places = dict.fromkeys(places, 0)
    out = [x for x in caption if x]
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, length = [], 0
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    pad = places[at] - length if places[at] > length or not parts else 2
                    parts += [" " * pad, lines[k]]
                    length += pad + len(lines[k])
            if line := "".join(parts).rstrip():
                out.append(line)
    return out


def _padded(rows: list[list[tuple[int, int, list[str]]]], places: dict[int, int]) -> int:
    """At most how long the rows are with their padding."""
    return sum(places[max(at for at, _, lines in row if any(lines))] * max(len(lines) for _, _, lines in row) for row in rows if any(any(lines) for _, _, lines in row))


def render(page: str | None) -> str:
    """The visible text of a page; nothing for a null or empty one."""
    if not page:
        return ""
    root, sheet = parse(page)
    out, look = _Lines(sheet), sheet.look(root)
    if not _gone(root, look):
        _lay(root, out, _space(look, None), 0, _seen(look, True))
    return out.text()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))
    for batch in batches:
        html_at = batch.schema.names.index("html")
        text = pa.array([render(x.as_py()) for x in batch.column(html_at)], pa.string())
        kept = [i for i in range(batch.num_columns) if i != html_at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], text], [*[batch.schema.names[i] for i in kept], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text` in place of `html`.

    A null or empty page, or one without visible text, gives an empty text.
    Other columns pass; one named text is replaced.  Elements nested deeper
    than 400 stand beside their parents, as in browsers.

    Columns of a table are as wide as their longest line; spans count up to
    HTML's limits (1,000 columns, 65,534 rows, the end of the row group), and a
    cell of several rows stands in the first.  Cells are wrapped at 60
    characters where padding would be more than 64 Ki characters and eight
    times the table's text; if 64 Mi characters of padding remain even so, as
    in tables made to exhaust memory, cells stand two blanks apart.
    """
    ship(pages.sparkSession)
    pages = pages.drop("text")
    kind = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"], "text string"])
    return pages.mapInArrow(_render, kind)
