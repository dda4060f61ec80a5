"""Layout-aware text of web pages.

A tree builder reads tags and character references, closes elements whose end
tag is implied (paragraphs, list items, table parts, options, definitions) and
keeps unclosed ones open to the end. Visibility rules drop what a browser does
not show: head matter, scripts and styles, hidden attributes, inline styles and
simple style-sheet rules (``tag``, ``.class``, ``#id``) that set ``display: none``
or ``visibility: hidden`` on a wide screen and that no later rule of the same
selector takes back, closed details and dialogs. What is made visible again within
an invisible element is shown, as nothing within an element without display is. The renderer emits all other
text: blocks on lines of their own with a blank line around those that have
margins, list items with markers and indentation, preformatted text as it is,
and table cells in aligned columns, spans included. Columns are padded to their widest line of at most ``PAD`` characters; a longer
line stands as it is. All padding and indentation of a page may take ``ROOM`` times its length; what doesn't fit into that is left out.

One narrow map; no shuffle and no state between rows.

Defined edge cases: a null or empty page has empty text and no title; elements
nested deeper than ``MAX_DEPTH`` are read as children of the last level, as widespread
browsers do at the same depth; cells span at most as many columns and rows as the
HTML standard allows (1,000 and 65,534); broken
markup never fails: what isn't a tag is text; text grows in proportion to the page, whatever is in it, and time to the page and the depth
of its tables; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

MAX_DEPTH = 512
#: Widest line that a column is padded to.
PAD = 120
#: Padding and indentation of a page, as a multiple of its length, and what any page may have.
ROOM, LEAST_ROOM = 8, 4_096
#: Python frames for elements of that depth, nested tables too.
FRAMES = 20 * MAX_DEPTH
# Limits of the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title meta link base noembed noframes iframe object canvas audio video map datalist param source track".split())
FOREIGN = frozenset({"svg", "math"})
#: Not shown within drawings and formulas.
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
#: Texts of a drawing and cells of a formula stand apart.
APART = frozenset("svg text mtr mtd".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption optgroup option".split()
)
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Opening the key ends open elements of the first set, up to an element of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
CELLS = frozenset({"td", "th"})
ROWS = CELLS | {"tr"}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "template"})

_COMMENTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_NAME_END = re.compile(r"[\s/>]|\Z")
_MARK = re.compile(r"[>\"']|\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
# A string that isn't closed ends with its line.
_CSS_MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|[{};]", re.S)
_FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)")
#: Width in pixels of the screen that media rules are judged for.
SCREEN = 1280
_SIMPLE = re.compile(r"^[A-Za-z0-9]*(?:[.#][\w-]+)?$")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "inside")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.inside = tag, attributes, [], None


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


class Tags:
    """The tags of a page in order, as (start, end, whether it closes, name, attributes); comments have no name.

    A tag ends at the first ``>`` outside quotes. Where there is none, the ``<`` is text and reading goes on behind it. What was
    learnt from a start that failed is kept: from a mark outside quotes the way on is always the same, so a mark that once led
    nowhere is never followed again, and every stretch of the page is read a bounded number of times.
    """

    def __init__(self, source: str):
        self.source = source
        self.lost: set[int] = set()
        self.name_from = self.name_end = self.mark_from = self.mark_at = -1

    def end_of_name(self, at: int) -> int:
        if not self.name_from <= at <= self.name_end:
            self.name_from, self.name_end = at, _NAME_END.search(self.source, at).start()
        return self.name_end

    def first_mark(self, at: int) -> int:
        if not self.mark_from <= at <= self.mark_at:
            self.mark_from, self.mark_at = at, _MARK.search(self.source, at).start()
        return self.mark_at

    def close(self, at: int) -> int:
        """Where the ``>`` is that ends a tag whose name ends at ``at``; -1 if there is none."""
        source, size = self.source, len(self.source)
        passed = []
        mark = self.first_mark(at)
        while mark < size and mark not in self.lost:
            if source[mark] == ">":
                return mark
            passed.append(mark)
            shut = source.find(source[mark], mark + 1)
            if shut < 0:
                break
            mark = _MARK.search(source, shut + 1).start()
        self.lost.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag or comment from ``at`` on."""
        source = self.source
        at = source.find("<", at)
        while at >= 0:
            if source.startswith(("<!", "<?"), at):
                return at, _COMMENTED.match(source, at).end(), False, "", ""
            closes = source.startswith("/", at + 1)
            start = at + 1 + closes
            first = source[start : start + 1]
            if first.isascii() and first.isalpha():
                name_end = self.end_of_name(start)
                end = self.close(name_end)
                if end >= 0:
                    return at, end + 1, closes, source[start:name_end].lower(), source[name_end:end]
            at = source.find("<", at + 1)
        return None


def parse(source: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack = [root]

    def close(tags, until) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                j = i
                while j - 1 > 0 and stack[j - 1].tag in tags:
                    j -= 1
                del stack[j:]
                return
            if stack[i].tag in until:
                return

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    at, size = 0, len(source)
    tags = Tags(source)
    while at < size:
        found = tags.after(at)
        if found is None:
            text(source[at:])
            break
        start, end, closes, tag, own = found
        text(source[at:start])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            else:
                stop = {"table"} if tag not in ("table", "body", "html") else set()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in stop:
                        break
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag == "body":
            close({"head"}, ())
        node = Node(tag, attributes_of(own) if own else {})
        stack[-1].children.append(node)
        drawn = (tag in FOREIGN_UNSEEN or own.endswith("/")) and (tag in FOREIGN or any(n.tag in FOREIGN for n in stack))
        if drawn and tag in FOREIGN_UNSEEN:
            node.attributes["hidden"] = ""
        if drawn and own.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else size
            body = source[at:stop]
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            gt = source.find(">", stop)
            at = size if end is None or gt < 0 else gt + 1
        elif tag not in VOID and not (own.endswith("/") and tag == "path") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def find(node: Node, tag: str) -> Node | None:
    waiting = [node]
    while waiting:
        n = waiting.pop()
        if n.tag == tag:
            return n
        waiting += [c for c in reversed(n.children) if isinstance(c, Node)]
    return None


def on_screen(query: str) -> bool:
    """Whether a media query holds on a wide screen; what can't be told doesn't, so that text stays."""
    for part in query.lower().split(","):
        words = re.sub(r"\([^()]*\)", " ", part).replace(" and ", " ").split()
        negated, kinds = words[:1] == ["not"], [w for w in words if w not in ("not", "only", "and")]
        features = re.findall(r"\([^()]*\)", part)
        known = [_FEATURE.fullmatch(f) for f in features]
        if not all(known) or len(kinds) > 1 or part.count("(") != len(features):
            continue
        wide = [(SCREEN >= w) if m[1] == "min" else (SCREEN <= w) for m in known if re.fullmatch(r"\d*\.?\d+|\d+\.", m[2]) for w in (float(m[2]) * (1 if m[3] == "px" else 16),)]
        if (len(wide) == len(known) and all(wide) and kinds in ([], ["all"], ["screen"])) != negated:
            return True
    return not query.strip()


def rules_of(css: str):
    """Selectors and declarations of the rules that apply on a screen, in order."""
    css = _COMMENT.sub(" ", css)
    blocks: list[tuple[bool, str]] = []
    start = 0
    for m in _CSS_MARK.finditer(css):
        if m[0] == "{":
            head = css[start : m.start()].strip()
            name, _, rest = head.partition(" ") if " " in head else head.partition("(")
            name = name.lower().partition("(")[0]
            holds = not head.startswith("@") or (name == "@media" and on_screen(head[6:])) or name == "@layer" or (name == "@supports" and "not" not in rest.lower().split())
            blocks.append((holds and (not blocks or blocks[-1][0]), "" if head.startswith("@") else head))
            start = m.end()
        elif m[0] == "}":
            if blocks:
                holds, head = blocks[-1]
                if head and holds:
                    yield head, css[start : m.start()]
                blocks.pop()
            start = m.end()
        elif m[0] == ";" and not (blocks and blocks[-1][1]):
            start = m.end()


class Rules:
    """Simple selectors that the page's own style sheets hide, make invisible or make visible."""

    def __init__(self, root: Node):
        state: dict[tuple[str, str], tuple[str, bool]] = {}  # by selector and property: the value, and whether it is important
        waiting = [root]
        while waiting:
            n = waiting.pop()
            if n.tag == "style" and on_screen(n.attributes.get("media", "")):
                for selectors, body in rules_of("".join(c for c in n.children if isinstance(c, str))):
                    for declaration in body.split(";"):
                        name, _, value = declaration.partition(":")
                        name, value = name.strip().lower(), value.strip()
                        if name not in ("display", "visibility") or not value:
                            continue
                        now = value.partition("!")[0].strip().lower(), "!" in value
                        for x in selectors.split(","):
                            x = x.strip()
                            if x and _SIMPLE.match(x) and state.get((x, name), ("", False))[1] <= now[1]:
                                state[x, name] = now
            waiting += [c for c in reversed(n.children) if isinstance(c, Node)]
        chosen = lambda name, *values: frozenset(x for (x, p), (v, _) in state.items() if p == name and v in values)
        self.gone, self.muted, self.seen = chosen("display", "none"), chosen("visibility", "hidden", "collapse"), chosen("visibility", "visible")

    def selectors(self, n: Node) -> set[str]:
        a = n.attributes
        marks = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if a.get("id") else set())
        return {n.tag} | {x + m for x in ("", n.tag) for m in marks}


class Renderer:
    """Lines of visible text."""

    def __init__(self, rules: Rules, room: list[int], muted: bool = False):
        self.rules = rules
        self.room = room  # characters of padding that the page may still have, shared by all its renderers
        self.muted = muted
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent = ""
        self.marker: str | None = None
        self.gap = False

    def visible(self, n: Node) -> bool:
        """Whether an element is displayed at all."""
        a = n.attributes
        if n.tag in UNSEEN or (n.tag == "dialog" and "open" not in a) or (n.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False
        if "hidden" in a or _NO_DISPLAY.search(a.get("style", "")):
            return False
        return not self.rules.gone or not (self.rules.selectors(n) & self.rules.gone)

    def mutes(self, n: Node, before: bool) -> bool:
        """Whether an element's text is invisible: its own style, else a rule, else as outside."""
        own = _VISIBILITY.findall(n.attributes.get("style", "")) if n.attributes else ()
        if own:
            return own[-1].lower() != "visible"
        if self.rules.muted or self.rules.seen:
            names = self.rules.selectors(n)
            if names & self.rules.muted:
                return True
            if names & self.rules.seen:
                return False
        return before

    def padding(self, n: int) -> bool:
        """Take ``n`` characters from the room for padding, if there are so many."""
        if n > self.room[0]:
            return False
        self.room[0] -= n
        return True

    def flush(self) -> None:
        s = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if s:
            self.line(s)

    def line(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.indent
        if self.marker is not None:
            lead, self.marker = self.indent[: -len(self.marker)] + self.marker if self.marker else self.indent, None
        self.lines.append((self.padding(len(self.indent)) and lead + s or s).rstrip())

    def render(self, n: Node | str) -> None:
        if isinstance(n, str):
            if not self.muted:
                self.inline.append(n)
            return
        if not self.visible(n):
            return
        before, self.muted = self.muted, self.mutes(n, self.muted)
        self.element(n)
        self.muted = before

    def element(self, n: Node) -> None:
        tag = n.tag
        if tag == "br":
            if "".join(self.inline).strip():
                self.flush()
            else:
                self.inline.clear()
            return
        if tag == "input":
            if not self.muted and n.attributes.get("type", "text").lower() not in ("checkbox", "radio", "file", "password", "image", "range", "color"):
                self.inline.append(" " + (n.attributes.get("value") or n.attributes.get("placeholder", "")) + " ")
            return
        if tag in ("textarea", "pre"):
            self.flush()
            self.gap = self.gap or tag == "pre"
            inner = "".join(self.plain(n, self.muted)).strip("\n")
            for row in inner.split("\n") if inner else ():
                self.line(row.rstrip())
            self.gap = tag == "pre"
            return
        if tag == "table":
            self.flush()
            self.gap = True
            for row in self.table(n):
                self.line(row)
            self.gap = True
            return
        block = tag in BLOCK
        if block:
            self.flush()
            self.gap = self.gap or (tag in MARGIN and not (tag in ("ul", "ol", "menu") and self.marker is None and self.indent))
        if tag in ("ul", "ol", "menu", "dir"):
            self.items(n, tag == "ol")
        elif tag == "details" and "open" not in n.attributes:
            for c in n.children:
                if isinstance(c, Node) and c.tag == "summary":
                    self.render(c)
                    break
        elif tag == "select":
            options = [o for o in walk(n, "option") if self.visible(o)]
            shown = [o for o in options if "selected" in o.attributes] or (options if "multiple" in n.attributes else options[:1])
            self.inline += [" " + "".join(self.plain(o, self.mutes(o, self.muted))) + " " for o in shown]
        else:
            before = self.indent
            if tag in APART:
                self.inline.append(" ")
            if tag in ("blockquote", "dd"):
                self.indent += "  "
            for c in n.children:
                self.render(c)
            if tag in APART:
                self.inline.append(" ")
            if block:
                self.flush()
            self.indent = before
        if block:
            self.flush()
            self.gap = self.gap or (tag in MARGIN and not (tag in ("ul", "ol", "menu") and self.indent))

    def plain(self, n: Node, muted: bool) -> list[str]:
        """Text with its own white space."""
        out: list[str] = []
        for c in n.children:
            if isinstance(c, str):
                out += [] if muted else [c]
            elif c.tag == "br":
                out.append("\n")
            elif self.visible(c):
                out += self.plain(c, self.mutes(c, muted))
        return out

    def items(self, n: Node, numbered: bool) -> None:
        start = n.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        outer = self.indent
        for c in n.children:
            if isinstance(c, Node) and c.tag == "li":
                if not self.visible(c):
                    continue
                self.flush()
                marker = f"{number}. " if numbered else "- "
                number += 1
                self.indent, self.marker = outer + " " * len(marker), marker
                before, self.muted = self.muted, self.mutes(c, self.muted)
                for x in c.children:
                    self.render(x)
                self.flush()
                self.indent, self.marker, self.muted = outer, None, before
            elif isinstance(c, Node) or c.strip():
                self.render(c)
        self.flush()
        self.indent = outer

    def table(self, n: Node) -> list[str]:
        """Rows of a table with its cells in aligned columns; captions come first."""
        grid: list[dict[int, list[str]]] = []
        width: dict[int, int] = {}
        busy: dict[int, int] = {}  # by column: the first row that no cell from above reaches into
        skip: dict[int, tuple[int, int]] = {}  # by column: the next one that isn't busy, until this row
        out: list[str] = []
        for row in rows_of(n, self.visible):
            if not self.visible(row):
                continue
            if row.tag == "caption":
                out += self.cell(row)
                continue
            cells: dict[int, list[str]] = {}
            at, r = 0, len(grid)
            before, self.muted = self.muted, self.mutes(row, self.muted)
            for c in cells_of(row, self.visible):
                if c.tag == "caption":
                    out += self.cell(c)
                    continue
                first, until = at, MOST_ROWS + r + 1
                while busy.get(at, 0) > r:
                    far, row_end = skip.get(at, (0, 0))
                    until = min(until, row_end if row_end > r else busy[at])
                    at = far if row_end > r else at + 1
                if at > first:
                    skip[first] = at, until
                across, down = span(c, "colspan", MOST_COLUMNS), span(c, "rowspan", MOST_ROWS)
                if down > 1:
                    busy.update(dict.fromkeys(range(at, at + across), r + down))
                cells[at] = self.cell(c)
                if across == 1:
                    width[at] = max(width.get(at, 0), *(len(x) for x in cells[at] or [""] if len(x) <= PAD), 0)
                at += across
            self.muted = before
            grid.append(cells)
        columns = sorted(width.keys() | {k for row in grid for k in row})
        place = {k: i for i, k in enumerate(columns)}
        widths = [width.get(k, 0) for k in columns]
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + w + 3)
        for row in grid:
            lines: list[list[tuple[int, str]]] = [[] for _ in range(max((len(x) for x in row.values()), default=0))]
            for k in sorted(row):
                for line, s in zip(lines, row[k]):
                    line.append((place[k], s))
            out += [self.aligned(line, widths, starts) for line in lines]
        return [x for x in out if x]

    def aligned(self, cells: list[tuple[int, str]], widths: list[int], starts: list[int]) -> str:
        """One line of a row from its own cells, as (column, text) in order; ``starts`` sums the widths and the marks between columns."""
        parts: list[str] = []
        at, last = 0, None  # the column after the cell before, and that cell's text
        for k, s in cells:
            if last is not None:
                short = widths[at - 1] - len(last)
                parts += [last, " " * short if short > 0 and self.padding(short) else "", " | "]
            if self.padding(starts[k] - starts[at]):
                parts += [" " * widths[i] + " | " for i in range(at, k)]
            elif last is not None:
                parts.append(" | ")
            at, last = k + 1, s
        return "".join([*parts, last or ""]).rstrip(" |")

    def cell(self, n: Node) -> list[str]:
        inner = Renderer(self.rules, self.room, self.mutes(n, self.muted))
        for c in n.children:
            inner.render(c)
        inner.flush()
        return [x for x in inner.lines if x]


def span(cell: Node, name: str, most: int) -> int:
    """Columns or rows of a cell; a row span of zero reaches to the end."""
    value = cell.attributes.get(name, "")
    if not (value.isascii() and value.isdecimal()):
        return 1
    n = min(int(value[:9]), most)
    return n or (most if name == "rowspan" else 1)


def walk(n: Node, tag: str) -> list[Node]:
    out = []
    for c in n.children:
        if isinstance(c, Node):
            out += [c] if c.tag == tag else walk(c, tag)
    return out


def inside(n: Node) -> frozenset[str]:
    """Which of ``ROWS`` are inside, nested tables aside; found once for each element."""
    if n.inside is None:
        found: set[str] = set()
        for c in n.children:
            if isinstance(c, Node) and c.tag != "table":
                found |= inside(c) | ({c.tag} & ROWS)
        n.inside = frozenset(found)
    return n.inside


def stray(c: Node | str) -> Node:
    out = Node("caption", {})
    out.children = [c]
    return out


def cells_of(row: Node, visible) -> list[Node]:
    """Visible cells in order, also those inside other elements; other content as captions."""
    out: list[Node] = []
    for c in row.children:
        if isinstance(c, str):
            if c.strip():
                out.append(stray(c))
        elif not visible(c):
            continue
        elif c.tag in ("td", "th"):
            out.append(c)
        elif c.tag != "table" and inside(c) & CELLS:
            out += cells_of(c, visible)
        else:
            out.append(stray(c))
    return out


def rows_of(table: Node, visible) -> list[Node]:
    """Rows and captions in order, also those inside other elements; stray cells make a row of their own, other content a caption."""
    out: list[Node] = []
    for c in table.children:
        if isinstance(c, str):
            if c.strip():
                out.append(stray(c))
        elif c.tag in ("tr", "caption"):
            out.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            out += rows_of(c, visible)
        elif c.tag in ("td", "th"):
            if not out or out[-1].tag != "tr" or not out[-1].attributes.get("#own"):
                out.append(Node("tr", {"#own": "1"}))
            out[-1].children.append(c)
        elif c.tag != "table" and inside(c):
            out += rows_of(c, visible) if visible(c) else []
        elif c.tag not in ("colgroup", "col"):
            out.append(stray(c))
    return out


def text_of(source: str | None) -> tuple[str, str | None]:
    """The visible text and the title of a page."""
    if not source:
        return "", None
    root = parse(source)
    title = find(root, "title")
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    r = Renderer(Rules(root), [ROOM * len(source) + LEAST_ROOM])
    for c in root.children:
        r.render(c)
    r.flush()
    return "\n".join(r.lines), _SPACE.sub(" ", "".join(c for c in title.children if isinstance(c, str))).strip() if title else None


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), html_col: str = "html") -> DataFrame:
    """The columns ``keep``, ``title`` and the visible ``text`` of every page."""
    n = len(keep)
    schema = T.StructType([*(pages.schema[c] for c in keep), *T._parse_datatype_string("title string, text string").fields])

    def run(batches):
        for part in slices(batches, n):
            found = [text_of(x) for x in part.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array([x[1] for x in found], pa.string()), pa.array([x[0] for x in found], pa.string())], names=schema.names)

    return pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate([*keep, html_col]))).mapInArrow(run, schema)
