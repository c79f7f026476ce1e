"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer feeds a tree builder that opens and closes elements as their content demands
(implied ends of paragraphs, list items, table cells; void elements; unclosed and stray
tags). Elements that are not shown are built by the same rules, so that they end where a
reader's browser ends them, but are left out of the tree: ``head`` (which the first tag or
text that is no head content ends), scripts, styles, templates, ``datalist``, the fallbacks
of ``audio``, ``video`` and ``canvas``, descriptions and definitions in ``svg``, annotations
in ``math``, closed ``dialog`` and ``details`` elements (of these the summary is shown),
``hidden`` attributes and ``display:none``. Text under ``visibility:hidden`` is
left out up to a descendant with ``visibility:visible``. Both count in style attributes and
in rules of the page's own style sheets whose selectors are a tag, classes or an id, in
``@media`` blocks for screens or all media too (rules under other conditions, and other
selectors, are passed over). The renderer keeps the spacing of
blocks, marks and indents list items, numbers ordered ones, keeps the white space of
``pre``, and aligns the columns of tables, cells over several columns or rows included. All
visible text is emitted. Time grows with the length of a page, however deep it is.

A column is as wide as its widest cell, up to ``WIDEST`` characters; longer cells stand out
of it. No gap in front of a cell and no indent is wider than ``GAP``, so deep lists and
cells far to the right do not make a text of another order of size.

Defined results: null or empty pages give an empty text; a page of any depth or length is
rendered whole, without recursion; repeated rows are rendered one by one; other columns
pass through in ``row``.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import as_row

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"""
    r"""<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Declarations that decide whether something is seen.
DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: What may hold a style sheet, or look like one; rules of a sheet; selectors that are understood.
SHEETS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|textarea|title|xmp)\b.*?(?:</\1\b|\Z)|<style\b([^>]*)>(.*?)(?:</style\b|\Z)", re.S | re.I)
BRACES = re.compile("[{};]")
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][a-z_-][\w-]*)*)", re.I)
INTEGER = re.compile(r"\s*([+-]?\d{1,10})(?!\d)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"))
UNSEEN = frozenset("head script style template title noembed noframes iframe datalist audio video canvas".split())
#: Not shown within svg or math.
UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol".split()), "math": frozenset(("annotation", "annotation-xml"))}
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements that no tag inside can close along with one outside.
WALLS = frozenset(("template", "object"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Blocks set off by an empty line.
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
#: A start tag ends these open elements, looking up to the given containers.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
}
#: Characters to which a column grows, and a gap before a cell or an indent.
WIDEST, GAP = 250, 100
#: The largest numbers of columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    """An element; children are nodes and texts."""

    __slots__ = ("tag", "children", "start", "span", "seen", "shut")

    def __init__(self, tag: str, seen: bool = True):
        self.tag, self.seen, self.children, self.shut = tag, seen, [], False
        self.start: int | None = None  # number of a list or list item
        self.span = (1, 1)  # columns and rows of a cell


class Sheet:
    """Which elements the page's own style sheets hide or show."""

    def __init__(self, page: str):
        #: By the rarest part of a selector: (tag, all classes and ids), and by property weight and value.
        self.rules: dict[str, dict[tuple, dict[str, tuple]]] = {}
        if "<style" not in page.lower():
            return
        merged: dict[tuple, dict[str, tuple]] = {}
        for order, (selector, declared) in enumerate(self._selectors(page)):
            marks = frozenset(re.findall(r"[.#][\w-]+", selector[2]))
            tag = (selector[1] or "*").lower()
            weight = (0, sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*", order)
            best = merged.setdefault((tag, marks), {})
            for key, value, important in declared:
                best[key] = max(best.get(key, ((),)), ((important, *weight), value))
        used = Counter(x for _, marks in merged for x in marks)
        for (tag, marks), best in merged.items():
            self.rules.setdefault(min(marks, key=lambda x: (used[x], x)) if marks else tag, {})[tag, marks] = best

    @staticmethod
    def _selectors(page: str):
        """Selectors that are understood, as matches, with the declarations that matter."""
        for m in SHEETS.finditer(page):
            media = re.search(r"media\s*=\s*[\"']?([^\"'>]*)", m[2] or "", re.I)
            if m[3] is None or (media and not re.search(r"\b(all|screen)\b", media[1].lower() or "all")):
                continue
            for selectors, body in RULE.findall(_without_blocks(re.sub(r"(?s)/\*.*?(?:\*/|\Z)", " ", m[3]))):
                declared = [(k.lower(), v.lower(), bool(i)) for k, v, i in DECLARED.findall(body)]
                for selector in selectors.split(",") if declared else ():
                    parts = SELECTOR.fullmatch(selector.strip())
                    if parts and parts[0]:
                        yield parts, declared

    def of(self, tag: str, given: dict[str, str]) -> dict[str, str]:
        """``display`` and ``visibility`` of an element by rules and its style attribute."""
        found: dict[str, tuple] = {}

        def offer(key: str, declared: tuple) -> None:
            found[key] = max(found.get(key, ((),)), declared)

        if self.rules:
            marks = {"." + c for c in given.get("class", "").split()} | ({"#" + given["id"].strip()} if given.get("id") else set())
            for key in (*marks, tag, "*"):
                for (name, wanted), best in self.rules.get(key, {}).items():
                    if name in (tag, "*") and wanted <= marks:
                        for k, declared in best.items():
                            offer(k, declared)
        for i, (k, v, important) in enumerate(DECLARED.findall(given.get("style", ""))):
            offer(k.lower(), ((bool(important), 1, 0, 0, False, i), v.lower()))
        return {k: v[1] for k, v in found.items()}


def _without_blocks(sheet: str) -> str:
    """A sheet without its at-rules and the rules in them; those for screens stay."""
    out, at = [], 0
    for m in re.finditer("@", sheet):
        if m.start() < at:
            continue
        out.append(sheet[at : m.start()])
        if shown := SCREEN.match(sheet, m.start()):
            at = shown.end()  # its closing brace, left over, belongs to no rule
            continue
        depth, at = 0, len(sheet)
        for x in BRACES.finditer(sheet, m.start()):
            depth += {"{": 1, "}": -1, ";": 0}[x[0]]
            if depth <= 0:
                at = x.end()
                break
    return "".join([*out, sheet[at:]])


#: A tag with none of these needs no look at its attributes, unless the page has style rules.
TELLING = re.compile("hidden|none|visib|start|value|span|open", re.I)
#: Media queries that hold on a screen whatever its size.
SCREEN = re.compile(r"@media\s+(?:[^{};]*,)?\s*(?:only\s+)?(?:screen|all)\s*(?:,[^{};]*)?\{", re.I)


def _integer(value: str | None) -> int | None:
    """A 32-bit number at the start of an attribute."""
    m = INTEGER.match(value or "")
    return int(m[1]) if m and abs(int(m[1])) < 1 << 31 else None


def parse(page: str) -> Node:
    """The tree of the visible elements and texts of a page."""
    root, sheet = Node("html"), Sheet(page)
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # where open elements of a tag are in the stack
    at = 0

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(s: str) -> None:
        if s and places.get("head") and stack[-1].tag == "head" and not s.isspace():
            end_head()
        if s and stack[-1].seen and not stack[-1].shut:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(ends: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the innermost element among ``ends`` that no element of ``within`` holds."""
        i = innermost(ends)
        if i and i > max(innermost(within), innermost(WALLS - set(ends))):
            cut(i)

    def end_head() -> None:
        """Close the head, unless something other than ``noscript`` is open in it."""
        i = len(stack) - 1
        while stack[i].tag == "noscript":
            i -= 1
        if stack[i].tag == "head":
            cut(i)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if places.get("head") and (tag in ("body", "html", "br") if ending else tag not in HEAD):
            end_head()
        if ending:
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close((tag,), ("table",) if tag not in ("table", "body", "html") and tag not in BLOCK else ())
            continue
        if tag in ("html", "body"):
            continue
        if tag == "head" and (len(stack) > 1 or any(not isinstance(x, str) or x.strip() for x in root.children)):
            continue
        hidden = tag in UNSEEN or any(places.get(t) and tag in within for t, within in UNSEEN_IN.items())
        given = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in ATTRIBUTE.finditer(m[3])} if m[3] and (sheet.rules or TELLING.search(m[3])) else {}
        foreign = tag in UNSEEN_IN or any(places.get(t) for t in UNSEEN_IN)
        style = sheet.of(tag, given) if sheet.rules or given else {}
        hidden |= style.get("display") == "none" or ("hidden" in given and "display" not in style) or (tag == "input" and given.get("type", "").lower() == "hidden")
        hidden |= tag == "dialog" and "open" not in given and "display" not in style
        if tag in BLOCK:
            close(("p",), ("td", "th", "table", "li", "button"))
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", stack[-1].seen)
            stack[-1].children.append(row)
            push(row)
        seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), stack[-1].seen)
        node = Node(tag, seen)
        if given:
            node.start = _integer(given.get("start" if tag == "ol" else "value")) if tag in ("ol", "li") else None
            if tag in ("td", "th"):
                columns, rows = (_integer(given.get(k)) for k in ("colspan", "rowspan"))
                # no rows means all that follow
                node.span = (min(max(columns or 1, 1), MOST_COLUMNS), MOST_ROWS if rows == 0 else min(max(rows or 1, 1), MOST_ROWS))
        node.shut = tag == "details" and "open" not in given
        above = stack[-1]
        if not hidden and not (above.shut and (tag != "summary" or above.start)):
            above.children.append(node)
            above.start = 1 if above.shut else above.start  # only the first summary is shown
        if tag in RAW:
            end = _after_raw(page, tag, at)
            inner = page[at:end]
            if seen:
                node.children.append(html.unescape(inner[: inner.rfind("<")] if end > at and inner.endswith(">") else inner))
            at = end
        elif tag not in VOID and not (foreign and m[3].endswith("/")):
            push(node)
    return root


def _after_raw(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


class Lines:
    """Text laid out so far: collapsed spaces, line ends, empty lines and indents."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent = ""
        self.mark: str | None = None  # of a list item that has no text yet

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space |= bool(s)
            return
        if not self.line:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.line.append(self.indent[: -len(self.mark)][:GAP] + self.mark if self.mark else self.indent[:GAP])
            self.mark = None
        elif self.space or s[0].isspace():
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = s[-1].isspace()

    def raw(self, s: str) -> None:
        """Text of ``pre``: spaces and line ends stay."""
        for i, part in enumerate(s.split("\n")):
            if i:
                self.end(keep=True)
            if part:
                if not self.line:
                    if self.gap and self.done:
                        self.done.append("")
                    self.gap = False
                    self.line.append(self.indent[:GAP])
                self.line.append(part)

    def end(self, gap: bool = False, keep: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
        elif keep:
            self.done.append("")
        self.line, self.space = [], False
        self.gap |= gap

    def rows(self, lines: list[str]) -> None:
        """Finished lines, set off by empty ones."""
        self.end(gap=True)
        if lines and self.gap and self.done:
            self.done.append("")
        indent = self.indent[:GAP]
        self.done.extend([(indent + x).rstrip() for x in lines] if indent else lines)
        self.gap = bool(lines)

    def result(self) -> list[str]:
        self.end()
        return self.done


def _align(rows: list[list[tuple[list[str], tuple[int, int]]]]) -> list[str]:
    """Lines of a table from its cells (lines, columns and rows spanned): columns padded to their widest cell."""
    placed: list[list[tuple[int, int, list[str]]]] = []  # first column, column behind, lines
    soonest = -1  # the first row behind one of those below
    below: list[tuple[int, int, int]] = []  # first column, column behind, row behind of cells from above, by column
    for number, row in enumerate(rows):
        if 0 <= soonest <= number:
            below = [x for x in below if x[2] > number]
            soonest = min((x[2] for x in below), default=-1)
        line, at, i, deeper = [], 0, 0, []
        for cell, (columns, deep) in row:
            while i < len(below) and below[i][0] <= at:
                at = max(at, below[i][1])
                i += 1
            line.append((at, at + columns, cell))
            if deep > 1:
                deeper.append((at, at + columns, MOST_ROWS if deep == MOST_ROWS else number + deep))
            at += columns
        for x in deeper:
            i = bisect.bisect_left(below, x)
            if i and below[i - 1][1:] == (x[0], x[2]):  # side by side, down to the same row
                below[i - 1] = (below[i - 1][0], *x[1:])
            else:
                below.insert(i, x)
            soonest = x[2] if soonest < 0 else min(soonest, x[2])
        placed.append(line)
    if all(len(line) < 2 and not any(a for a, _, _ in line) for line in placed):  # one column
        return placed[0][0][2] if len(placed) == 1 and placed[0] else [x for line in placed for _, _, cell in line for x in cell]
    # only columns in which a cell begins count
    begins = {c: i for i, c in enumerate(sorted({a for line in placed for a, _, _ in line}))}
    order = list(begins)
    cells = [[(begins[a], bisect.bisect_left(order, b), cell, min(WIDEST, max([0, *map(len, cell)]))) for a, b, cell in line] for line in placed]
    width = [0] * len(order)
    for line in cells:
        for a, b, _, wide in line:
            if b - a == 1:
                width[a] = max(width[a], wide)
    for line in cells:
        for a, b, _, wide in line:
            if 1 < b - a <= WIDEST:  # what a cell over several columns lacks goes to the last
                width[b - 1] = max(width[b - 1], wide - sum(width[a : b - 1]) - 3 * (b - 1 - a))
    starts = [0]
    for w in width:
        starts.append(starts[-1] + w + 3)
    out = []
    for line in cells:
        for k in range(max([0, *(len(cell) for _, _, cell, _ in line)])):
            parts: list[str] = []
            at = 0
            for a, b, cell, _ in line:
                if parts:
                    parts.append(" | ")
                parts.append(" " * min(GAP, starts[a] - at))
                parts.append((cell[k] if k < len(cell) else "").ljust(min(WIDEST, starts[b] - starts[a] - 3)))
                at = starts[b]
            out.append("".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    lines = Lines()
    outer: list[Lines] = []  # layouts around open table cells
    tables: list[list[list[tuple]]] = []  # rows of cells: lines, span
    lists: list[list] = []  # kind and next number
    pre = 0
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        if isinstance(node, str):
            (lines.raw if pre else lines.text)(node)
            continue
        tag = node.tag
        if not leaving:
            if tag == "br":
                lines.end(keep=not lines.line and bool(lines.done) and not lines.gap)
                continue
            if tag in ("td", "th") and tables:
                outer.append(lines)
                lines = Lines()
                if not tables[-1]:
                    tables[-1].append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                lines.end(gap=True)
                tables.append([])
            elif tag in BLOCK:
                lines.end(gap=tag in APART and not (tag in ("ul", "ol") and lists) and lines.mark is None)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, 1 if node.start is None else node.start])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    if node.start is not None:
                        lists[-1][1] = node.start
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                lines.mark = mark
                lines.indent += " " * len(mark)
                node.start = len(mark)
            elif tag in ("dd", "blockquote"):
                lines.indent += "  "
            elif tag == "pre":
                pre += 1
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("td", "th") and tables:
            cell = lines.result()
            lines = outer.pop()
            tables[-1][-1].append((cell, node.span))
        elif tag == "table":
            lines.rows(_align(tables.pop()))
        elif tag in BLOCK and tag != "tr":
            lines.end(gap=tag in APART and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            lines.indent, lines.mark = lines.indent[: -node.start], None
        elif tag in ("dd", "blockquote"):
            lines.indent = lines.indent[:-2]
        elif tag == "pre":
            pre -= 1
    return "\n".join(lines.result()).strip("\n")


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def html_text():
    """A vectorised UDF html -> visible text."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(page_text, na_action=None)

    return extract


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``row`` (the input row) and ``text``."""
    return pages.select(as_row(pages).alias("row")).withColumn("text", html_text()(F.col("row")[html].cast("string")))
