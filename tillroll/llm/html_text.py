"""Operator 1: layout-aware text of HTML pages.

A tree is built as a browser would: tags close and open what they imply (a
paragraph ends before a block, a cell opens its row, end tags without a partner are
passed over), and script, style and the like are read as raw text. The tree is then laid out:
blocks on lines of their own with blank lines by their margins, list items
with marks and indents, preformatted text as it is, and table cells padded to their
columns. All text that a page shows is given, and none that it hides (``hidden``,
``display: none``, ``visibility: hidden``, closed ``details`` and ``dialog``, scripts, templates, the head).
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import free_name, table, with_values

DEEPEST = 150
WIDEST = 60


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# fixed values: element kinds
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes textarea title")
UNSEEN = _set("head title script style template noscript iframe noembed noframes datalist object audio video canvas "
              "svg math rp map area param")
MARGIN = _set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre figure table fieldset hr xmp")
BLOCK = MARGIN | _set("html body address article aside center details dialog dd dir div dt fieldset figcaption footer form header "
                      "hgroup legend li listing main nav optgroup option search section summary caption "
                      "tr thead tbody tfoot td th colgroup")
ENDS_P = MARGIN | _set("address article aside center details dialog dir div figcaption footer form header hgroup "
                       "listing main nav search section summary li dd dt")
# fixed values: open elements that a start tag closes, and where the search for them stops
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption colgroup", "table thead tbody tfoot"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby"),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ("thead tbody tfoot tr td th caption colgroup", "table")),
    **dict.fromkeys(("caption", "colgroup"), ("caption colgroup", "table")),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), ("h1 h2 h3 h4 h5 h6", "div section article td th li body")),
}
CLOSES = {k: (_set(a), _set(b)) for k, (a, b) in CLOSES.items()}
SCOPES = _set("table td th caption button object template html")
# fixed values: elements that hold only parts of a table, the open elements under which these parts stand, and what seals them off
TABLE_PARTS = _set("table thead tbody tfoot tr")
UNDER = {"tr": _set("table thead tbody tfoot"), "td": TABLE_PARTS, "th": TABLE_PARTS,
         **dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup", "col"), _set("table"))}
IN_TABLE = frozenset(UNDER) | _set("script style template")
SEALED = _set("template noscript svg math")
ENDS_ROWS = SEALED | _set("table")
HOLDS_TABLES = SEALED | _set("td th caption")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[\s/]++
        |[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z)))?+)*+)(?:>|\Z)""", re.S | re.X)
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+)))?+""")


class Node:
    __slots__ = ("name", "attrs", "inner")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.inner = name, attrs, []


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if rest and not rest.isspace():
        for name, *value in _ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), html.unescape("".join(value)))
    return found


def parse(page: str) -> Node:
    """The tree of a page. Elements deeper than ``DEEPEST`` become children of their last ancestor above it."""
    root = Node("html", {})
    stack = [root]
    at, n = 0, len(page)
    low = None

    def close(names: frozenset[str], stop: frozenset[str], all_of_them: bool = True) -> None:
        """Close the open elements of these names above the first of ``stop`` (or only the innermost), and all in them."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                if not all_of_them:
                    break
            elif stack[i].name in stop:
                break

    def back_to(names: frozenset[str]) -> bool:
        """Close the open elements above the innermost of these names, if there is one on this side of a sealed element."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i + 1:]
                return True
            if stack[i].name in SEALED:
                break
        return False

    def end_table() -> None:
        """Close the innermost table, unless a cell or caption of it is open: a table in parts of another ends that one."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "table":
                del stack[i:]
                break
            if stack[i].name in HOLDS_TABLES:
                break

    def table_above() -> int:
        """The place of the table whose part the innermost open element is (but no cell or caption), else 0."""
        if stack[-1].name == "colgroup":
            back_to(UNDER["colgroup"])
        i = len(stack) - 1
        while stack[i].name in TABLE_PARTS and stack[i].name != "table":
            i -= 1
        return i if stack[i].name == "table" else 0

    def add(item: str | Node, fostered: bool = True) -> None:
        """Append to the innermost open element; what cannot stand in a part of a table goes before the table."""
        i = table_above() if fostered else 0
        if i:
            stack[i - 1].inner.insert(-1, item)
        else:
            stack[-1].inner.append(item)

    def text(piece: str) -> None:
        if piece:
            add(piece, not piece.isspace())

    def implied(name: str) -> None:
        top = stack[-1].name
        if name in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})

    def push(name: str, attrs: dict[str, str]) -> Node:
        node = Node(name, attrs)
        add(node, name not in IN_TABLE)
        if name not in VOID and len(stack) < DEEPEST:
            stack.append(node)
        return node

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None or not m[0].endswith(">"):
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" and not any(x.name == "p" for x in stack):
                add(Node("p", {}))
            elif name == "br":
                add(Node("br", {}))
            elif name not in ("html", "body"):
                row_or_group = name in TABLE_PARTS and name != "table"  # ends the cell in it, too
                close(frozenset((name,)), ENDS_ROWS if row_or_group else frozenset() if name in SCOPES else SCOPES, False)
            continue
        attrs = _attributes(m["rest"])
        if name in ("html", "body"):
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            close(_set("head"), frozenset())
            continue
        if name in ENDS_P:
            close(_set("p"), SCOPES)
        if name == "table":
            end_table()
        if name == "form" and table_above():
            continue
        if name in CLOSES or name in UNDER:
            if not back_to(UNDER.get(name, frozenset())) and name in CLOSES:
                close(*CLOSES[name])
            implied(name)
        node = push(name, attrs)
        if name in RAW:
            low = low or page.lower()
            if len(low) != n:  # a letter whose lower case is longer
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = low.find(f"</{name}", at)
            end = n if end < 0 else end
            node.inner.append(page[at:end] if name in ("textarea", "title") else page[at:end].replace("&", "&amp;"))
            if stack[-1] is node:
                stack.pop()
            stop = page.find(">", end)
            at = n if stop < 0 else stop + 1
        elif name == "plaintext":
            node.inner.append(page[at:].replace("&", "&amp;"))
            at = n
    return root


class Page:
    """Lines as they are laid out: the current one, its indent, and the blank lines that are due."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = False
        self.due = 0
        self.indent = ""
        self.mark = ""

    def add(self, text: str) -> None:
        """Text of a line, white space collapsed."""
        own = text.split()
        if not own:
            self.gap = self.gap or (bool(text) and bool(self.current))
            return
        if self.current and (self.gap or text[0].isspace()):
            self.current.append(" ")
        self.current.append(" ".join(own))
        self.gap = text[-1].isspace()

    def line(self, blank: int = 0) -> None:
        """End the line; at least ``blank`` empty lines come before the next text."""
        if self.current:
            self._put("".join(self.current))
            self.current = []
        self.gap = False
        self.due = max(self.due, blank)

    def _put(self, text: str) -> None:
        if self.lines and self.due:
            self.lines.append("")
        self.due = 0
        self.lines.append(f"{self.indent[:len(self.indent) - len(self.mark)]}{self.mark}{text}" if self.mark else self.indent + text)
        self.mark = ""

    def exactly(self, text: str) -> None:
        for row in text.split("\n"):
            self._put(row.rstrip())

    def text(self) -> str:
        self.line()
        return "\n".join(x.rstrip() for x in self.lines)


def _seen(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element has a place in the layout, and whether its text is visible."""
    a = node.attrs
    style = a.get("style", "")
    if node.name in UNSEEN or "hidden" in a or (style and _HIDES.search(style)):
        return False, False
    if node.name == "input" and a.get("type", "").lower() == "hidden" or node.name == "dialog" and "open" not in a:
        return False, False
    m = _VISIBILITY.search(style) if style else None
    return True, visible if m is None else m[1].lower() == "visible"


def _number(value: str | None, low: int, high: int, usual: int) -> int:
    value = (value or "").strip()
    return min(max(int(value), low), high) if re.fullmatch("-?[0-9]{1,6}", value, re.A) else usual


def lay_out(node: Node, page: Page, visible: bool = True) -> None:
    """Add the element's visible text to ``page``."""
    ordinal = _number(node.attrs.get("start"), -99_999, 99_999, 1) if node.name == "ol" else 0
    closed = node.name == "details" and "open" not in node.attrs
    for child in node.inner:
        if isinstance(child, str):
            if visible and not closed:
                page.add(html.unescape(child) if "&" in child else child)
            continue
        name = child.name
        placed, shown = _seen(child, visible)
        if not placed or closed and name != "summary":
            continue
        if name == "br":
            page.line() if page.current else page.line(1)
        elif name == "hr":
            page.line(1)
        elif name in ("img", "input", "wbr"):
            said = child.attrs.get("alt" if name == "img" else "value")
            if said and shown:
                page.add(said)
        elif name == "table":
            page.line(1)
            _table(child, page, shown)
            page.line(1)
        elif name in ("pre", "listing", "xmp"):
            page.line(1)
            if shown:
                body = _plain(child).strip("\n")
                if body:
                    page.exactly(body)
            page.line(1)
        elif name == "li":
            mark = "- "
            if node.name == "ol":
                ordinal = _number(child.attrs.get("value"), -99_999, 99_999, ordinal)
                mark = f"{ordinal}. "
                ordinal += 1
            page.line()
            before = page.indent
            page.indent, page.mark = before + " " * len(mark), mark
            lay_out(child, page, shown)
            page.line()
            page.indent, page.mark = before, ""
        elif name in BLOCK:
            blank = 1 if name in MARGIN and not (name in ("ul", "ol", "menu", "dl") and node.name == "li") else 0
            page.line(blank)
            before = page.indent
            page.indent += "    " if name in ("dd", "blockquote") else ""
            lay_out(child, page, shown)
            page.line(blank)
            page.indent = before
        elif name == "q":
            page.add('"')
            page.gap = False
            lay_out(child, page, shown)
            page.gap = False
            page.current.append('"')
        else:
            lay_out(child, page, shown)


def _plain(node: Node) -> str:
    """The text as it is written, of what is visible."""
    parts = []
    for child in node.inner:
        if isinstance(child, str):
            parts.append(html.unescape(child))
        elif child.name == "br":
            parts.append("\n")
        elif all(_seen(child, True)):
            parts.append(_plain(child))
    return "".join(parts)


def _rows(node: Node, visible: bool) -> list[tuple[Node, bool]]:
    found = []
    for child in node.inner:
        if isinstance(child, Node) and _seen(child, visible)[0]:
            shown = _seen(child, visible)[1]
            if child.name == "tr":
                found.append((child, shown))
            elif child.name in ("thead", "tbody", "tfoot"):
                found += _rows(child, shown)
    return found


def _table(node: Node, page: Page, visible: bool) -> None:
    """Captions and stray text first, then rows with their cells padded to the columns.

    A cell of several lines or over ``WIDEST`` characters does not widen its column; lines within a cell are joined.
    """
    stray = Node("div", {})
    stray.inner = [x for x in node.inner if not (isinstance(x, Node) and x.name in ("tr", "thead", "tbody", "tfoot", "colgroup"))]
    lay_out(stray, page, visible)
    page.line()
    grid: list[list[tuple[str, int]]] = []
    for row, shown in _rows(node, visible):
        cells = []
        for child in row.inner:
            if isinstance(child, Node) and child.name in ("td", "th"):
                placed, own = _seen(child, shown)
                if placed:
                    inside = Page()
                    lay_out(child, inside, own)
                    cells.append((" ".join(inside.text().split("\n")).strip(), _number(child.attrs.get("colspan"), 1, 100, 1)))
            elif isinstance(child, str):
                if child.strip() and shown:
                    page.add(html.unescape(child))
            elif _seen(child, shown)[0]:
                lay_out(child, page, _seen(child, shown)[1])
        page.line()
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        at = 0
        for text, span in cells:
            if span == 1 and len(text) <= WIDEST:
                widths[at] = max(widths.get(at, 0), len(text))
            at += span
    for cells in grid:
        out, at = [], 0
        for text, span in cells:
            wide = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)
            out.append(text.ljust(wide))
            at += span
        if any(text for text, _ in cells):
            page.exactly(" | ".join(out))


def page_text(page: str | None) -> str | None:
    """The visible text of a page; null for null, empty for a page that shows nothing."""
    if page is None:
        return None
    laid = Page()
    root = parse(page)
    placed, shown = _seen(root, True)
    if placed:
        lay_out(root, laid, shown)
    return laid.text()


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html_column`` and with its visible text.

    Null stays null and empty pages give empty texts; broken and very deep markup
    is read as far as it goes; repeated rows give equal texts; an empty table gives no rows; other
    columns are kept, and a column called ``into`` makes the new one take underscores.
    """
    into = free_name(pages.drop(html_column), into)
    return with_values(pages, html_column, lambda ps: [page_text(p) for p in ps], into, T.StringType(), keep_text=False)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
