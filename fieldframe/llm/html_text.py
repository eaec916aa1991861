"""Layout-aware text of HTML pages.

A tree builder reads the markup, adds the end tags that HTML implies and leaves out what a browser does
not show; the renderer then lays the tree out as lines: blocks start lines, paragraphs are set apart by
a blank line, list items have markers and indents, table cells are aligned in columns, preformatted
text keeps its spaces. The text elements of drawings (SVG) and the parts of formulas (MathML) that stand
at different places are set apart by spaces. All visible text is emitted. What is shown follows the ``hidden``
attribute, closed ``dialog`` and ``details``, and ``display`` and ``visibility`` of ``style`` attributes and of those rules of
``style`` elements whose selectors are a tag, classes and an id (no combinators, nothing inside at-rules).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.shared import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes object audio video canvas datalist "
                   "area param source track colgroup rp".split())
# parts of drawings and formulas that are not shown; of the children of FIRST_SHOWN only the first is
UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient".split()),
             "math": frozenset("annotation annotation-xml mphantom".split())}
FIRST_SHOWN = frozenset("semantics maction".split())
# formula parts whose children stand at different places (above, below, raised), and the rows of formula tables
SPREAD = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtd".split())
FORMULA_ROWS = frozenset("mtr mlabeledtr".split())
# elements of drawings and formulas that hold HTML, and start tags of HTML that end a drawing or formula
HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
                       "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
# blocks with a blank line around them, and blocks that only start a line
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr xmp listing plaintext".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html "
                           "legend li main nav optgroup option search section summary caption".split())
# controls and annotations that stand apart from the text around them
APART = frozenset("button meter progress select output rt".split())
TABLE_PARTS = frozenset("caption thead tbody tfoot tr td th".split())
# start tag -> open elements that it ends, looked for up to the nearest of the second set
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "tr", "td", "th"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, set()),
}
# a start tag of a block ends an open paragraph, up to the nearest of these
SCOPE = frozenset("table td th caption html button object marquee".split())
IN_HEAD = frozenset("title meta link base style script noscript template head html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
OPEN = re.compile(r"(?:<!--.*|<![^>]*+|<\?[^>]*+)()()", re.S)  # what needs no ">"
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
AT_RULE = re.compile(r"@[^{;]*+(?:;|\{(?:[^{}]++|\{[^{}]*+\})*+\}?|\Z)")
RULE = re.compile(r"([^{}]++)\{([^{}]*+)(?:\}|\Z)")
SELECTOR = re.compile(r"([a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
LONG_NUMBER = re.compile(r"&#([0-9]{20,}+);?")
MAX_INDENT = 64  # levels of lists and quotations that indent further
MAX_COLUMN = 200  # a longer cell does not widen its column


class Node:
    """An element; ``space`` is "svg" or "math" for the elements of drawings and formulas."""

    __slots__ = ("tag", "attrs", "children", "space")

    def __init__(self, tag: str, attrs: dict[str, str], space: str = ""):
        self.tag, self.attrs, self.children, self.space = tag, attrs, [], space

    def inner(self) -> str:
        """``space`` of the elements it holds."""
        return "" if self.space and self.tag in HOLDS_HTML[self.space] else self.space


def _short_reference(m: re.Match) -> str:
    digits = m[1].lstrip("0") or "0"
    return f"&#{digits};" if len(digits) < 20 else "\ufffd"


def unescape(text: str) -> str:
    """Character references replaced; a number beyond any character is the replacement character."""
    return html.unescape(LONG_NUMBER.sub(_short_reference, text)) if "&" in text else text


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


def self_closed(text: str) -> bool:
    """True if the attributes of a tag end with a slash that is not part of a value without quotes."""
    if not text.endswith("/"):
        return False
    word = text.rsplit(None, 1)[-1]
    return word == "/" or word[-2] in "\"'" or "=" not in word


def declared(style: str) -> list[tuple[bool, str, str]]:
    """(important, property, value) of the declarations that decide what is shown."""
    return [(bool(m[3]), m[1].lower(), m[2].lower()) for m in SHOWING.finditer(COMMENT.sub("", style))]


class Sheet:
    """Rules of the ``style`` elements of a page that decide what is shown, by the last part of their selectors."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        order = 0
        for style in styles:
            for selectors, body in RULE.findall(AT_RULE.sub("", COMMENT.sub("", style))):
                said = declared(body)
                for selector in selectors.split(",") if said else ():
                    m = SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    order += 1
                    weight = (m[2].count("#"), m[2].count("."), bool(m[1]), order)
                    self.rules[parts[-1] if parts else m[1].lower()].append((weight, (m[1] or "").lower(), frozenset(parts), said))

    def shown(self, node: Node) -> dict[str, str]:
        """``display`` and ``visibility`` that rules, attributes and the style attribute give an element."""
        a, out = node.attrs, {}
        if node.space:
            out = {k: a[k] for k in ("display", "visibility") if k in a}
        found = []
        if self.rules:
            marks = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
            for key in (node.tag, *marks):
                for weight, tag, parts, said in self.rules.get(key, ()):
                    if tag in ("", node.tag) and parts <= marks:
                        found += [((important, 0, weight), name, value) for important, name, value in said]
        if "style" in a:
            found += [((important, 1, (0, 0, 0, k)), name, value) for k, (important, name, value) in enumerate(declared(a["style"]))]
        for _, name, value in sorted(found):
            out[name] = value
        return out


def hidden(node: Node, style: dict[str, str]) -> bool:
    """True if the element and all it holds are not shown."""
    a = node.attrs
    if node.space and node.tag in UNSEEN_IN[node.space] or node.tag in UNSEEN or node.tag == "dialog" and "open" not in a:
        return True
    if "hidden" in a and "display" not in style or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    return style.get("display") == "none"


def own_lines(node: Node) -> bool:
    """True for the parts of drawings and formulas that stand on lines of their own."""
    if node.space == "svg":
        return node.tag == "foreignobject"
    return node.tag in FORMULA_ROWS or node.tag == "math" and node.attrs.get("display") == "block"


def build_tree(text: str, styles: list[str] | None = None) -> Node:
    """Tree of elements and strings, with implied end tags; the content of ``style`` elements is added to ``styles``."""
    root = Node("html", {})
    stack = [root]
    count = Counter()  # open elements of each tag: nothing is looked for that is not open

    def push(node: Node) -> None:
        stack.append(node)
        count[node.tag] += 1

    def cut(low: int) -> None:
        count.subtract(n.tag for n in stack[low:])
        del stack[low:]

    def close(tags, scope) -> None:
        if not any(count[t] for t in tags):
            return
        low = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                low = k
            elif stack[k].tag in scope:
                break
        if low is not None:
            cut(low)

    def put(data: str) -> None:
        if data:
            if stack[-1].tag == "head" and data.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(unescape(data))

    at, last = 0, text.rfind(">")
    while True:
        # behind the last ">" only what needs no end can be markup
        m = (TOKEN if at <= last else OPEN).search(text, at)
        if m is None:
            put(text[at:])
            return root
        put(text[at:m.start()])
        at = m.end()
        space = stack[-1].inner()
        if not m[2]:
            if space and text.startswith("<![CDATA[", m.start()):
                stop = text.find("]]>", m.start())
                stop = len(text) if stop < 0 else stop
                stack[-1].children.append(text[m.start() + 9:stop])
                at = stop + 3
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not count["p"]:
                stack[-1].children.append(Node("p", {}))
            elif count[tag]:
                barrier = frozenset() if tag in ("table", "body", "html") else frozenset({"table"}) if tag in TABLE_PARTS else SCOPE - {tag}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in barrier:
                        break
            continue
        attrs = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag == "html":
            for name, value in attrs.items():
                root.attrs.setdefault(name, value)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if space and tag in BREAKS_OUT:
            low = len(stack)
            while stack[low - 1].inner():
                low -= 1
            cut(low)
            space = ""
        if tag in ("svg", "math"):
            space = tag
        if tag in BLOCK and not space:
            close({"p"}, SCOPE)
        if tag in ENDS and not space:
            close(*ENDS[tag])
        if not space and tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attrs, space)
        stack[-1].children.append(node)
        if tag in VOID or space and self_closed(m[3]):
            continue
        if tag in RAW and not space:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            if tag == "style" and styles is not None:
                styles.append(text[at:stop])
            if tag in ("textarea", "title", "xmp"):
                raw = text[at:stop]
                node.children.append(raw if tag == "xmp" else unescape(raw))
            at = end.end() if end else len(text)
            continue
        push(node)


class Box:
    """Lines of a block context; inline text is gathered in ``inline`` until the line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False  # a blank line is due before the next line
        self.space = False  # a space is due before the next inline text
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").expandtabs(8).split("\n")
            self.add(first)
            for line in rest:
                self.end_line(force=True)
                self.add(line)
            return
        if data[0] in " \t\n\r\f\v":
            self.space = True
        words = SPACE.sub(" ", data).strip(" ")
        if words:
            if self.space and self.inline and not self.inline[-1].endswith(" "):
                self.inline.append(" ")
            self.inline.append(words)
            self.space = data[-1] in " \t\n\r\f\v"

    def add(self, piece: str) -> None:
        if piece:
            if self.space and self.inline:
                self.inline.append(" ")
            self.space = False
            self.inline.append(piece)

    def end_line(self, force: bool = False) -> None:
        line = "".join(self.inline)
        self.inline, self.space = [], False
        if line.strip() or force:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        prefix = "".join(self.indent[:MAX_INDENT])
        if self.marker is not None:
            prefix, self.marker = (prefix[:len(prefix) - len(self.marker)] if len(self.indent) <= MAX_INDENT else prefix) + self.marker, None
        self.lines.append((prefix + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and self.marker is None:
            self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def width(line: str) -> int:
    """Columns that a line takes: wide characters take two, combining ones none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.next = 0  # column of the row's next cell
        self.spans: list[tuple[int, int, int]] = []  # (first column, stop, last row) of cells of earlier rows that reach into this one
        self.reach: list[tuple[int, int, int]] = []  # the same of cells of this row

    def start_row(self) -> None:
        self.rows.append([])
        self.next = 0
        if self.spans or self.reach:
            self.spans = sorted(s for s in self.spans + self.reach if s[2] >= len(self.rows))
            self.reach = []

    def start_group(self) -> None:
        """Cells do not reach beyond their group of rows."""
        self.spans, self.reach = [], []

    def add(self, cell: list[str], columns: int, rows: int) -> None:
        """A cell in the next columns that no cell of an earlier row reaches into; ``rows`` 0: up to the end of the group."""
        row = len(self.rows)
        for first, stop, _ in self.spans:
            if first < self.next + columns and self.next < stop:
                self.next = stop
        self.rows[-1].append((self.next, cell))
        self.next += columns
        if rows != 1:
            self.reach.append((self.next - columns, self.next, row + rows - 1 if rows else 1 << 30))

    def lines(self) -> list[str]:
        """Rows with the cells of a column starting at the same place; a line longer than ``MAX_COLUMN`` shifts
        what follows it in its row."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for k, cell in row:
                widths[k] = max(widths.get(k, 0), min(MAX_COLUMN, max(map(width, cell), default=0)))
        columns = sorted(widths)
        start, at = {}, 0
        for k in columns:
            start[k], at = at, at + widths[k] + 2
        out = []
        for row in self.rows:
            for n in range(max((len(cell) for _, cell in row), default=0)):
                pieces, size = [], 0
                for k, cell in row:
                    if n < len(cell) and cell[n]:
                        gap = max(start[k] - size, 2 if size else 0)
                        pieces += [" " * gap, cell[n]]
                        size += gap + width(cell[n])
                out.append("".join(pieces).rstrip())
        return out


def whole_number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"[0-9]{1,9}", text) else default


def numbering(node: Node) -> list[int] | None:
    """[next number, step] of a list, None for one without numbers."""
    if node.tag != "ol":
        return None
    down = "reversed" in node.attrs
    start = node.attrs.get("start", "")
    if re.fullmatch(r"-?\d{1,9}", start):
        return [int(start), -1 if down else 1]
    return [sum(not isinstance(c, str) and c.tag == "li" for c in node.children), -1] if down else [1, 1]


def render(root: Node, sheet: Sheet) -> list[str]:
    """Lines of the visible text of a tree; ``label`` counts the open text elements of drawings. The walk keeps its own stack: nesting depth is no limit."""
    boxes, tables, lists = [Box()], [], []
    veil: list[tuple[Node, bool]] = []  # open elements that say whether they are visible
    keep = label = 0
    walk: list[tuple] = [(root, False)]
    while walk:
        node, leaving = walk.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if not veil or veil[-1][1]:
                box.text(node, keep > 0)
            continue
        tag = node.tag
        if leaving and veil and veil[-1][0] is node:
            veil.pop()
        if not leaving:
            style = sheet.shown(node) if node.attrs or sheet.rules else {}
            if hidden(node, style):
                continue
            seen = style.get("visibility", "inherit")
            visible = seen not in ("hidden", "collapse") and (seen == "visible" or not veil or veil[-1][1])
            if tag in VOID and not node.space:
                if not visible:
                    continue
            elif seen != "inherit":
                veil.append((node, visible))
            if node.space:
                walk.append((node, True))
                shown = node.children
                if own_lines(node):
                    box.block(False)
                elif node.space == "svg":
                    if tag in ("text", "tspan", "textpath"):
                        box.space = box.space or tag != "tspan" or not node.attrs.keys().isdisjoint(("x", "y", "dy"))
                        label += tag == "text"
                    if not label and node.inner():
                        shown = [c for c in shown if not isinstance(c, str)]  # only text elements show text
                elif tag in FIRST_SHOWN:
                    first = next((c for c in shown if not isinstance(c, str)), None)
                    shown = [c for c in shown if isinstance(c, str) or c is first]
                elif tag in SPREAD:
                    shown = [" ", *(piece for c in shown for piece in (c, " "))]
                walk += [(child, False) for child in reversed(shown)]
                continue
            if tag == "br":
                box.end_line(force=bool(box.inline) or keep > 0)
                continue
            if tag == "img":
                if alt := node.attrs.get("alt", "").strip():
                    box.text(alt, False)
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") \
                        and (value := node.attrs.get("value", "").strip()):
                    box.text(f" {value} ", False)
                continue
            if tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].start_row()
                boxes.append(Box())
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and bool(lists)
                box.block(tag in SPACED and not nested)
            if tag in APART:
                box.space = True
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(numbering(node))
            elif tag == "li":
                marker = "- "
                if lists and lists[-1] is not None:
                    if re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                        lists[-1][0] = int(node.attrs["value"])
                    marker = f"{lists[-1][0]}. "
                    lists[-1][0] += lists[-1][1]
                box.marker = marker if visible else None
                box.indent.append(" " * len(marker))
            elif tag in ("dd", "blockquote"):
                box.indent.append("    ")
            elif tag == "table":
                tables.append(Table())
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].start_group()
            elif tag == "tr" and tables:
                tables[-1].start_row()
            elif tag in ("pre", "xmp", "listing", "plaintext", "textarea"):
                keep += 1
            elif tag == "hr":
                continue
            walk.append((node, True))
            shown = node.children
            if tag == "details" and "open" not in node.attrs:
                shown = [c for c in shown if not isinstance(c, str) and c.tag == "summary"]
            walk += [(child, False) for child in reversed(shown)]
            continue
        if node.space:
            if node.space == "svg" and tag == "text":
                box.space = True
                label -= 1
            elif own_lines(node):
                box.block(False)
            continue
        if tag in ("td", "th") and tables:
            columns = max(1, min(whole_number(node.attrs.get("colspan", "1"), 1), 1000))
            tables[-1].add(boxes.pop().done(), columns, min(whole_number(node.attrs.get("rowspan", "1"), 1), 65534))
            continue
        if tag in APART:
            box.space = True
        if tag in ("pre", "xmp", "listing", "plaintext", "textarea"):
            keep -= 1
        if tag == "table":
            table = tables.pop()
            box.end_line()
            for line in table.lines():
                box.put(line)
        if tag in BLOCK:
            box.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            box.marker = None
            box.indent.pop()
        elif tag in ("dd", "blockquote"):
            box.indent.pop()
    return boxes[0].done()


def page_text(markup: str | None) -> str | None:
    """Visible text of a page; null stays null and an empty page is empty."""
    if markup is None:
        return None
    styles: list[str] = []
    tree = build_tree(markup, styles)
    lines = render(tree, Sheet(styles))
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).replace("\xa0", " ")


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of each whole page in ``text_col`` (replaced if it is there).

    Null html gives null, html without visible text the empty string; markup may be broken or cut off.
    Every row is handled by itself, so repeated rows give repeated texts and an empty table none.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(markup: pd.Series) -> pd.Series:
        return markup.map(page_text)

    return pages.withColumn(text_col, extract(F.col(f"`{html_col}`")))
