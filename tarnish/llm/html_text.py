"""HTML extraction: a tree with implied tags, visibility rules, and a layout of plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.common import small_batches, text_of

#: Element names of the HTML standard by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist".split())
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = MARGIN | set(
    "html body div article section nav aside header footer main address form li dt dd figcaption details summary legend "
    "center caption hgroup search dialog tr thead tbody tfoot".split()
)
#: An opening tag ends these open elements, looking up the tree as far as the barrier of the tag.
ENDS_P = BLOCK - set("html body li dt dd tr thead tbody tfoot caption legend summary figcaption".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
#: What may stand in a head; any other element ends it.
HEAD = set("html head base basefont bgsound link meta title script style template noscript noframes".split())
BARRIER = set("table td th caption button object html body template".split())
#: Browsers flatten deeper trees as well; it bounds the recursion.
DEPTH = 200
#: A table whose cells are single lines up to this width is laid out in columns.
CELL = 60

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CSS = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|[{};]|[^{};\"']+", re.DOTALL)
SHOWING = re.compile(r"\s*(display|visibility)\s*:\s*([\w\s-]+?)\s*(!\s*important)?\s*", re.IGNORECASE)
#: Media queries that always hold on a screen.
ALWAYS = {"", "all", "screen", "only all", "only screen", "not print"}
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(source: str) -> tuple[Node, dict[str, dict[str, tuple]]]:
    """The tree, and what style sheets say on the visibility of simple selectors (tag, .class, #id):
    per selector and property its rank and whether it hides."""
    root = Node("#root", {})
    stack, hidden, at = [root], {}, 0
    while True:
        found = TOKEN.search(source, at)
        if text := source[at : found.start() if found else len(source)]:
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                stack.pop()
            stack[-1].children.append(html.unescape(text))
        if not found:
            return root, hidden
        at = found.end()
        closing, opening = found[1], found[2] or found[4]
        if closing:
            _close(stack, closing.lower())
        elif opening:
            tag = opening.lower()
            written = found[3] or found[5] or ""
            pairs = ATTRIBUTE.findall(written) if written.strip(" \t\n\r\f/") else ()
            attributes = {name.lower(): html.unescape(a or b or c) for name, a, b, c in pairs}
            _imply(stack, tag)
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE).search(source, at)
                inside, at = source[at : end.start()], end.end()
                if tag == "style" and _always(attributes.get("media", "")):
                    _read_sheet(inside, hidden)
                elif tag == "textarea":
                    node.children.append(html.unescape(inside))
            elif tag not in VOID and len(stack) < DEPTH:
                stack.append(node)


def _always(media: str) -> bool:
    """Whether one of the media queries holds on a screen whatever its size."""
    return any(" ".join(query.lower().split()) in ALWAYS for query in media.split(","))


def _declarations(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declaration of all rules that hold without a condition, in order."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL)
    stack, piece = [(True, "")], ""
    for token in [*CSS.findall(re.sub(r"<!--|-->", " ", sheet)), ";"]:
        if token not in ("{", "}", ";"):
            piece += token
            continue
        holds, selectors = stack[-1]
        if token == "{":
            at_rule = re.fullmatch(r"\s*@([\w-]+)(.*)", piece, re.DOTALL)
            if at_rule:
                name = at_rule[1].lower()
                holds = holds and (name == "layer" or (name == "media" and _always(at_rule[2])))
            else:
                # a rule inside a rule depends on where its element stands
                holds, selectors = holds and not selectors, piece
            stack.append((holds, selectors))
        else:
            if holds and selectors:
                yield selectors, piece
            if token == "}" and len(stack) > 1:
                stack.pop()
        piece = ""


def _showing(declaration: str, rank: int, order: int) -> tuple[str, tuple] | None:
    """The property, and its rank followed by whether it hides; nothing for other declarations."""
    found = SHOWING.fullmatch(declaration)
    if not found:
        return None
    hides = found[2].lower() in (("none",) if found[1].lower() == "display" else ("hidden", "collapse"))
    return found[1].lower(), (bool(found[3]), rank, order, hides)


def _read_sheet(sheet: str, hidden: dict[str, dict[str, tuple]]) -> None:
    """Add a style sheet's rules. Important ones win, then ids over classes over tags, then the last."""
    order = max((r[2] for h in hidden.values() for r in h.values()), default=0)
    for selectors, declaration in _declarations(sheet):
        for selector in map(str.strip, selectors.split(",")):
            if not re.fullmatch(r"[.#]?[\w-]+", selector):
                continue
            rank = 2 if selector[0] == "#" else int(selector[0] == ".")
            if found := _showing(declaration, rank, order := order + 1):
                own = hidden.setdefault(selector if rank else selector.lower(), {})
                own[found[0]] = max(found[1], own.get(found[0], found[1]))


def _imply(stack: list[Node], tag: str) -> None:
    """Close what the opening tag ends by implication, and open the row that a cell needs."""
    if tag not in HEAD:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "template":
                break
            if stack[i].tag == "head":
                del stack[i:]
                break
    _end(stack, tag)
    if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot") and len(stack) < DEPTH:
        row = Node("tr", {})
        stack[-1].children.append(row)
        stack.append(row)


def _end(stack: list[Node], tag: str) -> None:
    ended, barrier = ENDS.get(tag, (set(), set()))
    if tag in ENDS_P:
        ended, barrier = ended | {"p"}, barrier | BARRIER
    if not ended:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in barrier:
            return
        if stack[i].tag in ended:
            # for rows, go on to the outermost part that ends
            while i > 1 and tag in ("tr", "thead", "tbody", "tfoot") and stack[i - 1].tag in ended:
                i -= 1
            del stack[i:]
            return


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html"):
            return  # a cell is not left by a stray end tag
    if tag == "p":
        stack[-1].children.append(Node("p", {}))


class Page:
    """Lines written so far. Inline text collapses its white space; blocks ask for line breaks."""

    def __init__(self, hidden: dict[str, dict[str, tuple]]):
        self.hidden, self.lines, self.line, self.gap, self.indent, self.mark = hidden, [], "", 0, "", ""
        self.space = False

    def text(self, piece: str) -> None:
        flat = SPACE.sub(" ", piece)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if (self.space or flat[0] == " ") and self.line:
            self.line += " "
        self.line += flat.strip(" ")
        self.space = flat[-1] == " "

    def break_line(self, blank: bool = False) -> None:
        if self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append(self.indent + self.mark + self.line)
            self.mark = " " * len(self.mark)
            self.line, self.gap = "", 0
        self.space = False
        self.gap = self.gap or int(blank)

    def visible(self, node: Node) -> bool:
        a = node.attributes
        if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
            return False
        written = a.get("style", "")
        if not self.hidden and not written:
            return True
        names = [node.tag, "#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())] if self.hidden else []
        said = [item for name in names for item in self.hidden.get(name, {}).items()]
        said += filter(None, (_showing(d, 3, i) for i, d in enumerate(written.split(";")))) if written else []
        best = {}
        for what, rank in said:
            best[what] = max(rank, best.get(what, rank))
        return not any(rank[-1] for rank in best.values())

    def render(self, node: Node) -> None:
        tag = node.tag
        if tag == "br":
            if self.line:
                self.break_line()
            else:
                self.gap = 1
            return
        if tag == "input" and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
            self.text(node.attributes.get("value", ""))
        if tag in ("pre", "textarea"):
            self.preformatted(node)
            return
        if tag == "table":
            self.table(node)
            return
        block = tag in BLOCK
        nested = tag in ("ul", "ol", "menu") and self.mark
        if block:
            self.break_line(tag in MARGIN and not nested)
        if tag in ("ul", "ol", "menu", "blockquote", "dd"):
            outer = self.indent, self.mark
            self.indent, self.mark = self.indent + (" " * len(self.mark) or "  " * (tag in ("blockquote", "dd"))), ""
            self.children(node, tag)
            self.break_line()
            self.indent, self.mark = outer
        else:
            self.children(node, tag)
        if block:
            self.break_line(tag in MARGIN and not nested)

    def children(self, node: Node, tag: str) -> None:
        number = node.attributes.get("start", "1")
        number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif self.visible(child):
                if child.tag == "li":
                    self.break_line()
                    self.mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    self.render(child)
                    self.break_line()
                    self.mark = ""
                else:
                    self.render(child)

    def preformatted(self, node: Node) -> None:
        self.break_line(True)
        stack, pieces = [node], []
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                pieces.append(top)
            elif top.tag == "br":
                pieces.append("\n")
            elif top is node or self.visible(top):
                stack.extend(reversed(top.children))
        text = "".join(pieces).replace("\r\n", "\n").strip("\n")
        if text.strip():
            if self.lines:
                self.lines.append("")
            self.lines.extend(self.indent + line.rstrip() for line in text.split("\n"))
        self.gap = 1

    def table(self, node: Node) -> None:
        """Rows of cells in columns where every cell is short, else one cell under the other."""
        self.break_line(True)
        rows, captions = [], []

        def walk(part: Node) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if child.strip():
                        self.text(child)  # misplaced text stands before the table
                elif self.visible(child):
                    if child.tag in ("caption", "tr"):
                        (captions if child.tag == "caption" else rows).append(child)
                    elif child.tag in ("thead", "tbody", "tfoot"):
                        walk(child)
                    else:
                        self.render(child)

        walk(node)
        for caption in captions:
            self.render(caption)
        self.break_line(True)
        grid = []
        for row in rows:
            cells = []
            for cell in row.children:
                if isinstance(cell, str):
                    cells += [([cell.strip()])] if cell.strip() else []
                elif self.visible(cell):
                    inner = Page(self.hidden)
                    inner.children(cell, cell.tag)
                    inner.break_line()
                    cells.append(inner.lines)
                    span = cell.attributes.get("colspan", "1")
                    cells += [[]] * (min(int(span), 1000) - 1 if re.fullmatch(r"\d{1,9}", span) else 0)
            if any(cells):
                grid.append(cells)
        if all(len(c) < 2 and all(len(x) <= CELL for x in c) for row in grid for c in row):
            flat = [[c[0] if c else "" for c in row] for row in grid]
            width = [max((len(r[i]) for r in flat if i < len(r)), default=0) for i in range(max(map(len, flat), default=0))]
            lines = ["  ".join(c.ljust(width[i]) for i, c in enumerate(r)).rstrip() for r in flat]
        else:
            lines = [line for row in grid for cell in row for line in cell]
        if lines:
            if self.lines:
                self.lines.append("")
            self.lines.extend(self.indent + line for line in lines)
        self.gap = 1


def visible_text(source: str) -> str:
    """All visible text of a page, laid out in lines."""
    root, hidden = parse(source)
    page = Page(hidden)
    page.children(root, "#root")
    page.break_line()
    return "\n".join(page.lines).replace("\xa0", " ")


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, n_chars``: the visible text of every page.

    Opening tags end elements by implication (paragraphs, list items, rows, cells); scripts, heads,
    hidden elements and what a style sheet's simple rules hide are left out. Blocks stand on lines
    of their own, paragraphs and headings with a blank line between, list items behind a dash or
    number and indented by depth, table cells in aligned columns.

    Null and empty pages, and pages without visible text, give empty text. Broken markup is read
    as far as it goes. Repeated rows each have a row, null ids stay null, an empty table gives an
    empty result, other columns are not looked at. Row by row, no shuffle.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([visible_text(page) for page in column], dtype=object)

    rows = pages.select(pages[id_col].alias("page_id"), run(text_of(pages, html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text"))
