"""HTML extraction: a tree builder with implied tags and visibility rules, then a layout-aware rendering.

All visible text comes out, boilerplate included. Blocks stand on lines of their own, paragraph-like blocks with an empty
line between them; list items carry ``-`` or their number, nested ones are indented; table cells are padded so that
columns align and are joined by `` | `` (a cell of several rows stands in its first, its place is empty in the others); preformatted text keeps its white space, other white space collapses.

Hidden: head, script, style, template and embedded-media fallbacks; hidden inputs; what a closed ``details`` folds away;
and elements whose ``display`` is none or whose ``visibility`` is hidden, by the ``hidden`` attribute, inline or by a style
sheet of the page. Of rules the important, then the more specific, then the later one wins; selectors may name tags,
classes, ids, attributes, ancestors, parents and siblings before, and use ``:not``, ``:is``, ``:where``, ``:root``,
``:empty`` and the child pseudo-classes of ``CHILD``; rules may be nested. Selectors with other pseudo-classes are left
out. Classes and ids are told apart by case in a page with a doctype and only there.
``visibility`` is inherited, and a descendant may be visible again. ``aria-hidden`` text is visible and stays.

Null and empty pages give empty text; other columns are ignored; every row gives a row. A page is parsed in one pass
over its bytes with memory in proportion to that page, however deep it is nested; tables nested more than ``TABLES``
deep lose their alignment, not their text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = 64
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe object canvas audio video datalist noembed noframes title meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form li dt dd tr caption details summary figcaption center legend option optgroup thead tbody tfoot td th hgroup search dialog".split())
CLOSES_P = SPACED | frozenset("div section article header footer nav aside main address form details summary center dialog hgroup search figcaption li dt dd".split())
#: A start tag: open elements that it ends, and those that stop the search for them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)(?:>|\Z))", re.S)
DOCTYPE = re.compile(r"<!doctype\s+html\b", re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: In svg and math: what isn't shown, and what stands apart from its neighbours.
FOREIGN_UNSEEN = frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
FOREIGN_APART = frozenset("text mtr mtd mfrac".split())
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
MARK = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|([{};])", re.S)
SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)([^;]*)", re.I)
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)")
#: Pages are read as on a screen of so many pixels' width.
SCREEN = 1280
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "before", "children", "latest", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.latest: Node | None = None  # its last child element
        self.before = parent.latest if parent else None  # the sibling element before it
        if parent:
            parent.latest = self


def parse(page: str) -> tuple[Node, list[str], bool]:
    """The tree, the contents of style elements, and whether the page has a doctype. Without a doctype, ids and classes come in lower case."""
    root = Node("html", {})
    stack, styles, at = [root], [], 0
    strict = seen = False  # whether a doctype stands before the first tag
    opened: dict[str, int] = {}  # how many of each tag are open, so that a tag without any needs no search

    def close_from(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw))

    def end(tags: set[str], bounds: set[str]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close_from(i)
                return
            if stack[i].tag in bounds or stack[i].tag == "table":
                return

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        return node

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            strict |= bool(DOCTYPE.match(m[0])) and not seen
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        seen = True
        if m[1]:
            if tag == "br":
                push("br", {})
            elif tag == "p" and not opened.get("p"):
                push("p", {})
                close_from(len(stack) - 1)
            elif tag not in ("html", "body") and opened.get(tag):
                cell = tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption")
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close_from(i)
                        break
                    if stack[i].tag == "table" or not cell and stack[i].tag in ("td", "th", "caption"):
                        break
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] and not m[3].isspace() else {}
        if not strict:
            attrs |= {k: attrs[k].lower() for k in ("id", "class") if k in attrs}
        if tag in ("html", "body") and stack[0].tag == "html":
            end({"head"}, set())
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            continue
        if stack[-1].tag == "head" and tag not in UNSEEN and tag not in VOID:
            close_from(len(stack) - 1)
        if tag in CLOSES_P:
            end({"p"}, {"td", "th", "caption", "button", "object"})
        if tag in IMPLIED:
            tags, bounds = IMPLIED[tag]
            while True:
                before = len(stack)
                end(tags, bounds)
                if len(stack) == before or tag in ("li", "dt", "dd", "option", "td", "th"):
                    break
        if tag == "tr" and stack[-1].tag == "table":
            push("tbody", {})
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if stack[-1].tag == "table":
                push("tbody", {})
            push("tr", {})
        node = push(tag, attrs)
        if m[3].rstrip().endswith("/") and tag not in BLOCK and (opened.get("svg") or opened.get("math")):
            if stack[-1] is node:
                close_from(len(stack) - 1)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : close.start() if close else len(page)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            if tag == "style" and on_screen(attrs.get("media", "")):
                styles.append(inner)
            if stack[-1] is node:
                close_from(len(stack) - 1)
            at = close.end() if close else len(page)
    text(page[at:])
    return root, styles, strict


def on_screen(media: str) -> bool:
    """Whether a media query list applies to a wide screen; features other than the width count as absent."""

    def one(query: str) -> bool:
        first, *rest = (x.strip() for x in re.split(r"\band\b", query))
        negated = first.startswith("not ")
        first = re.sub(r"^(?:not|only)\s+", "", first)
        features = rest if first in ("all", "screen") else [first, *rest]
        known = [WIDTH.fullmatch(f) for f in features]
        if not all(known):  # print, speech, or a feature that isn't judged: "not print" applies, "not (feature)" stays undecided
            return negated and not first.startswith("(") and first not in ("all", "screen")
        fits = all((SCREEN >= x if m[1] == "min" else SCREEN <= x) for m in known for x in [float(m[2]) * (1 if m[3] == "px" else 16)])
        return fits != negated

    media = media.strip().lower()
    return not media or any(one(q.strip()) for q in media.split(","))


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the style rules that apply to a screen, in their order; those nested in others with the selectors they amount to."""
    sheet = COMMENT.sub(" ", sheet)
    stack: list[list] = []  # kind, applies, selectors, declarations
    at = 0
    marks = [(m.start(), m[1]) for m in MARK.finditer(sheet) if m[1]]
    for i, mark in [*marks, *[(len(sheet), "}")] * len(marks)]:
        kind, applies = stack[-1][:2] if stack else ("group", True)
        if mark == "{":
            before, _, prelude = sheet[at:i].rpartition(";")
            if kind == "style":
                stack[-1][3] += before + ";"
            prelude = prelude.strip()
            name = re.match(r"@([\w-]+)", prelude)
            if kind == "other":
                stack.append(["other", False, "", ""])
            elif not name:
                stack.append(["style", applies, nested(stack[-1][2], prelude) if kind == "style" else prelude, ""])
            else:
                rest, word = prelude[name.end() :].strip(), name[1].lower()
                met = on_screen(rest) if word == "media" else word == "layer" or word == "supports" and not rest.lower().startswith("not")
                inside = kind if word in ("media", "supports", "layer") else "other"
                stack.append([inside, applies and met, stack[-1][2] if kind == "style" else "", ""])
            at = i + 1
        elif mark == "}":
            if stack:
                kind, applies, selectors, held = stack.pop()
                if kind == "style" and applies:
                    yield selectors, held + sheet[at:i]
            at = min(i + 1, len(sheet))
        elif kind == "group":
            at = i + 1


def shows(body: str) -> Iterator[tuple[str, bool, bool]]:
    """Property, whether it is marked important and whether it hides, of the declarations that bear on visibility."""
    for name, value, rest in SHOWS.findall(body):
        name, value = name.lower(), value.lower()
        yield name, "!important" in re.sub(r"\s", "", rest.lower()), value == "none" if name == "display" else value in ("hidden", "collapse")


def parts_of(text: str, separators: str) -> list[str]:
    """The text split at the separators that stand outside of brackets and quotes; each part after the first is preceded by its separator."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0 and c in separators:
            out += [text[at:i], c]
            at = i + 1
    return [*out, text[at:]]


def nested(outer: str, inner: str) -> str:
    """The selectors of a rule inside of another."""
    of = f":is({outer})"
    return ",".join(x.replace("&", of) if "&" in x else f"{of} {x}" for x in map(str.strip, parts_of(inner, ",")[::2]))


SIMPLE = re.compile(r"([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*(i\s*)?)?\]|(\*)|:([\w-]+)(\(?)", re.I)
#: Pseudo-classes that are judged by the siblings.
CHILD = frozenset("first-child last-child only-child".split())
#: Attributes whose values HTML compares without regard to case (those that bear on what pages hide).
CASELESS = frozenset("align checked dir disabled hidden lang media method open rel selected shape type valign".split())


class Selector:
    """Compounds, the combinators between them, and the specificity."""

    __slots__ = ("compounds", "joints", "weight")

    def __init__(self, compounds: list[list[tuple]], joints: list[str], weight: tuple[int, int, int]):
        self.compounds, self.joints, self.weight = compounds, joints, weight

    def meets(self, node: Node) -> bool:
        if not all(_has(node, x) for x in self.compounds[-1]):
            return False
        tried: set[tuple[int, int]] = set()  # so that every node is tried once for each compound
        todo = [(len(self.joints), node)]
        while todo:
            k, at = todo.pop()
            if k == 0:
                return True
            joint = self.joints[k - 1]
            at = at.parent if joint in " >" else at.before
            while at is not None and (k, id(at)) not in tried:
                tried.add((k, id(at)))
                if all(_has(at, x) for x in self.compounds[k - 1]):
                    todo.append((k - 1, at))
                if joint in ">+":
                    break
                at = at.parent if joint == " " else at.before
        return False


class Rule:
    """A selector and what it sets."""

    __slots__ = ("selector", "sets")

    def __init__(self, selector: Selector, sets: dict[str, tuple]):
        self.selector, self.sets = selector, sets


def _has(node: Node, part: tuple) -> bool:
    kind, name, value = part
    if kind == "":
        return node.tag == name
    if kind == "#":
        return node.attrs.get("id") == name
    if kind == ".":
        return name in node.attrs.get("class", "").split()
    if kind == "[":
        if (held := node.attrs.get(name)) is None or value is None:
            return held is not None
        how, wanted, caseless = value
        if caseless:
            held, wanted = held.lower(), wanted.lower()
        if how in "^$*" and not wanted and how:
            return False
        return {"": held == wanted, "~": wanted in held.split(), "|": held == wanted or held.startswith(f"{wanted}-"), "^": held.startswith(wanted), "$": held.endswith(wanted), "*": wanted in held}[how]
    if kind == ":":
        if name in ("not", "is"):
            return any(x.meets(node) for x in value) == (name == "is")
        if name == "root":
            return node.parent is None
        if name == "empty":
            return not any(not isinstance(c, str) or c for c in node.children)
        first, last = node.parent is None or node.before is None, node.parent is None or node.parent.latest is node
        return first and last if name == "only-child" else first if name == "first-child" else last
    return True


def selectors_of(text: str, strict: bool) -> list[Selector] | None:
    """The selectors of a list; None if one of them isn't understood."""
    found = [selector_of(x.strip(), strict) for x in parts_of(text, ",")[::2]]
    return None if None in found else found


def selector_of(text: str, strict: bool) -> Selector | None:
    """None for what isn't understood."""
    compounds, joints, weight, joint = [], [], [0, 0, 0], ""
    pieces = parts_of(text, " \t\n\r\f>+~")
    for separator, part in zip(["", *pieces[1::2]], pieces[::2], strict=True):
        if separator:
            joint = separator if separator in ">+~" else joint or " "
        if not part:
            continue
        compound, at = [], 0
        while m := SIMPLE.match(part, at):
            at = m.end()
            if m[3]:
                name = m[3].lower()
                given = next((x for x in (m[5], m[6], m[7]) if x is not None), None)
                compound.append(("[", name, None if given is None else (m[4], given, bool(m[8]) or name in CASELESS or not strict and name in ("id", "class"))))
                weight[1] += 1
            elif m[9]:
                compound.append(("*", "", None))
            elif m[10]:
                name, inner = m[10].lower(), None
                if m[11]:
                    end = _closing(part, at)
                    inner = selectors_of(part[at:end], strict) if name in ("not", "is", "where", "matches") else None
                    at = end + 1
                    if inner is None:
                        return None
                    if name != "where":
                        weight = [a + b for a, b in zip(weight, max(x.weight for x in inner), strict=True)]
                    name = "not" if name == "not" else "is"
                elif name in CHILD or name in ("root", "empty"):
                    weight[1] += 1
                else:
                    return None
                compound.append((":", name, inner))
            else:
                kind, name = m[1], m[2] if m[1] and strict else m[2].lower()
                compound.append((kind, name, None))
                weight[{"#": 0, ".": 1}.get(kind, 2)] += 1
        if at != len(part) or not compound:
            return None
        if compounds:
            joints.append(joint or " ")
        elif joint in (">", "+", "~"):
            return None
        compounds.append(compound)
        joint = ""
    return Selector(compounds, joints, tuple(weight)) if compounds and not joint.strip() else None


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes what is open at ``at``; the end without one."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return len(text)


def hidden_selectors(styles: list[str], strict: bool = True) -> dict[str, list[Rule]]:
    """The rules that bear on visibility, by a part of their last compound. strict: whether case tells classes and ids apart."""
    found: dict[str, list[Rule]] = {}
    place = 0
    for sheet in styles:
        for selectors, body in rules(sheet):
            sets: dict[str, tuple] = {}
            for name, important, hides in shows(body):
                place += 1
                sets[name] = max(sets.get(name, (False, 0, False)), (important, place, hides))
            if not sets:
                continue
            for selector in selectors_of(selectors, strict) or ():  # one that isn't understood makes the whole rule void
                kind, name, _ = min(selector.compounds[-1], key=lambda x: "#.[:*".find(x[0]) if x[0] else 1.5)
                found.setdefault(kind + name if kind in (".", "#", "") else "*", []).append(Rule(selector, sets))
    return found


def shown(node: Node, selectors: dict[str, list[Rule]]) -> tuple[bool, bool | None]:
    """Whether a node is displayed, and whether it sets its visibility (None: inherited)."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False, None
    if not a and not selectors:
        return True, None
    wins: dict[str, tuple] = {"display": (False, (-1, 0, 0), 0, True)} if "hidden" in a else {}
    if selectors:
        for key in [node.tag, f"#{a.get('id', '')}", *(f".{c}" for c in a.get("class", "").split()), "*"]:
            for rule in selectors.get(key, ()):
                if rule.selector.meets(node):
                    for name, (important, place, hides) in rule.sets.items():
                        new = (important, rule.selector.weight, place, hides)
                        wins[name] = max(wins.get(name, new), new)
    for place, (name, important, hides) in enumerate(shows(a.get("style", ""))):
        new = (important, (1 << 30, 0, 0), place, hides)
        wins[name] = max(wins.get(name, new), new)
    seen = wins.get("visibility")
    return not wins.get("display", (0, 0, 0, False))[3], None if seen is None else not seen[3]


class Page:
    """Lines of text; white space is settled as inline text arrives."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next inline text
        self.blank = False  # an empty line is due before the next line
        self.marks: list[str] = []  # what a list item's first line starts with
        self.indent = 0

    def inline(self, text: str) -> None:
        parts = SPACE.split(text)
        if parts == [""]:
            return
        joined = " ".join(x for x in parts if x)
        if not joined:
            self.gap = bool(self.line)
            return
        if self.line and (self.gap or not parts[0]):
            self.line.append(" ")
        self.line.append(joined)
        self.gap = not parts[-1]

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        mark = "".join(self.marks)
        self.marks.clear()
        self.lines.append((" " * (self.indent - len(mark)) + mark + line).rstrip())

    def stop(self, spaced: bool = False) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line.clear()
        self.gap = False
        self.blank |= spaced

    def text(self) -> str:
        self.stop()
        return "\n".join(self.lines)


def _span(cell: Node, name: str, least: int, most: int) -> int:
    given = cell.attrs.get(name, "1").strip()
    return max(least, min(most, int(given))) if given.isdecimal() and len(given) < 10 else most if given.isdecimal() else 1


def cells(table: Node, selectors: dict[str, list[Rule]], tables: int, dark: bool) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """The rows of a table with the number of their row group: each cell's text, the columns and the rows that it spans (0: all of the group's); what is no row stands alone, without columns. dark: whether the table's visibility is hidden."""
    loose: list = []
    parts: list[tuple] = []
    for group, child in enumerate(table.children):
        if not isinstance(child, Node) or child.tag not in ("thead", "tbody", "tfoot"):
            parts.append((child, dark, group))
            continue
        displayed, seen = shown(child, selectors)
        if displayed:
            parts.extend((x, dark if seen is None else not seen, group) for x in child.children)
    for part, hid, group in parts:
        if not isinstance(part, Node) or part.tag != "tr":
            loose.append((part, hid))
            continue
        displayed, seen = shown(part, selectors)
        if not displayed:
            continue
        unlit = hid if seen is None else not seen
        row = []
        for cell in part.children:
            displayed, seen = shown(cell, selectors) if isinstance(cell, Node) else (True, None)
            if not displayed:
                continue
            if not isinstance(cell, Node) and not cell.strip():
                continue
            whole = isinstance(cell, Node) and cell.tag in ("td", "th")
            held = Node("div", {})
            held.children = cell.children if whole else [cell]
            spans = (_span(cell, "colspan", 1, 1000), _span(cell, "rowspan", 0, 65534)) if whole else (1, 1)
            row.append((render(held, selectors, tables + 1, unlit if seen is None else not seen), *spans))
        yield group, row
    for unlit in (False, True):
        held = Node("div", {})
        held.children = [x for x, hid in loose if hid == unlit]
        if text := render(held, selectors, tables + 1, unlit) if held.children else "":
            yield -1, [(text, 0, 1)]


def placed(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> Iterator[list[tuple[str, int, int]]]:
    """Each row's cells with the column they begin in and the columns they span; a cell from a row above keeps its columns, without text."""
    group, above = -1, {}  # first column: columns and rows left (below 0: all) of cells that reach into the next row
    for its, row in rows:
        if its != group:
            group, above = its, {}
        if row and row[0][1] == 0:
            yield [(row[0][0], 0, 0)]
            continue
        line, reach, at = [], {}, 0
        todo = iter(row)
        cell = next(todo, None)
        while cell or any(first >= at for first in above):
            if at in above:
                columns, left = above.pop(at)
                line.append(("", at, columns))
                if left != 1:
                    reach[at] = (columns, left - 1)
                at += columns
            elif cell:
                text, columns, deep = cell
                line.append((text, at, columns))
                if deep != 1:
                    reach[at] = (columns, deep - 1)
                at += columns
                cell = next(todo, None)
            else:
                at = min(first for first in above if first >= at)
        above = reach
        if row:
            yield line


def aligned(rows: list[tuple[int, list[tuple[str, int, int]]]]) -> Iterator[str]:
    lines = list(placed(rows))
    widths: list[int] = []
    spread: list[tuple[int, int, int]] = []
    for line in lines:
        for text, at, columns in line:
            widths += [0] * (at + columns - len(widths))
            need = max(map(len, text.split("\n")))
            if columns == 1:
                widths[at] = max(widths[at], need)
            elif columns:
                spread.append((columns, at, need))
    for columns, at, need in sorted(spread):  # what doesn't fit over its columns widens the last of them
        widths[at + columns - 1] += max(0, need - sum(widths[at : at + columns]) - 3 * (columns - 1))
    for line in lines:
        if line[0][2] == 0:
            yield from line[0][0].split("\n")
            continue
        split = [text.split("\n") for text, _, _ in line]
        for k in range(max(map(len, split))):
            out, end = [], 0
            for texts, (_, at, columns) in zip(split, line, strict=True):
                out += [" " * w for w in widths[end:at]]  # columns that no cell of this row covers
                width = sum(widths[at : at + columns]) + 3 * (columns - 1)
                out.append((texts[k] if k < len(texts) else "").ljust(width))
                end = at + columns
            yield " | ".join(out).rstrip()


def _whole(given: str | None) -> int | None:
    return int(given) if given and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", given) else None


def render(root: Node, selectors: dict[str, list[Rule]], tables: int = 0, dark: bool = False) -> str:
    page = Page()
    todo: list[tuple] = [("open", root, {"pre": False, "dark": dark})]
    while todo:
        what, node, state = todo.pop()
        if what == "close":
            if state.get("foreign") and node.tag in FOREIGN_APART:
                page.inline(" ")
            spaced = node.tag in SPACED and not (node.tag in ("ul", "ol", "menu") and state.get("list"))
            if node.tag in BLOCK:
                page.stop(spaced)
            if node.tag in ("li", "dd"):
                page.indent = state["indent"]
                if page.marks and node.tag == "li":
                    page.marks.clear()
            continue
        if isinstance(node, str):
            if state["dark"]:
                continue
            if state["pre"]:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                page.line.append(first)
                for line in rest:
                    page.put("".join(page.line)) if page.lines or page.line != [""] else None
                    page.line = [line]
            else:
                page.inline(node)
            continue
        displayed, seen = shown(node, selectors)
        if not displayed or state.get("foreign") and node.tag in FOREIGN_UNSEEN:
            continue
        if seen is not None and seen == state["dark"]:
            state = state | {"dark": not seen}
        if node.tag == "br":
            page.put("".join(page.line)) if page.line else page.put("")
            page.line.clear()
            page.gap = False
            continue
        if node.tag == "wbr":
            continue
        if node.tag in BLOCK:
            page.stop(node.tag in SPACED and not (node.tag in ("ul", "ol", "menu") and state.get("list")))
        if node.tag == "input":
            state["dark"] or page.inline(f" {node.attrs.get('value', '')} ")
            continue
        if node.tag == "table" and tables < TABLES:
            for line in aligned(list(cells(node, selectors, tables, state["dark"]))):
                page.put(line)
            page.stop(True)
            continue
        inner = state
        if node.tag in ("ul", "ol", "menu"):
            step = -1 if "reversed" in node.attrs else 1
            first = _whole(node.attrs.get("start")) if node.tag == "ol" else 1
            if first is None:
                first = 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            inner = state | {"list": node.tag, "number": [first, step]}
        elif node.tag in ("li", "dd"):
            mark = "  " if node.tag == "dd" else "- "
            if node.tag == "li" and state.get("list") == "ol":
                number = state["number"]
                given = _whole(node.attrs.get("value"))
                number[0] = number[0] if given is None else given
                mark = f"{number[0]}. "
                number[0] += number[1]
            inner = state | {"indent": page.indent}
            page.indent += len(mark)
            if not state["dark"]:
                page.marks.append(mark)
        elif node.tag in ("pre", "textarea"):
            inner = state | {"pre": True}
        elif node.tag in ("svg", "math"):
            inner = state | {"foreign": True}
        children = node.children
        if state.get("foreign") and node.tag in FOREIGN_APART:
            page.inline(" ")
            if node.tag == "mfrac":
                children = [x for c in children for x in (c, " ")]
        if node.tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo.append(("close", node, inner if node.tag in ("li", "dd") else state))
        todo.extend(("open", c, inner) for c in reversed(children))
    return page.text().strip("\n")


def to_text(page: str | None) -> str:
    if not page:
        return ""
    root, styles, strict = parse(page)
    return render(root, hidden_selectors(styles, strict))


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "text": [to_text(x) for x in frame["html"]]})

    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id string, text string").select(F.col("page_id").cast("long").alias("page_id"), "text")
