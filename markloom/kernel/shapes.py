"""Node rows of pages that differ from an earlier page only in their words.

Plain tables, lists and text are parsed by their signs alone. Of their words, runs of ASCII
letters and digits, only the names and values of attributes and the texts come into the rows,
as slices, and no node begins or ends inside a word. So the rows of one such page, its *shape*,
serve every page with the same signs between words, whatever the words and their lengths. Pages
with other markup are parsed each for itself, as are those with words that the parser knows
(protocols, RFC, PMID, ISBN, itemscope) and when lines and columns are wanted.

Pages whose words have the same lengths too, a *cut* of the shape, share all places, so such a
page is told by one translation of its letters and none of its words is looked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from markloom.config import SiteConfig
from markloom.kernel import parse as kernel
from markloom.kernel.parse import FIELDS, FILL, PIPE, VOID, Node

#: Shapes that are kept; then they are gathered anew.
SHAPES = 8_192
#: Cuts that are kept, and the rows that they may have in all; then they are gathered anew.
CUTS = 8_192
CUT_ROWS = 500_000
#: Longer pages are parsed each for itself.
LONGEST = 4_000
TYPES = frozenset("root table table-syntax table-attrs table-attr table-attr-dirty attr-key attr-value tr td td-inner text list hr".split())
WORD = re.compile("([A-Za-z0-9]+)")
#: Every ASCII letter and digit to one letter.
SIGNS = bytes(97 if chr(k).isalnum() and k < 128 else k for k in range(256))
PLACES = frozenset("start end inner_start inner_end".split())
SIBLINGS = ("type_ordinal", "type_count", "previous_type")
_AT = {f: k for k, f in enumerate((*FIELDS, *SIBLINGS))}


def add_siblings(rows: list[list]) -> None:
    """Places among siblings, after the other values of each row."""
    parent, elem, kind = _AT["parent_id"], _AT["elem_ordinal"], _AT["type"]
    counts: dict[tuple, int] = {}
    types: dict[tuple, str] = {}
    for r in rows:
        alike = r[parent], r[kind]
        before = None if r[elem] is None else types.get((r[parent], r[elem] - 1))
        r += [counts.get(alike, 0), 0, before]
        counts[alike] = r[-3] + 1
        if r[elem] is not None:
            types[r[parent], r[elem]] = r[kind]
    for r in rows:
        r[-2] = counts[r[parent], r[kind]]


def _spans(attr: Node) -> tuple[int, int, int, int]:
    """Where an attribute's name and its value stand; without a value an empty slice."""
    key, value = attr.children[0], attr.children[1] if len(attr.children) > 1 else None
    return key.start, key.end, value.start if value else 0, value.end if value else 0


def _slices(root: Node) -> tuple[dict[int, tuple], dict[int, tuple], bool]:
    """Where the attributes of each dictionary of attributes stand, where that of each attribute's props, and whether the tree has no other types."""
    owners: dict[int, tuple] = {}
    own: dict[int, tuple] = {}
    plain, left = True, [root]
    while left:
        node = left.pop()
        left += node.children
        plain = plain and node.type in TYPES
        if node.type == "table-attr":
            own[id(node.props)] = _spans(node)
        elif node.type == "table-attrs":
            owners[id(node.attrs)] = tuple(_spans(c) for c in node.children if c.type == "table-attr")
    return owners, own, plain


def colons(text: str) -> list[int]:
    return [k for k, c in enumerate(text) if c == ":"] if ":" in text else []


class Shape:
    """Columns of a page's rows, and where the values stand that are a page's own: at so many characters after the start of a part."""

    __slots__ = ("columns", "count")

    def __init__(self, rows: list[list], columns: list[str], owners: dict[int, tuple], own: dict[int, tuple], starts: list[int]):
        self.count = len(rows)

        def at(place: int) -> tuple[int, int]:
            """Words are the odd parts: a place is a word's start, or the end of the word before, or among signs."""
            k = bisect_left(starts, place)
            k = k if k < len(starts) and starts[k] == place else k - 1
            if k % 2:
                if starts[k] != place:
                    raise ValueError("a node ends inside a word")
                return k, 0
            return k, place - starts[k]

        def ends(*places: int) -> tuple[int, ...]:
            return tuple(x for p in places for x in at(p))

        self.columns: list[tuple] = []
        for name in columns:
            values = [r[_AT[name]] for r in rows]
            spans: list = []
            if name == "name":
                spans = [(k, *ends(*own[id(r[_AT["props"]])][:2])) for k, r in enumerate(rows) if r[_AT["type"]] == "table-attr"]
            elif name == "props":
                spans = [(k, *ends(*own[id(r[_AT["props"]])][2:])) for k, r in enumerate(rows) if r[_AT["type"]] == "table-attr"]
            elif name == "data":
                spans = [(k, *ends(r[_AT["start"]], r[_AT["end"]])) for k, r in enumerate(rows) if r[_AT["type"]] == "text"]
            elif name == "text":
                spans = [(k, *ends(r[_AT["start"]], r[_AT["end"]])) for k, r in enumerate(rows)]
            elif name == "attrs":
                spans = [(k, [ends(*one) for one in owners[id(r[_AT["attrs"]])]]) for k, r in enumerate(rows) if r[_AT["attrs"]]]
            elif name in PLACES:
                spans = [at(v) for v in values]
            self.columns.append((name, values, spans))

    def cut(self, parts: list[str]) -> Cut:
        """The shape at the lengths of these parts."""
        s = [0, *accumulate(map(len, parts))]
        columns = []
        for name, values, spans in self.columns:
            if name in PLACES:
                columns.append((name, [s[a] + b for a, b in spans], []))
            elif name == "attrs":
                columns.append((name, values, [(k, [(s[a] + b, s[c] + d, s[e] + f, s[g] + h) for a, b, c, d, e, f, g, h in found]) for k, found in spans]))
            else:
                columns.append((name, values, [(k, s[a] + b, s[c] + d) for k, a, b, c, d in spans]))
        return Cut(columns, self.count)


class Cut:
    """A shape with words of given lengths: all places are known, and the values that are a page's own are slices of it."""

    __slots__ = ("colons", "columns", "count", "own", "shared")

    def __init__(self, columns: list[tuple], count: int):
        self.columns, self.count = columns, count
        self.colons: list[int] = []
        self.shared = [values for _, values, _ in columns]
        self.own = [(at, *column) for at, column in enumerate(columns) if column[2]]

    def of(self, text: str) -> list[list]:
        """The columns for a page; those without own values are the same lists for all pages."""
        if not self.own:
            return self.shared
        out = self.shared.copy()
        for at, name, values, spans in self.own:
            values = values.copy()
            if name == "attrs":
                for k, found in spans:
                    values[k] = {text[a:b].lower(): text[c:d] for a, b, c, d in found}
            elif name == "props":
                for k, a, b in spans:
                    values[k] = values[k] | {"value": text[a:b]}
            elif name == "name":
                for k, a, b in spans:
                    values[k] = text[a:b].lower()
            elif len(spans) == len(values):
                values = [text[a:b] for _, a, b in spans]
            else:
                for k, a, b in spans:
                    values[k] = text[a:b]
            out[at] = values
        return out


class Tables:
    """Pages to columns of node rows, by shapes where a page has one."""

    def __init__(self, config: SiteConfig, columns: list[str], types: frozenset[str] | None, last: str = "convert"):
        self.config, self.types, self.last = config, types, last
        self.columns = [c for c in columns if c != "page_id"]
        self.want = frozenset(self.columns)
        self.shapes: dict[str, Shape | None] = {}
        self.cuts: dict[bytes, Cut] = {}
        self.cut_rows = 0
        self.blocks = None
        self.placed = bool(self.want & {"line", "col", "end_line", "end_col"})
        self.colons = tuple(p.lower().partition(":")[0] + ":" for p in config.protocols if ":" in p)
        self.tails = frozenset(p[-3:-1] for p in self.colons)
        self.words = ("rfc", "pmid", "isbn", "itemscope", *(p.lower() for p in config.protocols if ":" not in p))
        self.other = re.compile("|".join([f"[{FILL}{VOID}{PIPE}]", *map(re.escape, (*self.colons, *self.words))]), re.IGNORECASE)

    def plain(self, text: str) -> bool:
        """Is it without other markup and without words that the parser knows?"""
        if self.placed or len(text) > LONGEST or "<" in text or "[" in text or "{{" in text or "-{" in text or "__" in text or "''" in text:
            return False
        if not text.isascii():
            return not self.other.search(text)
        return not self.known(text)

    def known(self, text: str) -> bool:
        """Has a text of ASCII signs words that the parser knows?"""
        return self._named(text.lower(), colons(text))

    def _named(self, low: str, at: list[int]) -> bool:
        for w in self.words:
            if w in low:
                return True
        for k in at:
            if low[max(k - 2, 0) : k] in self.tails and low.endswith(self.colons, 0, k + 1):
                return True
        return False

    def of(self, text: str, include: bool, title: str) -> tuple[int, list[list]]:
        """(number of rows, columns) of a clean page; pages may share columns, so they are not to be changed."""
        signs = None
        if not self.placed and len(text) <= LONGEST and text.isascii():
            signs = text.encode().translate(SIGNS)
            cut = self.cuts.get(signs)
            if cut is not None and not self._named(text.lower(), cut.colons):
                return cut.count, cut.of(text)
        key, parts = None, []
        if self.plain(text):
            parts = WORD.split(text)
            key = "a".join(parts[::2])
            shape = self.shapes.get(key)
            if shape:
                cut = shape.cut(parts)
                if signs is not None:
                    cut.colons = colons(text)
                    self._keep(signs, cut)
                return cut.count, cut.of(text)
        root = kernel.parse(text, self.config, include, self.last, title)
        found = kernel.table(root, text, self.want, self.types, self.config)
        if not self.want.isdisjoint(SIBLINGS):
            add_siblings(found)
        if key is not None and key not in self.shapes:
            if len(self.shapes) >= SHAPES:
                self.shapes.clear()
            self.shapes[key] = self._shape(root, found, text, parts)
        made = list(zip(*found, strict=True)) if found else [()] * len(_AT)
        return len(found), [made[_AT[c]] for c in self.columns]

    def _keep(self, signs: bytes, cut: Cut) -> None:
        if len(self.cuts) >= CUTS or self.cut_rows + cut.count > CUT_ROWS:
            self.cuts, self.cut_rows = {}, 0
        self.cuts[signs] = cut
        self.cut_rows += cut.count

    def _shape(self, root: Node, rows: list[list], text: str, parts: list[str]) -> Shape | None:
        """The shape of a page's rows, unless some value of them is no slice of the page."""
        owners, own, plain = _slices(root)
        if not plain:
            return None
        for r in rows:
            kind, attrs, props = r[_AT["type"]], r[_AT["attrs"]], r[_AT["props"]]
            if "props" in self.want and "lonely" in props and WORD.search(text, r[_AT["start"]], r[_AT["end"]]):
                return None  # places that depend on the lengths of words
            if kind == "table-attr" and (text[slice(*own[id(props)][2:])] != props["value"]):
                return None
            if attrs and (id(attrs) not in owners or attrs != {text[a:b].lower(): text[x:y] for a, b, x, y in owners[id(attrs)]}):
                return None
            if "text" in self.want and r[_AT["text"]] != text[r[_AT["start"]] : r[_AT["end"]]]:
                return None
        try:
            return Shape(rows, self.columns, owners, own, [0, *accumulate(map(len, parts))])
        except ValueError:
            return None


_LAST: list[tuple] = []


def tables(config: SiteConfig, columns: list[str], types: frozenset[str] | None, last: str = "convert") -> Tables:
    """That of the task before, if it asked for the same: a worker's tasks share shapes and cuts."""
    asked = (config, columns, types, last)
    if not _LAST or _LAST[0][0] != asked:
        _LAST[:] = [(asked, Tables(config, columns, types, last))]
    return _LAST[0][1]
