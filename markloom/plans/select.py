"""A CSS-like selector language over the node table, compiled to DataFrame plans.

Simple predicates become column filters that Catalyst pushes into the scan. Combinators,
nested selectors and sibling counts become flags that windows work out, over siblings or over
the nodes of a page in document order, after one shuffle by page; so nodes are read once and
never joined with themselves. Nodes that know their places among siblings (``SIBLINGS``), as
those that ``find`` parses, need no shuffle for of-type pseudo-classes and for ``type + x``.
A selector is checked when it is compiled, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig
from markloom.plans.parse import parse as parse_pages
from markloom.schema import NODES, SIBLINGS

KEY = ["page_id", "node_id"]
LINKS = ("link", "redirect-target", "free-ext-link", "magic-link", "ext-link", "gallery-image")


class SelectorError(ValueError):
    """The selector cannot be read."""


@dataclass
class Attribute:
    key: str
    op: str | None = None
    value: str = ""
    fold: bool = False


@dataclass
class Pseudo:
    name: str
    arg: str | None = None


@dataclass
class Compound:
    type: str | None = None
    name: str | None = None
    attributes: list[Attribute] = field(default_factory=list)
    pseudos: list[Pseudo] = field(default_factory=list)
    relation: str | None = None  # to the compound before it


def split_top(text: str, sep: str) -> list[str]:
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[last:i])
            last = i + 1
        i += 1
    if depth or quote:
        raise SelectorError(f"unbalanced selector: {text}")
    return [*out, text[last:]]


NAME = re.compile(r"(?:\\.|[\w\-:/.])+")
ATTRIBUTE = re.compile(r"\[\s*([\w\-]+)\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*([iI])?\s*)?\]")


def parse(selector: str) -> list[list[Compound]]:
    """Alternatives, each a list of compounds from left to right."""
    return [_complex(part.strip()) for part in split_top(selector, ",")]


def _complex(text: str) -> list[Compound]:
    out: list[Compound] = []
    i, relation = 0, None
    if text[:1] in (">", "+", "~"):
        relation, i = text[0], 1
    current = Compound(relation=relation)
    fresh = True
    while i < len(text):
        c = text[i]
        if c.isspace() or c in ">+~":
            m = re.compile(r"\s*([>+~]?)\s*").match(text, i)
            i = m.end()
            if i < len(text):
                if fresh and not out and current.relation is None:
                    raise SelectorError(f"misplaced combinator: {text}")
                if not fresh:
                    out.append(current)
                    current, fresh = Compound(relation=m[1] or " "), True
                elif m[1]:
                    raise SelectorError(f"two combinators: {text}")
            elif m[1]:
                raise SelectorError(f"selector ends in a combinator: {text}")
            continue
        fresh = False
        if c == "*":
            i += 1
        elif c == "#":
            m = re.compile(r"#((?:\\.|[^\s\[\]:>+~,()\\]|:(?! *[a-z-]+\())+(?: [^\s\[\]>+~:,()][^\[\]>+~,:()]*)?)").match(text, i)
            if not m:
                raise SelectorError(f"empty name: {text}")
            current.name, i = re.sub(r"\\(.)", r"\1", m[1]).strip(), m.end()
        elif c == "[":
            m = ATTRIBUTE.match(text, i)
            if not m:
                raise SelectorError(f"bad attribute: {text[i:]}")
            value = next((v for v in m.group(3, 4, 5) if v is not None), "")
            current.attributes.append(Attribute(m[1].lower(), m[2], value, bool(m[6])))
            i = m.end()
        elif c == ":":
            m = re.compile(r":([a-z-]+)(\()?").match(text, i)
            if not m:
                raise SelectorError(f"bad pseudo-class: {text[i:]}")
            i, arg = m.end(), None
            if m[2]:
                depth, a = 1, i
                while depth:
                    if i >= len(text):
                        raise SelectorError(f"unclosed parenthesis: {text}")
                    depth += {"(": 1, ")": -1}.get(text[i], 0)
                    i += 1
                arg = text[a : i - 1].strip()
            current.pseudos.append(Pseudo(m[1], arg))
        elif m := re.compile(r"[a-z][a-z-]*").match(text, i):
            current.type, i = m[0], m.end()
        else:
            raise SelectorError(f"unexpected {c!r}: {text}")
    out.append(current)
    return out


def ranges(text: str) -> list[tuple[int, int]]:
    """``an+b`` lists as (a, b); also ``odd``, ``even`` and plain numbers."""
    out = []
    for part in text.split(","):
        p = part.strip().replace(" ", "").lower()
        if p == "odd":
            out.append((2, 1))
        elif p == "even":
            out.append((2, 0))
        elif re.fullmatch(r"[+-]?\d+", p):
            out.append((0, int(p)))
        elif m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", p):
            a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
            out.append((a, int(m[2] or 0)))
        else:
            raise SelectorError(f"bad index: {text}")
    return out


def _nth(index: Column, arg: str) -> Column:
    test = F.lit(False)
    for a, b in ranges(arg):
        if a == 0:
            test = test | (index == b)
        else:
            test = test | (((index - b) % a == 0) & ((index - b) / a >= 0))
    return test


def _value(key: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(key)), F.try_element_at("props", F.lit(key)))


def _attribute(a: Attribute) -> Column:
    x = _value(a.key)
    v = F.lit(a.value.lower() if a.fold else a.value)
    x = F.lower(x) if a.fold else x
    if a.op is None:
        return x.isNotNull() & (x != "false")
    if a.op == "!=":
        return ~x.eqNullSafe(v)
    tests = {
        "=": x == v,
        "~=": F.array_contains(F.split(x, r"\s+"), v),
        "|=": (x == v) | F.startswith(x, F.concat(v, F.lit("-"))),
        "^=": F.startswith(x, v),
        "$=": F.endswith(x, v),
        "*=": F.contains(x, v),
    }
    return F.coalesce(tests[a.op], F.lit(False))


COUNTED = {
    "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type",
}
#: Pseudo-classes that count all siblings of whatever type.
ALL_SIBLINGS = {"last-child", "only-child", "nth-last-child"}
#: Those that columns of SIBLINGS tell.
OF_TYPE = {name for name in COUNTED if "type" in name}
NESTED = ("is", "not", "has")


def _siblings() -> WindowSpec:
    return Window.partitionBy("page_id", "parent_id")


def _earlier(backward: bool = False) -> WindowSpec:
    """The nodes of a page before a node; or after it, from the end back, as frames that reach forward are worked out anew for every row."""
    return Window.partitionBy("page_id").orderBy(F.desc("node_id") if backward else F.asc("node_id")).rowsBetween(Window.unboundedPreceding, -1)


class Selector:
    """A compiled selector; ``Selector("template#Template:Foo > parameter").apply(nodes)``.

    ``placed``: the nodes have the columns of SIBLINGS.
    """

    def __init__(self, text: str, placed: bool = False):
        self.text = text
        self.placed = placed
        self.parts = parse(text) if text.strip() else [[Compound()]]
        self._parsed: dict[str, list[list[Compound]]] = {}

    def apply(self, nodes: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        elements = nodes.filter(F.col("type") != "text")
        if all(self._plain(p) for p in self.parts):
            return elements.filter(self._any(self.parts))
        types = self.types()
        rows = elements if types is None else elements.filter(F.col("type").isin(*sorted(types)))
        # Tests of single nodes come before the shuffle, which so carries their results and not what they read.
        self._told = {id(c): f"_t{k}" for k, c in enumerate(self._compounds(self.parts))}
        self._count = 0
        rows = rows.withColumns({self._told[id(c)]: F.coalesce(self._test(c), F.lit(False)) for c in self._compounds(self.parts)})
        if not any(p.name in self._windowed() for c in self._compounds(self.parts) for p in c.pseudos):
            rows = rows.filter(reduce(or_, map(F.col, self._told.values())))  # the others can't matter, as places among siblings are told by ordinals
        rows, found = self._alternatives(rows.repartition("page_id"), elements, self.parts, scope)
        return rows.filter(found).select(*nodes.columns)

    # -- what a selector reads

    def _inner(self, p: Pseudo) -> list[list[Compound]]:
        if p.name == "has" and ":has(" in p.arg:
            raise SelectorError(":has can't be nested")
        if p.arg not in self._parsed:
            self._parsed[p.arg] = parse(p.arg) if p.arg.strip() else [[Compound()]]
        return self._parsed[p.arg]

    def _compounds(self, parts: list[list[Compound]]) -> list[Compound]:
        """All compounds, those of nested selectors too."""
        out = []
        for c in (c for part in parts for c in part):
            out.append(c)
            for p in c.pseudos:
                if p.name in NESTED:
                    out += self._compounds(self._inner(p))
        return out

    def types(self) -> frozenset[str] | None:
        """Types of all nodes that matter; None if they may be of any type."""

        def of(parts: list[list[Compound]], own: str | None) -> set[str] | None:
            found: set[str] = set()
            for part in parts:
                for k, c in enumerate(part):
                    kind = c.type or (own if k == len(part) - 1 else None)
                    if kind is None or any(p.name in ALL_SIBLINGS | {"lang"} for p in c.pseudos):
                        return None
                    found.add(kind)
                    for p in c.pseudos:
                        if p.name in NESTED:
                            inner = of(self._inner(p), None if p.name == "has" else kind)
                            if inner is None:
                                return None
                            found |= inner
            return found

        found = of(self.parts, None)
        return None if found is None else frozenset(found)

    def columns(self) -> list[str]:
        """Columns of the nodes that the selector reads."""
        out = {"node_id", "type"}
        alone = all(self._plain(p) for p in self.parts)
        for c in self._compounds(self.parts):
            names = {p.name for p in c.pseudos}
            out |= {"name"} if c.name is not None else set()
            out |= {"attrs", "props"} if c.attributes or names & {"any-link", "invalid", "valid", "regex", "local-link", "lang"} else set()
            out |= {"text"} if names & {"contains", "hidden", "visible", "only-whitespace"} else set()
            out |= {"parent_id", "type_ordinal", "type_count"} if self.placed and names & OF_TYPE else set()
            out |= {"parent_id", "previous_type"} if self.placed and c.relation == "+" else set()
            out |= {"parent_id", "elem_ordinal"} if names & (self._windowed() | {"root", "has"}) or c.relation in (">", "+", "~") and not alone else set()
            out |= {"last_id"} if names & {"has", "empty", "parent", "lang"} or c.relation == " " else set()
            out |= {"depth"} if "lang" in names else set()
        return sorted(out)

    # -- one compound

    def _windowed(self) -> set[str]:
        """Pseudo-classes that need all siblings."""
        return COUNTED - OF_TYPE if self.placed else COUNTED

    def _plain(self, part: list[Compound]) -> bool:
        """Can it be told from each node alone?"""
        c = part[-1]
        if len(part) == 2 and self.placed and c.relation == "+":
            if part[0].type is None or part[0] != Compound(type=part[0].type):
                return False
        elif len(part) > 1 or c.relation is not None:
            return False
        alone = all(all(self._plain(i) for i in self._inner(p)) for p in c.pseudos if p.name in ("is", "not"))
        return alone and not any(p.name in self._windowed() | {"has", "lang", "scope"} for p in c.pseudos)

    def _any(self, parts: list[list[Compound]]) -> Column:
        """The test of alternatives that are plain."""
        test = F.lit(False)
        for part in parts:
            one = self._test(part[-1])
            if len(part) == 2:
                one = one & F.col("parent_id").isNotNull() & (F.col("previous_type") == part[0].type)
            test = test | F.coalesce(one, F.lit(False))
        return test

    def _test(self, c: Compound) -> Column:
        test = F.lit(True) if c.type is None else F.col("type") == c.type
        if c.name is not None:
            test = test & (F.col("name") == c.name)
        for a in c.attributes:
            test = test & _attribute(a)
        for p in c.pseudos:
            t = self._of_type(p) if self.placed and p.name in OF_TYPE else self._simple(p)
            if p.name in ("is", "not") and all(self._plain(i) for i in self._inner(p)):
                t = self._any(self._inner(p)) if p.name == "is" else ~self._any(self._inner(p))
            if t is not None:
                test = test & t
        return test

    @staticmethod
    def _of_type(p: Pseudo) -> Column:
        i, n = F.col("type_ordinal") + 1, F.col("type_count")
        tests = {
            "first-of-type": lambda: i == 1, "last-of-type": lambda: i == n, "only-of-type": lambda: n == 1,
            "nth-of-type": lambda: _nth(i, p.arg), "nth-last-of-type": lambda: _nth(n - i + 1, p.arg),
        }
        return F.col("parent_id").isNotNull() & tests[p.name]()

    @staticmethod
    def _simple(p: Pseudo) -> Column | None:
        blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
        fixed = {
            "root": lambda: F.col("parent_id").isNull(),
            "parent": lambda: F.col("last_id") > F.col("node_id"),
            "empty": lambda: F.col("last_id") == F.col("node_id"),
            "local-link": lambda: F.col("type").isin("link", "file", "gallery-image") & (F.try_element_at("props", F.lit("target")) == ""),
            "header": lambda: F.col("type") == "heading",
            "hidden": lambda: F.col("text") == "",
            "visible": lambda: F.col("text") != "",
            "only-whitespace": lambda: blank,
            "any-link": lambda: F.col("type").isin(*LINKS) | ((F.col("type") == "file") & (F.coalesce(F.try_element_at("attrs", F.lit("link")), F.lit("x")) != "")),
            "invalid": lambda: F.coalesce(F.try_element_at("props", F.lit("invalid")) == "true", F.lit(False)),
            "valid": lambda: ~F.coalesce(F.try_element_at("props", F.lit("invalid")) == "true", F.lit(False)),
            "required": lambda: F.col("type").isin("template-name", "magic-word-name", "link-target", "heading-title", "table-syntax", "attr-key", "arg-name"),
            "optional": lambda: ~F.col("type").isin("template-name", "magic-word-name", "link-target", "heading-title", "table-syntax", "attr-key", "arg-name"),
        }
        if p.name in fixed:
            return fixed[p.name]()
        if p.name == "contains":
            return F.contains("text", F.lit(p.arg.strip("\"'")))
        if p.name == "regex":
            m = re.fullmatch(r"\s*[\"']?\s*([\w-]+)\s*,\s*/(.*)/([a-z]*)\s*[\"']?\s*", p.arg or "")
            if not m:
                raise SelectorError(f"bad :regex: {p.arg}")
            return F.coalesce(_value(m[1].lower()).rlike(("(?iu)" if "i" in m[3] else "") + m[2]), F.lit(False))
        if p.name in COUNTED | {"is", "not", "has", "lang", "scope"}:
            return None
        raise SelectorError(f"unknown pseudo-class :{p.name}")

    def _compound(self, rows: DataFrame, elements: DataFrame, c: Compound, scope: DataFrame | None) -> tuple[DataFrame, Column]:
        """Rows with the columns that it takes, and whether a row matches."""
        found = F.col(self._told[id(c)])
        counts = {p.name for p in c.pseudos} & self._windowed()
        k = self._next()
        i, n, ti, tn = F.col("elem_ordinal") + 1, F.col(f"{k}n"), F.col(f"{k}ti"), F.col(f"{k}tn")
        if counts & ALL_SIBLINGS:
            rows = rows.withColumn(f"{k}n", F.count(F.lit(1)).over(_siblings()))
        if any("type" in name for name in counts):
            alike = Window.partitionBy("page_id", "parent_id", "type")
            rows = rows.withColumns({f"{k}ti": F.row_number().over(alike.orderBy("elem_ordinal")), f"{k}tn": F.count(F.lit(1)).over(alike)})
        for p in c.pseudos:
            counted = {
                "first-child": lambda: i == 1, "last-child": lambda: i == n, "only-child": lambda: n == 1,
                "first-of-type": lambda: ti == 1, "last-of-type": lambda: ti == tn, "only-of-type": lambda: tn == 1,
                "nth-child": lambda p=p: _nth(i, p.arg), "nth-of-type": lambda p=p: _nth(ti, p.arg),
                "nth-last-child": lambda p=p: _nth(n - i + 1, p.arg), "nth-last-of-type": lambda p=p: _nth(tn - ti + 1, p.arg),
            }
            if p.name in counts:
                found = found & F.col("parent_id").isNotNull() & counted[p.name]()
            elif p.name in ("is", "not") and not all(self._plain(part) for part in self._inner(p)):
                rows, inner = self._alternatives(rows, elements, self._inner(p), scope)
                found = found & (inner if p.name == "is" else ~inner)
            elif p.name == "has":
                rows, inner = self._has(rows, elements, self._inner(p), scope)
                found = found & inner
            elif p.name in ("lang", "scope"):
                if p.name == "scope" and scope is None:
                    raise SelectorError(":scope needs a scope")
                keys = scope.select(*KEY).distinct() if p.name == "scope" else self._lang(elements, rows, p.arg)
                name = self._next()
                rows = rows.join(keys.withColumn(name, F.lit(True)).hint("merge"), KEY, "left")
                found = found & F.col(name).isNotNull()
        return self._flag(rows, found)

    def _next(self) -> str:
        self._count += 1
        return f"_f{self._count}"

    def _flag(self, rows: DataFrame, test: Column) -> tuple[DataFrame, Column]:
        name = self._next()
        return rows.withColumn(name, F.coalesce(test, F.lit(False))), F.col(name)

    # -- combinators

    def _meet(self, rows: DataFrame, flag: Column, own: str, key: str) -> tuple[DataFrame, Column]:
        """Is there a flagged row on the page whose ``key`` is this row's ``own``? Flagged rows come once more, under their keys, and go again."""
        name, k, role = self._next(), self._next(), self._next()
        both = rows.withColumn(role, F.explode(F.when(flag, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        both = both.withColumn(k, F.when(F.col(role) == 1, F.col(key)).otherwise(F.col(own)))
        met = both.withColumn(name, F.max(role).over(Window.partitionBy("page_id", k)) == 1)
        return met.filter(F.col(role) == 0).drop(role, k), F.col(name) & F.col(own).isNotNull()

    def _after(self, rows: DataFrame, flag: Column, relation: str) -> tuple[DataFrame, Column]:
        """Does a row stand in the relation to some flagged row?"""
        if relation == ">":
            return self._meet(rows, flag, "parent_id", "node_id")
        order = F.col("elem_ordinal")
        child = F.col("parent_id").isNotNull()
        if relation == "+":
            w = _siblings().orderBy("elem_ordinal")
            return self._flag(rows, child & F.lag(flag).over(w) & (F.lag(order).over(w) == order - 1))
        if relation == "~":
            return self._flag(rows, child & (F.min(F.when(flag, order)).over(_siblings()) < order))
        # Subtrees nest or are apart: one that began before and reaches a node holds it.
        return self._flag(rows, F.max(F.when(flag, F.col("last_id"))).over(_earlier()) >= F.col("node_id"))

    def _before(self, rows: DataFrame, flag: Column, relation: str) -> tuple[DataFrame, Column]:
        """Does some flagged row stand in the relation to a row?"""
        if relation == ">":
            return self._meet(rows, flag, "node_id", "parent_id")
        order = F.col("elem_ordinal")
        child = F.col("parent_id").isNotNull()
        if relation == "+":
            w = _siblings().orderBy("elem_ordinal")
            return self._flag(rows, child & F.lead(flag).over(w) & (F.lead(order).over(w) == order + 1))
        if relation == "~":
            return self._flag(rows, child & (F.max(F.when(flag, order)).over(_siblings()) > order))
        return self._flag(rows, F.min(F.when(flag, F.col("node_id"))).over(_earlier(backward=True)) <= F.col("last_id"))

    def _alternatives(self, rows: DataFrame, elements: DataFrame, parts: list[list[Compound]], scope: DataFrame | None) -> tuple[DataFrame, Column]:
        any_ = F.lit(False)
        for part in parts:
            rows, found = self._compound(rows, elements, part[0], scope)
            for c in part[1:]:
                rows, right = self._compound(rows, elements, c, scope)
                rows, left = self._after(rows, found, c.relation)
                rows, found = self._flag(rows, left & right)
            any_ = any_ | found
        return self._flag(rows, any_)

    def _has(self, rows: DataFrame, elements: DataFrame, parts: list[list[Compound]], scope: DataFrame | None) -> tuple[DataFrame, Column]:
        any_ = F.lit(False)
        for part in parts:
            # From the right end back to the first compound, which stands in the relation to the candidate.
            rows, hit = self._compound(rows, elements, part[-1], scope)
            for left, c in zip(reversed(part[:-1]), reversed(part[1:]), strict=True):
                rows, own = self._compound(rows, elements, left, scope)
                rows, right = self._before(rows, hit, c.relation)
                rows, hit = self._flag(rows, own & right)
            rows, found = self._before(rows, hit, part[0].relation or " ")
            rows, found = self._flag(rows, found)
            any_ = any_ | found
        return self._flag(rows, any_)

    @staticmethod
    def _lang(elements: DataFrame, out: DataFrame, arg: str) -> DataFrame:
        tagged = elements.filter(F.try_element_at("attrs", F.lit("lang")).isNotNull()).select(
            F.col("page_id").alias("_p"), F.col("node_id").alias("_id"), F.col("last_id").alias("_last"), F.col("depth").alias("_d"), F.try_element_at("attrs", F.lit("lang")).alias("_lang")
        )
        near = out.select("page_id", "node_id").join(tagged, (F.col("page_id") == F.col("_p")) & (F.col("node_id") >= F.col("_id")) & (F.col("node_id") <= F.col("_last")))
        best = near.groupBy(*KEY).agg(F.max_by("_lang", "_d").alias("_lang"))
        return best.filter(F.col("_lang").rlike(f"(?iu)^{re.escape(arg.strip())}(?:-|$)")).select(*KEY)


def select(nodes: DataFrame, selector: str, scope: DataFrame | None = None) -> DataFrame:
    """Nodes that match, each once; order them by (page_id, node_id) for document order."""
    return Selector(selector, placed=set(SIBLINGS.fieldNames()) <= set(nodes.columns)).apply(nodes, scope)


def find(pages: DataFrame, selector: str, columns: list[str] | None = None, scope: DataFrame | None = None, config: SiteConfig = DEFAULT) -> DataFrame:
    """Nodes of pages that match, with these columns: what neither they nor the selector need is not parsed into rows."""
    compiled = Selector(selector, placed=True)
    wanted = [c for c in columns or NODES.fieldNames() if c != "page_id"]
    types = compiled.types()
    nodes = parse_pages(pages, config, columns=sorted({*wanted, *compiled.columns()}), types=sorted(types) if types is not None else None)
    return compiled.apply(nodes, scope).select("page_id", *wanted)


def closest(nodes: DataFrame, start: DataFrame, selector: str) -> DataFrame:
    """(page_id, node_id, closest_id): for each start node the nearest ancestor or self that matches.

    Types alone are read from the start nodes' own chains of ancestors; anything else is a join.
    """
    kinds = {p[0].type for p in parse(selector) if p == [Compound(type=p[0].type)]} if selector.strip() else {None}
    if None not in kinds and len(kinds) == len(split_top(selector, ",")) and {"anc", "type"} <= set(start.columns):
        chain = F.concat("anc", F.array(F.struct(F.col("node_id").alias("id"), F.col("type").alias("type"))))
        at = F.try_element_at(F.filter(chain, lambda a: a["type"].isin(*sorted(kinds))), F.lit(-1))["id"]
        return start.select(*KEY, at.alias("closest_id")).filter("closest_id is not null")
    hits = select(nodes, selector).select(F.col("page_id").alias("_p"), F.col("node_id").alias("_id"), F.col("last_id").alias("_last"), "depth")
    met = start.select(*KEY).join(hits.hint("merge"), (F.col("page_id") == F.col("_p")) & F.col("node_id").between(F.col("_id"), F.col("_last")))
    return met.groupBy(*KEY).agg(F.max_by("_id", "depth").alias("closest_id"))
