"""Wikitext of one page to a syntax tree.

Every stage works on a *mask*: a copy of the page, of the same length, in which text that
an earlier stage has claimed is overwritten by a filler. Offsets in the mask are offsets
in the page, so nodes carry absolute positions from the start and nothing is renumbered.
When a construct is found, its inner regions are taken through the later stages first and
then its whole span is filled.

Stages in order of precedence: redirect, comments and extension tags, braces and headings,
HTML tags, tables, rules and switches, links, quotes, bracketed URLs, bare URLs, lists,
variant conversion.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, insort
from functools import lru_cache
from operator import attrgetter

from markloom.config import DEFAULT, SiteConfig
from markloom.kernel.titles import normalise

FILL = ""  # a node
VOID = ""  # a node that shows nothing, such as a comment
PIPE = ""  # rest of a magic word that stands for a pipe
WIKI_EXT = frozenset("indicator poem ref option combooption tab tabs langconvert phonos".split())
#: Stages that the inner text of a tag is not taken through.
SKIPPED = {"poem": frozenset({"heading"}), "langconvert": frozenset({"list"}), "pre": frozenset({"list"})}
#: Tags whose inner text is only these tags; what else is there shows nothing.
NESTED = {"references": ("ref",), "choose": ("option", "choicetemplate"), "combobox": ("combooption",)}
_START = attrgetter("start")
STAGES = ("redirect", "ext", "brace", "html", "table", "rule", "link", "quote", "extlink", "url", "list", "convert")
#: Markup nests as deep as the page says; Python frames are on the heap, so this only has to be out of reach.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


#: Without one of these a text holds no markup (digits are for RFC 1 and the like).
_MARKS = frozenset("{}[]=<>'-_:;*#|0123456789")
_SIGNS = _MARKS - frozenset("0123456789")
_NUMBERED = re.compile(r"RFC|PMID|ISBN", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "end", "inner", "name", "props", "start", "type")

    def __init__(self, type_: str, start: int, end: int, name: str | None = None, inner: tuple[int, int] | None = None, **props: str):
        self.type, self.start, self.end, self.name = type_, start, end, name
        self.inner = inner or (start, end)
        self.children: list[Node] = []
        self.attrs: dict[str, str] = {}
        self.props = props

    def add(self, child: Node) -> Node:
        self.children.append(child)
        return child


@lru_cache(maxsize=8)
def _patterns(key: int) -> dict[str, re.Pattern]:
    config = _configs[key]
    ext = "|".join(sorted(config.ext - {"translate", "tvar"}, key=len, reverse=True)) or "(?!)"
    protocols = "|".join(map(re.escape, sorted(config.protocols, key=len, reverse=True))) or "(?!)"
    url = r"[^\s<>\"\[\]\x00-\x20|]"
    return {
        "ext": re.compile(
            rf"<!--.*?(?:-->|\Z)|<(/?)(noinclude|includeonly|onlyinclude)(\s[^<>]*)?/?>|<({ext})(\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)?(?:/>|>(.*?)</\4\s*>)", re.DOTALL | re.IGNORECASE
        ),
        "extlink": re.compile(rf"\[((?:{protocols}|//){url}+)([^\]\n]*)\]", re.IGNORECASE),
        "url": re.compile(rf"(?<![\w])((?:{protocols}){url}+)|(?<![\w])(?:(RFC|PMID) +(\d+)|ISBN +((?:97[89][- ]?)?(?:\d[- ]?){{9}}[\dXx]))(?![\w])", re.IGNORECASE),
        "redirect": re.compile(rf"(\s*(?:{'|'.join(map(re.escape, config.redirection))})\s*:?\s*)\[\[([^\n|\[\]]+)(\|.*?)?\]\]", re.IGNORECASE),
    }


_configs: dict[int, SiteConfig] = {}
HTML = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>")
BRACE = re.compile(r"\{{2,}|\}{2,}|\[\[|\]\]|-\{(?!\{)|\}-|\||=|^(={1,6})(?=[^\n])", re.MULTILINE)
HEADING = re.compile(rf"^(={{1,6}})(.+?)\1([ \t{VOID}]*)$", re.MULTILINE)
ATTR = re.compile(r"([^\s/][^\s/=]*)(?:(\s*=\s*)(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z)|(\S*)))?")
ATTR_NAME = re.compile(rf"[\w:{FILL}][\w:.\-{FILL}]*")
RULE = re.compile(rf"^(-{{4,}})|__([A-Za-z]+)__", re.MULTILINE)
LIST = re.compile(rf"^{VOID}*([;:*#]+)", re.MULTILINE)
TVAR = re.compile(r"(<tvar\|[^>]+>).*?(</>)|(?i:(<tvar\s+name\s*=(?:\s*(?:\"[^\"]*\"|'[^']*'|[^\"'\s>]+))?\s*>).*?(</tvar\s*>))", re.DOTALL)
QUOTE = re.compile(r"'{2,}")
CONDITIONALS = frozenset("if ifeq ifexpr ifexist iferror switch".split())
#: Letters that may stand before the bar of a conversion.
FLAGS = frozenset("ASTRDNH-")
BRACKETS = re.compile(r"[\[\]{}]+")


class Parser:
    def __init__(self, text: str, config: SiteConfig = DEFAULT, include: bool = False, last: str = "convert", page: str = ""):
        self.text, self.config, self.include, self.page = text, config, include, page
        self.mask = list(text)
        self.last = STAGES.index(last)
        self.transcluded = include
        self.inside: list[str] = []  # references around what is parsed
        _configs[id(config)] = config
        self.re = _patterns(id(config))

    def fill(self, start: int, end: int, char: str = FILL) -> None:
        if char == VOID:
            self.mask[start:end] = [c if c == "\n" else char for c in self.mask[start:end]]
        else:
            self.mask[start:end] = [char] * (end - start)

    def view(self, start: int, end: int) -> str:
        return "".join(self.mask[start:end])

    def run(self) -> Node:
        root = Node("root", 0, len(self.text))
        start = 0
        if m := self.re["redirect"].match(self.text):
            target = normalise(m[2], 0, self.config)
            if target.valid:
                self.include = False
                node = root.add(Node("redirect", m.start(), m.end(), target.title))
                node.add(Node("redirect-syntax", m.start(), m.start() + len(m[1])))
                link = node.add(Node("redirect-target", m.start() + len(m[1]), m.end(), target.title))
                link.add(Node("link-target", m.start(2), m.end(2)))
                if m[3]:
                    link.add(Node("noinclude", m.start(3) + 1, m.end(3), ignored="redirect"))
                node.props["target"] = target.title
                self.fill(m.start(), m.end())
                start = m.end()
        if self.include and self._only(root):
            return root
        self._ext(root, start, len(self.text), 0)
        self._region(root, 0, len(self.text), 2, 0)
        return root

    def _only(self, root: Node) -> bool:
        """A transcluded page with ``<onlyinclude>`` parts is only these; the rest of it shows nothing."""
        found = list(re.finditer(r"<onlyinclude>(.*?)</onlyinclude>", self.text, re.DOTALL))
        at = 0
        for m in found:
            if m.start() > at:
                root.add(Node("noinclude", at, m.start()))
            node = root.add(Node("onlyinclude", m.start(), m.end(), "onlyinclude", m.span(1)))
            self._ext(node, *m.span(1), 1)
            self._region(node, *m.span(1), 2, 1)
            at = m.end()
        if found and at < len(self.text):
            root.add(Node("noinclude", at, len(self.text)))
        return bool(found)

    def _translate(self, parent: Node, start: int, end: int, depth: int) -> None:
        """``<translate>`` with its ``<tvar>`` marks, where the wiki has them; nowiki comes first."""
        view = self.view(start, end)
        plain = re.sub(r"<nowiki>.*?</nowiki>", lambda m: FILL * len(m[0]), view, flags=re.DOTALL | re.IGNORECASE)
        for m in re.finditer(r"<translate( nowrap)?>(.*?)</translate>", plain, re.DOTALL):
            node = parent.add(Node("translate", start + m.start(), start + m.end(), "translate", (start + m.start(2), start + m.end(2))))
            if m[1]:
                node.add(Node("translate-attr", start + m.start(1), start + m.end(1)))
            inner = node.add(Node("translate-inner", start + m.start(2), start + m.end(2)))
            for t in TVAR.finditer(m[2]):
                for k in range(1, 5):
                    if t[k] is not None:
                        a, b = inner.start + t.start(k), inner.start + t.end(k)
                        inner.add(Node("tvar", a, b, "tvar", closing=str(k % 2 == 0).lower()))
                        self.fill(a, b, VOID)
            self._ext(inner, inner.start, inner.end, depth + 1)
            self._region(inner, inner.start, inner.end, 2, depth + 1)
            self.fill(node.start, node.end)

    # -- comments, inclusion tags, extension tags

    def _ext(self, parent: Node, start: int, end: int, depth: int) -> None:
        if self.last < 1:
            return
        if "translate" in self.config.ext and depth == 0:
            self._translate(parent, start, end, depth)
        found: list[Node] = []
        pos, view = 0, self.view(start, end)
        if "<" not in view:
            return
        while m := self.re["ext"].search(view, pos):
            a, b = start + m.start(), start + m.end()
            pos = m.end()
            if m[0].startswith("<!--"):
                found.append(Node("comment", a, b, inner=(a + 4, b - 3 if m[0].endswith("-->") and len(m[0]) >= 7 else b), closed=str(m[0].endswith("-->") and len(m[0]) >= 7).lower()))
                self.fill(a, b, VOID)
            elif m[2]:
                name = m[2].lower()
                hide = "noinclude" if self.include else "includeonly"
                closing = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(view, m.end()) if name == hide and not m[1] else None
                if name == hide and not m[1]:
                    stop = start + closing.end() if closing else end
                    found.append(Node("include", a, stop, name, (b, start + closing.start() if closing else end), closed=str(bool(closing)).lower(), attr=(m[3] or "").strip()))
                    self.fill(a, stop, VOID)
                    pos = stop - start
                else:
                    found.append(Node("noinclude", a, b, name))
                    self.fill(a, b, VOID)
            else:
                found.append(self._ext_tag(m, start, depth))
                self.fill(a, b)
        parent.children = sorted(parent.children + found, key=_START)

    def _ext_tag(self, m: re.Match, start: int, depth: int) -> Node:
        a, b, name = start + m.start(), start + m.end(), m[4].lower()
        closed = m[6] is not None
        node = Node("ext", a, b, name, selfClosing=str(not closed).lower())
        head = a + 1 + len(m[4])
        node.attrs = self._attributes(node, "ext", head, head + len(m[5] or ""))
        if self.inside:
            node.props["in"] = self.inside[-1]
        if closed:
            x, y = start + m.start(6), start + m.end(6)
            node.inner = (x, y)
            node.props["blank"] = str(not self.text[x:y].strip()).lower()
            inner = node.add(Node("ext-inner", x, y, name))
            if name in WIKI_EXT or name == "pre" and node.attrs.get("format") == "wikitext":
                self._ext(inner, x, y, depth + 1)
                self._region(inner, x, y, 2, depth + 1, SKIPPED.get(name, frozenset()))
            elif name == "pre":
                for m in re.finditer(r"(<nowiki>).*?(</nowiki>)", self.text[x:y], re.DOTALL | re.IGNORECASE):
                    inner.add(Node("noinclude", x + m.start(1), x + m.end(1), "nowiki"))
                    inner.add(Node("noinclude", x + m.start(2), x + m.end(2), "nowiki"))
            elif name in NESTED:
                self._nested(inner, x, y, name, depth)
            elif name == "hiero":
                for m in re.finditer(r"<!--(.*?)-->", self.text[x:y], re.DOTALL):
                    inner.add(Node("comment", x + m.start(), x + m.end(), inner=(x + m.start(1), x + m.end(1)), closed="true"))
            elif name == "gallery":
                self._gallery(inner, x, y, depth)
            elif name == "imagemap":
                self._imagemap(inner, x, y, depth)
            elif name == "charinsert":
                self._charinsert(inner, x, y)
            elif name == "categorytree":
                title = normalise(self.text[x:y], 14, self.config)
                if title.valid and title.main:
                    inner.props["target"] = title.title
            elif name == "poll":
                for w in re.finditer(r"[^\n]+", self.text[x:y]):
                    inner.add(Node("poll-line", x + w.start(), x + w.end()))
            elif name in ("inputbox", "dynamicpagelist", "seo"):
                self._param_lines(inner, x, y, "|" if name == "seo" else "\n")
        return node

    def _nested(self, parent: Node, start: int, end: int, name: str, depth: int) -> None:
        """Only the allowed child tags are kept; for references, comments and calls as well."""
        if name == "references":
            self.inside.append(name)
            self._ext(parent, start, end, depth + 1)
            self.inside.pop()
            self._braces(parent, start, end, depth + 1, frozenset({"heading"}))
            parent.children = [c if c.type != "ext" or c.name in NESTED[name] else Node("noinclude", c.start, c.end) for c in parent.children]
        else:
            flags = re.DOTALL | (re.IGNORECASE if name == "combobox" else re.NOFLAG)
            tag = re.compile(rf"<()()()({'|'.join(NESTED[name])})(\s[^>]*?)?(?:/>|>(.*?)</\4\s*>)", flags)
            for m in tag.finditer(self.text[start:end]):
                parent.add(self._ext_tag(m, start, depth + 1))
        at = start
        for c in [*parent.children, None]:
            stop = c.start if c else end
            if self.text[at:stop].strip():
                comment = re.fullmatch(r"\s*<!--.*-->\s*", self.text[at:stop], re.DOTALL)
                parent.add(Node("noinclude", at, stop, name, ignored="comment" if comment else name))
            at = c.end if c else end
        parent.children.sort(key=_START)

    def _charinsert(self, parent: Node, start: int, end: int) -> None:
        """Lines of items; ``a+b`` goes around the cursor, a nowiki part is one item's text."""
        for m in re.finditer(r"[^\n]+", self.text[start:end]):
            line = parent.add(Node("charinsert-line", start + m.start(), start + m.end()))
            for w in re.finditer(r"(?:<nowiki>.*?</nowiki>|\S)+", m[0], re.IGNORECASE):
                text = re.sub(r"(?i)<nowiki>(.*?)</nowiki>", r"\1", w[0])
                before, plus, after = text.partition("+")
                if not before:
                    before, plus, after = text, "", ""
                item = line.add(Node("charinsert-item", line.start + w.start(), line.start + w.end(), text))
                item.props |= {"before": before, "after": after, "pair": str(bool(plus)).lower()}

    def _param_lines(self, parent: Node, start: int, end: int, separator: str = "\n") -> None:
        for m in re.finditer(rf"[^{re.escape(separator)}]+", self.text[start:end]):
            key, sep, value = m[0].partition("=")
            a = start + m.start()
            if not sep and key.strip() and not re.fullmatch(r"\s*<!--.*-->\s*", key, re.DOTALL):
                parent.add(Node("param-line", a, start + m.end(), "", tag=parent.name or ""))
            if sep:
                line = parent.add(Node("param-line", a, start + m.end(), key.strip().lower()))
                line.props |= {"value": value.strip(), "tag": parent.name or ""}
                parent.attrs[key.strip().lower()] = value.strip()

    def _imagemap(self, parent: Node, start: int, end: int, depth: int) -> None:
        """First line the image; then ``shape coordinates [[link]]``, ``desc`` and ``#`` lines."""
        first = True
        parent.props["image"] = "false"
        for m in re.finditer(r"[^\n]+", self.text[start:end]):
            line, a, b = m[0], start + m.start(), start + m.end()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if first:
                first = False
                parent.props["image"] = "true"
                head = line.partition("|")[0]
                title = normalise(head, 6, self.config)
                good = title.valid and title.ns == 6 and bool(title.main)
                image = parent.add(Node("imagemap-image", a, b, title.title, invalid=str(not good).lower()))
                image.add(Node("link-target", a, a + len(head)))
                continue
            shape = re.match(r"\s*(\w+)\s*([-\d.\s]*)", line)
            kind = shape[1].lower() if shape else ""
            numbers = len(shape[2].split()) if shape else 0
            wanted = {"rect": numbers == 4, "circle": numbers == 3, "poly": numbers >= 6 and numbers % 2 == 0, "default": True, "desc": True}
            link = re.search(r"\[\[[^\[\]]+\]\]|\[[^\[\]\s]+[^\[\]]*\]", line)
            fault = "shape" if kind not in wanted else "coord" if not wanted[kind] else "link" if kind != "desc" and not link else ""
            row = parent.add(Node("imagemap-link", a, b, kind, fault=fault))
            if link:
                self._region(row, a + link.start(), a + link.end(), 6, depth + 1)

    def _gallery(self, parent: Node, start: int, end: int, depth: int) -> None:
        for m in re.finditer(r"[^\n]+", self.text[start:end]):
            if not m[0].strip():
                continue
            a, b = start + m.start(), start + m.end()
            head, bar, _ = m[0].partition("|")
            title = normalise(head, 6, self.config)
            if not title.valid or not title.main:
                line = m[0].strip()
                kind = "galleryNoImage" if line.startswith("|") else "galleryComment" if line.startswith("<!--") or line.endswith("-->") else "galleryImage"
                if re.fullmatch(r"<!--.*-->", line):
                    kind = "comment"
                parent.add(Node("noinclude", a, b, ignored=kind))
                continue
            image = parent.add(Node("gallery-image", a, b, title.title))
            image.add(Node("link-target", a, a + len(head)))
            if bar:
                cut = a + len(head) + 1
                self._ext(parameter := image.add(Node("image-parameter", cut, b, "caption")), cut, b, depth + 1)
                self._region(parameter, cut, b, 2, depth + 1)

    # -- attributes

    def _attributes(self, owner: Node, kind: str, start: int, end: int) -> dict[str, str]:
        if end <= start:
            return {}
        box = Node(f"{kind}-attrs", start, end, owner.name)
        tag = owner.name if kind != "table" else {"holder": "table", "tr": "tr"}.get(owner.type, owner.name)
        owner.add(box)
        attrs: dict[str, str] = {}
        last = start
        for m in ATTR.finditer(self.view(start, end)):
            a, b = start + m.start(), start + m.end()
            if not ATTR_NAME.fullmatch(m[1].replace(VOID, "")):
                continue  # not an attribute: it stays between the others
            if self.text[last:a].strip():
                box.add(Node(f"{kind}-attr-dirty", last, a))
            key = self.text[a : a + len(m[1])].lower()
            value, quote = next(((self.text[start + m.start(k) : start + m.end(k)], q) for k, q in ((3, 4), (5, 6), (7, None)) if m[k] is not None), ("", None))
            attr = box.add(Node(f"{kind}-attr", a, b, key))
            attr.add(Node("attr-key", a, a + len(m[1])))
            k = next((k for k in (3, 5, 7) if m[k] is not None), None)
            if k:
                attr.add(Node("attr-value", start + m.start(k), start + m.end(k)))
            attr.props["balanced"] = str(quote is None or bool(m[quote])).lower()
            attr.props["value"] = re.sub(r"[\t\r\n ]+", " ", value).strip()
            attr.props["has_value"] = str(k is not None).lower()
            attr.props["tag"] = tag or ""
            attr.props["plain"] = str(k is None or FILL not in self.mask[start + m.start(k) : start + m.end(k)]).lower()
            attrs[key] = attr.props["value"]
            last = b
        if self.text[last:end].strip():
            box.add(Node(f"{kind}-attr-dirty", last, end))
        box.attrs = attrs
        if "itemscope" in attrs:
            for child in box.children:
                child.props["itemscope"] = "true"
        return attrs

    # -- a region through the later stages

    def _region(self, parent: Node, start: int, end: int, stage: int, depth: int, skip: frozenset[str] = frozenset()) -> None:
        if start >= end:
            return
        chars = self.mask[start:end]
        if _MARKS.isdisjoint(chars) or _SIGNS.isdisjoint(chars) and not _NUMBERED.search("".join(chars)):
            return
        steps = (None, None, self._braces, self._html, self._tables, self._rules, self._links, self._quotes, self._extlinks, self._urls, self._lists, self._converters)
        for k in range(stage, min(self.last, 11) + 1):
            if STAGES[k] not in skip:
                steps[k](parent, start, end, depth, skip)

    # -- braces

    def _braces(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "{{" in view or "[[" in view:
            self._brace_scan(parent, start, end, view, depth)
            view = self.view(start, end)
        if "=" in view and "heading" not in skip:
            for m in HEADING.finditer(view):
                a, b = start + m.start(), start + m.end()
                level = len(m[1])
                if not m[2].strip():
                    continue
                node = Node("heading", a, b, str(level), (start + m.start(2), start + m.end(2)), level=str(level))
                x, y = node.inner
                self._take(parent, node, [("heading-title", x, y, None)], 3, depth, frozenset({"list", "rule", "table"}))
                if m[3]:
                    node.add(Node("heading-trail", start + m.start(3), start + m.end(3)))

    def _take(self, parent: Node, node: Node, parts: list[tuple[str, int, int, str | None]], stage: int, depth: int, skip: frozenset[str] = frozenset()) -> None:
        """Make children of node for these regions, run later stages in them, hang node under parent, fill its span."""
        for type_, a, b, name in parts:
            child = Node(type_, a, b, name)
            child.children = self._pull(parent, a, b)
            self._region(child, a, b, stage, depth + 1, skip)
            node.add(child)
        for c in self._pull(parent, node.start, node.end):
            self._sink(node, c)
        insort(parent.children, node, key=_START)
        self.fill(node.start, node.end)

    @staticmethod
    def _pull(parent: Node, start: int, end: int) -> list[Node]:
        """Take the children of parent that lie in a region; children are kept in order of their starts."""
        found = parent.children
        lo = hi = bisect_left(found, start, key=_START)
        while hi < len(found) and found[hi].start < end:
            hi += 1
        inside = [c for c in found[lo:hi] if c.end <= end]
        found[lo:hi] = [c for c in found[lo:hi] if c.end > end]
        return inside

    @staticmethod
    def _sink(node: Node, child: Node) -> None:
        """Hang a node found earlier under the deepest part that holds it, such as an attribute."""
        while deeper := next((x for x in node.children if x.start <= child.start and child.end <= x.end), None):
            node = deeper
        node.children.append(child)

    def _brace_scan(self, parent: Node, start: int, end: int, view: str, depth: int) -> None:
        stack: list[list] = []  # [kind, position, braces open, bars, first '=' after the last bar]
        last_close = max(view.rfind("}}"), view.rfind("]]"))
        for m in BRACE.finditer(view):
            token, at = m[0], m.start()
            if token[0] == "{" and at < last_close:
                stack.append(["{", at + len(token), len(token), [], []])
            elif token == "[[":
                stack.append(["[", at + 2, 2, [], []])
            elif token == "]]":
                if stack and stack[-1][0] == "[":
                    stack.pop()
            elif token[0] == "}" and token != "}-":
                left, pos = len(token), at
                while left >= 2 and stack:
                    if stack[-1][0] != "{":
                        if any(s[0] == "{" for s in stack):
                            stack.pop()
                            continue
                        break
                    top = stack[-1]
                    use = 3 if left >= 3 and top[2] >= 3 else 2
                    if top[2] < 2:
                        stack.pop()
                        continue
                    self._call(parent, start, top[1] - 0, pos, use, top[3], top[4], depth)
                    left, pos = left - use, pos + use
                    top[2] -= use
                    top[1] -= use
                    if top[2] >= 2:
                        top[3], top[4] = [], []
                    else:
                        stack.pop()
            elif token == "|" and stack:
                stack[-1][3].append(at)
                stack[-1][4].append(None)
            elif token[0] == "=" and stack and stack[-1][0] == "{" and stack[-1][4] and stack[-1][4][-1] is None:
                stack[-1][4][-1] = at

    def _call(self, parent: Node, base: int, x: int, y: int, braces: int, bars: list[int], equals: list[int | None], depth: int) -> None:
        """One matched pair of braces around [x, y), relative to base; bars split it."""
        bars_at = [b for b in bars if x <= b < y]
        eq = [e for b, e in zip(bars, equals, strict=True) if x <= b < y]
        cuts = [x, *(b + 1 for b in bars_at)]
        ends = [*bars_at, y]
        a, b = base + x - braces, base + y + braces
        head = self.view(base + cuts[0], base + ends[0])
        raw = self.text[base + cuts[0] : base + ends[0]]
        if braces == 3:
            node = Node("arg", a, b, raw.strip(), (base + x, base + y), include=str(self.transcluded).lower())
            parts = [("arg-name", base + cuts[0], base + ends[0], None)]
            parts += [("arg-default" if k == 1 else "hidden", base + cuts[k], base + ends[k], None) for k in range(1, len(cuts))]
            self._take(parent, node, parts, 3, depth)
            return
        name = re.sub(f"[{VOID}]", "", head).strip()
        modifier = re.match(r"(?i)(safesubst|subst|msgnw|msg|raw):", name)
        bare = name[modifier.end() :].strip() if modifier else name
        fn, colon, first = bare.partition(":")
        key = fn.strip().lower()
        if (colon and key in self.config.functions) or (not colon and self._variable(bare)):
            canonical = self.config.functions[key] if colon else bare.lower()
            node = Node("magic-word", a, b, canonical, (base + x, base + y))
            shift = head.find(":") + 1 if colon else len(head)
            node.add(Node("magic-word-name", base + x, base + x + (shift - 1 if colon else shift), canonical))
            spans = [(base + x + shift, base + ends[0], None)] if colon else []
            spans += [(base + cuts[k], base + ends[k], eq[k - 1]) for k in range(1, len(cuts))]
            named = {"switch": 1, "tag": 2, "invoke": 2}.get(canonical, 1 << 30)
            self._parameters(parent, node, base, spans, depth, named)
            if canonical in CONDITIONALS:
                left = list(node.children)
                while left:
                    child = left.pop()
                    if child.type == "html":
                        child.props["conditional"] = "true"
                    if child.type != "magic-word":
                        left += child.children
            if canonical == "!":
                self.mask[a:b] = ["|"] + [PIPE] * (b - a - 1)
            return
        if FILL in bare or re.search(r"[<>\[\]{}\n]", bare.strip()):
            title, valid = None, FILL in bare
        else:
            t = normalise(bare, 10, self.config)
            title, valid = t.title, t.valid and bool(t.main)
        if not valid:
            return
        node = Node("template", a, b, title or self.text[base + x : base + ends[0]].strip(), (base + x, base + y))
        if modifier:
            node.props["modifier"] = modifier[1].lower()
        self._take_inner(parent, node.add(Node("template-name", base + x, base + ends[0], node.name)))
        spans = [(base + cuts[k], base + ends[k], eq[k - 1]) for k in range(1, len(cuts))]
        self._parameters(parent, node, base, spans, depth, 0)

    def _variable(self, name: str) -> bool:
        return name.lower() in self.config.variables and (name.isupper() or not name[:1].isalpha() or name.lower() == name and name in ("!", "="))

    def _take_inner(self, parent: Node, child: Node) -> None:
        child.children += self._pull(parent, child.start, child.end)

    def _parameters(self, parent: Node, node: Node, base: int, spans: list[tuple[int, int, int | None]], depth: int, named_from: int) -> None:
        anon = 0
        for k, (a, b, equal) in enumerate(spans):
            cut = base + equal if equal is not None and k >= named_from else None
            p = Node("parameter", a, b)
            if cut is None:
                anon += 1
                key = str(anon)
                regions = [("parameter-key", a, a, None), ("parameter-value", a, b, None)]
            else:
                key = re.sub(r"<!--.*?(?:-->|\Z)", "", self.text[a:cut], flags=re.DOTALL).strip(" \t\n\x00\x0b")
                regions = [("parameter-key", a, cut, None), ("parameter-value", cut + 1, b, None)]
            self._take(parent, p, regions, 3, depth)
            parent.children.pop(bisect_left(parent.children, p.start, key=_START) + next(k for k, c in enumerate(parent.children[bisect_left(parent.children, p.start, key=_START) :]) if c is p))
            node.add(p)
            p.name = key
            value = re.sub(r"(?m)^[ \t]*<!--.*?-->[ \t]*\n|<!--.*?(?:-->|\Z)", "", self.text[regions[1][1] : b], flags=re.DOTALL) if "<!--" in self.text[a:b] else self.text[regions[1][1] : b]
            value = value if cut is None else value.strip()
            p.props |= {"anon": str(cut is None).lower(), "value": value, "pos": str(k + 1)}
            node.attrs[key] = value
        self._take(parent, node, [], 12, depth)

    # -- HTML

    def _html(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "<" not in view:
            return
        pos = 0
        while m := HTML.search(view, pos):
            pos = m.start() + 1
            name = m[2].lower()
            if name not in self.config.html:
                continue
            a, b = start + m.start(), start + m.end()
            if name in ("meta", "link") and not re.search(r"(?i)itemprop\s*=", m[3]) or name == "meta" and not re.search(r"(?i)content\s*=", m[3]) or name == "link" and not re.search(r"(?i)href\s*=", m[3]):
                continue
            node = Node("html", a, b, name, closing=str(bool(m[1])).lower(), selfClosing=str(bool(m[4])).lower())
            x = start + m.start(3)
            node.attrs = self._attributes(node, "html", x, start + m.end(3))
            self._take(parent, node, [], 12, depth)
            pos = m.end()

    # -- tables

    def _tables(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "{|" not in view:
            return
        stack: list[dict] = []
        pos = 0
        for line in view.split("\n"):
            at, stop = pos, pos + len(line)
            pos = stop + 1
            body = line.lstrip(" \t" + VOID)
            lead = len(line) - len(body)
            indent = re.match(r"[:\s]*", body)[0] if body.startswith((":", "{|")) else ""
            if body[len(indent) :].startswith("{|"):
                x = at + lead + len(indent)
                stack.append({"start": x, "attrs": (x + 2, stop), "rows": [], "row": None, "parts": []})
                continue
            if not stack:
                continue
            table = stack[-1]
            if body.startswith("|}"):
                self._close_cell(table, at + lead)
                table["end"] = at + lead + 2
                table["closed"] = True
                stack.pop()
                self._make_table(parent, start, table, depth)
                continue
            if body.startswith("|-"):
                self._close_cell(table, max(at - 1, 0))
                dashes = len(body) - len(body[1:].lstrip("-")) 
                table["rows"].append({"start": at + lead, "syntax": dashes, "attrs": (at + lead + dashes, stop), "cells": []})
            elif body.startswith(("|", "!")):
                self._close_cell(table, max(at - 1, 0))
                self._open_cells(table, view, at + lead, stop, body)
            # otherwise the line goes on with the open cell
        while stack:
            table = stack.pop()
            self._close_cell(table, len(view))
            table["end"], table["closed"] = len(view), False
            self._make_table(parent, start, table, depth)

    @staticmethod
    def _close_cell(table: dict, at: int) -> None:
        if table["row"] is not None:
            table["row"]["end"] = max(at, table["row"]["inner"])
            table["row"] = None

    def _open_cells(self, table: dict, view: str, at: int, stop: int, body: str) -> None:
        if not table["rows"]:
            table["rows"].append({"start": None, "cells": []})
        kind = "caption" if body.startswith("|+") else "th" if body[0] == "!" else "td"
        width = 2 if kind == "caption" else 1
        separators = r"\|\|" if kind != "th" else r"\|\||!!"
        cuts = [(at, at + width)] + [(at + width + m.start(), at + width + m.end()) for m in re.finditer(separators, view[at + width : stop])] if kind != "caption" else [(at, at + width)]
        for k, (a, b) in enumerate(cuts):
            end = cuts[k + 1][0] if k + 1 < len(cuts) else stop
            text = view[b:end]
            bar = text.find("|")
            attrs = None
            if bar >= 0 and "[[" not in text[:bar] and "-{" not in text[:bar] and text[bar : bar + 2] != "||":
                attrs = (b, b + bar)
            cell = {"start": a, "syntax": b, "attrs": attrs, "inner": attrs[1] + 1 if attrs else b, "end": end, "kind": kind}
            table["rows"][-1]["cells"].append(cell)
            table["row"] = cell if k + 1 == len(cuts) else None

    def _make_table(self, parent: Node, base: int, t: dict, depth: int) -> None:
        node = Node("table", base + t["start"], base + t["end"], closed=str(t["closed"]).lower())
        own: list[Node] = [Node("table-syntax", node.start, node.start + 2)]
        box = Node("holder", node.start, node.end)
        node.attrs = self._attributes(box, "table", base + t["attrs"][0], base + t["attrs"][1])
        own += box.children
        for r in t["rows"]:
            row = node
            if r["start"] is not None:
                row = Node("tr", base + r["start"], base + r["start"])
                row.add(Node("table-syntax", row.start, base + r["attrs"][0]))
                row.attrs = self._attributes(row, "table", base + r["attrs"][0], base + r["attrs"][1])
                row.end = base + r["attrs"][1]
            cells = []
            for c in r["cells"]:
                cell = Node("td", base + c["start"], base + c["end"], c["kind"], (base + c["inner"], base + c["end"]), subtype=c["kind"])
                cell.add(Node("table-syntax", cell.start, base + c["syntax"]))
                if c["attrs"]:
                    cell.attrs = self._attributes(cell, "table", base + c["attrs"][0], base + c["attrs"][1])
                inner = cell.add(Node("td-inner", base + c["inner"], base + c["end"]))
                self._take_inner(parent, inner)
                self._region(inner, inner.start, inner.end, 5, depth + 1)
                cells.append(cell)
                row.end = max(row.end, cell.end)
            if row is node:
                own += cells
            else:
                row.children += cells
                own.append(row)
        node.children = own
        self._take(parent, node, [], 12, depth)

    # -- rules, switches

    def _rules(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "----" not in view and "__" not in view:
            return
        for m in RULE.finditer(view):
            a, b = start + m.start(), start + m.end()
            if m[1]:
                self._take(parent, Node("hr", a, b), [], 12, depth)
            elif m[2] in self.config.switches_exact or m[2].lower() in self.config.switches:
                self._take(parent, Node("double-underscore", a, b, m[2].lower()), [], 12, depth)

    # -- links

    def _links(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "[[" not in view:
            return
        opened: list[int] = []
        for m in re.finditer(r"\[\[|\]\]", view):
            if m[0] == "[[":
                opened.append(m.start())
            elif opened:
                a = opened.pop()
                now = self.view(start + a, start + m.end())
                if self._link(parent, start + a, start + m.end(), now, depth) is False and opened:
                    continue

    def _link(self, parent: Node, a: int, b: int, view: str, depth: int) -> bool:
        inner = view[2:-2]
        target, bar, _ = inner.partition("|")
        plain = re.sub(f"[{VOID}]", "", target)
        if "\n" in target or not plain.strip() or "[" in plain or "]" in plain or re.match(rf"\s*(?:{'|'.join(map(re.escape, self.config.protocols))}|//)", plain, re.IGNORECASE):
            return False
        forced = plain.strip().startswith(":")
        raw = self.text[a + 2 : a + 2 + len(target)]
        title = normalise(plain if FILL not in plain else raw, 0, self.config)
        if FILL not in plain and not title.valid:
            return False
        kind = "link" if forced or title.interwiki else {6: "file", 14: "category"}.get(title.ns, "link")
        node = Node(kind, a, b, title.title, (a + 2, b - 2))
        node.props["target"] = title.title
        if title.fragment is not None:
            node.props["fragment"] = title.fragment
        parts = [("link-target", a + 2, a + 2 + len(target), None)]
        x = a + 2 + len(target) + 1
        if bar and kind == "file":
            for piece in inner[len(target) + 1 :].split("|"):
                parts.append(("image-parameter", x, x + len(piece), None))
                x += len(piece) + 1
        elif bar:
            parts.append(("link-text", x, b - 2, None))
        self._take(parent, node, parts, 7, depth, frozenset({"list", "rule"}))
        if kind == "file":
            for p in (c for c in node.children if c.type == "image-parameter"):
                text = self.text[p.start : p.end]
                for pattern, key in self.config.image_patterns:
                    if m := pattern.fullmatch(text):
                        p.name = key
                        value = m[1] if m.re.groups else ""
                        if key == "manualthumb" and key in node.attrs:
                            break
                        node.attrs[key] = value.strip()
                        break
                else:
                    p.name = "caption"
                    node.attrs["caption"] = text
                p.props["value"] = node.attrs.get(p.name, "")
        elif kind == "category" and bar:
            node.props["sortkey"] = self.text[a + 2 + len(target) + 1 : b - 2].strip()
        return True

    # -- quotes

    def _quotes(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "''" not in view:
            return
        pos = 0
        for line in view.split("\n"):
            runs = [(m.start(), len(m[0])) for m in QUOTE.finditer(line)]
            if runs:
                open_bold = open_italic = False
                for at, n in balanced_quotes(line, runs):
                    a = start + pos + at
                    bold, italic = n in (3, 5), n in (2, 5)
                    node = Node("quote", a, a + n, bold=str(bold).lower(), italic=str(italic).lower())
                    node.props["closes"] = str(bold and open_bold or italic and open_italic).lower()
                    open_bold, open_italic = open_bold ^ bold, open_italic ^ italic
                    if line[at - 1 : at] == "'":
                        lead = line[:at].rstrip("'")
                        node.props["apostrophes"] = str(at - len(lead))
                        node.props["word"] = str(at - len(lead) == 1 and re.search(r"(?i)[a-z\d]$", lead) is not None).lower()
                    self._take(parent, node, [], 12, depth)
            pos += len(line) + 1

    # -- external links

    def _extlinks(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if "[" not in view:
            return
        for m in self.re["extlink"].finditer(view):
            a, b = start + m.start(), start + m.end()
            node = Node("ext-link", a, b, m[1], url=m[1])
            parts = [("ext-link-url", a + 1, a + 1 + len(m[1]), None)]
            text = m[2]
            lead = len(text) - len(text.lstrip(" \t"))
            if text.strip():
                parts.append(("ext-link-text", a + 1 + len(m[1]) + lead, b - 1, None))
            self._take(parent, node, parts, 11, depth)

    def _urls(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        if ":" not in view and not _NUMBERED.search(view):
            return
        for m in self.re["url"].finditer(view):
            a, b = start + m.start(), start + m.end()
            if m[1]:
                trail = ",;.:!?" + ("" if "(" in m[1] else ")")
                url = m[1].split("''")[0].rstrip(trail)
                url = re.split(r"&(?:lt|gt);", url)[0]
                if not url.partition(":")[2].strip("/"):
                    continue
                self._take(parent, Node("free-ext-link", a, a + len(url), url, url=url), [], 12, depth)
            else:
                kind = m[2].upper() if m[2] else "ISBN"
                number = m[3] or re.sub(r"[- ]", "", m[4]).upper()
                self._take(parent, Node("magic-link", a, b, kind, number=number), [], 12, depth)

    # -- lists

    def _lists(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        view = self.view(start, end)
        last, after = "", -1  # the prefix of the line before, and where the next line begins
        for m in LIST.finditer(view):
            stop = view.find("\n", m.end())
            stop = len(view) if stop < 0 else stop
            prefix = m[1]
            levels = prefix.replace(";", ":")
            common = 0
            if m.start() == after:
                while common < min(len(levels), len(last)) and levels[common] == last[common]:
                    common += 1
            last, after = levels, stop + 1
            a = start + m.start(1)
            self._take(parent, Node("list", a, a + len(prefix), prefix, prefix=prefix, common=str(common)), [], 12, depth)
            terms = self._terms(prefix, common)
            if terms:
                self._definitions(parent, start + m.end(), start + stop, terms, depth)

    @staticmethod
    def _terms(prefix: str, common: int) -> int:
        """How many terms a line opens; levels that it shares with the line before are open already."""
        new = prefix[common - 1 :] if common > 1 else prefix
        terms = new.count(";")
        if common > 1 and new.startswith(";"):
            shared = prefix[: common - 1]
            terms += shared.count(";") + (shared[0] != ";") if ";" in shared else 0
        return terms

    def _definitions(self, parent: Node, start: int, end: int, terms: int, depth: int) -> None:
        """Colons that end the terms of a line: outside of tags, of bold and italic text and of conversions."""
        lo, hi = bisect_left(parent.children, start, key=_START), bisect_left(parent.children, end, key=_START)
        marks: list[tuple[int, str, Node | None]] = [(c.start, c.type, c) for c in parent.children[lo:hi] if c.type in ("html", "quote")]
        marks += [(start + m.start(), m[0], None) for m in re.finditer(r":+|-\{|\}-", self.view(start, end))]
        tags = conversions = 0
        bold = italic = False
        for at, kind, node in sorted(marks, key=lambda x: x[0]):
            if kind in ("-{", "}-"):
                conversions = max(0, conversions + (1 if kind == "-{" else -1))
            elif conversions:
                continue
            elif kind == "html":
                closing, alone = node.props["closing"] == "true", node.props["selfClosing"] == "true"
                if node.name in self.config.html_paired or not alone and node.name not in self.config.html_void:
                    tags = max(0, tags - 1) if closing else tags + 1
            elif kind == "quote":
                if node.props["bold"] == "true":
                    tags, bold = (max(0, tags - 1) if bold else tags + 1), not bold
                if node.props["italic"] == "true":
                    tags, italic = (max(0, tags - 1) if italic else tags + 1), not italic
            elif not tags:
                n = min(len(kind), terms)
                self._take(parent, Node("dd", at, at + n, kind[:n]), [], 12, depth)
                terms -= n
                if not terms:
                    return

    # -- variant conversion

    def _converters(self, parent: Node, start: int, end: int, depth: int, skip: frozenset[str]) -> None:
        """``-{flags|rules}-``, inner ones first."""
        if not self.config.variants:
            return
        view = self.view(start, end)
        opened: list[int] = []
        for m in re.finditer(r"-\{(?!\{)|\}-", view):
            if m[0] == "-{":
                opened.append(m.start())
            elif opened:
                self._converter(parent, start + opened.pop(), start + m.end(), depth)

    def _ignored_flags(self, flags: str) -> set[str]:
        """Flags of a block that have no effect beside its others: variants and letters don't go together."""
        found = [f.strip() for f in flags.split(";")]
        unknown = {f for f in found if "{{{" in f or FILL in f}
        variants = {f for f in found if f.lower() in self.config.variants}
        letters = [f for f in found if f in FLAGS]
        known = sum(1 for f in found if f) - len(unknown)
        if len({f.lower() for f in variants}) == known or len(letters) == known:
            return set()
        return {f for f in found if f and f not in variants and f not in unknown and (variants or f not in FLAGS)}

    def _converter(self, parent: Node, a: int, b: int, depth: int) -> None:
        body = self.view(a + 2, b - 2)
        node = Node("converter", a, b, inner=(a + 2, b - 2))
        flags, bar, rest = body.partition("|")
        x = a + 2
        if bar:
            box = Node("converter-flags", x, x + len(flags))
            at = x
            for f in flags.split(";"):
                box.add(Node("converter-flag", at, at + len(f), f.strip(), ignored=str(f.strip() in self._ignored_flags(flags)).lower()))
                at += len(f) + 1
            node.add(box)
            node.props["flags"] = ";".join(f.strip() for f in flags.split(";"))
            x += len(flags) + 1
        else:
            rest = flags
        for r in re.finditer(r"[^;]+", rest):
            lang, colon, text = r[0].partition(":")
            origin, arrow, target = lang.partition("=>")
            variant = (target if arrow else origin).strip().lower()
            rule = node.add(Node("converter-rule", x + r.start(), x + r.end(), variant if colon else ""))
            if colon and variant in self.config.variants:
                rule.props |= {"variant": variant, "from": origin.strip() if arrow else "", "to": self.text[x + r.end() - len(text) : x + r.end()].strip()}
        self._take(parent, node, [], 12, depth)


def balanced_quotes(line: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Apostrophe runs of one line as (position, 2, 3 or 5): four give one back, more than five all over five.

    With an odd number of both bold and italic marks, one bold loses an apostrophe: the
    first after a one-letter word, else after a longer word, else after a blank.
    """
    out = []
    for at, n in runs:
        if n == 4:
            out.append([at + 1, 3])
        elif n > 5:
            out.append([at + n - 5, 5])
        else:
            out.append([at, n])
    bold = sum(n in (3, 5) for _, n in out)
    italic = sum(n in (2, 5) for _, n in out)
    if bold % 2 and italic % 2:
        single = word = blank = None
        for k, (at, n) in enumerate(out):
            if n != 3:
                continue
            before, before2 = line[at - 1 : at] if at else "", line[at - 2 : at - 1] if at > 1 else ""
            if before == " ":
                blank = k if blank is None else blank
            elif before2 == " ":
                single = k if single is None else single
            else:
                word = k if word is None else word
        pick = next((x for x in (single, word, blank) if x is not None), None)
        if pick is not None:
            out[pick] = [out[pick][0] + 1, 2]
    return [(at, n) for at, n in out]


def clean(text: str | None) -> str:
    text = text or ""
    return re.sub(r"[\x00\x7f]|\r(?=\n|\Z)", "", text) if "\r" in text or "\0" in text or "\x7f" in text else text


def parse(text: str | None, config: SiteConfig = DEFAULT, include: bool = False, last: str = "convert", page: str = "") -> Node:
    return Parser(clean(text), config, include, last, page).run()


HIDDEN = frozenset("comment include noinclude tvar double-underscore hidden category".split())

#: Columns of a node row, in the order in which ``table`` makes them.
FIELDS = (
    "node_id parent_id depth last_id ordinal elem_ordinal type name start end inner_start inner_end data attrs props text anc line col end_line end_col"
).split()


def leaves_wanted(types: frozenset[str] | None) -> bool:
    return types is None or "text" in types


def note_siblings(node: Node, config: SiteConfig) -> None:
    """Props that depend on a node's children together: tags without a partner, odd apostrophes of a heading, image maps without an image."""
    opened: dict[str, list[Node]] = {}
    bold = italic = False
    for c in node.children:
        if c.type == "html" and c.name not in config.html_void and not (c.props["selfClosing"] == "true" and c.name in config.html_flexible):
            c.props["matched"] = "false"
            if c.props["closing"] == "false":
                opened.setdefault(c.name, []).append(c)
            elif opened.get(c.name):
                c.props["matched"] = opened[c.name].pop().props["matched"] = "true"
        elif c.type == "quote":
            bold, italic = bold ^ (c.props["bold"] == "true"), italic ^ (c.props["italic"] == "true")
    if node.type == "heading-title":
        node.props["odd"] = str(bold or italic).lower()


def table(root: Node, text: str, want: frozenset[str] = frozenset(FIELDS), types: frozenset[str] | None = None, config: SiteConfig = DEFAULT) -> list[list]:
    """Pre-order rows of the tree with text leaves, as lists in the order of FIELDS.

    Only wanted columns are worked out (others are None) and only rows of wanted types are
    made; node numbers are those of the whole tree.
    """
    out: list[list] = []
    shows, chains, placed = "text" in want or "props" in want, "anc" in want, bool(want & {"line", "col", "end_line", "end_col"})
    breaks = [-1, *(m.start() for m in re.finditer("\n", text))] if placed else []
    marks, variants = "props" in want, bool(config.variants)
    count = 0

    def row(values: list, a: int, b: int) -> list:
        if placed:
            x, y = bisect_left(breaks, a) - 1, bisect_left(breaks, b) - 1
            values += [x, a - breaks[x] - 1, y, b - breaks[y] - 1]
        else:
            values += [None, None, None, None]
        out.append(values)
        return values

    leaves = leaves_wanted(types)

    def visit(node: Node, parent: int | None, depth: int, ordinal: int, elem: int, anc: tuple) -> str:
        nonlocal count
        me, mine = count, None
        count += 1
        if types is None or node.type in types:
            mine = row([me, parent, depth, me, ordinal, elem, node.type, node.name, node.start, node.end, *node.inner, None, node.attrs, node.props, "", anc], node.start, node.end)
        below = (*anc, (me, node.type)) if chains else ()
        at, k, e = node.start, 0, 0
        shown: list[str] = []
        bare: list[tuple[list, str, str]] = []  # text rows with brackets, and the types around each
        last = ""
        for child in sorted(node.children, key=_SPAN) if len(node.children) > 1 else node.children:
            if child.start < at and child.start != child.end:
                continue  # overlapping leftovers of malformed markup stay text
            if child.start > at:
                if leaves:
                    made = row([count, me, depth + 1, count, k, None, "text", None, at, child.start, at, child.start, text[at : child.start], {}, {}, text[at : child.start] if shows else "", below], at, child.start)
                    if marks and BRACKETS.search(made[12]):
                        bare.append((made, last, child.type))
                if shows:
                    shown.append(text[at : child.start])
                count, k = count + 1, k + 1
            shown.append(visit(child, me, depth + 1, k, e, below))
            if child.type == "heading-title":
                node.props["source"] = text[child.start : child.end]
                if shows:
                    node.props["title"] = shown[-1].strip()
            k, e, last = k + 1, e + 1, child.type
            at = max(at, child.end)
        if node.end > at:
            if leaves:
                made = row([count, me, depth + 1, count, k, None, "text", None, at, node.end, at, node.end, text[at : node.end], {}, {}, text[at : node.end] if shows else "", below], at, node.end)
                if marks and BRACKETS.search(made[12]):
                    bare.append((made, last, ""))
            if shows:
                shown.append(text[at : node.end])
            count += 1
        if bare:
            for (made, _, _), found in zip(bare, lonely_brackets([(r[12], a, b) for r, a, b in bare], variants), strict=True):
                if found:
                    made[14] = {"lonely": found}
        if marks and node.children:
            note_siblings(node, config)
        made = "".join(shown) if shows and node.type not in HIDDEN else ""
        if mine is not None:
            mine[3] = count - 1
            mine[15] = made
        return made

    visit(root, None, 0, 0, 0, ())
    return out


_SPAN = attrgetter("start", "end")


def lonely_brackets(texts: list[tuple[str, str, str]], variants: bool) -> list[str]:
    """For the texts between a node's children, each with the types around it: their brackets without a partner.

    Marks are ``offset:length:kind``. Two or more brackets in a row are ``double``; one alone is
    ``single`` unless a partner is in this or another text of the node; next to a bare URL at
    the text's edge it is ``extLink``, next to the hyphen of a conversion ``converter``.
    """
    partners, opened = {"]": "[", "}": "{"}, {"[": [], "{": []}
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, (data, before, after) in enumerate(texts):
        for m in BRACKETS.finditer(data):
            for run in re.finditer(r"\[+|\]+|\{+|\}+", m[0]):
                at, token = m.start() + run.start(), run[0]
                if len(token) > 1:
                    found[k].append((at, len(token), "double"))
                    continue
                kind = "single"
                if token == "[" and after == "free-ext-link" and not data[at + 1 :].strip() or token == "]" and before == "free-ext-link" and at == 0:
                    kind = "extLink"
                elif variants and (token == "{" and data[at - 1 : at] == "-" or token == "}" and data[at + 1 : at + 2] == "-"):
                    kind = "converter"
                if kind == "extLink":
                    found[k].append((at, 1, kind))
                    if token == "[":
                        opened[token].append(None)
                    continue
                mark = (at - 1, 2, kind) if kind == "converter" and token == "{" else (at, 2 if kind == "converter" else 1, kind)
                if token in opened:
                    opened[token].append((k, mark))
                elif opened[partners[token]] and kind == "single":
                    opened[partners[token]].pop()
                else:
                    found[k].append(mark)
    for rest in opened.values():
        for k, mark in filter(None, rest):
            found[k].append(mark)
    return [" ".join(f"{a}:{n}:{kind}" for a, n, kind in sorted(marks)) for marks in found]


def rows(root: Node, text: str, config: SiteConfig = DEFAULT) -> list[dict]:
    """The node table of one page as dictionaries."""
    out = [dict(zip(FIELDS, r, strict=True)) for r in table(root, text, config=config)]
    for r in out:
        r["anc"] = [{"id": i, "type": t} for i, t in r["anc"]]
    return out
