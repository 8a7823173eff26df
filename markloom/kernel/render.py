"""Wikitext of one page to HTML: inline markup, lists, paragraphs, tables, references, contents."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

from markloom.config import DEFAULT, SiteConfig
from markloom.kernel.expand import wiki_url
from markloom.kernel.parse import Node, clean, parse

TAG_HOOKS: dict[str, Callable[[dict[str, str], str], str]] = {}


def register_tag(name: str, fn: Callable[[dict[str, str], str], str]) -> None:
    """A custom extension tag: called with its attributes and inner text, returns HTML."""
    TAG_HOOKS[name.lower()] = fn


def esc(text: str) -> str:
    return re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;").replace(">", "&gt;")


BLOCK = re.compile(r"^\s*</?(?:table|div|h[1-6]|ul|ol|dl|li|dd|dt|p|pre|blockquote|hr|center|section|figure|tr|td|th|caption)\b", re.IGNORECASE)


class Renderer:
    def __init__(self, text: str, config: SiteConfig = DEFAULT, page: str = "", known: Callable[[str], bool] | None = None):
        self.text, self.config, self.page = clean(text), config, page
        self.categories: list[str] = []
        self.refs: dict[str, list] = {}
        self.ids: dict[str, int] = {}
        self.heads: list[tuple[int, str, str]] = []
        self.switches: set[str] = set()

    def page_html(self) -> str:
        tree = parse(self.text, self.config, page=self.page)
        body = blocks(self.inline(tree))
        for group in list(self.refs):
            if self.refs[group]:
                body += "\n" + self.reference_list(group)
        body = self.contents(body)
        if self.categories:
            items = "".join(f'<li><a href="/wiki/{wiki_url(c)}" title="{esc(c)}">{esc(c.partition(":")[2])}</a></li>' for c in dict.fromkeys(self.categories))
            body += f'\n<div id="catlinks" class="catlinks"><ul>{items}</ul></div>'
        return body.strip()

    def contents(self, body: str) -> str:
        marker = "\x00toc\x00"
        want = "notoc" not in self.switches and (len(self.heads) > 3 or "forcetoc" in self.switches) or "toc" in self.switches
        if not want:
            return body.replace(marker, "")
        counts: list[int] = []
        levels: list[int] = []
        items = []
        for level, anchor, title in self.heads:
            while levels and levels[-1] > level:
                levels.pop()
                counts.pop()
            if levels and levels[-1] == level:
                counts[-1] += 1
            else:
                levels.append(level)
                counts.append(1)
            items.append(f'<li class="toclevel-{len(levels)}"><a href="#{anchor}"><span class="tocnumber">{".".join(map(str, counts))}</span> <span class="toctext">{title}</span></a></li>')
        box = f'<div id="toc" class="toc"><ul>{"".join(items)}</ul></div>'
        if marker in body:
            return body.replace(marker, box, 1).replace(marker, "")
        m = re.search(r"<h[1-6]\b", body)
        return body[: m.start()] + box + "\n" + body[m.start() :] if m else body

    # -- inline

    def inline(self, node: Node, region: tuple[int, int] | None = None) -> str:
        a, b = region or (node.start, node.end)
        parts: list[str] = []
        at = a
        children = [c for c in sorted(node.children, key=lambda c: (c.start, c.end)) if c.start >= a and c.end <= b]
        state = ""
        for c in children:
            if c.start < at:
                continue
            raw = self.text[at : c.start]
            if state and "\n" in raw:  # apostrophes close at the line's end
                head, _, tail = raw.partition("\n")
                raw_html = esc(head) + self.toggle(state, "close") + "\n" + esc(tail)
                state = ""
                parts.append(raw_html)
            else:
                parts.append(esc(raw))
            if c.type == "quote":
                mark, state = self.quote(c, state)
                parts.append(mark)
            else:
                parts.append(self.node(c))
            at = c.end
        raw = self.text[at:b]
        if state:
            head, nl, tail = raw.partition("\n")
            parts.append(esc(head) + self.toggle(state, "close") + nl + esc(tail))
        else:
            parts.append(esc(raw))
        return "".join(parts)

    @staticmethod
    def toggle(state: str, _: str = "") -> str:
        return "".join({"b": "</b>", "i": "</i>"}[c] for c in reversed(state))

    def quote(self, c: Node, state: str) -> tuple[str, str]:
        """Markup of an apostrophe run after ``state`` (open marks, outermost first), and the new state."""
        marks = ("i" if c.props["italic"] == "true" else "") + ("b" if c.props["bold"] == "true" else "")
        opening = [m for m in marks if m not in state]
        out = ""
        for m in [m for m in reversed(state) if m in marks]:
            k = state.index(m)
            after = state[k + 1 :]
            out += self.toggle(state[k:], "") + "".join(f"<{x}>" for x in after)
            state = state[:k] + after
        return out + "".join(f"<{m}>" for m in opening), state + "".join(opening)

    def child(self, node: Node, type_: str) -> Node | None:
        return next((c for c in node.children if c.type == type_), None)

    def node(self, c: Node) -> str:
        fn = getattr(self, "_" + c.type.replace("-", "_"), None)
        if fn:
            return fn(c)
        if c.type in ("comment", "include", "noinclude", "redirect-syntax"):
            return ""
        return self.inline(c)

    def _heading(self, c: Node) -> str:
        title = self.child(c, "heading-title")
        body = self.inline(title).strip()
        plain = html.unescape(re.sub(r"<[^>]*>", "", body))
        anchor = re.sub(r"\s+", "_", plain)
        k = self.ids[anchor.lower()] = self.ids.get(anchor.lower(), 0) + 1
        anchor = anchor if k == 1 else f"{anchor}_{k}"
        self.heads.append((int(c.props["level"]), esc(anchor), body))
        return f'<h{c.props["level"]} id="{esc(anchor)}">{body}</h{c.props["level"]}>'

    def _hr(self, c: Node) -> str:
        return "<hr>"

    def _double_underscore(self, c: Node) -> str:
        self.switches.add(c.name)
        return "\x00toc\x00" if c.name == "toc" else ""

    def _html(self, c: Node) -> str:
        if c.props["closing"] == "true":
            return f"</{c.name}>"
        return f"<{c.name}{self.attributes(c.attrs)}>"

    @staticmethod
    def attributes(attrs: dict[str, str]) -> str:
        safe = {k: v for k, v in attrs.items() if not k.startswith("on") and not re.search(r"(?i)javascript:|expression", v)}
        return "".join(f' {k}="{html.escape(v)}"' for k, v in safe.items())

    def _link(self, c: Node) -> str:
        target = c.props["target"]
        text = self.child(c, "link-text")
        name = self.child(c, "link-target")
        fragment = c.props.get("fragment")
        shown = self.inline(text) if text is not None else esc(self.text[name.start : name.end].strip().lstrip(":"))
        if target == "" and fragment is not None:
            return f'<a href="#{esc(fragment.replace(" ", "_"))}">{shown}</a>'
        if target == self.page and fragment is None:
            return f'<a class="mw-selflink selflink">{shown}</a>'
        href = self.config.article_path.replace("$1", wiki_url(target)) + (f"#{fragment.replace(' ', '_')}" if fragment else "")
        return f'<a href="{esc(href)}" title="{html.escape(target)}">{shown}</a>'

    def _category(self, c: Node) -> str:
        self.categories.append(c.props["target"])
        return ""

    def _file(self, c: Node) -> str:
        target = c.props["target"]
        href = self.config.article_path.replace("$1", wiki_url(target))
        width = c.attrs.get("width", "").partition("x")[0]
        caption = next((p for p in reversed(c.children) if p.type == "image-parameter" and p.name == "caption"), None)
        text = self.inline(caption) if caption is not None else ""
        size = f' width="{width}"' if width else ""
        alt = c.attrs.get("alt", re.sub("<[^>]*>", "", text))
        image = f'<img alt="{html.escape(html.unescape(alt))}" src="/wiki/Special:Redirect/file/{wiki_url(target.partition(":")[2])}"{size} class="mw-file-element">'
        link = c.attrs.get("link")
        linked = image if link == "" else f'<a href="{esc(href if link is None else self.config.article_path.replace("$1", wiki_url(link)))}" class="mw-file-description">{image}</a>'
        if "thumbnail" in c.attrs or "framed" in c.attrs or "manualthumb" in c.attrs:
            return f'<figure typeof="mw:File/Thumb">{linked}<figcaption>{text}</figcaption></figure>'
        return f'<span typeof="mw:File">{linked}</span>'

    def _ext_link(self, c: Node) -> str:
        text = self.child(c, "ext-link-text")
        url = html.unescape(c.props["url"])
        if text is None:
            self.ids["\x00ext"] = self.ids.get("\x00ext", 0) + 1
            return f'<a rel="nofollow" class="external autonumber" href="{html.escape(url)}">[{self.ids[chr(0) + "ext"]}]</a>'
        return f'<a rel="nofollow" class="external text" href="{html.escape(url)}">{self.inline(text)}</a>'

    def _free_ext_link(self, c: Node) -> str:
        url = html.unescape(c.props["url"])
        return f'<a rel="nofollow" class="external free" href="{html.escape(url)}">{esc(url)}</a>'

    def _magic_link(self, c: Node) -> str:
        raw, n = self.text[c.start : c.end], c.props["number"]
        if c.name == "ISBN":
            return f'<a href="/wiki/Special:BookSources/{n}" class="internal mw-magiclink-isbn">{esc(raw)}</a>'
        url = f"https://datatracker.ietf.org/doc/html/rfc{n}" if c.name == "RFC" else f"//www.ncbi.nlm.nih.gov/pubmed/{n}?dopt=Abstract"
        return f'<a class="external mw-magiclink-{c.name.lower()}" rel="nofollow" href="{url}">{esc(raw)}</a>'

    def _list(self, c: Node) -> str:
        return f"\x01{c.props['prefix']}\x02"

    def _dd(self, c: Node) -> str:
        return "\x03"

    def _table(self, c: Node) -> str:
        rows: list[str] = []
        loose = [x for x in c.children if x.type == "td"]
        captions = [x for x in loose if x.props["subtype"] == "caption"]
        cells = [x for x in loose if x.props["subtype"] != "caption"]
        out = f"<table{self.attributes(c.attrs)}>\n" + "".join(f"<caption>{self.inline(self.child(x, 'td-inner')).strip()}\n</caption>\n" for x in captions)
        if cells:
            rows.append("<tr>\n" + "\n".join(map(self.cell, cells)) + "</tr>")
        for r in (x for x in c.children if x.type == "tr"):
            inner = [x for x in r.children if x.type == "td"]
            if inner:
                rows.append(f"<tr{self.attributes(r.attrs)}>\n" + "\n".join(map(self.cell, inner)) + "</tr>")
        return out + "<tbody>" + "\n".join(rows) + "</tbody></table>"

    def cell(self, c: Node) -> str:
        tag = c.props["subtype"]
        body = self.inline(self.child(c, "td-inner"))
        body = blocks(body) if "\n" in body.strip() or "\x01" in body else body.strip()
        return f"<{tag}{self.attributes(c.attrs)}>{body}\n</{tag}>"

    def _redirect(self, c: Node) -> str:
        t = c.props["target"]
        return f'<div class="redirectMsg"><p>Redirect to:</p><ul class="redirectText"><li><a href="{esc(self.config.article_path.replace("$1", wiki_url(t)))}" title="{html.escape(t)}">{esc(t)}</a></li></ul></div>'

    def _ext(self, c: Node) -> str:
        inner = self.child(c, "ext-inner")
        raw = self.text[inner.start : inner.end] if inner is not None else ""
        if c.name in TAG_HOOKS:
            return TAG_HOOKS[c.name](c.attrs, raw)
        if c.name == "nowiki":
            return esc(raw)
        if c.name == "pre":
            return f"<pre{self.attributes(c.attrs)}>{esc(raw.removeprefix(chr(10)))}</pre>"
        if c.name in ("syntaxhighlight", "source"):
            return f'<div class="mw-highlight"><pre>{esc(raw.strip(chr(10)))}</pre></div>'
        if c.name in ("math", "chem", "ce"):
            return f'<span class="mwe-math-element">{esc(raw)}</span>'
        if c.name == "poem":
            body = re.sub(r"(?<=[^\n])\n(?=[^\n])", "<br>\n", self.inline(inner).strip("\n")) if inner is not None else ""
            return f'<div class="poem"><p>{body}\n</p></div>'
        if c.name == "ref":
            return self.reference(c, inner)
        if c.name == "references":
            if inner is not None:
                self.inline(inner)
            return self.reference_list(c.attrs.get("group", ""))
        if c.name == "gallery" and inner is not None:
            items = []
            for g in (x for x in inner.children if x.type == "gallery-image"):
                cap = self.child(g, "image-parameter")
                items.append(f'<li class="gallerybox"><div class="thumb"><a href="{esc(self.config.article_path.replace("$1", wiki_url(g.name)))}">{esc(g.name.partition(":")[2])}</a></div><div class="gallerytext">{self.inline(cap).strip() if cap is not None else ""}</div></li>')
            return f'<ul class="gallery">{"".join(items)}</ul>'
        return ""

    def reference(self, c: Node, inner: Node | None) -> str:
        group, name = c.attrs.get("group", ""), c.attrs.get("name", "")
        listed = self.refs.setdefault(group, [])
        body = self.inline(inner).strip() if inner is not None else ""
        k = next((i for i, r in enumerate(listed) if name and r[0] == name), None)
        if k is None:
            listed.append([name, body, 0])
            k = len(listed) - 1
        elif body and not listed[k][1]:
            listed[k][1] = body
        listed[k][2] += 1
        use = listed[k][2]
        key = f"{name}_{k + 1}" if name else str(k + 1)
        label = f"{group} {k + 1}" if group else str(k + 1)
        return f'<sup id="cite_ref-{esc(key)}{f"-{use - 1}" if name else ""}" class="reference"><a href="#cite_note-{esc(f"{name}-{k + 1}" if name else str(k + 1))}">[{label}]</a></sup>'

    def reference_list(self, group: str) -> str:
        listed, self.refs[group] = self.refs.get(group, []), []
        items = []
        for k, (name, body, uses) in enumerate(listed, 1):
            if not name:
                back = f'<a href="#cite_ref-{k}">↑</a>'
            elif uses == 1:
                back = f'<a href="#cite_ref-{esc(name)}_{k}-0">↑</a>'
            else:
                back = "↑ " + " ".join(f'<sup><a href="#cite_ref-{esc(name)}_{k}-{u}">{k}.{u}</a></sup>' for u in range(uses))
            items.append(f'<li id="cite_note-{esc(f"{name}-{k}" if name else str(k))}"><span class="mw-cite-backlink">{back}</span> <span class="reference-text">{body}</span></li>')
        return f'<ol class="references">{"".join(items)}</ol>'


def _list_turn(old: str, new: str) -> str:
    """Markup between two list lines of these prefixes (one of them may be empty)."""
    norm = lambda p: p.replace(";", ":")
    k = 0
    while k < min(len(old), len(new)) and norm(old)[k] == norm(new)[k]:
        k += 1
    outer = {"*": "ul", "#": "ol", ":": "dl", ";": "dl"}
    item = {"*": "li", "#": "li", ":": "dd", ";": "dt"}
    out = "".join(f"</{item[c]}></{outer[c]}>" for c in reversed(old[k:]))
    if k and k == len(new):
        out += f"</{item[old[k - 1]]}>\n<{item[new[k - 1]]}>"
    elif k < len(new):
        out += "".join(f"<{outer[c]}><{item[c]}>" for c in new[k:])
    return out


def blocks(text: str) -> str:
    """Lines to lists, paragraphs and preformatted blocks."""
    out: list[str] = []
    paragraph: list[str] = []
    prefix, pre = "", False
    pieces: list[str] = []

    def flush() -> None:
        if paragraph:
            out.append("<p>" + "\n".join(paragraph) + "\n</p>")
            paragraph.clear()

    def end_list() -> None:
        nonlocal prefix
        if pieces:
            out.append("".join(pieces) + _list_turn(prefix, ""))
            pieces.clear()
        prefix = ""

    def end_pre() -> None:
        nonlocal pre
        if pre:
            out[-1] += "\n</pre>"
            pre = False

    inside = 0
    for line in text.split("\n"):
        m = re.match(r"\s*\x01([;:*#]+)\x02(.*)", line, re.DOTALL)
        if m and not inside:
            flush()
            end_pre()
            new, body = m[1], m[2].strip()
            pieces.append(_list_turn(prefix, new))
            prefix = new
            if "\x03" in body:
                term, _, rest = body.partition("\x03")
                pieces.append(f"{term.strip()}</dt>\n<dd>{rest.strip()}")
                prefix = prefix[:-1] + ":"
            else:
                pieces.append(body)
            continue
        end_list()
        line = line.replace("\x03", ":").replace("\x01", "").replace("\x02", "")
        depth = len(re.findall(r"<(?:table|pre|ul|ol|dl|div|figure)\b", line)) - len(re.findall(r"</(?:table|pre|ul|ol|dl|div|figure)>", line))
        if inside or BLOCK.match(line) or depth > 0:
            flush()
            end_pre()
            out.append(line)
            inside = max(inside + depth, 0)
        elif line.startswith(" ") and line.strip():
            flush()
            if pre:
                out[-1] += "\n" + line[1:]
            else:
                out.append("<pre>" + line[1:])
                pre = True
        elif not line.strip():
            flush()
            end_pre()
        else:
            end_pre()
            paragraph.append(line.strip())
    flush()
    end_list()
    end_pre()
    return "\n".join(out)


def render(text: str, config: SiteConfig = DEFAULT, page: str = "") -> str:
    return Renderer(text, config, page).page_html()


def highlight(node: Node, text: str) -> str:
    """The source as HTML, each node in a span of its type; without tags it is the source."""
    out, at = [], node.start
    for c in sorted(node.children, key=lambda c: (c.start, c.end)):
        if c.start < at:
            continue
        out.append(html.escape(text[at : c.start], quote=False))
        out.append(highlight(c, text))
        at = c.end
    out.append(html.escape(text[at : node.end], quote=False))
    return f'<span class="wl-{node.type}">{"".join(out)}</span>'
