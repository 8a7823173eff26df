"""Template expansion and parser functions for the text of one page."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import quote, unquote_plus
from zoneinfo import ZoneInfo

from markloom.config import DEFAULT, SiteConfig
from markloom.kernel.parse import Node, clean, parse
from markloom.kernel.titles import normalise

HOOKS: dict[str, Callable[..., str]] = {}
#: Always zero or empty without a database.
ZERO = frozenset("revisionsize numberofarticles numberoffiles numberofusers numberofactiveusers numberofpages numberofadmins numberofedits numberingroup pagesincategory pagesize pageid".split())
EMPTY = frozenset("displaytitle defaultsort revisionid revisionday revisionday2 revisionmonth revisionmonth1 revisionyear revisiontimestamp revisionuser translation".split())


def register_function(name: str, fn: Callable[..., str]) -> None:
    """A custom parser function: called with its arguments, returns wikitext."""
    HOOKS[name.lower()] = fn


class ExprError(ValueError):
    """The expression cannot be evaluated."""


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([a-z]+)|(<=|>=|<>|!=|[-+*/()=<>^]))", re.IGNORECASE)
_BINARY = {
    "or": (1, lambda a, b: float(bool(a) or bool(b))), "and": (2, lambda a, b: float(bool(a) and bool(b))),
    "=": (3, lambda a, b: float(a == b)), "!=": (3, lambda a, b: float(a != b)), "<>": (3, lambda a, b: float(a != b)),
    "<": (3, lambda a, b: float(a < b)), ">": (3, lambda a, b: float(a > b)), "<=": (3, lambda a, b: float(a <= b)), ">=": (3, lambda a, b: float(a >= b)),
    "round": (4, lambda a, b: math.floor(abs(a) * 10 ** int(b) + 0.5) / 10 ** int(b) * (1 if a >= 0 else -1)),
    "+": (5, lambda a, b: a + b), "-": (5, lambda a, b: a - b),
    "*": (6, lambda a, b: a * b), "/": (6, lambda a, b: a / b), "div": (6, lambda a, b: a / b), "mod": (6, lambda a, b: math.fmod(int(a), int(b))), "fmod": (6, math.fmod),
    "^": (8, lambda a, b: a**b), "e": (9, lambda a, b: a * 10**b),
}
_UNARY = {
    "not": lambda a: float(not a), "ceil": math.ceil, "floor": math.floor, "trunc": math.trunc, "abs": abs, "exp": math.exp, "ln": math.log, "sqrt": math.sqrt,
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan,
}


def evaluate(text: str) -> float | None:
    """The number that an #expr expression stands for; None if it is blank."""
    tokens, pos = [], 0
    text = html.unescape(text).strip()
    if not text:
        return None
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ExprError(f'Unrecognized punctuation character "{text[pos:].strip()[:1]}".')
        tokens.append(float(m[1]) if m[1] else (m[2] or m[3]).lower())
        pos = m.end()
    at = 0

    def unary() -> float:
        nonlocal at
        if at >= len(tokens):
            raise ExprError("Missing operand.")
        t = tokens[at]
        at += 1
        if isinstance(t, float):
            return t
        if t == "(":
            value = binary(0)
            if at >= len(tokens) or tokens[at] != ")":
                raise ExprError("Unclosed bracket.")
            at += 1
            return value
        if t in "+-":
            value = binary(7)
            return -value if t == "-" else value
        if t in _UNARY:
            return float(_UNARY[t](binary(8)))
        if t == "pi":
            return math.pi
        if t == "e":
            return math.e
        raise ExprError(f'Unrecognized word "{t}".' if t.isalpha() else f"Unexpected {t} operator.")

    def binary(least: int) -> float:
        nonlocal at
        left = unary()
        while at < len(tokens) and not isinstance(tokens[at], float) and tokens[at] in _BINARY and _BINARY[tokens[at]][0] > least:
            level, fn = _BINARY[tokens[at]]
            at += 1
            right = binary(level)
            try:
                left = float(fn(left, right))
            except (ZeroDivisionError, ValueError, OverflowError) as e:
                raise ExprError("Division by zero." if isinstance(e, ZeroDivisionError) else "Invalid argument.") from e
        return left

    value = binary(0)
    if at < len(tokens):
        raise ExprError("Unexpected number." if isinstance(tokens[at], float) else f"Unexpected {tokens[at]} operator.")
    return value


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.14g}"


def same(a: str, b: str) -> bool:
    a, b = a.strip(), b.strip()
    if a == b:
        return True
    try:
        return bool(a and b) and float(a) == float(b)
    except ValueError:
        return False


def _cut(text: str, start: int, n: int | None) -> str:
    start = max(len(text) + start, 0) if start < 0 else start
    if not n:
        return text[start:]
    return text[start : start + n] if n > 0 else text[start : len(text) + n]


def _integer(x: str, default: int = 0) -> int:
    try:
        return int(x)
    except ValueError:
        return default


def wiki_url(title: str) -> str:
    return quote(title.replace(" ", "_"), safe="/:()!'*~,;@$")


class Expander:
    def __init__(self, templates: dict[str, str], redirects: dict[str, str] | None = None, page: str = "", config: SiteConfig = DEFAULT, now: datetime | None = None, constant: bool = False):
        self.templates, self.redirects, self.page, self.config = templates, redirects or {}, page, config
        self.now = now or datetime(1970, 1, 1, 0, 2, 3, tzinfo=timezone.utc)
        self.constant = constant

    def page_text(self, text: str) -> str:
        return self.expand(clean(text), {}, (), include=False, root=True)

    def expand(self, text: str, args: dict[str, str], stack: tuple[str, ...], include: bool = True, root: bool = False) -> str:
        if "{{" not in text and "<" not in text:
            return text
        tree = parse(text, self.config, include, last="brace")
        return self.render(tree, text, args if not root else None, stack)

    def render(self, node: Node, text: str, args: dict[str, str] | None, stack: tuple[str, ...], region: tuple[int, int] | None = None) -> str:
        """Text of a node (or a region of it) with its calls replaced."""
        a, b = region or (node.start, node.end)
        out, at = [], a
        for c in sorted(node.children, key=lambda c: (c.start, c.end)):
            if c.start < at or c.end > b or c.start < a:
                continue
            out.append(text[at : c.start])
            out.append(self.one(c, text, args, stack))
            at = c.end
        out.append(text[at:b])
        return "".join(out)

    def one(self, c: Node, text: str, args: dict[str, str] | None, stack: tuple[str, ...]) -> str:
        raw = text[c.start : c.end]
        if c.type in ("comment", "include", "noinclude", "tvar"):
            return ""
        if c.type in ("onlyinclude", "translate"):
            return self.render(c, text, args, stack, c.inner)
        if c.type == "ext":
            return raw
        if c.type == "arg":
            if args is None and not self.constant:
                parts = [p for p in c.children if p.type == "arg-default"]
                return self.render(parts[0], text, args, stack) if parts else raw
            key = self.render(c.children[0], text, args, stack).strip()
            if args and key in args:
                return args[key]
            default = next((p for p in c.children if p.type == "arg-default"), None)
            return self.render(default, text, args, stack) if default else raw
        if c.type == "template":
            return self.template(c, text, args, stack)
        if c.type == "magic-word":
            return self.magic(c, text, args, stack)
        return self.render(c, text, args, stack)

    def arguments(self, c: Node, text: str, args: dict[str, str] | None, stack: tuple[str, ...]) -> list[tuple[str, str, bool]]:
        out, anon = [], 0
        for p in (x for x in c.children if x.type == "parameter"):
            key, value = (x for x in p.children if x.type in ("parameter-key", "parameter-value"))
            body = self.render(value, text, args, stack)
            if p.props["anon"] == "true":
                anon += 1
                out.append((str(anon), body, True))
            else:
                out.append((self.render(key, text, args, stack).strip(), body.strip(), False))
        return out

    def template(self, c: Node, text: str, args: dict[str, str] | None, stack: tuple[str, ...]) -> str:
        if self.constant:
            return self.render(c, text, args, stack)
        named = next(x for x in c.children if x.type == "template-name")
        title = normalise(self.render(named, text, args, stack).strip(), 10, self.config).title
        title = self.redirects.get(title, title)
        if title in stack:
            return f'<span class="error">Template loop detected: [[{title}]]</span>'
        body = self.templates.get(title)
        if body is None:
            return self.render(c, text, args, stack)
        given = {k: v for k, v, _ in self.arguments(c, text, args, stack)}
        found = self.expand(body, given, (*stack, title))
        return "\n" + found if found[:2] == "{|" or found[:1] in ":;#*" and c.start and text[c.start - 1] != "\n" else found

    def magic(self, c: Node, text: str, args: dict[str, str] | None, stack: tuple[str, ...]) -> str:
        raw = text[c.start : c.end]
        if self.constant and c.name not in ("if", "ifeq", "ifexist", "iferror", "switch"):
            return self.render(c, text, args, stack)
        given = self.arguments(c, text, args, stack)
        values = [v if anon else f"{k}={v}" for k, v, anon in given]
        try:
            out = call(c.name, values, self.page, self.config, self.now, given)
        except ExprError as e:
            return f'<strong class="error">Expression error: {e}</strong>'
        return raw if out is None else out


def call(name: str, args: list[str], page: str = "", config: SiteConfig = DEFAULT, now: datetime | None = None, named: list[tuple[str, str, bool]] | None = None) -> str | None:
    """A parser function or variable by canonical name; None if it is unknown."""
    a = args + [""] * 6
    n = len(args)
    now = now or datetime(1970, 1, 1, 0, 2, 3, tzinfo=timezone.utc)
    if name in HOOKS:
        return HOOKS[name](*args)
    if name in ZERO:
        return "0"
    if name in EMPTY:
        return ""
    if name.startswith("current") and name != "currentversion":
        return _clock(name.removeprefix("current"), now)
    if name.startswith("local") and name not in ("localurl", "localurle"):
        return _clock(name.removeprefix("local"), now.astimezone(ZoneInfo(config.timezone)))
    first = a[0].strip()
    simple: dict[str, Callable[[], str]] = {
        "!": lambda: "|", "=": lambda: "=", "lc": lambda: first.lower(), "uc": lambda: first.upper(), "lcfirst": lambda: first[:1].lower() + first[1:], "ucfirst": lambda: first[:1].upper() + first[1:],
        "if": lambda: (a[1] if first else a[2]).strip(), "ifeq": lambda: (a[2] if same(a[0], a[1]) else a[3]).strip(),
        "iferror": lambda: (a[1] if re.search(r"<(?:strong|span|p|div)\s[^>]*class=\"[^\"]*\berror\b", a[0]) else (a[2] if n > 2 else a[0])).strip(),
        "ifexist": lambda: (a[1] if (t := normalise(first, 0, config)).valid and not t.interwiki else a[2]).strip(),
        "expr": lambda: "" if (v := evaluate(a[0])) is None else number(v), "ifexpr": lambda: (a[1] if evaluate(a[0]) else a[2]).strip(),
        "padleft": lambda: _pad(first, a, n) + first, "padright": lambda: first + _pad(first, a, n),
        "len": lambda: str(len(first)), "pos": lambda: "" if (k := first.find(a[1] or " ", _integer(a[2]))) < 0 else str(k), "rpos": lambda: str(first.rfind(a[1] or " ")),
        "sub": lambda: _cut(first, _integer(a[1]), _integer(a[2]) if n > 2 else None), "count": lambda: str(first.count(a[1] or " ")),
        "replace": lambda: first.replace(a[1] or " ", a[2], _integer(a[3], -1) if n > 3 else -1), "explode": lambda: _explode(first, a[1] or " ", _integer(a[2])),
        "urlencode": lambda: wiki_url(first) if a[1].strip().upper() == "WIKI" else quote(first, safe="") if a[1].strip().upper() == "PATH" else quote(first, safe="").replace("%20", "+"),
        "urldecode": lambda: unquote_plus(first), "anchorencode": lambda: _anchor(first),
        "plural": lambda: (a[1] if first.lstrip("-") == "1" else a[2] or a[1]).strip(), "gender": lambda: (a[3] or a[1]).strip(), "formal": lambda: a[0], "formatnum": lambda: first, "bidi": lambda: first, "grammar": lambda: a[1],
        "ns": lambda: _ns(first, config), "nse": lambda: _ns(first, config).replace(" ", "_"), "titleparts": lambda: _titleparts(first, _integer(a[1]), _integer(a[2])),
        "rel2abs": lambda: _rel2abs(first, a[1].strip() or page), "int": lambda: f"⧼{first}⧽", "directionmark": lambda: "", "language": lambda: first, "sitename": lambda: "Wiki", "server": lambda: config.server,
        "servername": lambda: config.server.split("//")[-1], "articlepath": lambda: config.article_path, "scriptpath": lambda: "/w", "contentlanguage": lambda: "en", "pagelanguage": lambda: "en", "userlanguage": lambda: "en",
        "special": lambda: f"Special:{first or 'Badtitle'}", "speciale": lambda: wiki_url(f"Special:{first or 'Badtitle'}"), "filepath": lambda: f"/wiki/Special:Redirect/file/{wiki_url(first)}",
        "contentmodel": lambda: _content_model(first, a[1].strip() or page, n, config),
    }
    if name in simple:
        return simple[name]()
    if name == "switch":
        return _switch(args, named or [])
    if name == "tag":
        attrs = "".join(f' {k}="{v.strip(chr(34))}"' for k, v, anon in (named or [])[2:] if not anon)
        return f"<{first}{attrs}>{a[1]}</{first}>"
    if name in ("localurl", "localurle", "fullurl", "fullurle", "canonicalurl", "canonicalurle"):
        path = config.article_path.replace("$1", wiki_url(normalise(first, 0, config).title)) + (f"?{a[1].strip()}" if a[1].strip() else "")
        path = path if name.startswith("local") else (config.server if name.startswith("full") else "https:" + config.server) + path
        return html.escape(path) if name.endswith("e") else path
    return _page_word(name, first or page, config)


def _pad(s: str, a: list[str], n: int) -> str:
    fill = a[2] if n > 2 else "0"
    need = min(max(_integer(a[1].strip()), 0), 500) - len(s)
    return (fill * need)[:need] if fill and need > 0 else ""


def _explode(s: str, by: str, k: int) -> str:
    parts = s.split(by)
    return parts[k] if -len(parts) <= k < len(parts) else ""


def _ns(x: str, config: SiteConfig) -> str:
    k = int(x) if re.fullmatch(r"-?\d+", x) else config.aliases.get(x.lower().replace("_", " "))
    return config.namespaces.get(k, "") if k is not None else ""


def _titleparts(s: str, n: int, offset: int) -> str:
    parts = s.split("/", 24)
    first = offset - 1 if offset > 0 else max(len(parts) + offset, 0) if offset < 0 else 0
    rest = parts[first:]
    return "/".join(rest[:n] if n else rest)


def _rel2abs(path: str, base: str) -> str:
    full = f"{base}/{path}" if re.match(r"\.{0,2}/|\.{1,2}$", path) else path
    out: list[str] = []
    for p in full.split("/"):
        if p == "..":
            if not out:
                return '<strong class="error">Error: Invalid depth in path</strong>'
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _switch(args: list[str], named: list[tuple[str, str, bool]]) -> str:
    value = args[0].strip() if args else ""
    through, default, last = False, "", ""
    for key, body, anon in named[1:]:
        if anon:
            last = body.strip()
            through = through or same(last, value)
            default = default if last != "#default" else default
            continue
        last = ""
        if through or same(key, value):
            return body.strip()
        if key.strip() == "#default":
            default = body.strip()
    return last or default


def _clock(word: str, now: datetime) -> str:
    year = datetime(now.year, 1, 1, tzinfo=now.tzinfo)
    words = {
        "year": str(now.year), "month": f"{now.month:02}", "month1": str(now.month), "day": str(now.day), "day2": f"{now.day:02}", "dow": str((now.weekday() + 1) % 7), "hour": f"{now.hour:02}",
        "time": f"{now:%H:%M}", "timestamp": f"{now:%Y%m%d%H%M%S}", "monthname": f"{now:%B}", "monthnamegen": f"{now:%B}", "monthabbrev": f"{now:%b}", "dayname": f"{now:%A}", "week": str(math.ceil((now - year).total_seconds() / 604800)),
    }
    return words.get(word, "")


def _anchor(text: str) -> str:
    """Plain text of a heading as an id: no markup, blanks as underscores, marks of HTML as references, percent signs of codes kept apart."""
    plain = re.sub(r"\[\[([^\[\]]+)\]\]", lambda m: m[1].partition("|")[2] or m[1], re.sub("<[^>]*>|'{2,}", "", text))
    named = re.sub(r"[ \t\n_]+", "_", plain.strip())
    for mark, reference in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        named = named.replace(mark, reference)
    return re.sub(r"%(?=[0-9a-fA-F]{2})", "%25", named)


# What kinds of text a page may hold, by the name that is the same on all wikis and the shown one.
CONTENT_MODELS = {"css": "CSS", "javascript": "JavaScript", "js": "JavaScript", "json": "JSON", "sanitized-css": "Sanitized CSS", "Scribunto": "Scribunto module", "wikitext": "wikitext"}


def _content_model(kind: str, page: str, n: int, config: SiteConfig) -> str:
    if not n:
        return "wikitext"
    if kind not in ("local", "canonical"):
        return ""
    t = normalise(page, 0, config)
    extension = t.main.rpartition(".")[2].lower() if "." in t.main else ""
    below = "/" in t.main
    if below and extension == "css" and t.ns in (10, 828):
        model = "sanitized-css"
    elif t.ns == 828:
        model = "json" if extension == "json" else "wikitext" if t.main.endswith("/doc") else "Scribunto"
    elif (t.ns == 8 or t.ns == 2 and below) and extension in ("css", "js", "json"):
        model = "javascript" if extension == "js" else extension
    else:
        model = "wikitext"
    return CONTENT_MODELS[model] if kind == "local" else model


def escape_page_name(name: str, config: SiteConfig) -> str:
    """A page name that stays text wherever it is put: marks that could start markup are written as references."""
    reference = lambda c: f"&#{ord(c)};"
    out = re.sub(r"[\"&'=;＿]", lambda m: reference(m[0]), name)
    out = re.sub(r"!!|__|~{3}", lambda m: "".join(map(reference, m[0])) if m[0][0] != "~" else m[0][:2] + reference("~"), out)
    out = re.sub(r"^[!#*:+_~-]|[_~]$", lambda m: reference(m[0]), out)
    out = re.sub(r"(ISBN|PMID|RFC) ", r"\1&#32;", out)
    schemes = "|".join(re.escape(p[:-1]) for p in config.protocols if p.endswith(":"))
    return re.sub(rf"(?i)\b({schemes}):|(?<=:)//", lambda m: f"{m[1]}&#58;" if m[1] else "&#47;&#47;", out) if schemes else out


def _page_word(name: str, page: str, config: SiteConfig) -> str | None:
    t = normalise(page, 0, config)
    talk = t.ns + 1 if t.ns >= 0 and t.ns % 2 == 0 else t.ns
    subject = t.ns - 1 if t.ns > 0 and t.ns % 2 else t.ns
    full = lambda k: (f"{config.namespaces.get(k, '')}:" if config.namespaces.get(k) else "") + t.main
    words = {
        "pagename": t.main, "fullpagename": t.title, "subpagename": t.main.rsplit("/", 1)[-1], "rootpagename": t.main.split("/", 1)[0], "basepagename": re.sub("/[^/]*$", "", t.main),
        "namespace": config.namespaces.get(t.ns, ""), "namespacenumber": str(t.ns), "talkspace": config.namespaces.get(talk, ""), "subjectspace": config.namespaces.get(subject, ""),
        "talkpagename": full(talk), "subjectpagename": full(subject),
    }
    if name in words:
        return escape_page_name(words[name], config) if "name" in name else words[name]
    return wiki_url(words[name[:-1]]) if name.endswith("e") and name[:-1] in words else None
