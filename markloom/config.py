"""Site dialect: which tags, namespaces, magic words and image options a wiki knows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

# The vocabulary of an English-language MediaWiki site.
EXT = "pre nowiki gallery indicator langconvert graph timeline hiero charinsert ref references inputbox imagemap source syntaxhighlight poem categorytree section score templatestyles templatedata math ce chem maplink mapframe page-collection phonos"
HTML_PAIRED = "b bdi del i ins u font big small sub sup h1 h2 h3 h4 h5 h6 cite code em s strike strong tt var div center blockquote ol ul dl table caption pre ruby rb rp rt rtc p span abbr dfn kbd samp data time mark tr td th q bdo"
HTML_FLEXIBLE = "li dt dd"
HTML_VOID = "br wbr hr meta link"
NAMESPACES = {
    -2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk",
    8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk",
    100: "Portal", 101: "Portal talk", 118: "Draft", 119: "Draft talk", 710: "TimedText", 711: "TimedText talk", 828: "Module", 829: "Module talk",
}
ALIASES = {"image": 6, "image talk": 7, "wp": 4, "wikipedia": 4, "wikipedia talk": 5, "wt": 5, "tm": 10}
#: Parser functions called with a colon; the value is the canonical name.
FUNCTIONS = {
    **{n: n for n in "ns nse urlencode lcfirst ucfirst lc uc localurl localurle fullurl fullurle canonicalurl canonicalurle formatnum grammar gender plural bidi padleft padright anchorencode filepath pageid int pagename pagenamee fullpagename fullpagenamee subpagename subpagenamee rootpagename rootpagenamee basepagename basepagenamee talkpagename talkpagenamee subjectpagename subjectpagenamee namespace namespacee namespacenumber talkspace talkspacee subjectspace subjectspacee defaultsort displaytitle pagesincategory pagesize numberingroup protectionlevel".split()},
    **{f"#{n}": n for n in "if ifeq ifexpr ifexist iferror switch expr time timel rel2abs titleparts tag invoke len pos rpos sub count replace explode urldecode language special speciale formatdate dateformat lst lsth lstx".split()},
    "contentmodel": "contentmodel", "defaultsortkey": "defaultsort", "defaultcategorysort": "defaultsort",
}
VARIABLES = "! = articlepath basepagename basepagenamee contentlanguage contentmodel currentday currentday2 currentdayname currentdow currenthour currentmonth currentmonth1 currentmonthname currentmonthnamegen currentmonthabbrev currenttime currenttimestamp currentversion currentweek currentyear directionmark fullpagename fullpagenamee localday localday2 localdayname localdow localhour localmonth localmonth1 localmonthabbrev localmonthname localmonthnamegen localtime localtimestamp localweek localyear namespace namespacee namespacenumber numberofactiveusers numberofadmins numberofarticles numberofedits numberoffiles numberofpages numberofusers pageid pagelanguage pagename pagenamee revisionday revisionday2 revisionid revisionmonth revisionmonth1 revisionsize revisiontimestamp revisionuser revisionyear rootpagename rootpagenamee scriptpath server servername sitename stylepath subjectpagename subjectpagenamee subjectspace subjectspacee subpagename subpagenamee talkpagename talkpagenamee talkspace talkspacee userlanguage"
SWITCHES = "forcetoc nocontentconvert nocc noeditsection nogallery notitleconvert notc notoc toc archivedtalk notalk"
SWITCHES_EXACT = "EXPECTUNUSEDCATEGORY EXPECTUNUSEDTEMPLATE HIDDENCAT INDEX NEWSECTIONLINK NOINDEX NONEWSECTIONLINK STATICREDIRECT NOGLOBAL DISAMBIG"
PROTOCOLS = "bitcoin: ftp:// ftps:// geo: git:// gopher:// http:// https:// irc:// ircs:// magnet: mailto: news: nntp:// redis:// sftp:// sip: sips: sms: ssh:// svn:// tel: telnet:// urn: xmpp:"
#: Image options; ``$1`` stands for a value.
IMAGE = {
    "alt=$1": "alt", "class=$1": "class", "lang=$1": "lang", "link=$1": "link", "page=$1": "page", "page $1": "page", "thumbnail=$1": "manualthumb",
    "thumb=$1": "manualthumb", "upright=$1": "upright", "upright $1": "upright", "$1px": "width", "upright": "upright", "frame": "framed",
    "framed": "framed", "enframed": "framed", "frameless": "frameless", "thumb": "thumbnail", "thumbnail": "thumbnail", "centre": "center",
    **{n: n for n in "baseline border bottom center left middle none right sub super text-bottom text-top top".split()}, "sup": "super",
}


@dataclass(frozen=True)
class SiteConfig:
    """Everything about a wiki that changes how its text is read."""

    ext: frozenset[str] = frozenset(EXT.split())
    html_paired: frozenset[str] = frozenset(HTML_PAIRED.split())
    html_flexible: frozenset[str] = frozenset(HTML_FLEXIBLE.split())
    html_void: frozenset[str] = frozenset(HTML_VOID.split())
    namespaces: dict[int, str] = field(default_factory=lambda: dict(NAMESPACES))
    aliases: dict[str, int] = field(default_factory=lambda: {**{v.lower(): k for k, v in NAMESPACES.items() if v}, **ALIASES})
    functions: dict[str, str] = field(default_factory=lambda: dict(FUNCTIONS))
    variables: frozenset[str] = frozenset(VARIABLES.split())
    switches: frozenset[str] = frozenset(SWITCHES.split())
    switches_exact: frozenset[str] = frozenset(SWITCHES_EXACT.split())
    protocols: tuple[str, ...] = tuple(PROTOCOLS.split())
    image: dict[str, str] = field(default_factory=lambda: dict(IMAGE))
    redirection: tuple[str, ...] = ("#redirect",)
    variants: tuple[str, ...] = ()
    interwiki: tuple[str, ...] = ()
    article_path: str = "/wiki/$1"
    server: str = "//example.org"
    timezone: str = "UTC"

    @cached_property
    def html(self) -> frozenset[str]:
        return self.html_paired | self.html_flexible | self.html_void

    @cached_property
    def image_patterns(self) -> list[tuple[re.Pattern, str]]:
        out = []
        for syntax, key in sorted(self.image.items(), key=lambda x: ("$1" in x[0], x[0])):
            head, _, tail = syntax.partition("$1")
            value = r"([\d]*(?:x[\d]*)?)" if syntax == "$1px" else "(.*)"
            body = re.escape(head) + (value if "$1" in syntax else "") + re.escape(tail)
            out.append((re.compile(rf"\s*{body}\s*", re.DOTALL), key))
        return out

    @classmethod
    def find(cls, name: str, folders: list[str]) -> SiteConfig:
        """The description of a wiki by name, or the path of one: the first ``name.json`` in the folders."""
        from pathlib import Path

        tried = [Path(name), *[Path(f) / f"{name}.json" for f in folders]]
        found = next((p for p in tried if p.is_file()), None)
        if found is None:
            raise FileNotFoundError(f"no description of {name} in {', '.join(folders) or 'no folder'}")
        return cls.from_json(found.read_text(encoding="utf-8"))

    @classmethod
    def from_json(cls, text: str) -> SiteConfig:
        """A site description: ext, html (three lists), namespaces, nsid, protocol, img, redirection, variants, ..."""
        raw = json.loads(text)
        functions = dict(FUNCTIONS)
        for part in raw.get("parserFunction", [])[:2]:
            functions |= {k.lower(): v for k, v in part.items()} if isinstance(part, dict) else {}
        html = raw.get("html", [[], [], []])
        return cls(
            ext=frozenset(raw.get("ext", [])),
            html_paired=frozenset(html[0]),
            html_flexible=frozenset(html[1]),
            html_void=frozenset(html[2]),
            namespaces={int(k): v for k, v in raw.get("namespaces", {}).items()},
            aliases={k: v for k, v in raw.get("nsid", {}).items() if k},
            functions=functions,
            variables=frozenset(raw.get("variable", [])),
            protocols=tuple(p for p in raw.get("protocol", "").split("|") if p),
            image=dict(raw.get("img", {})),
            redirection=tuple(raw.get("redirection", ["#redirect"])),
            variants=tuple(raw.get("variants", [])),
            interwiki=tuple(raw.get("interwiki", [])),
            article_path=raw.get("articlePath", "/wiki/$1"),
            server=raw.get("server", ""),
        )


DEFAULT = SiteConfig()
