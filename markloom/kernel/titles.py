"""Title normalisation for one string; the column form is in markloom.functions.titles."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from urllib.parse import unquote

from markloom.config import DEFAULT, SiteConfig

_BAD = re.compile(r"[<>\[\]{}|\n\t]|%[0-9a-fA-F]{2}|^:|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|�")


@dataclass
class Title:
    ns: int
    main: str
    fragment: str | None
    interwiki: str
    valid: bool
    prefix: str

    @property
    def title(self) -> str:
        return f"{self.prefix}{self.main}"


def decode_entities(text: str) -> str:
    """Character references that end in a semicolon; others are text."""
    return re.sub(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", lambda m: html.unescape(m[0]), text)


def normalise(raw: str, default_ns: int = 0, config: SiteConfig = DEFAULT) -> Title:
    text = decode_entities(raw) if "&" in raw else raw
    if "%" in text:
        text = unquote(text)
    text = re.sub(r"[_ \xa0]+", " ", text).strip()
    ns, interwiki = default_ns, ""
    if text.startswith(":"):
        ns, text = 0, text[1:].strip()
    head, sep, rest = text.partition(":")
    if sep:
        key = head.strip().lower()
        if key in config.interwiki:
            interwiki, text, ns = key, rest.strip(), 0
        elif config.aliases.get(key):
            ns, text = config.aliases[key], rest.strip()
    main, sharp, fragment = text.partition("#")
    main = main.strip()
    valid = not _BAD.search(main) and not re.search(r"(?:^|/)\.{1,2}(?:/|$)", main) and bool(main or sharp or interwiki)
    if main and not interwiki:
        main = main[0].upper() + main[1:]
    prefix = config.namespaces.get(ns, "")
    return Title(ns, main, fragment.strip() if sharp else None, interwiki, valid, f"{prefix}:" if prefix else "")
