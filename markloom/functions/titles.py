"""Title algebra as column expressions (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items(), key=str) for x in kv])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _named_entities() -> str:
    """All named references that end in a semicolon, as JSON: a literal that Spark parses once."""
    import json
    from html.entities import html5

    return json.dumps({f"&{name}": char for name, char in html5.items() if name.endswith(";")})


def decode_entities(text: Column) -> Column:
    """Character references that end in a semicolon: numbers of the basic plane and all names, as in the kernel."""
    from markloom.functions.text import decode_numeric

    names = F.from_json(F.lit(_named_entities()), "map<string,string>")

    def named(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit("(&[a-zA-Z][a-zA-Z0-9]*;)"), F.lit(1)))
        # the ampersand last, so that nothing is decoded twice
        order = F.concat(F.filter(found, lambda e: e != "&amp;"), F.array(F.lit("&amp;")))
        return F.aggregate(order, t, lambda acc, e: F.replace(acc, e, F.coalesce(F.try_element_at(names, e), e)))

    def numbers(t: Column) -> Column:
        hidden = F.replace(t, F.lit("&amp;"), F.lit("\x00"))
        return F.when(F.contains(t, F.lit("&#")), F.replace(decode_numeric(hidden), F.lit("\x00"), F.lit("&amp;"))).otherwise(t)

    return _let(text, lambda t: F.when(F.contains(t, F.lit("&")), _let(numbers(t), named)).otherwise(t))


def normalise(text: Column, default_ns: int = 0, config: SiteConfig = DEFAULT) -> Column:
    """STRUCT<ns, main, prefix, title, fragment, interwiki, valid> of a page name."""
    spaced = F.trim(F.regexp_replace(decode_entities(text), r"[_  ]+", " "))
    decoded = _let(spaced, lambda s: F.when(s.rlike("%[0-9a-fA-F]{2}"), F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))).otherwise(s))

    def begin(d: Column) -> Column:
        colon = F.startswith(d, F.lit(":"))
        return F.struct(F.when(colon, F.trim(F.substring(d, 2, 1 << 30))).otherwise(d).alias("body"), colon.alias("colon"))

    def parts(start: Column) -> Column:
        b, colon = start["body"], start["colon"]
        head = F.lower(F.trim(F.split_part(b, F.lit(":"), F.lit(1))))
        has = F.contains(b, F.lit(":"))
        rest = F.trim(F.substring(b, F.length(F.split_part(b, F.lit(":"), F.lit(1))) + 2, F.lit(1 << 30)))
        wiki = F.array_contains(F.array(*[F.lit(x) for x in config.interwiki] or [F.lit("")]), head) & has & (head != "")
        found = F.when(has & ~wiki, F.try_element_at(_map({k: v for k, v in config.aliases.items() if v}), head))
        ns = F.coalesce(found, F.when(wiki | colon, F.lit(0)), F.lit(default_ns))
        left = F.when(wiki | found.isNotNull(), rest).otherwise(b)
        return F.struct(ns.cast("int").alias("ns"), left.alias("left"), F.when(wiki, head).otherwise("").alias("interwiki"))

    def finish(p: Column) -> Column:
        sharp = F.contains(p["left"], F.lit("#"))
        main = F.trim(F.split_part(p["left"], F.lit("#"), F.lit(1)))
        named = F.when((F.length(main) > 0) & (p["interwiki"] == ""), F.concat(F.upper(F.left(main, F.lit(1))), F.substring(main, 2, 1 << 30))).otherwise(main)
        name = F.coalesce(F.try_element_at(_map(config.namespaces), p["ns"]), F.lit(""))
        prefix = F.when(name != "", F.concat(name, F.lit(":"))).otherwise("")
        bad = main.rlike(r"[<>\[\]{}|\n\t�]|%[0-9a-fA-F]{2}|^:|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|(?:^|/)\.{1,2}(?:/|$)")
        fragment = F.when(sharp, F.trim(F.substring(p["left"], F.length(F.split_part(p["left"], F.lit("#"), F.lit(1))) + 2, F.lit(1 << 30))))
        return F.struct(
            p["ns"].alias("ns"), named.alias("main"), prefix.alias("prefix"), F.concat(prefix, named).alias("title"), fragment.alias("fragment"),
            p["interwiki"].alias("interwiki"), (~bad & ((F.length(main) > 0) | sharp | (p["interwiki"] != ""))).alias("valid"),
        )

    return _let(_let(_let(decoded, begin), parts), finish)


def encode(title: Column) -> Column:
    """Path form: blanks to underscores, UTF-8 percent-encoding, slashes and colons kept."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%27", "'"), ("%7E", "~"), ("+", "%20")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url(title: Column, fragment: Column | None = None, config: SiteConfig = DEFAULT) -> Column:
    path = F.replace(F.lit(config.article_path), F.lit("$1"), encode(title))
    return path if fragment is None else F.concat(path, F.coalesce(F.concat(F.lit("#"), F.replace(fragment, F.lit(" "), F.lit("_"))), F.lit("")))


def _named(ns: Column, main: Column, config: SiteConfig) -> Column:
    name = F.coalesce(F.try_element_at(_map(config.namespaces), ns), F.lit(""))
    return F.concat(F.when(name != "", F.concat(name, F.lit(":"))).otherwise(""), main)


def talk_page(t: Column, config: SiteConfig = DEFAULT) -> Column:
    ns = F.when((t["ns"] >= 0) & (t["ns"] % 2 == 0), t["ns"] + 1).otherwise(t["ns"])
    return _named(ns, t["main"], config)


def subject_page(t: Column, config: SiteConfig = DEFAULT) -> Column:
    ns = F.when((t["ns"] > 0) & (t["ns"] % 2 == 1), t["ns"] - 1).otherwise(t["ns"])
    return _named(ns, t["main"], config)


def is_talk(t: Column) -> Column:
    return (t["ns"] > 0) & (t["ns"] % 2 == 1)


def base_page(t: Column) -> Column:
    return F.regexp_replace(t["main"], "/[^/]*$", "")


def root_page(t: Column) -> Column:
    return F.regexp_replace(t["main"], "/.*$", "")


def subpage_name(t: Column) -> Column:
    return F.regexp_extract(t["main"], "[^/]*$", 0)


def extension(t: Column) -> Column:
    return F.lower(F.regexp_extract(t["main"], r"\.([^./]+)$", 1))


def resolve_subpage(link: Column, page: Column) -> Column:
    """``../x`` and ``/x`` relative to ``page``."""
    ups = F.length(F.regexp_extract(link, r"^(?:\.\./)+", 0)) / 3
    rest = F.regexp_replace(link, r"^(?:\.\./)+", "")
    parts = F.split(page, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups.cast("int"), F.lit(0))), "/")
    up = F.when(F.length(rest) > 0, F.concat_ws("/", base, rest)).otherwise(base)
    return F.when(F.startswith(link, F.lit("../")), up).when(F.startswith(link, F.lit("/")), F.concat(page, F.regexp_replace(link, "/+$", ""))).otherwise(link)


def pipe_trick(target: Column) -> Column:
    """Link text that ``[[target|]]`` stands for."""
    body = F.regexp_replace(F.regexp_replace(target, r"^:", ""), r"^[^:]+:", "")
    bare = F.regexp_replace(body, r"\s*[（(].*?[）)]\s*$", "")
    return F.when(bare != body, bare).otherwise(F.regexp_replace(body, r"[,，、].*$", ""))


def file_url(t: Column, width: Column | None = None, height: Column | None = None, config: SiteConfig = DEFAULT) -> Column:
    """Where a file's bytes are, in a width, or in the largest size that fits width and height; null for other pages."""
    size = F.lit("")
    if height is not None:
        size = F.concat((F.lit(10000) if width is None else width).cast("string"), F.lit("x"), height.cast("string"))
    elif width is not None:
        size = width.cast("string")
    path = F.concat(F.lit(config.server), url(F.concat(F.lit("Special:Redirect/file/"), t["main"]), None, config), F.when(size != "", F.concat(F.lit("?width="), size)).otherwise(""))
    return F.when(t["valid"] & (t["ns"] == 6) & (t["interwiki"] == ""), path)


def convert(title: Column, pairs: dict[str, str]) -> Column:
    """Title in another variant: at every place the longest key that fits is replaced, and nothing twice."""
    if not pairs:
        return title
    keys = sorted(pairs, key=lambda k: (-len(k), k))
    pattern = "|".join("".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in k) for k in keys)
    hits, pieces = F.regexp_extract_all(title, F.lit(f"({pattern})"), F.lit(1)), F.split(title, pattern, -1)
    changed = F.transform(hits, lambda h: F.try_element_at(_map(pairs), h))
    return F.aggregate(F.arrays_zip(pieces.alias("p"), changed.alias("c")), F.lit(""), lambda acc, z: F.concat(acc, z["p"], F.coalesce(z["c"], F.lit(""))))


def is_interwiki(text: Column, config: SiteConfig = DEFAULT) -> Column:
    """The interwiki prefix of a link, empty without one."""
    known = "|".join(sorted(config.interwiki, key=lambda w: (-len(w), w)))
    return F.lower(F.regexp_extract(text, rf"(?i)^({known})\s*:", 1)) if known else F.lit("")
