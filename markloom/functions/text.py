"""Small text functions as column expressions: escapes, CSS, classes, converter flags, messages, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escape_html(s: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def escape_wikitext(s: Column) -> Column:
    """Pipes, braces and equals signs as the magic words that stand for them."""
    out = F.replace(s, F.lit("="), F.lit("{{=}}"))
    return F.replace(F.replace(out, F.lit("||"), F.lit("{{!!}}")), F.lit("|"), F.lit("{{!}}"))


def decode_numeric(s: Column) -> Column:
    """Decimal and hexadecimal character references up to the basic plane."""
    found = F.regexp_extract_all(s, F.lit("(&#(?:[0-9]{1,5}|[xX][0-9a-fA-F]{1,4});)"), F.lit(1))

    def char(e: Column) -> Column:
        body = F.regexp_replace(e, "^&#|;$", "")
        code = F.when(F.lower(F.left(body, F.lit(1))) == "x", F.conv(F.substring(body, 2, 8), 16, 10)).otherwise(body)
        return F.decode(F.unhex(F.lpad(F.hex(code.try_cast("int")), 4, "0")), "UTF-16BE")

    return F.aggregate(F.array_distinct(found), s, lambda acc, e: F.replace(acc, e, char(e)))


def css(style: Column, key: str) -> Column:
    """The last value of a property in a style text, null where there is none."""
    pairs = F.transform(F.split(style, r";(?![^()]*\))"), lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.substring(p, F.length(F.split_part(p, F.lit(":"), F.lit(1))) + 2, F.lit(1 << 30))).alias("v")))
    return F.try_element_at(F.filter(pairs, lambda p: (p["k"] == key.lower()) & (p["v"] != "")), F.lit(-1))["v"]


def set_css(style: Column, key: str, value: str) -> Column:
    kept = F.filter(F.split(style, r";(?![^()]*\))"), lambda p: (F.trim(p) != "") & (F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(1)))) != key.lower()))
    return F.array_join(F.concat(F.transform(kept, lambda p: F.trim(p)), F.array(F.lit(f"{key}: {value}"))), "; ")


def has_class(classes: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.trim(classes), r"\s+"), name), F.lit(False))


def effective_flags(flags: Column, variants: list[str]) -> Column:
    """Flags of a language-variant block that take effect: R, then N, then -, then variant codes, then the rest."""
    has = lambda f: F.array_contains(flags, f)
    codes = F.array_intersect(flags, F.array(*[F.lit(v) for v in variants])) if variants else F.array().cast("array<string>")
    rest = F.array_intersect(flags, F.array(*[F.lit(f) for f in "SATDH"]))
    return F.when(has("R"), F.array(F.lit("R"))).when(has("N"), F.array(F.lit("N"))).when(has("-"), F.array(F.lit("-"))).when(F.size(codes) > 0, codes).when(F.size(rest) > 0, rest).otherwise(F.array(F.lit("S")))


def message(template: Column, *args: Column) -> Column:
    """$1, $2, ... of an interface message filled in."""
    out = template
    for k, a in reversed(list(enumerate(args, 1))):
        out = F.replace(out, F.lit(f"${k}"), a)
    return out


def utf16_offset(text: Column, at: Column) -> Column:
    """Editor offset (UTF-16 units) of a code-point offset."""
    head = F.left(text, at)
    return F.length(head) + F.length(head) - F.length(F.regexp_replace(head, r"[\x{10000}-\x{10FFFF}]", ""))


def escape_newline(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit("&#10;"))


def no_wrap(s: Column) -> Column:
    """Line feeds as a backslash and an n."""
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


def remove_comments(s: Column, closed_only: bool = False) -> Column:
    return F.regexp_replace(s, r"(?s)<!--.*?-->" if closed_only else r"(?s)<!--.*?(?:-->|\z)", "")


def remove_comment_lines(s: Column) -> Column:
    """Lines inside the text that hold comments and blanks only go; other comments are cut out."""
    return remove_comments(F.regexp_replace(s, r"(?<=\n)[ \t]*(?:<!--(?:(?!-->)[\s\S])*-->[ \t]*)+\n", ""))


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\{}()|.?*+^$\[\]])", r"\\$1")


def encode_fragment(s: Column) -> Column:
    """Marks that a link fragment can't hold, percent-encoded."""
    out = s
    for mark in "<>[]#|=":
        out = F.replace(out, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return out


def attribute_value(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\t\r\n ]+", " "))


def sanitise_attribute(s: Column, is_id: bool = False) -> Column:
    out = F.regexp_replace(s, r"\s+|&#10;", "_" if is_id else " ")
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def sanitise_alt(s: Column) -> Column:
    bare = F.trim(F.regexp_replace(s, r"(?s)</?[a-z].*?>", ""))
    return F.replace(F.regexp_replace(bare, r"\s+", " "), F.lit('"'), F.lit("&quot;"))


def charinsert_items(inner: Column) -> Column:
    """array<array<string>> of lines of a charinsert tag: each item as its one or two parts."""
    plain = F.regexp_replace(inner, r"(?i)</?nowiki>", "")
    items = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    return F.transform(items, lambda x: F.when(F.instr(x, "+") > 1, F.split(x, r"\+", 2)).otherwise(F.array(x)))


# -- edits of one text


def append_text(s: Column, more: Column | str) -> Column:
    return F.concat(s, F.lit(more) if isinstance(more, str) else more)


def insert_text(s: Column, at: Column, more: Column | str) -> Column:
    return F.concat(F.left(s, at), F.lit(more) if isinstance(more, str) else more, F.substring(s, at + 1, F.length(s)))


def delete_text(s: Column, at: Column, n: Column) -> Column:
    return F.concat(F.left(s, at), F.substring(s, at + n + 1, F.length(s)))


def split_text(s: Column, at: Column) -> Column:
    """array of the two parts; from the end if the place is negative."""
    place = F.when(at < 0, F.length(s) + at).otherwise(at)
    return F.array(F.left(s, place), F.substring(s, place + 1, F.length(s)))


# -- new wikitext


def make_comment(s: Column) -> Column:
    """A comment; a mark that would end it early is escaped."""
    return F.concat(F.lit("<!--"), F.replace(s, F.lit("-->"), F.lit("--&gt;")), F.lit("-->"))


def make_element(tag: str, attrs: dict[str, Column | str] | None = None, inner: Column | str | None = None) -> Column:
    """``<tag a="b">inner</tag>``, or a self-closed tag without inner text."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = [c for k, v in (attrs or {}).items() for c in (F.lit(f' {k}="'), sanitise_attribute(lit(v)), F.lit('"'))]
    tail = [F.lit("/>")] if inner is None else [F.lit(">"), lit(inner), F.lit(f"</{tag}>")]
    return F.concat(F.lit(f"<{tag}"), *parts, *tail)


def make_text(s: Column) -> Column:
    """Text that reads as itself: everything that would start markup is escaped."""
    return F.regexp_replace(escape_html(s), r"([\[\]{}|'*]|(?m:^[#:;= ])|(?<=~~)~|(?<=_)_)", "<nowiki>$1</nowiki>")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """key, template of an interface language: JSON files of flat objects."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "template")).filter(~F.startswith("key", F.lit("@")))


def messages(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(key, args array<string>) with ``message``: its template filled in, or the key in brackets."""
    filled = F.aggregate(F.reverse(F.sequence(F.lit(1), F.greatest(F.size("args"), F.lit(1)))), F.col("template"), lambda t, k: F.replace(t, F.concat(F.lit("$"), k.cast("string")), F.coalesce(F.try_element_at("args", k), F.lit(""))))
    return asked.join(known, "key", "left").withColumn("message", F.coalesce(filled, F.concat(F.lit("⧼"), "key", F.lit("⧽")))).drop("template")
