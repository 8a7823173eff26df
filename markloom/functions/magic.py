"""Parser functions as column expressions. The text kernel for expansion has its own registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig
from markloom.functions import titles

def lc(s: Column) -> Column:
    return F.lower(s)


def uc(s: Column) -> Column:
    return F.upper(s)


def lcfirst(s: Column) -> Column:
    return F.concat(F.lower(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def ucfirst(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def _pad(s: Column, n: Column, pad: Column) -> tuple[Column, Column]:
    need = F.greatest(F.least(n, F.lit(500)) - F.length(s), F.lit(0))
    return s, F.when(F.length(pad) > 0, F.left(F.repeat(pad, need), need)).otherwise("")


def padleft(s: Column, n: Column, pad: Column | None = None) -> Column:
    s, extra = _pad(s, n, F.lit("0") if pad is None else pad)
    return F.concat(extra, s)


def padright(s: Column, n: Column, pad: Column | None = None) -> Column:
    s, extra = _pad(s, n, F.lit("0") if pad is None else pad)
    return F.concat(s, extra)


def length(s: Column) -> Column:
    return F.length(F.trim(s))


def pos(s: Column, needle: Column, offset: Column | int = 0) -> Column:
    """Zero-based place of needle, '' where there is none."""
    n = F.when(needle == "", " ").otherwise(needle)
    at = F.call_function("locate", n, s, (F.lit(offset) if isinstance(offset, int) else offset) + 1)
    return F.when(at > 0, (at - 1).cast("string")).otherwise("")


def rpos(s: Column, needle: Column) -> Column:
    n = F.when(needle == "", " ").otherwise(needle)
    at = F.call_function("locate", F.reverse(n), F.reverse(s))
    return F.when(at > 0, F.length(s) - at - F.length(n) + 1).otherwise(-1)


def sub(s: Column, start: Column, n: Column | None = None) -> Column:
    a = F.when(start < 0, F.greatest(F.length(s) + start, F.lit(0))).otherwise(start)
    if n is None:
        return F.substring(s, a + 1, F.length(s))
    stop = F.when(n < 0, F.length(s) + n).when(n == 0, F.length(s)).otherwise(a + n)
    return F.substring(s, a + 1, F.greatest(stop - a, F.lit(0)))


def count(s: Column, needle: Column) -> Column:
    n = F.when(needle == "", " ").otherwise(needle)
    return ((F.length(s) - F.length(F.replace(s, n, F.lit("")))) / F.length(n)).cast("int")


def replace(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, F.when(old == "", " ").otherwise(old), new)


def explode(s: Column, by: Column, index: Column) -> Column:
    return F.coalesce(F.split_part(s, F.when(by == "", " ").otherwise(by), F.when(index >= 0, index + 1).otherwise(index)), F.lit(""))


def same(a: Column, b: Column) -> Column:
    """Equal as strings or as numbers."""
    number = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
    numbers = F.trim(a).rlike(number) & F.trim(b).rlike(number)
    return (F.trim(a) == F.trim(b)) | (numbers & (F.trim(a).try_cast("double") == F.trim(b).try_cast("double")))


def if_(test: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(F.trim(test) != "", yes).otherwise(F.lit("") if no is None else no)


def ifeq(a: Column, b: Column, yes: Column, no: Column | None = None) -> Column:
    return F.when(same(a, b), yes).otherwise(F.lit("") if no is None else no)


def switch(value: Column, cases: list[tuple[list[str], Column | str]], default: Column | str = "") -> Column:
    out = None
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    for keys, result in cases:
        test = F.lit(False)
        for k in keys:
            test = test | same(value, F.lit(k))
        out = F.when(test, lit(result)) if out is None else out.when(test, lit(result))
    return lit(default) if out is None else out.otherwise(lit(default))


def plural(n: Column, one: Column, other: Column) -> Column:
    return F.when(F.abs(n) == 1, one).otherwise(other)


def urlencode(s: Column, kind: str = "QUERY") -> Column:
    encoded = F.url_encode(s)
    if kind == "WIKI":
        return titles.encode(s)
    return F.replace(encoded, F.lit("+"), F.lit("%20")) if kind == "PATH" else encoded


def anchorencode(s: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(s, r"<[^>]*>", "")), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(bare, "'{2,}", ""), r"[ \t\n_]+", "_")


def titleparts(s: Column, n: Column, offset: Column) -> Column:
    parts = F.split(s, "/", 25)
    first = F.when(offset > 0, offset).when(offset < 0, F.greatest(F.size(parts) + offset + 1, F.lit(1))).otherwise(1)
    left = F.size(parts) - first + 1
    take = F.when(n > 0, n).when(n < 0, F.greatest(left + n, F.lit(0))).otherwise(left)
    return F.array_join(F.slice(parts, first.cast("int"), F.greatest(take, F.lit(0)).cast("int")), "/")


def rel2abs(path: Column, base: Column) -> Column:
    full = F.when(path.rlike(r"^\.{0,2}/|^\.{1,2}$") & ~F.startswith(path, F.lit("//")), F.concat_ws("/", base, path)).otherwise(path)
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")


def ns(value: Column, config: SiteConfig = DEFAULT) -> Column:
    number = F.coalesce(value.try_cast("int"), F.try_element_at(titles._map({k: v for k, v in config.aliases.items() if v}), F.lower(value)))
    return F.coalesce(F.try_element_at(titles._map(config.namespaces), number), F.lit(""))


def current(name: str, at: Column) -> Column:
    """Clock words on a timestamp column; the same for current* (UTC) and local* after a zone shift."""
    fmt = {"year": "yyyy", "month": "MM", "month1": "M", "day": "d", "day2": "dd", "hour": "HH", "time": "HH:mm", "timestamp": "yyyyMMddHHmmss", "monthname": "MMMM", "monthnamegen": "MMMM", "monthabbrev": "MMM", "dayname": "EEEE"}
    if name in fmt:
        return F.date_format(at, fmt[name])
    if name == "dow":
        return (F.dayofweek(at) - 1).cast("string")
    if name == "week":
        return F.ceil((F.unix_timestamp(at) - F.unix_timestamp(F.trunc(at, "year").cast("timestamp"))) / 604800).cast("string")
    raise KeyError(name)


def isbn_valid(number: Column) -> Column:
    """ISBN-10 or ISBN-13 checksum of bare digits."""
    digits = F.transform(F.regexp_extract_all(number, F.lit("[0-9Xx]"), F.lit(0)), lambda d: F.when(F.lower(d) == "x", 10).otherwise(d.try_cast("int")))
    ten = F.aggregate(F.transform(digits, lambda d, i: d * (10 - i)), F.lit(0), lambda a, x: a + x) % 11 == 0
    thirteen = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(F.length(number) == 10, ten).when(F.length(number) == 13, thirteen).otherwise(False)
