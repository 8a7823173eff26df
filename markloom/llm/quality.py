"""Quality rules: a threshold table compiled into one Spark projection.

Everything runs in the JVM (no Python functions). Each document is judged from its own
row, so there is no shuffle at all and skew in any key cannot matter.

Defined results for odd input
    null, empty or blank text   no words; every count is 0, ``base_failed`` is true, not kept
    very long text              one pass over an in-row array; sorting only if a window repeats
    repeated rows, null doc_id  each row is judged alone and returned
    empty table                 empty result
    extra columns               ignored by ``score``; ``filter_documents`` hands all through
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5

# Common function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this are from or an at not "
    "der die das und ist nicht von den zu mit dem des ein eine für auf "
    "le la les et de des est dans pour qui que sur au pas un une du en "
    "el los las y se del por con una para lo como más su"
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] for documents of at least ``min_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


THRESHOLDS: tuple[Rule, ...] = (
    Rule("length", "n_words", low=10, high=200_000),
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.06, min_words=40),
    Rule("repeated_lines", "dup_line_ratio", high=0.5, min_words=20),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a lambda variable is evaluated a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return _let(trimmed, lambda t: F.when(F.length(t) == 0, none).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def _covered(positions: Column) -> Column:
    """Words covered by windows at these sorted start positions."""

    def body(q: Column) -> Column:
        n = F.size(q)
        gaps = F.zip_with(F.slice(q, 1, n - 1), F.slice(q, 2, n - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(WINDOW)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x))

    return _let(positions, body)


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur at least twice in the text.

    Windows are compared by xxhash64 (a clash inside one text of 20,000 words has a
    chance of 1e-11). Only texts in which some window repeats pay for the sort.
    """

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == e["h"])),
            )
            return _covered(F.sort_array(F.transform(twice, lambda e: e["i"])))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, positions))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(hashes, repeated))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Ratios by name: (part, whole).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def _counts(text: Column) -> Column:
    """The raw counts of a text as one struct expression, in which every part is evaluated once."""
    body = F.coalesce(text, F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), _has_word)
        n_lines = _let(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("dup")))
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS.split())))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            n_lines.alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            stops.cast("long").alias("n_stop_words"),
        )

    def flat(m: Column) -> Column:
        return F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")],
            m["lines"]["dup"].cast("long").alias("n_dup_lines"),
            m["lines"]["n"].cast("long").alias("n_lines"),
        )

    return _let(_let(_words(text), counts), flat)


def _rated(m: Column) -> Column:
    """Counts with their ratios."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    return F.struct(*[m[c].alias(c) for c in names], *[_ratio(m[a], m[b]).alias(name) for name, (a, b) in RATIOS.items()])


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The threshold table as one expression: names of the rules that these metrics break."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m[r.metric] < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m[r.metric] > F.lit(r.high))
        broken.append(F.when((m["n_words"] >= r.min_words) & bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(text: Column, rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """Metrics, ``base_failed`` and ``broken`` of a text, as one struct expression."""

    def judge(m: Column) -> Column:
        return F.struct(m.alias("m"), _base_failed(m).alias("base_failed"), verdict(m, rules).alias("broken"))

    return _let(_let(_counts(text), _rated), judge)


def score(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Counts, ratios, ``base_failed``, ``broken`` (rule names) and ``kept`` for each row."""
    rows = docs.select(*keep, judged(F.col(text), rules).alias("_j"))
    return rows.select(*keep, "_j.m.*", "_j.base_failed", "_j.broken").withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows that every rule lets pass, with their own columns unchanged.

    The condition is a single expression that binds each intermediate value once; a filter
    on derived columns would be pushed below them and repeat the whole measurement.
    """
    return docs.filter(_let(judged(F.col(text), rules), lambda j: ~j["base_failed"] & (F.size(j["broken"]) == 0)))
