"""Chat formatting by quotation linking; DataFrame operations only.

1. A message's lines carry a quote level: the number of ``>`` that they start with. Runs of
   lines of one level are passages; level 0 is the author's own text, which is what stays.
2. Quoted passages, whole and by paragraph, line and sentence, are normalised (lower case,
   white space collapsed) and hashed. They are joined to the own text of messages of the
   same conversation, likewise whole, by paragraph, line and sentence. A whole passage may
   have any length, its parts at least LEAST_CHARS. Of equal originals the earliest
   counts, found by a pre-aggregated minimum, so a sentence that a conversation repeats a
   thousand times is one row of the join.
3. A message answers the latest original among its shallowest linked quotes. Messages
   without a linked quote begin a thread of their own. The first message of each thread is
   found by pointer doubling.
4. Conversations come out in reply order: thread by thread, by the threads' first turns; in
   a thread each message is followed by its answers, the earliest first, each with its own
   answers. These places come from a tour down and up the reply trees, a linked list whose
   members are counted by pointer doubling: rows of fixed size however deep or wide a thread.
5. ``conversations`` joins the messages, without their quotes, to texts.

Places in a conversation are ranks from a range sort, so one conversation may hold any
share of all messages.

Defined results for odd input
    null text                 no lines: own text is empty
    null conv_id or turn      never linked; nulls sort first
    repeated (conv_id, turn)  each row is returned; they share links
    only quotes               own text is empty, the row stays
    very long texts           whole texts
    empty table               empty result
    extra columns             ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm._io import materialise
from markloom.llm._ranks import ranked

#: Parts of a quoted passage shorter than this say too little to be linked on their own.
LEAST_CHARS = 12
#: Sentence ends in normalised text: a mark, maybe a closing one, and a space; none after full-width marks.
SENTENCE = r"""(?<=[.!?…]["')\]”’]?) +|(?<=[。！？])(?![。！？」』”’])|(?<=[。！？][」』”’])"""


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _line(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^(?:[ \t]*>)+", 0)
    level = F.length(F.translate(marks, " \t", ""))
    body = F.when(level > 0, F.substring(line, F.length(marks) + 1, F.length(line))).otherwise(line)
    return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(body, r"^[ \t]", "")).otherwise(body).alias("body"))


def passages(text: Column) -> Column:
    """array<struct<level, text>>: runs of lines of the same quote level."""

    def runs(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

        def cut(s: Column) -> Column:
            def one(first: Column, k: Column) -> Column:
                n = F.coalesce(F.get(s, k + 1), F.size(lines)) - first
                body = F.array_join(F.transform(F.slice(lines, first + 1, n), lambda x: x["body"]), "\n")
                return F.struct(F.get(lines, first)["level"].alias("level"), body.alias("text"))

            return F.transform(s, one)

        return _let(starts, cut)

    whole = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")))
    quoted = _let(F.transform(F.split(text, "\n"), _line), runs)
    return F.when(text.rlike(r"(?m)^[ \t]*>"), quoted).otherwise(whole)


def _units(text: Column, least: int) -> Column:
    """Distinct hashes of a text whole, and of its paragraphs, lines and their sentences of at least so many characters."""
    blocks = F.transform(F.concat(F.split(text, r"\n\s*\n"), F.split(text, r"\n")), normal)
    sentences = F.flatten(F.transform(blocks, lambda x: F.transform(F.split(x, SENTENCE), F.trim)))
    parts = F.filter(F.concat(blocks, sentences), lambda x: F.length(x) >= least)
    whole = F.filter(F.array(normal(text)), lambda x: F.length(x) > 0)
    return F.transform(F.array_distinct(F.concat(whole, parts)), lambda x: F.md5(F.encode(x, "UTF-8")))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, own_text, n_quotes, n_linked, parent_turn, root_turn, formatted."""
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        passages(F.coalesce("text", F.lit(""))).alias("parts"),
    )
    own = F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    base = materialise(base.select("conv_id", "turn", "role", F.btrim(own, F.lit(" \t\n\r")).alias("own_text"), F.filter("parts", lambda p: p["level"] > 0).alias("quotes")), "chat-base")
    quotes = base.filter(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("no", "quote"))
    keys = quotes.select("conv_id", "turn", "no", "quote.level", F.explode(_units(F.col("quote.text"), LEAST_CHARS)).alias("key"))
    keys = materialise(keys, "chat-keys")
    links = None
    if keys.head(1):
        wanted = keys.select("conv_id").distinct()
        originals = base.join(wanted, "conv_id", "left_semi").select("conv_id", "turn", F.explode(_units(F.col("own_text"), 1)).alias("key"))
        first = originals.groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
        met = keys.join(first, ["conv_id", "key"]).filter("origin < turn")
        links = met.groupBy("conv_id", "turn").agg(
            F.max(F.struct((-F.col("level")).alias("depth"), "origin")).alias("best"), F.count_distinct("no").alias("n_linked")
        )
        links = materialise(links.select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "n_linked"), "chat-links")
        roots = _roots(links.select("conv_id", "turn", F.col("parent_turn").alias("up")))
        links = materialise(links.join(roots, ["conv_id", "turn"]), "chat-rooted")
        tour = _tour(links.select("conv_id", "turn", "parent_turn", "root_turn"))
        told = base.join(links.drop("root_turn"), ["conv_id", "turn"], "left").join(tour, ["conv_id", "turn"], "left")
    else:
        none = F.lit(None).cast("long")
        told = base.withColumns({"parent_turn": none, "n_linked": none, "root_turn": none, "place": none})
    rows = told.select(
        "conv_id",
        "turn",
        "role",
        "own_text",
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("place", F.lit(0)).alias("place"),
    )
    placed = ranked(rows, "conv_id", ["root_turn", "place", "role", "own_text"], "chat-ranked")
    return placed.select(
        "conv_id", F.col("rank").cast("long").alias("position"), "turn", "role", "own_text", "n_quotes", "n_linked", "parent_turn", "root_turn",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "own_text", F.lit("\n<|end|>")).alias("formatted"),
    )


def _roots(up: DataFrame) -> DataFrame:
    """(conv_id, turn, up) -> (conv_id, turn, root_turn): doubling, so log2 of the longest chain rounds."""
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("over"))
        up = materialise(up.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "chat-up")
        if not up.filter("moved").head(1):
            return up.select("conv_id", "turn", F.col("up").alias("root_turn"))
        up = up.drop("moved")


def _tour(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, root_turn) of answers -> conv_id, turn, root_turn, place: everyone's place in the thread's reply order.

    Each message is entered and left once: after entering comes its first answer, after
    leaving the next answer to the same message. Counting the entries from each step to the
    end of the thread gives the places.
    """
    tops = links.select("conv_id", F.col("root_turn").alias("turn"), F.lit(None).cast("long").alias("parent_turn"), "root_turn").distinct()
    everyone = materialise(tops.unionByName(links), "chat-everyone")
    first = links.groupBy("conv_id", "parent_turn").agg(F.min("turn").alias("child")).select("conv_id", F.col("parent_turn").alias("turn"), "child")
    siblings = links.select("conv_id", "parent_turn", "turn", F.concat_ws(":", "conv_id", "parent_turn").alias("_set"))
    numbered = materialise(ranked(siblings, "_set", ["turn"], "chat-siblings").select("conv_id", "parent_turn", "turn", "rank"), "chat-numbered")
    later = numbered.select("conv_id", "parent_turn", F.col("turn").alias("sibling"), (F.col("rank") - 1).alias("rank"))
    after = numbered.join(later, ["conv_id", "parent_turn", "rank"]).select("conv_id", "turn", "sibling")
    # A step is named by its turn and whether it enters (1) or leaves (0).
    met = everyone.join(first, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left")
    entering = met.select("conv_id", "turn", F.lit(1).alias("enters"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNotNull(), 1).otherwise(0).alias("to_enters"))
    leaving = met.select("conv_id", "turn", F.lit(0).alias("enters"), F.coalesce("sibling", "parent_turn").alias("to"), F.when(F.col("sibling").isNotNull(), 1).otherwise(0).alias("to_enters"))
    steps = materialise(entering.unionByName(leaving).withColumn("n", F.col("enters").cast("long")), "chat-tour")
    while steps.filter("to is not null").head(1):
        ahead = steps.select("conv_id", F.col("turn").alias("to"), F.col("enters").alias("to_enters"), F.col("to").alias("to2"), F.col("to_enters").alias("to_enters2"), F.col("n").alias("n2"))
        moved = steps.join(ahead, ["conv_id", "to", "to_enters"], "left")
        steps = materialise(moved.select("conv_id", "turn", "enters", F.col("to2").alias("to"), F.coalesce("to_enters2", F.lit(0)).alias("to_enters"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "chat-tour")
    left = everyone.join(steps.filter("enters = 1").select("conv_id", "turn", "n"), ["conv_id", "turn"])
    size = left.filter("turn = root_turn").select("conv_id", "root_turn", F.col("n").alias("size"))
    return left.join(size, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", (F.col("size") - F.col("n")).alias("place"))


#: Messages in one text: longer conversations come as several parts, so no row grows without bound.
PART_MESSAGES = 1_000


def conversations(linked: DataFrame) -> DataFrame:
    """conv_id, part, n_messages, text: formatted messages without quotes, in reply order."""
    part = F.floor(F.col("position") / PART_MESSAGES).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("position", "formatted")))
    texts = linked.groupBy("conv_id", part.alias("part")).agg(F.count(F.lit(1)).alias("n_messages"), ordered.alias("m"))
    return texts.select("conv_id", "part", "n_messages", F.array_join(F.transform("m", lambda x: x["formatted"]), "\n").alias("text"))
