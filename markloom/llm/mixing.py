"""Mixing sources to target weights by Pfair scheduling; DataFrame operations only.

Each source's rows, in the order of md5(doc_id), are cut into blocks of BLOCK_ROWS. The
j-th block of a source with share w of the mixture has release time floor((j - 1) / w)
and deadline ceil(j / w); one block a slot goes out, of the released ones that with the
earliest deadline (a tie goes to the later successor deadline, then to the name). A
source is therefore never a whole block away from its share of the slots so far.

Weights are whole numbers, so the schedule repeats after sum(weights) slots: one round is
laid out on the driver and every block finds its slot by arithmetic. When a source runs
out, the others go on with their weights among themselves, in a new phase; no row is
dropped or repeated. Phases are at most two for each source.

Ranks within a source come from a range sort over all sources together, so that a source
with a third of all rows is spread over many tasks: each partition's rows are numbered
and shifted by the counts of the partitions before it.

Defined results for odd input
    null or unlisted source  belongs to the source OTHER, with weight ``other``
    null doc_id              sorts first in its source
    repeated rows            each is placed; equal ids are next to each other
    null or long texts       not looked at
    empty table              empty result
    extra columns            ``schedule`` ignores them, ``mix`` hands all through (but ``placed`` replaces slot and position)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm._ranks import ranked

BLOCK_ROWS = 16
OTHER = "(other)"

#: Target weights of the synthetic sources src0 .. src19, from a rule: 1 to 5.
TARGETS = {f"src{i}": 1 + (7 * i) % 5 for i in range(20)}


def pfair_round(weights: dict[str, int]) -> list[tuple[str, int]]:
    """(source, number of its block) for each slot of one round of sum(weights) slots."""
    span = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    out = []
    for slot in range(span):
        best = None
        for name in sorted(weights):
            w, j = weights[name], done[name] + 1
            if j > w or (j - 1) * span // w > slot:
                continue
            deadline = -(-j * span // w)
            overlap = 1 if j * span % w else 0  # its window shares a slot with the next one's
            rank = (deadline, -overlap, -(-(j + 1) * span // w) if overlap else 0, name)
            if best is None or rank < best:
                best = rank
        name = best[-1]
        out.append((name, done[name]))
        done[name] += 1
    return out


def plan(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple]:
    """(source, first block, blocks a round, number in round, first slot, slots a round, number of slot, rounds).

    The k-th block of a source, with first <= k < first + rounds * blocks a round and
    (k - first) % blocks a round = number in round, gets the slot
    first slot + (k - first) // blocks a round * slots a round + number of slot.
    """
    left, begun, rows, slot = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), [], 0
    while left:
        active = {s: weights[s] for s in left}
        rounds = min(left[s] // w for s, w in active.items())
        if rounds:
            take = active
        else:  # a source has less than a round left: one short round, in which its last blocks take part
            rounds, take = 1, {s: min(w, left[s]) for s, w in active.items()}
        order = [(s, j) for s, j in pfair_round(active) if j < take[s]]
        rows += [(s, begun[s], take[s], j, slot, len(order), k, rounds) for k, (s, j) in enumerate(order)]
        slot += rounds * len(order)
        for s in list(left):
            begun[s] += rounds * take[s]
            left[s] -= rounds * take[s]
            if not left[s]:
                del left[s]
    return rows


def _ranked(docs: DataFrame, keep: list, doc_id: str, source: str, names: list[str]) -> DataFrame:
    """Rows with their source and 0-based rank in it, by md5 of the doc_id."""
    named = F.when(F.col(source).isin(*names), F.col(source)).otherwise(F.lit(OTHER))
    ident = F.col(doc_id).cast("long")
    base = docs.select(ident.alias("doc_id"), named.alias("source"), F.md5(ident.cast("string").cast("binary")).alias("_key"), *keep)
    return ranked(base, "source", ["_key", "doc_id"], "mix-ranked", few_groups=True)


def _layout(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    values = ", ".join("({}, {})".format("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'", ", ".join(f"{x}L" for x in rest)) for s, *rest in rows)
    names = "source, first, a_round, j, slot0, slots, k, rounds"
    return spark.sql(f"SELECT * FROM VALUES {values or '(NULL, 0L, 1L, 0L, 0L, 0L, 0L, 0L)'} AS t({names})")


def _schedule(docs: DataFrame, keep: list, weights: dict[str, int], other: int, block_rows: int, doc_id: str, source: str) -> DataFrame:
    spark = docs.sparkSession
    weights = {**weights, OTHER: other}
    ranked = _ranked(docs, keep, doc_id, source, sorted(set(weights) - {OTHER}))
    named = F.when(F.col(source).isin(*sorted(set(weights) - {OTHER})), F.col(source)).otherwise(F.lit(OTHER))
    sizes = {r[0]: r[1] for r in docs.groupBy(named.alias("s")).count().collect()}  # a row for each listed source
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    rows = plan(blocks, weights)
    layout = _layout(spark, rows)
    #: The last block of a source may be short: (slot, rows missing) of those blocks.
    short = []
    for s, n in sizes.items():
        last, missing = blocks[s] - 1, blocks[s] * block_rows - n
        for name, first, a_round, j, slot0, slots, k, rounds in rows:
            if name == s and first <= last < first + a_round * rounds and (last - first) % a_round == j and missing:
                short.append((slot0 + (last - first) // a_round * slots + k, missing))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / F.lit(block_rows)).cast("long")).alias("r")
    lay = F.broadcast(layout).alias("l")  # at most 2 * sources * sum(weights) rows
    met = placed.join(
        lay,
        (F.col("r.source") == F.col("l.source"))
        & (F.col("block") >= F.col("first"))
        & (F.col("block") < F.col("first") + F.col("a_round") * F.col("rounds"))
        & ((F.col("block") - F.col("first")) % F.col("a_round") == F.col("j")),
    ).drop(F.col("l.source"))
    slot = F.col("slot0") + F.floor((F.col("block") - F.col("first")) / F.col("a_round")) * F.col("slots") + F.col("k")
    out = met.withColumn("slot", slot.cast("long"))
    missing = F.lit(0).cast("long")
    if short:
        gaps = F.array(*[F.struct(F.lit(a).cast("long").alias("slot"), F.lit(b).cast("long").alias("n")) for a, b in sorted(short)])
        missing = F.aggregate(F.filter(gaps, lambda g: g["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda acc, g: acc + g["n"])
    return out.withColumn("position", F.col("slot") * block_rows + F.col("rank") % block_rows - missing)


def schedule(
    docs: DataFrame, weights: dict[str, int] | None = None, other: int = 1, block_rows: int = BLOCK_ROWS, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """doc_id, source, block (in its source), slot (of the block), position (gapless from 0)."""
    out = _schedule(docs, [], weights or TARGETS, other, block_rows, doc_id, source)
    return out.select("doc_id", "source", "block", "slot", "position")


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    other: int = 1,
    block_rows: int = BLOCK_ROWS,
    doc_id: str = "doc_id",
    source: str = "source",
    placed: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs``, in the order of the schedule (a range sort).

    Files don't keep that order; ``placed`` adds slot and position, in place of columns of these names.
    """
    own = [c for c in docs.columns if not placed or c.lower() not in ("slot", "position")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    out = _schedule(docs, [row], weights or TARGETS, other, block_rows, doc_id, source)
    added = ["slot", "position"] if placed else []
    return out.select("slot", "position", "_row").sort("position").select("_row.*", *added)
