"""Sharding by best-fit-decreasing bin packing of indivisible groups (law: bytes).

Items are packed into bins of a fixed capacity: from the largest item down, each enters
the bin with the tightest remaining room that still holds it, found in a balanced tree of
remaining capacities; only if none fits is a bin opened. With a given shard count, the
capacity is the smallest in a short ladder above the mean for which that many bins do.

A group is all rows with equal text; it stays in one shard if it fits. The packing itself is
sequential, so its number of items is bounded whatever the table's size:
  * groups of at least 1/GRAIN of a shard are items of their own (at most GRAIN * shards),
  * smaller groups are dealt whole, by hash, to bundles of about 1/GRAIN of a shard,
  * a group larger than a shard (the mean of their sizes) is cut, by hash of the doc_id,
    into pieces of about 1/GRAIN of a shard; all others stay whole, at any cost to balance.
Only these sums reach the driver. Rows meet their shard by two joins with those bounded
tables. Slots come from counts for each (input partition, shard), never from one task a shard.

Defined results for odd input
    null text         size 16, crc 0, in the group of empty texts
    null doc_id       sharded like any other row
    repeated rows     same group; each has a slot of its own
    very long texts   whole texts are hashed; the size counts in full
    empty table       empty result
    extra columns     ignored
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm._io import materialise

OVERHEAD = 16
GRAIN = 500


class CapacityTree:
    """A balanced tree of (room, bin), as a B+ tree of two levels: blocks of sorted entries.

    Insertion, removal and best fit take O(sqrt n) moves in C and O(log n) comparisons.
    """

    BLOCK = 512

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = []

    def _block(self, entry: tuple[int, int]) -> int:
        return bisect.bisect_left(self.blocks, entry, key=lambda b: b[-1])

    def add(self, room: int, number: int) -> None:
        entry = (room, number)
        if not self.blocks:
            self.blocks.append([entry])
            return
        k = min(self._block(entry), len(self.blocks) - 1)
        bisect.insort(self.blocks[k], entry)
        if len(self.blocks[k]) > self.BLOCK:
            half = len(self.blocks[k]) // 2
            self.blocks[k : k + 1] = [self.blocks[k][:half], self.blocks[k][half:]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that holds ``size``."""
        k = self._block((size, -1))
        if k == len(self.blocks):
            return None
        at = bisect.bisect_left(self.blocks[k], (size, -1))
        entry = self.blocks[k].pop(at)
        if not self.blocks[k]:
            del self.blocks[k]
        return entry


def best_fit_decreasing(sizes: Iterable[tuple[int, object]], capacity: int, bins: int | None = None) -> dict[object, int] | None:
    """item -> bin. ``bins`` opens that many at once and gives None if they don't do."""
    tree = CapacityTree()
    opened = bins or 0
    for k in range(opened):
        tree.add(capacity, k)
    placed = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        found = tree.take(size)
        if found is None:
            if bins is not None:
                return None
            found = (max(capacity, size), opened)
            opened += 1
        tree.add(found[0] - size, found[1])
        placed[item] = found[1]
    return placed


def pack(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Best-fit-decreasing into exactly ``shards`` bins of the least capacity that does.

    An item above the mean of what is left to pack has a bin of its own, so that it does not
    raise the capacity of the others, which would leave the last bins empty.
    """
    rest = sorted(sizes, key=lambda x: (-x[0], str(x[1])))
    total, alone = sum(s for s, _ in rest), 0
    while alone < min(shards - 1, len(rest)) and rest[alone][0] * (shards - alone) > total:
        total -= rest[alone][0]
        alone += 1
    placed = {item: k for k, (_, item) in enumerate(rest[:alone])}
    rest, bins = rest[alone:], shards - alone
    least = max(-(-total // bins), max((s for s, _ in rest), default=0), 1)
    slack = 0.0
    while True:
        found = best_fit_decreasing(rest, int(least * (1 + slack)) + (slack > 0), bins)
        if found is not None:
            return placed | {item: alone + k for item, k in found.items()}
        slack = slack * 1.5 if slack else 0.0005


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for batch in batches:
        sizes, crcs, hi = [], [], []
        for t in batch.column(1):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw) + OVERHEAD)
            crcs.append(zlib.crc32(raw))
            hi.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(hi), pa.array([part] * len(sizes), pa.int32())],
            ["doc_id", "size", "text_crc32", "group", "part"],
        )


def _lookup(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table of at most 4 * GRAIN * shards rows."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the running number of each row within its task and shard."""
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    counts: dict[int, int] = {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        number = np.zeros(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            number[at] = counts.get(s, 0) + np.arange(len(at))
            counts[s] = counts.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(number)],
            ["doc_id", "size", "text_crc32", "shard", "part", "number"],
        )


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = materialise(rows.mapInArrow(_measure, "doc_id long, size long, text_crc32 long, group string, part int"), "shard-sizes")
    total = measured.agg(F.sum("size")).first()[0] or 0
    grain = max(1, total // (shards * GRAIN))
    bundles = shards * GRAIN
    groups = materialise(measured.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    large = groups.filter(F.col("bytes") >= grain).collect()  # at most GRAIN * shards + shards rows, as each has that share of the total
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int")
    small = groups.filter(F.col("bytes") < grain).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    cut = {r["group"]: -(-r["bytes"] // grain) for r in large if r["bytes"] * shards > total}
    items: list[tuple[int, tuple]] = [(r["bytes"], ("b", "", r["bundle"])) for r in small]
    items += [(r["bytes"], ("g", r["group"], 0)) for r in large if r["group"] not in cut]
    known = _lookup(spark, [(r["group"], cut.get(r["group"], 1)) for r in large], "group string, pieces long")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", "part"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")
    keyed = measured.join(known, "group", "left").withColumns(
        {
            "kind": F.when(F.col("pieces").isNull(), "b").otherwise("g"),
            "item": F.when(F.col("pieces").isNull(), "").otherwise(F.col("group")),
            "piece": F.when(F.col("pieces").isNull(), bundle).otherwise(piece),
        }
    )
    if cut:
        sums = keyed.filter("pieces > 1").groupBy("item", "piece").agg(F.sum("size").alias("bytes")).collect()
        items += [(r["bytes"], ("g", r["item"], r["piece"])) for r in sums]
    placed = pack(items, shards)
    where = _lookup(spark, [(*k, v) for k, v in placed.items()], "kind string, item string, piece int, shard int")
    sharded = keyed.join(where, ["kind", "item", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    numbered = materialise(
        sharded.mapInArrow(_numbered, "doc_id long, size long, text_crc32 long, shard int, part int, number long"), "shard-rows"
    )
    counts = numbered.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("number") + F.col("offset")).cast("long").alias("slot")
    )
