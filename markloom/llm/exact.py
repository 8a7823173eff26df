"""Exact dedup by Golomb-coded fingerprint exchange.

1. Each input partition fingerprints its texts, sorts the fingerprints and sends each
   owner (a range of the fingerprint space) one packet: the distinct sorted values,
   gaps Golomb-Rice coded. A text copied a thousand times inside a partition is sent once.
2. Owners count how many partitions sent each fingerprint and answer every packet with a
   bitmap: one bit for each value, set if another partition holds it too.
3. Rows whose bit is set, or that repeat inside their own partition, are suspects. Only
   suspects' texts are shuffled; grouping them by the whole normalised text is the byte
   verification, with map-side combining, so that a hot text is one row a task.

Fingerprints are short (log2(rows) + 12 bits): about one row in 4,000 is suspected
wrongly and then cleared by step 3. Results never depend on a hash alone: rows of one
class have been grouped by their bytes, and the classes meet the rows again by SHA-256.

Defined results for odd input
    null text            counts as the empty text
    null doc_id          smaller than every other id; a class of null ids only has keep_id null
    repeated rows        each row is returned; rows that share the kept doc_id are all kept
    very long texts      hashed whole; only suspects are shuffled
    empty table          empty result
    extra columns        ignored by ``classes``; ``drop_copies`` hands all columns through
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.llm._io import materialise, semi_by_id, without

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: An owner has about 100,000 fingerprints until there are so many owners. Beyond that owners grow, not packets
#: shrink: 50 billion rows are 12 million fingerprints an owner (100 MB), and packets of a 60,000-row partition still hold 15.
MOST_OWNERS = 4096

PACKETS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("owner", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("rice", T.IntegerType()),
        T.StructField("high", T.BinaryType()),
        T.StructField("low", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("shas", T.BinaryType()),
        T.StructField("slots", T.BinaryType()),
    ]
)


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 values as (Rice parameter, unary quotients, remainders)."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    rice = max(0, int(np.log2(max(1.0, float(values[-1]) / len(values)))))
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    bits = ((gaps[:, None] >> np.arange(rice, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return rice, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, rice: int, high: bytes, low: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(rice)
    if rice:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * rice).reshape(n, rice).astype(np.uint64)
        gaps |= (bits << np.arange(rice, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _fingerprints(bits: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list = []
        digests: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            # bytes.lower touches A-Z only
            digests += [hashlib.sha256((t.as_py() or "").encode("utf-8", "surrogatepass").lower()).digest() for t in batch.column(1)]
        if not ids:
            return
        whole = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        prints = whole[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        span = (1 << bits) // owners + 1
        owner = (prints // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(prints)], strict=True):
            distinct, slots = np.unique(prints[a:b], return_inverse=True)
            o = int(owner[a])
            rice, high, low = golomb_encode(distinct - np.uint64(o * span))
            picked = order[a:b]
            rows.append((part, o, len(distinct), rice, high, low, [ids[k] for k in picked], whole[picked].tobytes(), slots.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_pydict(
            {f.name: [r[k] for r in rows] for k, f in enumerate(PACKETS.fields)},
            schema=pa.schema(
                [
                    ("part", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("rice", pa.int32()), ("high", pa.binary()),
                    ("low", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("shas", pa.binary()), ("slots", pa.binary()),
                ]
            ),
        )

    return run


def _answer(packets: pa.Table) -> pa.Table:
    """All packets of one owner: a bitmap for each, set where another partition has the value."""
    columns = [packets[name] for name in ("n", "rice", "high", "low")]
    sent = [golomb_decode(n.as_py(), rice.as_py(), high.as_py(), low.as_py()) for n, rice, high, low in zip(*columns, strict=True)]
    _, place, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = (counts > 1)[place]
    ends = np.cumsum([len(v) for v in sent]).tolist()
    maps = [np.packbits(shared[b - len(v) : b]).tobytes() for v, b in zip(sent, ends, strict=True)]
    return packets.select(["part", "owner"]).append_column("bitmap", pa.array(maps, pa.binary()))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: list = []
        shas: list[bytes] = []
        flags: list[bool] = []
        for r in batch.to_pylist():
            slots = np.frombuffer(r["slots"], "<u4")
            shared = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)
            local = np.bincount(slots, minlength=r["n"]) > 1
            flags += (shared | local)[slots].tolist()
            ids += r["doc_ids"]
            shas += [r["shas"][k : k + 32].hex() for k in range(0, len(r["shas"]), 32)]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, pa.int64()), "text_sha256": pa.array(shas, pa.string()), "suspect": pa.array(flags, pa.bool_())}
        )


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fingerprint_bits: int | None = None, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = max(rows.count(), 1)
    bits = fingerprint_bits or min(60, max(16, total.bit_length() + 12))
    owners = owners or min(MOST_OWNERS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 100_000)))
    packets = materialise(rows.mapInArrow(_fingerprints(bits, owners), PACKETS), "exact-packets")
    answers = (
        packets.select("part", "owner", "n", "rice", "high", "low")
        .groupBy("owner")
        .applyInArrow(_answer, "part int, owner int, bitmap binary")
    )
    told = packets.select("part", "owner", "n", "doc_ids", "shas", "slots").join(answers, ["part", "owner"])
    flagged = materialise(told.mapInArrow(_flags, "doc_id long, text_sha256 string, suspect boolean"), "exact-flags")
    suspects = flagged.filter("suspect and doc_id is not null").select("doc_id").distinct()
    body = normalised(F.col("text"))
    texts = semi_by_id(rows.filter("doc_id is not null"), suspects, "doc_id").unionByName(rows.filter("doc_id is null"))
    verified = texts.groupBy(body.alias("body")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = verified.select(F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"), "keep_id", "group_size").filter("group_size > 1")
    joined = flagged.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their own columns unchanged."""
    gone = classes(docs, doc_id, text).filter("not kept").select("doc_id").distinct()
    return without(docs, materialise(gone, "exact-gone"), doc_id)
