"""Near-duplicate detection with HyperMinHash sketches.

1. Sketch: each document's distinct word shingles are dealt to BUCKETS buckets by hash. A
   bucket's minimum is stored in 16 bits: 6 for its leading zeros, 10 for the mantissa.
   Documents with the same shingle set (128-bit sum) become one class, whose smallest
   doc_id stands for it from here on; copies are never expanded into pairs.
2. Banding: BANDS bands of 4 compressed registers each. At the smallest similarity asked
   for (0.85) two sets miss every band with a chance of 5e-11; at 0.8, of 5e-8.
3. Each bucket of a band is first linked as a star: the member that meets most others in all
   its buckets, which is close to the middle of its family, against the rest of the bucket.
   Pairs pass if the collision-corrected Jaccard estimate of their registers is not more
   than SIGMAS standard errors under the threshold, and are then confirmed on full sets.
4. Components of these links are formed. Members of band buckets that still hold several
   components are searched for links between components only: a document's rarest shingles,
   so many that two similar ones must share one, are its keys; members outside a key's
   largest component meet all its other members, and of these pairs those stay whose places
   of the shared key leave room for enough common shingles. They are estimated and confirmed
   in turn. Any fixed order of shingles is right for this; rarity makes it short. It is
   counted exactly, by a shuffle of the shingles of the documents that are still open:
   those of one component only can't be shared and come first, and a document that has
   enough of them is out. No pair inside a component is made, so a large group of near
   copies stays linear.

Defined results for odd input
    null, empty, blank text  empty set; linked with nothing; its own component
    fewer words than a shingle  the whole word sequence is the one shingle
    null doc_id              not linked; component_id null, kept
    repeated rows            returned each; rows that share doc_id share the outcome
    very long texts          whole texts; memory follows the longest single document
    empty table              empty result
    extra columns            ignored by ``link``; ``drop_near_copies`` hands all through
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm._io import BROADCAST_ROWS, materialise, semi_by_id, trimmed, without
from markloom.llm._text import U, Words, chunks, grams, mix
from markloom.llm.components import components

BUCKETS = 128
BAND_ROWS = 4
BANDS = BUCKETS // BAND_ROWS
MANTISSA = 10
SIGMAS = 5.0
#: Into so many parts the pairs of one document are split when they are confirmed on full sets.
SALTS = 32
#: Keys before a key that travel with it, by which a pair's later meetings are told from its first.
EARLIER = 32
#: Expected share of equal registers of disjoint sets, times 2**MANTISSA (Yu and Weber, HyperMinHash).
COLLISION = 0.169919487159739


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents: (document, hash), sorted by both."""
    h = words.hashes()
    per = np.diff(words.first)
    fits = words.room() >= k
    at = np.flatnonzero(fits)
    doc = np.repeat(np.arange(len(per)), per)
    values = grams(h, k)[at]
    docs = doc[at]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        ones = []
        for i in short:
            acc = U(per[i])
            with np.errstate(over="ignore"):
                for x in h[words.first[i] : words.first[i + 1]]:
                    acc = mix(np.array([acc * U(31) + x], np.uint64))[0]
            ones.append(acc)
        values = np.concatenate([values, np.array(ones, np.uint64)])
        docs = np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
        values, docs = values[new], docs[new]
    return docs, values


def registers(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) uint16; 0 is an empty bucket."""
    none = np.uint64(1 << 53)
    least = np.full(n * BUCKETS, none, np.uint64)
    np.minimum.at(least, docs * BUCKETS + (values & U(BUCKETS - 1)).astype(np.int64), values >> U(11))
    length = np.frexp(least.astype(np.float64))[1]
    zeros = np.minimum(53 - length, 62)
    mantissa = ((least << np.clip(53 - length, 0, 63).astype(np.uint64)) >> U(52 - MANTISSA)) & U((1 << MANTISSA) - 1)
    packed = ((zeros.astype(np.uint64) + U(1)) << U(MANTISSA)) | mantissa
    return np.where(least == none, 0, packed).astype(np.uint16).reshape(n, BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the registers they rest on."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.maximum(na, 1) / np.maximum(nb, 1)
    chance = COLLISION * used * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return np.maximum(equal - chance, 0) / np.maximum(used, 1), used


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1), lower=True):
                docs, values = _shingles(words, k)
                n = b - a
                sizes = np.bincount(docs, minlength=n)
                sums = []
                for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, docs, mix(values ^ salt))
                    sums.append(total.astype(np.int64))
                regs = registers(docs, values, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(sizes, pa.int64()), *map(pa.array, sums), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "n_shingles", "f1", "f2", "regs"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        quads = np.ascontiguousarray(_matrix(batch.column(1))).view(np.uint64)
        keys = mix(quads + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        at, _ = np.nonzero(quads)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[quads > 0].astype(np.int64)), batch.column(0).take(pa.array(at))], ["key", "rep"]
        )


def _tokens(k: int):
    """All shingles of each document: key, rep, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1), lower=True):
                docs, values = _shingles(words, k)
                at = pa.array(a + docs)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), batch.column(0).take(at), batch.column(2).take(at)], ["key", "rep", "component"])

    return run


def _likely(percent: int):
    """Keep the pairs whose estimate can still reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goal = percent / 100
        for batch in batches:
            if not len(batch):
                continue
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            got, used = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb)
            good = got >= goal - SIGMAS * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1), lower=True):
                docs, values = _shingles(words, k)
                bounds = np.searchsorted(docs, np.arange(b - a + 1))
                raw = [values[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(raw, pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """Rows sorted by hub: its own set first (no leaf), then those of the leaves to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    hub, own = a, x.copy()
                elif hub == a:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        found.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _links(pairs: DataFrame, reps: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) of representatives -> those with a confirmed similarity."""
    sketch = reps.select("rep", "n", "regs")
    likely = (
        pairs.join(sketch.toDF("a", "na", "ra"), "a")
        .join(sketch.toDF("b", "nb", "rb"), "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .select("a", "b", "na", "nb", "ra", "rb")
        .mapInArrow(trimmed(_likely(percent)), "a long, b long")
    )
    likely = materialise(likely, "near-likely")
    ids = materialise(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    sets = semi_by_id(rows.filter("doc_id is not null"), ids, "doc_id").mapInArrow(trimmed(_sets(k)), "doc_id long, shingles binary").dropDuplicates(["doc_id"])
    sets = materialise(sets, "near-sets")
    # The member of more pairs is the hub: its set travels once for each of its parts, not once for each pair.
    degree = likely.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    sided = likely.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = F.col("da") >= F.col("db")
    pairs = sided.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    hubs = pairs.select("hub", "part").distinct().join(sets.toDF("hub", "shingles"), "hub").select("hub", F.lit(None).cast("long").alias("leaf"), "shingles", "part")
    leaves = pairs.join(sets.toDF("leaf", "shingles"), "leaf").select("hub", "leaf", "shingles", "part")
    dealt = hubs.unionByName(leaves).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("leaf").asc_nulls_first())
    return materialise(dealt.select("hub", "leaf", "shingles").mapInArrow(trimmed(_confirm(percent)), "a long, b long"), "near-links")


def _across(tokens: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a prefix shingle and can still be similar.

    tokens(key, rep, component), members(rep, component, n). Shingles in the order of their counts, those of a single
    component before all: with ``at`` the place of the first shingle that both prefixes
    hold, two sets have at most 1 + min(what follows it in either) shingles in common. A
    pair is made at its first common shingle; at a later one only if the EARLIER shared keys
    before it hold none.
    """
    counted = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = materialise(counted.filter("lo <> hi").select("key", "c"), "near-shared")
    mine = tokens.select("key", "rep").join(shared, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("s")).join(members, "rep")
    alone = F.col("n") - F.size("s")
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + 1")  # whole numbers, as a rounded share could lose a pair
    at = F.transform("s", lambda t, i: F.struct((alone + i).alias("at"), t["key"].alias("key")))
    bags = mine.filter(prefix > alone).select("rep", "component", "n", F.slice(at, F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")).alias("ts"))
    placed = bags.select("rep", "component", "n", "ts", F.posexplode("ts").alias("k", "t"))
    before = F.slice("ts", F.greatest(F.col("k") - EARLIER, F.lit(0)) + 1, F.least(F.col("k"), F.lit(EARLIER)))
    held = placed.select("rep", "component", "n", F.col("t.key").alias("key"), F.col("t.at").alias("at"), F.transform(before, lambda t: t["key"]).alias("earlier"))
    held = materialise(held, "near-held")
    sizes = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max_by("component", "size").alias("largest"))
    held = held.join(most, "key")
    outside = held.filter("component <> largest").select("key", *[F.col(c).alias(f"{c}1") for c in ("rep", "component", "n", "at", "earlier")])
    inside = held.select("key", "largest", *[F.col(c).alias(f"{c}2") for c in ("rep", "component", "n", "at", "earlier")])
    room = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    fits = room * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    met = outside.join(inside, "key").filter((F.col("component1") != F.col("component2")) & fits)
    met = met.filter("component2 = largest or rep1 < rep2").filter(~F.arrays_overlap("earlier1", "earlier2"))
    return met.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = materialise(
        rows.mapInArrow(trimmed(_sketch(shingle)), "doc_id long, n_shingles long, f1 long, f2 long, regs binary"), "near-sketches"
    )
    full = sketches.filter("doc_id is not null and n_shingles > 0")
    reps = materialise(
        full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("regs").alias("regs")), "near-reps"
    )
    bands = reps.select("rep", "regs").mapInArrow(trimmed(_bands), "key long, rep long")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialise(bands.join(buckets, "key"), "near-members")
    central = members.groupBy("rep").agg(F.sum("size").alias("company"))
    ranked = members.join(central, "rep").select("key", "rep", "company")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("company", "rep")).alias("top")).select("key", F.col("top.rep").alias("leader"))
    stars = members.join(leaders, "key").filter("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    links = _links(stars, reps, rows, shingle, percent)

    labels = materialise(components(links), "near-labels")
    placed = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "near-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    unsettled = materialise(placed.join(mixed, "key").select(F.col("rep").alias("doc_id"), "component").distinct(), "near-open")
    ids = F.broadcast(unsettled) if unsettled.count() <= BROADCAST_ROWS else unsettled
    texts = rows.filter("doc_id is not null").join(ids, "doc_id").select("doc_id", "text", "component")
    tokens = texts.mapInArrow(trimmed(_tokens(shingle)), "key long, rep long, component long")
    members = unsettled.toDF("rep", "component").join(reps.select("rep", "n"), "rep")
    more = _links(_across(tokens, members, percent), reps, rows, shingle, percent)
    final = components(links.unionAll(more))

    classes = reps.select("f1", "f2", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    named = classes.select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    told = sketches.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays (the smallest doc_id); columns unchanged."""
    gone = link(docs, doc_id, text, shingle, percent).filter("not kept").select("doc_id").distinct()
    return without(docs, materialise(gone, "near-gone"), doc_id)
