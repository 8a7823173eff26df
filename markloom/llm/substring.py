"""Substring dedup by relative Lempel-Ziv factors, verified by their words.

The corpus itself is the reference. Every window of MIN_WORDS words is looked up in the
index of all windows; a document is then parsed from left to right into literal words and
factors (source document, source word, length).

1. Index: in every window the smallest hash of ANCHOR_WORDS consecutive words is its
   *anchor*; neighbouring windows mostly share one. A run of windows under one anchor goes
   to the owner of the anchor as one block of the index: 8 bytes a window and about 28 a
   run of some eight windows. Of equal windows in a group of texts only the first is sent,
   so a passage that a third of all documents share is a row a group, not a row a document.
2. Lookup: the owner finds the earliest place of each window. That place is the source of
   all later ones.
3. Parse: at the first word with a source the factor begins, and it is extended word by
   word as long as the following windows go on at the same source. Where that ends another
   factor may begin, inside the last one too: as every window was looked up on its own,
   none that lies across the boundary of two factors is missed.
4. Check: the SHA-256 of a factor's words is compared with that of the words at its source,
   taken from the source's own text. Should any differ (two windows with equal 64-bit
   hashes under equal anchors), everything is parsed again with other hash weights, so
   nothing is removed for a clash of hashes.
5. Words under factors are removed; ``spans`` are the runs of removed words.

There is one plan for all sizes. Texts are shuffled of those documents only that hold a
factor or are a source of one.

Defined results for odd input
    null text            no words
    null doc_id          the row is returned whole; it is neither a source nor parsed
    repeated doc_id      rows with the same id don't remove each other, whether their texts are equal or not
    ties                 of equal windows in a document the first start is the source; the earliest document else
    under MIN_WORDS      nothing removed
    very long texts      whole texts; memory follows the longest single document
    empty table          empty result
    extra columns        ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm._io import materialise, semi_by_id, trimmed
from markloom.llm._text import U, Words, chunks, grams, mix

MIN_WORDS = 20
ANCHOR_WORDS = 6
#: Windows of a group of texts that are sorted together before the shuffle.
GROUP_WINDOWS = 1 << 20
#: Bytes of text for each owner of anchors.
OWNER_BYTES = 8 << 20

#: Blocks of the index (local false: runs of windows) and of found windows (local true).
BLOCKS = "slot int, local boolean, docs binary, texts binary, starts binary, sizes binary, a binary, b binary, c binary"
FOUND = "slot int, docs binary, texts binary, starts binary, sizes binary, a binary, b binary, c binary"
FACTORS = "doc_id long, text_id int, starts binary, lengths binary, sources binary, source_texts binary, source_starts binary"


def _windows(words: Words, h: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(words at which a window starts, the anchors of those windows)."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = words.room()
    least = grams(h, anchor)
    least[room < anchor] = np.iinfo(np.uint64).max
    width, span = 1, size - anchor + 1
    while width < span:
        step = min(width, span - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    at = np.flatnonzero(room >= size)
    return at, least[at]


def _earliest(key, anchor, doc, text, start):
    """Windows by place -> (index of those that come again, index of their sources, index of repeated rows)."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    at = at[np.lexsort((start[at], text[at], doc[at], anchor[at], key[at]))]
    if not len(at):
        return at, at, at

    def turns(column, before):
        new = before.copy()
        new[1:] |= column[at[1:]] != column[at[:-1]]
        return new

    begin = np.zeros(len(at), bool)
    begin[0] = True
    group = turns(anchor, turns(key, begin))
    place = turns(text, turns(doc, group))
    first = np.flatnonzero(group)[np.cumsum(group) - 1]
    own = np.flatnonzero(place)[np.cumsum(place) - 1]
    again = ~turns(start, place)
    later = doc[at] > doc[at[first]]
    source = np.where(later, first, own)
    late = (later | (own != np.arange(len(at)))) & ~again
    return at[late], at[source[late]], at[again & ~later]


def _slots(slot: np.ndarray, columns: dict[str, np.ndarray], sizes: np.ndarray | None = None, values: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows packed into one row a slot; ``values`` are a list of ``sizes`` for each row."""
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
    bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    out: dict = {"slot": pa.array(slot[cuts[:-1]], pa.int32())}
    for name, column in columns.items():
        column = column[order]
        out[name] = pa.array([column[a:b].tobytes() for a, b in bounds], pa.binary())
    if values is not None:
        per = sizes[order]
        ends = np.cumsum(per)
        at = np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - per), per) + np.arange(int(ends[-1]) if len(ends) else 0)
        values, edges = values[at], np.concatenate([[0], ends])
        out["c"] = pa.array([values[edges[a] : edges[b]].tobytes() for a, b in bounds], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _found(doc, text, start, size, source, source_text, source_start, slots: int) -> pa.RecordBatch:
    columns = {"docs": doc.astype("<i8"), "texts": text.astype("<i4"), "starts": start.astype("<i4"), "sizes": size.astype("<i4"), "a": source.astype("<i8"), "b": source_text.astype("<i4"), "c": source_start.astype("<i4")}
    return _slots((mix(doc.astype(np.uint64)) % U(slots)).astype(np.int32), columns)


def _runs(doc, text, start, source, source_text, source_start):
    """Windows with sources -> runs of them that go on at the same source, with the size as the fourth column."""
    order = np.lexsort((start, text, doc))
    columns = [x[order] for x in (doc, text, start, source, source_text, source_start)]
    new = np.ones(len(order), bool)
    new[1:] = False
    for x, step in zip(columns, (0, 0, 1, 0, 0, 1), strict=True):
        new[1:] |= x[1:].astype(np.int64) != x[:-1].astype(np.int64) + step
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    doc, text, start, source, source_text, source_start = (x[at] for x in columns)
    return doc, text, start, size, source, source_text, source_start


def _index(size: int, anchor: int, slots: int, salt: int):
    """Windows for the owners of their anchors, and what is found inside a group of texts."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        key, under, doc, text, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(key):
            return
        late, source, again = _earliest(key, under, doc, text, start)
        if len(late):
            block = _found(*_runs(doc[late], text[late], start[late], doc[source], text[source], start[source]), slots)
            yield _told(block, True)
        kept = np.ones(len(key), bool)
        kept[late] = kept[again] = False
        key, under, doc, text, start = (x[kept] for x in (key, under, doc, text, start))
        new = np.ones(len(key), bool)
        new[1:] = (under[1:] != under[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(key)))
        columns = {"docs": doc[at].astype("<i8"), "texts": text[at].astype("<i4"), "starts": start[at].astype("<i4"), "sizes": sizes.astype("<i4"), "a": under[at].astype("<u8"), "b": np.zeros(len(at), "<i1")}
        yield _told(_slots((mix(under[at]) % U(slots)).astype(np.int32), columns, sizes, key.astype("<u8")), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, _, words in chunks(batch.column(1)):
                h = words.hashes(salt)
                at, under = _windows(words, h, size, anchor)
                doc = np.searchsorted(words.first, at, side="right") - 1
                parts.append((grams(h, size)[at], under, ids[a + doc], texts[a + doc], (at - words.first[doc]).astype(np.int32)))
                held += len(at)
                if held > GROUP_WINDOWS:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _told(block: pa.RecordBatch, local: bool) -> pa.RecordBatch:
    names = ["slot", "local", "docs", "texts", "starts", "sizes", "a", "b", "c"]
    columns = [pa.array([local] * len(block)) if name == "local" else block.column(name) for name in names]
    return pa.RecordBatch.from_arrays(columns, names)


def _unpack(rows: list, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows])


def _owners(slots: int):
    """All windows of this task's anchors: the later ones with their sources, by slot of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            local = batch.column(1)
            told = batch.filter(local).drop_columns("local")
            if len(told):
                yield told
            rows += batch.filter(pa.compute.invert(local)).to_pylist()
        if not rows:
            return
        sizes = _unpack(rows, "sizes", "<i4")
        key = _unpack(rows, "c", "<u8")
        each = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        anchor, doc, text, start = (_unpack(rows, n, k) for n, k in (("a", "<u8"), ("docs", "<i8"), ("texts", "<i4"), ("starts", "<i4")))
        del rows
        start = start[each] + step.astype(np.int32)
        anchor, doc, text = anchor[each], doc[each], text[each]
        late, source, _ = _earliest(key, anchor, doc, text, start)
        if len(late):
            yield _found(*_runs(doc[late], text[late], start[late], doc[source], text[source], start[source]), slots)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return run


def _parse(size: int):
    """The greedy parse of this task's documents: factors of each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        doc, text, start, n, source, source_text, source_start = (
            _unpack(rows, name, kind)
            for name, kind in (("docs", "<i8"), ("texts", "<i4"), ("starts", "<i4"), ("sizes", "<i4"), ("a", "<i8"), ("b", "<i4"), ("c", "<i4"))
        )
        order = np.lexsort((source_start, source, start, text, doc))
        doc, text, start, n, source, source_text, source_start = (x[order] for x in (doc, text, start.astype(np.int64), n.astype(np.int64), source, source_text, source_start.astype(np.int64)))
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
        line = (np.cumsum(other) << 33) + start
        # Rows of one document read twice find the same windows twice.
        done = np.maximum.accumulate(line + n)
        skip = np.maximum(np.concatenate([[0], done[:-1]]) - line, 0)
        start, source_start, n, line = start + skip, source_start + skip, n - skip, line + skip
        left = n > 0
        doc, text, start, n, source, source_text, source_start, line = (x[left] for x in (doc, text, start, n, source, source_text, source_start, line))
        new = np.ones(len(doc), bool)
        goes_on = (line[1:] == (line + n)[:-1]) & (source[1:] == source[:-1]) & (source_text[1:] == source_text[:-1]) & (source_start[1:] == (source_start + n)[:-1])
        new[1:] = ~goes_on
        at = np.flatnonzero(new)
        length = np.add.reduceat(n, at) + size - 1
        doc, text, start, source, source_text, source_start = (x[at] for x in (doc, text, start, source, source_text, source_start))
        yield _by_text(doc, text, {"starts": (start, "<i4"), "lengths": (length, "<i4"), "sources": (source, "<i8"), "source_texts": (source_text, "<i4"), "source_starts": (source_start, "<i4")})

    return run


def _by_text(doc, text, columns: dict) -> pa.RecordBatch:
    """One row for each run of rows of one (doc, text); columns packed."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    cuts = np.flatnonzero(new)
    out: dict = {"doc_id": pa.array(doc[cuts], pa.int64()), "text_id": pa.array(text[cuts], pa.int32())}
    ends = [*cuts[1:].tolist(), len(doc)]
    for name, (column, kind) in columns.items():
        column = column.astype(kind)
        out[name] = pa.array([column[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _distinct(doc, text, start, length) -> pa.RecordBatch:
    order = np.lexsort((length, start, text, doc))
    columns = [x[order] for x in (doc, text, start, length)]
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    doc, text, start, length = (x[new] for x in columns)
    return _by_text(doc, text, {"asked_starts": (start, "<i4"), "asked_lengths": (length, "<i4")})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors by document -> the distinct places that are their sources, by source."""
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            yield _distinct(*(_unpack(rows, n, k) for n, k in (("sources", "<i8"), ("source_texts", "<i4"), ("source_starts", "<i4"), ("lengths", "<i4"))))


def _asked_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        sizes = [len(r["asked_starts"]) // 4 for r in rows]
        doc, text = (np.repeat(np.array([r[n] for r in rows], k), sizes) for n, k in (("doc_id", np.int64), ("text_id", np.int32)))
        yield _distinct(doc, text, _unpack(rows, "asked_starts", "<i4"), _unpack(rows, "asked_lengths", "<i4"))


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie under the factors."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges)[:-1] > 0


CUT = (
    "doc_id long, text_id int, n_removed long, kept_sha256 string, spans array<array<int>>, "
    "starts binary, lengths binary, sources binary, source_texts binary, source_starts binary, shas binary, "
    "asked_starts binary, asked_lengths binary, asked_shas binary"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: what is left, the words' SHA-256 of its factors and of places that others name as source."""

    def numbers(cell) -> np.ndarray:
        return np.frombuffer(cell.as_py() or b"", "<i4").astype(np.int64)

    for batch in batches:
        for a, b, words in chunks(batch.column(2)):
            text = words.data.tobytes()
            removed, kept, spans, own, asked = [], [], [], [], []
            for i in range(a, b):
                x, y = int(words.first[i - a]), int(words.first[i - a + 1])
                begin, end = words.starts[x:y].tolist(), words.ends[x:y].tolist()

                def body(some) -> bytes:
                    return b" ".join([text[begin[k] : end[k]] for k in some])

                def shas(starts, lengths) -> bytes:
                    # a source of another text of the same id may be too short: no words then
                    return b"".join([hashlib.sha256(body(range(s, min(s + n, len(begin))))).digest() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])

                starts, lengths = numbers(batch.column(3)[i]), numbers(batch.column(4)[i])
                gone = _cover(starts, lengths, y - x)
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(body(np.flatnonzero(~gone).tolist())).hexdigest())
                spans.append(np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist())
                own.append(shas(starts, lengths))
                asked.append(shas(numbers(batch.column(8)[i]), numbers(batch.column(9)[i])))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    *(part.column(k) for k in range(3, 8)), pa.array(own, pa.binary()), part.column(8), part.column(9), pa.array(asked, pa.binary()),
                ],
                ["doc_id", "text_id", "n_removed", "kept_sha256", "spans", "starts", "lengths", "sources", "source_texts", "source_starts", "shas", "asked_starts", "asked_lengths", "asked_shas"],
            )


PLACES = "doc_id long, text_id int, start int, length int, sha binary"


def _places(asked: bool):
    """(document, text, first word, length, SHA-256) of named sources: as their factors read, or as asked from the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            if asked:
                sizes = [len(r["starts"]) // 4 for r in rows]
                doc, text = (np.repeat(np.array([r[n] for r in rows], k), sizes) for n, k in (("doc_id", np.int64), ("text_id", np.int32)))
            else:
                doc, text = _unpack(rows, "sources", "<i8"), _unpack(rows, "source_texts", "<i4")
            raw = b"".join(r["shas"] for r in rows)
            shas = pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), pa.array(_unpack(rows, "starts", "<i4")), pa.array(_unpack(rows, "lengths", "<i4")), shas], ["doc_id", "text_id", "start", "length", "sha"])

    return run


def _factor_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
    for batch in batches:
        lists = []
        for r in batch.to_pylist():
            columns = [np.frombuffer(r[n] or b"", k).tolist() for n, k in (("starts", "<i4"), ("lengths", "<i4"), ("sources", "<i8"), ("source_starts", "<i4"))]
            lists.append([dict(zip(("start", "length", "source", "source_start"), f, strict=True)) for f in zip(*columns, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(lists, kind)], [*batch.schema.names[:5], "factors"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in chunks(batch.column(1)):
            part = batch.slice(a, b - a)
            shas = [hashlib.sha256(b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(words.first), pa.int64()), pa.array(shas)], ["doc_id", "text_id", "n_words", "whole_sha256"])


def _cuts(known: DataFrame, slots: int, size: int, anchor: int, salt: int) -> DataFrame | None:
    """CUT rows of all documents that hold or are a source; None if hashes clashed."""
    blocks = known.mapInArrow(trimmed(_index(size, anchor, slots, salt)), BLOCKS)
    found = blocks.repartitionById(slots, "slot").mapInArrow(trimmed(_owners(slots)), FOUND)
    factors = materialise(found.repartitionById(slots, "slot").mapInArrow(trimmed(_parse(size)), FACTORS), "rlz-factors")
    schema = "doc_id long, text_id int, asked_starts binary, asked_lengths binary"
    asked = factors.mapInArrow(_asked, schema).repartition("doc_id", "text_id").mapInArrow(_asked_together, schema)
    needs = materialise(factors.join(asked, ["doc_id", "text_id"], "full"), "rlz-needs")
    involved = materialise(needs.select("doc_id").distinct(), "rlz-involved")
    columns = ["doc_id", "text_id", "text", "starts", "lengths", "sources", "source_texts", "source_starts", "asked_starts", "asked_lengths"]
    texts = semi_by_id(known, involved, "doc_id").join(needs, ["doc_id", "text_id"]).select(*columns)
    cut = materialise(texts.mapInArrow(trimmed(_cut), CUT).dropDuplicates(["doc_id", "text_id"]), "rlz-cut")
    told = cut.filter("length(starts) > 0").select("sources", "source_texts", F.col("source_starts").alias("starts"), "lengths", "shas").mapInArrow(_places(False), PLACES)
    there = cut.filter("length(asked_starts) > 0").select("doc_id", "text_id", F.col("asked_starts").alias("starts"), F.col("asked_lengths").alias("lengths"), F.col("asked_shas").alias("shas")).mapInArrow(_places(True), PLACES)
    wrong = told.distinct().join(there, ["doc_id", "text_id", "start", "length", "sha"], "left_anti")
    return None if wrong.head(1) else cut


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (bounds of removed runs, in words) and factors (start,
    length, source, source_start, in words): a row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    salt, cut = 0, None
    while cut is None:
        named = rows.withColumn("text_id", F.shiftrightunsigned(F.xxhash64(F.lit(salt), "text"), 33).cast("int"))
        cut = _cuts(named.filter("doc_id is not null"), slots, min_words, anchor_words, salt)
        salt += 1
    whole = named.mapInArrow(trimmed(_whole), "doc_id long, text_id int, n_words long, whole_sha256 string")
    less = cut.filter("n_removed > 0").select("doc_id", "text_id", "n_removed", "kept_sha256", "spans", "starts", "lengths", "sources", "source_starts")
    listed = "doc_id long, text_id int, n_removed long, kept_sha256 string, spans array<array<int>>, factors array<struct<start: int, length: int, source: long, source_start: int>>"
    less = less.mapInArrow(_factor_list, listed)
    return whole.join(less, ["doc_id", "text_id"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
        F.coalesce("factors", F.array().cast("array<struct<start: int, length: int, source: long, source_start: int>>")).alias("factors"),
    )
