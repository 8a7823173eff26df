"""Node rows of whole batches of pages, as Arrow columns, for pages that share a cut.

Such pages have the same rows but for values that are slices of them. So a batch is told by
arrays: the texts of a batch are one run of bytes, a cut knows where each of its values starts
in a page and how long it is, and all slices of a column are gathered at once. No page, row or
value of them is a Python object. Cuts know ASCII texts only, so a character is a byte.
"""

from __future__ import annotations

from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

from markloom.kernel.shapes import SIGNS, Cut, Tables

#: Rows of a batch.
ROWS = 20_000

#: What a value is cut from: the page, the page in lower case, or the values that cuts share.
PAGE, LOWER, SHARED = 0, 1, 2
CELLS = frozenset("name data text".split())
FEW = frozenset("type previous_type anc".split())
STRINGS = CELLS | {"type", "previous_type"}
MAPS = frozenset("attrs props".split())
#: Bytes of shared values that are kept; then all is gathered anew.
POOL = 8 << 20


def _lists(values: list, of) -> tuple[pa.Array, list]:
    """(offsets, all items) of a column of sized values."""
    offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
    return offsets, list(chain.from_iterable(map(of, values)))


def column_of(name: str, values: list) -> pa.Array:
    if name in ("attrs", "props"):
        offsets, items = _lists(values, dict.items)
        keys, cells = zip(*items, strict=True) if items else ((), ())
        return pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(cells, pa.string()))
    if name == "anc":
        offsets, items = _lists(values, iter)
        ids, types = zip(*items, strict=True) if items else ((), ())
        pairs = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(types, pa.string())], ["id", "type"])
        return pa.ListArray.from_arrays(offsets, pairs)
    kind = pa.int64() if name == "page_id" else pa.string() if name in STRINGS else pa.int32()
    return pa.array(values, kind)


class _Grown:
    """An array that grows by pieces; pieces are joined when it is read."""

    def __init__(self, kind: type):
        self.made, self.new = np.zeros(0, kind), []
        self.kind = kind

    def add(self, values: list) -> None:
        self.new.append(np.array(values, self.kind))

    def all(self) -> np.ndarray:
        if self.new:
            self.made, self.new = np.concatenate([self.made, *self.new]), []
        return self.made


class _Cells:
    """Texts of cuts: where each starts in what it is cut from, and its length; -1 for null."""

    def __init__(self, pool: _Pool):
        self.pool, self.start, self.length, self.source = pool, _Grown(np.int64), _Grown(np.int32), _Grown(np.int8)

    def add(self, cells: list) -> None:
        """Values that are shared, or (source, start, end)."""
        told = [(SHARED, *self.pool.at(c)) if not isinstance(c, tuple) else (c[0], c[1], c[2] - c[1]) for c in cells]
        for to, values in zip((self.source, self.start, self.length), zip(*told, strict=True) if told else ((), (), ()), strict=True):
            to.add(list(values))

    def gather(self, rows: np.ndarray, pages: np.ndarray, bases: np.ndarray, data: np.ndarray) -> pa.Array:
        """The texts of these rows; pages: where the page of each starts; bases: where each source starts in the data."""
        length, source = self.length.all()[rows], self.source.all()[rows]
        start = self.start.all()[rows] + bases[source]
        start += np.where(source == SHARED, 0, pages)
        null = length < 0
        full = np.maximum(length, 0)
        ends = np.cumsum(full, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        taken = data[np.repeat(start - ends + full, full) + np.arange(total)]
        offsets = np.zeros(len(rows) + 1, np.int32)
        offsets[1:] = ends
        valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
        return pa.Array.from_buffers(pa.string(), len(rows), [valid, pa.py_buffer(offsets), pa.py_buffer(taken)])


class _Pool:
    """Shared texts as one run of bytes."""

    def __init__(self) -> None:
        self.bytes, self.places = bytearray(), {}

    def at(self, value: str | None) -> tuple[int, int]:
        if value is None:
            return 0, -1
        if value not in self.places:
            made = value.encode()
            self.places[value] = len(self.bytes), len(made)
            self.bytes += made
        return self.places[value]


class _Ints:
    def __init__(self) -> None:
        self.values, self.null = _Grown(np.int32), _Grown(np.bool_)

    def add(self, values: list) -> None:
        self.values.add([0 if v is None else v for v in values])
        self.null.add([v is None for v in values])

    def gather(self, rows: np.ndarray) -> pa.Array:
        null = self.null.all()[rows]
        return pa.array(self.values.all()[rows], pa.int32(), mask=null if null.any() else None)


class _Few:
    """Values of which there are few, by their numbers."""

    def __init__(self, name: str):
        self.name, self.numbers, self.seen, self.values, self.arrow = name, _Grown(np.int32), {}, [], None

    def add(self, values: list) -> None:
        for v in values:
            if v not in self.seen:
                self.seen[v], self.arrow = len(self.values), None
                self.values.append(v)
        self.numbers.add([self.seen[v] for v in values])

    def gather(self, rows: np.ndarray) -> pa.Array:
        if self.arrow is None:
            self.arrow = column_of(self.name, self.values)
        return self.arrow.take(pa.array(self.numbers.all()[rows]))


class _Maps:
    def __init__(self, pool: _Pool):
        self.sizes, self.starts, self.keys, self.cells, self.total = _Grown(np.int32), _Grown(np.int64), _Cells(pool), _Cells(pool), 0

    def add(self, maps: list[list[tuple]]) -> None:
        sizes = [len(m) for m in maps]
        at, starts = self.total, []
        for n in sizes:
            starts.append(at)
            at += n
        self.total = at
        self.sizes.add(sizes)
        self.starts.add(starts)
        self.keys.add([k for m in maps for k, _ in m])
        self.cells.add([v for m in maps for _, v in m])

    def gather(self, rows: np.ndarray, pages: np.ndarray, bases: np.ndarray, data: np.ndarray) -> pa.Array:
        sizes = self.sizes.all()[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        inner = np.repeat(self.starts.all()[rows] - ends + sizes, sizes) + np.arange(total)
        owners = np.repeat(pages, sizes)
        offsets = np.zeros(len(rows) + 1, np.int32)
        offsets[1:] = ends
        return pa.MapArray.from_arrays(pa.array(offsets), self.keys.gather(inner, owners, bases, data), self.cells.gather(inner, owners, bases, data))


def _cells(name: str, values: list, spans: list) -> list:
    cells = list(values)
    for k, a, b in spans:
        cells[k] = (LOWER if name == "name" else PAGE, a, b)
    return cells


def _maps(name: str, values: list, spans: list) -> list[list[tuple]] | None:
    """Pairs of every row; None if attributes of one node might share a name."""
    made = [list(v.items()) for v in values]
    for k, *found in spans:
        if name == "props":
            pairs = values[k] | {"value": (PAGE, *found)}
            made[k] = list(pairs.items())
            continue
        lengths = [b - a for a, b, _, _ in found[0]]
        if len(set(lengths)) < len(lengths):
            return None
        made[k] = [((LOWER, a, b), (PAGE, c, d)) for a, b, c, d in found[0]]
    return made


class Blocks:
    """The cuts of a worker's tables, as arrays."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.known = [w.encode() for w in tables.words]
        self.tails = np.array(sorted({t.encode()[0] * 256 + t.encode()[1] for t in tables.tails if len(t) == 2 and t.isascii()}), np.int32)
        self.short = any(len(t) != 2 or not t.isascii() for t in tables.tails)
        self._start()

    def _start(self) -> None:
        pool = self.pool = _Pool()
        self.at: dict[int, tuple[int, Cut]] = {}  # a cut is held, so that its id stays its own
        self.firsts: list[int] = []
        self.counts: list[int] = []
        self.total = 0
        self.columns = [_Cells(pool) if c in CELLS else _Maps(pool) if c in MAPS else _Few(c) if c in FEW else _Ints() for c in self.tables.columns]

    def number(self, cut: Cut) -> int | None:
        """Of a cut; None if its pages are to be told one by one."""
        found = self.at.get(id(cut))
        if found is None:
            made, number = [], len(self.firsts)
            for name, values, spans in cut.columns:
                made.append(_maps(name, values, spans) if name in MAPS else _cells(name, values, spans) if name in CELLS else values)
                if made[-1] is None:
                    number = None
            if number is not None:
                for column, values in zip(self.columns, made, strict=True):
                    column.add(values)
                self.firsts.append(self.total)
                self.counts.append(cut.count)
                self.total += cut.count
            found = self.at[id(cut)] = number, cut
        return found[0]

    def _odd(self, low: bytes, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Of each page whether words that the parser knows may be in it."""
        odd, places = np.zeros(len(offsets) - 1, np.bool_), []
        for word in self.known:
            at = low.find(word)
            while at >= 0:
                places.append(at)
                at = low.find(word, at + 1)
        marks = np.flatnonzero(data[: len(low)] == ord(":"))
        if self.short:
            places += marks.tolist()
        elif len(marks):
            lows = data[len(low) : 2 * len(low)].astype(np.int32)
            marks = marks[marks >= 2]
            places += marks[np.isin(lows[marks - 2] * 256 + lows[marks - 1], self.tails)].tolist()
        if places:
            odd[np.clip(np.searchsorted(offsets, places, "right") - 1, 0, len(odd) - 1)] = True
        return odd

    def of(self, ids: pa.Array, texts: pa.StringArray) -> tuple[list[pa.RecordBatch], list[int]]:
        """(batches of the pages that have a cut, places of the others)."""
        if len(self.pool.bytes) > POOL or len(self.at) > 4 * max(len(self.tables.cuts), 2_048):
            self._start()
        if texts.null_count:
            texts = texts.fill_null("")
        _, at, run = texts.buffers()
        offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, end = int(offsets[0]), int(offsets[-1])
        raw = run.slice(first, end - first).to_pybytes() if run is not None else b""
        offsets = offsets - first
        low, signs = raw.lower(), raw.translate(SIGNS)
        data = np.frombuffer(raw + low, np.uint8)
        odd = self._odd(low, offsets, data)
        cuts, at = self.tables.cuts, offsets.tolist()
        pages, numbers, rest = [], [], []
        for k, (a, b, strange) in enumerate(zip(at, at[1:], odd.tolist())):  # noqa: B905
            cut = None if strange else cuts.get(signs[a:b])
            number = None if cut is None else self.number(cut)
            if number is None:
                rest.append(k)
            else:
                pages.append(k)
                numbers.append(number)
        return self._batches(ids, pages, numbers, offsets, data, len(raw)), rest

    def _batches(self, ids: pa.Array, pages: list[int], numbers: list[int], offsets: np.ndarray, data: np.ndarray, size: int) -> list[pa.RecordBatch]:
        if not pages:
            return []
        data = np.concatenate([data, np.frombuffer(bytes(self.pool.bytes), np.uint8)])
        bases = np.array([0, size, 2 * size], np.int64)
        told, chosen = np.array(pages), np.array(numbers)
        counts, firsts = np.array(self.counts)[chosen], np.array(self.firsts)[chosen]
        upto = np.cumsum(counts)
        out, a = [], 0
        while a < len(told):
            before = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + 4 * ROWS, "right")))
            n = counts[a:b]
            ends = np.cumsum(n)
            rows = np.repeat(firsts[a:b] - ends + n, n) + np.arange(int(ends[-1]))
            owners = np.repeat(told[a:b], n)
            starts = offsets[owners].astype(np.int64)
            made = [ids.take(pa.array(owners))]
            for column in self.columns:
                made.append(column.gather(rows, starts, bases, data) if isinstance(column, (_Cells, _Maps)) else column.gather(rows))
            out.append(pa.RecordBatch.from_arrays(made, ["page_id", *self.tables.columns]))
            a = b
        return out
