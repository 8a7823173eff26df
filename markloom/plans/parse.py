"""Pages to the node table: one kernel pass per page inside mapInArrow.

``columns`` and ``types`` are pushed into the kernel by hand, since Catalyst does not prune
through mapInArrow: what is not asked for is not worked out. A page on which the kernel
fails stops the query with its page_id; with ``errors="mark"`` it becomes one row of type
``error`` instead, and ``bad_records`` lists such pages with their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.config import DEFAULT, SiteConfig
from markloom.kernel.blocks import ROWS, Blocks
from markloom.kernel.blocks import column_of as _column
from markloom.schema import BAD, NODES, SIBLINGS

#: Pages of a batch that are told before the others.
FIRST = 200
#: Inputs of up to this many bytes a core, by the optimizer's estimate, are dealt out over all cores before the kernel.
SMALL_BYTES = 32 << 20


class PageError(RuntimeError):
    """The kernel failed on a page."""


def cleaned(text: Column) -> Column:
    """The text that offsets refer to."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00\x7F]|\r(?=\n|\z)", "")


def spread(df: DataFrame) -> DataFrame:
    """A small batch input over all cores; large ones keep the partitions of their files, so nothing big is shuffled.

    Kernels need about a millisecond of Python for 3 kB of text, so a file of a few megabytes in
    one task would leave the other cores idle.
    """
    if df.isStreaming or not hasattr(df, "_jdf"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SMALL_BYTES else df


class _Rows:
    """Node rows of pages until they make a batch. Lists that pages share are turned to Arrow once a batch and taken from there."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.ids: list = []
        self.counts: list[int] = []
        self.total = 0
        self.lists: list[list] = [[] for _ in columns[1:]]
        self.starts: list[list[int]] = [[] for _ in columns[1:]]
        self.seen: list[dict[int, tuple]] = [{} for _ in columns[1:]]
        self.to = list(zip(self.lists, [x.append for x in self.starts], self.seen, strict=True))

    def add(self, page_id: int | None, count: int, found: list) -> None:
        self.ids.append(page_id)
        self.counts.append(count)
        self.total += count
        for values, (held, start, seen) in zip(found, self.to):  # noqa: B905
            at = id(values)
            if at not in seen:
                seen[at] = len(held), values  # the list is held, so that its id stays its own
                held += values
            start(seen[at][0])

    def batch(self) -> pa.RecordBatch:
        import numpy as np

        counts = np.array(self.counts)
        within = np.arange(self.total) - np.repeat(np.cumsum(counts) - counts, counts)
        out = [_column("page_id", self.ids).take(pa.array(np.repeat(np.arange(len(counts)), counts)))]
        for name, held, starts in zip(self.columns[1:], self.lists, self.starts, strict=True):
            made = _column(name, held)
            out.append(made if len(held) == self.total else made.take(pa.array(np.repeat(np.array(starts), counts) + within)))
        return pa.RecordBatch.from_arrays(out, self.columns)


def _kernel(config: SiteConfig, columns: list[str], types: frozenset[str] | None, last: str, errors: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from markloom.kernel import shapes
        from markloom.kernel.parse import FIELDS, clean

        tables = shapes.tables(config, columns, types, last)
        blocks = tables.blocks = tables.blocks or Blocks(tables)
        rows = _Rows(columns)
        for batch in batches:
            parts = [batch.slice(0, FIRST), batch.slice(FIRST)]  # few pages at first, as the first page of a cut is told by itself
            while parts:
                part = parts.pop(0)
                made, rest = blocks.of(part.column(0), part.column(2)) if not tables.placed else ([], range(part.num_rows))
                yield from made
                if made and len(rest) > FIRST:  # what these pages are cut to may serve the others
                    parts.insert(0, part.take(pa.array(rest[FIRST:], pa.int32())))
                    rest = rest[:FIRST]
                for page_id, title, body, include in zip(*(part.column(k).take(pa.array(rest, pa.int32())).to_pylist() for k in range(4)), strict=True):
                    text = clean(body)
                    try:
                        count, found = tables.of(text, bool(include), title or "")
                    except Exception as e:
                        if errors == "raise":
                            raise PageError(f"page_id {page_id}: {type(e).__name__}: {e}") from e
                        row = dict(zip(FIELDS, [0, None, 0, 0, 0, 0, "error", type(e).__name__, 0, len(text), 0, len(text), str(e), {}, {}, "", (), 0, 0, 0, 0], strict=True))
                        count, found = 1, [[row.get(c)] for c in tables.columns]
                    rows.add(page_id, count, found)
                    if rows.total >= ROWS:
                        yield rows.batch()
                        rows = _Rows(columns)
        if rows.total:
            yield rows.batch()

    return run


def _input(pages: DataFrame) -> DataFrame:
    have = pages.columns
    title = F.col("title") if "title" in have else F.lit("")
    ns = F.col("ns") if "ns" in have else F.lit(0)
    told = F.coalesce(F.col("include"), F.lit(False)) if "include" in have else F.coalesce(title.endswith("/doc"), F.lit(False))
    include = told | (F.coalesce(ns, F.lit(0)) == 10)
    return spread(pages.select("page_id", title.alias("title"), "text", include.cast("boolean").alias("include")))


def parse(
    pages: DataFrame, config: SiteConfig = DEFAULT, columns: list[str] | None = None, types: list[str] | None = None, last: str = "convert", errors: str = "raise"
) -> DataFrame:
    """pages(page_id, text[, title, ns, include]) -> nodes. Works on batch and streaming frames."""
    columns = ["page_id", *[c for c in (columns or NODES.fieldNames()) if c != "page_id"]]
    schema = T.StructType([NODES[c] if c in NODES.fieldNames() else SIBLINGS[c] for c in columns])
    keep = frozenset(types) if types else None
    return _input(pages).mapInArrow(_kernel(config, columns, keep, last, errors), schema)


def bad_records(pages: DataFrame, config: SiteConfig = DEFAULT) -> DataFrame:
    """Pages on which the kernel fails, with the reason; run it again after a fix to replay them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from markloom.kernel.parse import clean, table
        from markloom.kernel.parse import parse as tree

        for batch in batches:
            for page in batch.to_pylist():
                text = clean(page["text"])
                try:
                    table(tree(text, config, bool(page["include"])), text, config=config)
                except Exception as e:  # noqa: BLE001
                    yield pa.RecordBatch.from_pylist(
                        [{"page_id": page["page_id"], "title": page["title"], "error": f"{type(e).__name__}: {e}", "text": page["text"]}],
                        pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("error", pa.string()), ("text", pa.string())]),
                    )

    return _input(pages).mapInArrow(run, BAD)


def wikitext(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """The source of every node: a slice of its page by offsets."""
    text = pages.select("page_id", cleaned(F.col("text")).alias("_page"))
    return nodes.join(text, "page_id").withColumn("source", F.substring("_page", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_page")
