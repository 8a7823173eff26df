"""Derived tables of the node table: arguments, links, sections, tables, references, tags, positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig


def prop(name: str) -> Column:
    return F.expr(f"try_element_at(props, '{name}')")


def attr(name: str) -> Column:
    return F.expr(f"try_element_at(attrs, '{name}')")


def among(column: str, words) -> Column:
    """``column in (...)`` for many plain words, as one piece of SQL."""
    return F.expr(f"{column} in ({', '.join(f"'{w}'" for w in words)})")


def has_ancestor(*types: str, barrier: str | None = None) -> Column:
    """Is there an ancestor of these types; with a barrier, not above the nearest one of that type."""
    listed = ", ".join(f"'{t}'" for t in types)
    if barrier is None:
        return F.expr(f"exists(anc, a -> a.type in ({listed}))")
    return F.expr(f"aggregate(anc, false, (acc, a) -> case when a.type = '{barrier}' then false when a.type in ({listed}) then true else acc end)")


def arguments(nodes: DataFrame) -> DataFrame:
    """A row for each argument of each template or magic word, duplicates included."""
    owner = F.element_at("anc", -1)
    return nodes.filter((F.col("type") == "parameter") & owner["type"].isin("template", "magic-word")).select(
        "page_id", F.col("parent_id").alias("call_id"), "node_id", F.col("name").alias("key"), (prop("anon") == "true").alias("anon"), prop("pos").cast("int").alias("pos"), prop("value").alias("value"), "start", "end",
    )


def calls(nodes: DataFrame) -> DataFrame:
    """Templates and magic words with their effective arguments (the last of equal keys)."""
    return nodes.filter(F.col("type").isin("template", "magic-word")).select("page_id", "node_id", "type", "name", F.col("attrs").alias("args"), "start", "end")


def effective_arguments(args: DataFrame) -> DataFrame:
    return args.groupBy("page_id", "call_id", "key").agg(F.max_by("value", "start").alias("value"), F.count(F.lit(1)).alias("n"))


def duplicate_arguments(args: DataFrame) -> DataFrame:
    return args.groupBy("page_id", "call_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def links(nodes: DataFrame) -> DataFrame:
    """Every link of a page: internal, file, category, redirect, external."""
    return nodes.filter(F.col("type").isin("link", "file", "category", "redirect-target", "gallery-image", "ext-link", "free-ext-link", "magic-link")).select(
        "page_id", "node_id", F.col("type").alias("kind"), F.coalesce(prop("target"), prop("url"), F.col("name")).alias("target"), prop("fragment").alias("fragment"), prop("sortkey").alias("sort_key"), "start", "end",
    )


def link_degree(found: DataFrame) -> DataFrame:
    """In-degree of link targets over the corpus, partially aggregated before the shuffle."""
    return found.filter(F.col("kind") == "link").groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.approx_count_distinct("page_id").alias("n_pages"))


def resolve_redirects(found: DataFrame, redirects: DataFrame, small: bool = False, variants: dict[str, str] | None = None) -> DataFrame:
    """``target`` through one redirect; titles of the map are normalised as those of links are.

    ``variants``: pairs that turn a title into its other form, tried where the title itself is no
    redirect. ``small``: the caller has checked that the map can be broadcast.
    """
    from markloom.functions import titles

    r = redirects.select(titles.normalise(F.col("from_title"))["title"].alias("_from"), titles.normalise(F.col("to_title"))["title"].alias("_to"))
    r = r.groupBy("_from").agg(F.min("_to").alias("_to"))
    r = F.broadcast(r) if small else r
    met = found.join(r, F.col("target") == F.col("_from"), "left").drop("_from").withColumnRenamed("_to", "resolved")
    if variants:
        other = met.withColumn("_other", F.when(F.col("resolved").isNull(), titles.convert(F.col("target"), variants)))
        met = other.join(r, F.col("_other") == F.col("_from"), "left").withColumn("resolved", F.coalesce("resolved", "_to")).drop("_from", "_to", "_other")
    return met.withColumn("resolved", F.coalesce("resolved", "target"))


def sections(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Heading sections; a section ends where a heading of its level or above begins, the last ones with the page.

    ``nodes`` has the ``heading`` rows, with props, and the ``root`` rows, which tell the lengths of
    the pages; without those, ``pages`` gives the lengths.
    """
    heads = nodes.filter(F.col("type").isin("heading", "root")).select(
        "page_id", "node_id", prop("level").cast("int").alias("level"), prop("title").alias("heading"), "start", "end", F.lit(None).cast("int").alias("size")
    )
    if pages is not None:
        from markloom.plans.parse import cleaned

        none = F.lit(None)
        sizes = pages.select("page_id", F.lit(-1).alias("node_id"), none.cast("int").alias("level"), none.cast("string").alias("heading"), F.lit(0).alias("start"), F.length(cleaned(F.col("text"))).alias("end"), F.length(cleaned(F.col("text"))).alias("size"))
        heads = heads.filter("level is not null").unionByName(sizes)
    size = F.max(F.when(F.col("level").isNull(), F.col("end"))).over(Window.partitionBy("page_id"))
    here = heads.withColumn("size", size)
    after = Window.partitionBy("page_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stop, above, name = None, None, None
    for k in range(1, 7):
        nxt = F.min(F.when(F.col("level") <= k, F.col("start"))).over(after)
        up = F.max(F.when(F.col("level") < k, F.struct("node_id", "heading"))).over(before)
        stop = F.when(F.col("level") == k, nxt) if stop is None else stop.when(F.col("level") == k, nxt)
        above = F.when(F.col("level") == k, up) if above is None else above.when(F.col("level") == k, up)
    number = F.count("level").over(Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    body = here.select("page_id", "node_id", number.cast("int").alias("section_no"), "level", "heading", "start", F.coalesce(stop, "size").alias("end"), above.alias("_up"))
    return body.filter("level is not null").select("page_id", "node_id", "section_no", "level", "heading", "start", "end", F.col("_up.node_id").alias("parent_section"), F.col("_up.heading").alias("parent_heading"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page in, its headings in order; one row a heading out, with its anchor."""
    for batch in batches:
        ids, nodes, found = [], [], []
        for page_id, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            used: set[str] = set()
            for h in heads:
                base = re.sub(r"[ \t_]+", "_", h["heading"] or "")
                name, k = base, 1
                while name.lower() in used:
                    k += 1
                    name = f"{base}_{k}"
                used.add(name.lower())
                ids.append(page_id)
                nodes.append(h["node_id"])
                found.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int32()), pa.array(found, pa.string())], ["page_id", "node_id", "anchor"])


def anchors(found: DataFrame) -> DataFrame:
    """Section anchors: page_id, node_id, anchor, made unique by _2, _3, ... (case-insensitively).

    Which number is free depends on all names before it, so a page's headings are named in order.
    """
    heads = F.transform(F.array_sort(F.collect_list(F.struct("start", "node_id", "heading"))), lambda h: F.struct(h["node_id"].alias("node_id"), h["heading"].alias("heading")))
    return found.groupBy("page_id").agg(heads.alias("heads")).mapInArrow(_anchor_rows, "page_id long, node_id int, anchor string")


def contents(found: DataFrame) -> DataFrame:
    """Numbers of a table of contents, 1, 1.1, 1.2, ...: the place among siblings, below the parent's number.

    A page's headings are folded in order over a stack of the open ones, which has at most six and
    a bottom: (level, children so far, number).
    """
    entry = "struct<level: int, children: int, number: string>"
    line = F.struct(F.col("start"), F.col("node_id"), F.col("level"), F.col("heading"))
    start = F.struct(F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("children"), F.lit("").alias("number"))).cast(f"array<{entry}>").alias("open"), F.array().cast("array<string>").alias("numbers"))

    def step(state: Column, h: Column) -> Column:
        left = F.filter(state["open"], lambda e: e["level"] < h["level"])
        parent = F.element_at(left, -1)
        place = parent["children"] + 1
        number = F.concat(F.when(parent["number"] == "", F.lit("")).otherwise(F.concat(parent["number"], F.lit("."))), place.cast("string"))
        counted = F.struct(parent["level"].alias("level"), place.alias("children"), parent["number"].alias("number"))
        mine = F.struct(h["level"].alias("level"), F.lit(0).alias("children"), number.alias("number"))
        return F.struct(F.concat(F.slice(left, 1, F.size(left) - 1), F.array(counted, mine)).cast(f"array<{entry}>").alias("open"), F.concat(state["numbers"], F.array(number)).alias("numbers"))

    pages = found.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("heads"))
    told = pages.select("page_id", F.arrays_zip("heads", F.aggregate("heads", start, step, lambda s: s["numbers"]).alias("number")).alias("z"))
    return told.select("page_id", F.explode("z").alias("z")).select("page_id", F.col("z.heads.node_id").alias("node_id"), F.col("z.heads.heading").alias("heading"), F.col("z.heads.start").alias("start"), F.col("z.number").alias("number"))


def tables_as_rows(nodes: DataFrame) -> DataFrame:
    """The starting point of table edits: page_id, table_id, table_attrs, caption, row, row_attrs, cells in order.

    A cell is (subtype, attrs, value): its attributes as written, spans among them, and its text.
    ``nodes`` has the types td, td-inner and table-attrs.
    """
    kind = F.col("type")
    up = lambda k: F.try_element_at(F.col("anc"), F.lit(-k))
    # Every row tells its table, its line (-1: cells before the first line, -2: the table itself) and its cell, if it is part of one.
    in_cell = (kind == "td-inner") | (up(1)["type"] == "td")
    k = F.when(kind == "td", F.lit(1)).when(in_cell, F.lit(2)).otherwise(F.lit(1))
    near, above = F.when(k == 1, up(1)).otherwise(up(2)), F.when(k == 1, up(2)).otherwise(up(3))
    cell = F.when(kind == "td", F.col("node_id")).when(in_cell, F.col("parent_id"))
    alone = near["type"] == "table"
    line = F.when(~alone, near["id"]).when(cell.isNull(), F.lit(-2)).otherwise(-1)
    parts = nodes.filter(kind.isin("td", "td-inner", "table-attrs")).select(
        "page_id", F.when(alone, near["id"]).otherwise(above["id"]).alias("table_id"), line.alias("_line"), cell.alias("_cell"), F.when(kind == "td", prop("subtype")).alias("subtype"),
        F.when(kind == "td-inner", F.btrim("text", F.lit(" \n"))).alias("value"), F.when(kind == "table-attrs", F.trim("text")).alias("attrs"),
    )
    # A page's rows meet in one shuffle, which serves all groups below.
    cells = parts.repartition("page_id").groupBy("page_id", "table_id", "_line", "_cell").agg(*[F.max(c).alias(c) for c in ("subtype", "value", "attrs")])
    caption = F.col("subtype") == "caption"
    whole = F.when(F.col("_cell").isNotNull() & ~caption & F.col("value").isNotNull(), F.struct("_cell", "subtype", F.coalesce("attrs", F.lit("")).alias("attrs"), "value"))
    named = F.transform(F.array_sort(F.collect_list(whole)), lambda c: F.struct(c["subtype"].alias("subtype"), c["attrs"].alias("attrs"), c["value"].alias("value")))
    lines_of = cells.groupBy("page_id", "table_id", "_line").agg(
        F.max(F.when(F.col("_cell").isNull(), F.col("attrs"))).alias("attrs"), F.min_by("value", F.when(caption, F.col("_cell"))).alias("caption"), named.alias("cells")
    )
    table, full = Window.partitionBy("page_id", "table_id"), F.size("cells") > 0
    row = F.count(F.when(full, 1)).over(table.orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)).cast("int")
    told = lines_of.select(
        "page_id", "table_id", F.coalesce(F.max(F.when(F.col("_line") == -2, F.col("attrs"))).over(table), F.lit("")).alias("table_attrs"),
        F.max(F.when(F.col("_line") == -1, F.col("caption"))).over(table).alias("caption"), row.alias("row"), F.when(F.col("_line") >= 0, F.coalesce("attrs", F.lit(""))).otherwise("").alias("row_attrs"), "cells",
    )
    return told.filter(full)


def write_tables(rows: DataFrame) -> DataFrame:
    """page_id, table_id, text: wikitext of tables given as rows of cells, with what attributes and caption they have."""
    spaced = lambda a: F.when(a == "", F.lit("")).otherwise(F.concat(F.lit(" "), a))

    def mark(c: Column) -> Column:
        attrs = F.when(c["attrs"] == "", F.lit("")).otherwise(F.concat(c["attrs"], F.lit(" | ")))
        return F.concat(F.when(c["subtype"] == "th", "! ").otherwise("| "), attrs, c["value"])

    line = F.concat(F.lit("|-"), spaced(F.col("row_attrs")), F.lit("\n"), F.array_join(F.transform("cells", mark), "\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))), lambda r: r["t"]), "\n")
    made = rows.groupBy("page_id", "table_id").agg(F.max("table_attrs").alias("a"), F.max("caption").alias("c"), body.alias("b"))
    head = F.concat(F.lit("{|"), spaced(F.col("a")), F.coalesce(F.concat(F.lit("\n|+ "), "c"), F.lit("")), F.lit("\n"))
    return made.select("page_id", "table_id", F.concat(head, "b", F.lit("\n|}")).alias("text"))


def replicate_row(rows: DataFrame, at: int, times: int = 1) -> DataFrame:
    """Row ``at`` of every table again, so many times, after itself."""
    again = rows.filter(F.col("row") == at).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("row", F.col("row") + F.col("_k")).drop("_k")
    return rows.withColumn("row", F.when(F.col("row") > at, F.col("row") + times).otherwise(F.col("row"))).unionByName(again)


def merge_cells(rows: DataFrame, row: int, first: int, n: int) -> DataFrame:
    """Cells ``first`` to ``first + n - 1`` of a row as one that spans their columns; their texts are joined by blanks."""
    cells = F.col("cells")
    part = F.slice(cells, F.lit(first + 1), F.lit(n))
    attrs = F.trim(F.concat(F.regexp_replace(F.get(part, F.lit(0))["attrs"], r"\s*colspan\s*=\s*(?:\"[^\"]*\"|\S+)", ""), F.lit(f" colspan={n}")))
    one = F.struct(F.get(part, F.lit(0))["subtype"].alias("subtype"), attrs.alias("attrs"), F.array_join(F.transform(part, lambda c: c["value"]), " ").alias("value"))
    merged = F.concat(F.slice(cells, 1, first), F.array(one), F.slice(cells, F.lit(first + n + 1), F.size(cells) + 1))
    return rows.withColumn("cells", F.when((F.col("row") == row) & (F.size(cells) >= first + n), merged).otherwise(cells))


def split_cell(rows: DataFrame, row: int, at: int, n: int) -> DataFrame:
    """A cell that spans ``n`` columns as ``n`` cells; the first keeps the text."""
    cells = F.col("cells")
    old = F.get(cells, F.lit(at))
    bare = F.trim(F.regexp_replace(old["attrs"], r"\s*colspan\s*=\s*(?:\"[^\"]*\"|\S+)", ""))
    new = lambda value: F.struct(old["subtype"].alias("subtype"), bare.alias("attrs"), value.alias("value"))
    parts = F.array(new(old["value"]), *[new(F.lit("")) for _ in range(n - 1)])
    split = F.concat(F.slice(cells, 1, at), parts, F.slice(cells, F.lit(at + 2), F.size(cells) + 1))
    return rows.withColumn("cells", F.when((F.col("row") == row) & (F.size(cells) > at), split).otherwise(cells))


def format_cells(rows: DataFrame, attrs: str, row: int | None = None, column: int | None = None) -> DataFrame:
    """Attributes for all cells of a row, a column, both or the table."""
    chosen = F.lit(True) if row is None else F.col("row") == row

    def one(c: Column, k: Column) -> Column:
        here = chosen if column is None else chosen & (k == column)
        return F.struct(c["subtype"].alias("subtype"), F.when(here, F.trim(F.concat(c["attrs"], F.lit(f" {attrs}")))).otherwise(c["attrs"]).alias("attrs"), c["value"].alias("value"))

    return rows.withColumn("cells", F.transform("cells", one))


def fill_cells(rows: DataFrame, value: str, row: int | None = None, column: int | None = None) -> DataFrame:
    """A text for all cells of a row, a column, both or the table."""
    chosen = F.lit(True) if row is None else F.col("row") == row

    def one(c: Column, k: Column) -> Column:
        here = chosen if column is None else chosen & (k == column)
        return F.struct(c["subtype"].alias("subtype"), c["attrs"].alias("attrs"), F.when(here, value).otherwise(c["value"]).alias("value"))

    return rows.withColumn("cells", F.transform("cells", one))


def move_rows(rows: DataFrame, order) -> DataFrame:
    """Rows of every table in a new order, by a column expression over ``row`` and ``cells``."""
    w = Window.partitionBy("page_id", "table_id").orderBy(order, "row")
    return rows.withColumn("row", F.row_number().over(w) - 1)


def move_column(rows: DataFrame, at: int, to: int) -> DataFrame:
    cells = F.col("cells")
    rest = F.filter(cells, lambda c, i: i != at)
    moved = F.concat(F.slice(rest, 1, to), F.slice(cells, at + 1, 1), F.slice(rest, F.lit(to + 1), F.size(rest) + 1))
    return rows.withColumn("cells", F.when(F.size(cells) > max(at, to), moved).otherwise(cells))


def insert_column(rows: DataFrame, at: int, value: str, head: str | None = None) -> DataFrame:
    first = F.col("row") == 0
    cell = F.struct(F.when(first & F.lit(head is not None), "th").otherwise("td").alias("subtype"), F.lit("").alias("attrs"), F.when(first & F.lit(head is not None), head or "").otherwise(value).alias("value"))
    return rows.withColumn("cells", F.concat(F.slice("cells", 1, at), F.array(cell), F.slice("cells", F.lit(at + 1), F.size("cells") + 1)))


def remove_column(rows: DataFrame, at: int) -> DataFrame:
    return rows.withColumn("cells", F.filter("cells", lambda c, i: i != at))


def insert_row(rows: DataFrame, at: int, values: list[str]) -> DataFrame:
    """A row of these cells in every table, before row ``at``."""
    cells = F.array(*[F.struct(F.lit("td").alias("subtype"), F.lit("").alias("attrs"), F.lit(v).alias("value")) for v in values])
    tables = rows.groupBy("page_id", "table_id").agg(F.max("table_attrs").alias("table_attrs"), F.max("caption").alias("caption"))
    new = tables.select("*", F.lit(at).alias("row"), F.lit("").alias("row_attrs"), cells.alias("cells"))
    return rows.withColumn("row", F.when(F.col("row") >= at, F.col("row") + 1).otherwise(F.col("row"))).unionByName(new)


def remove_row(rows: DataFrame, at: int) -> DataFrame:
    return rows.filter(F.col("row") != at).withColumn("row", F.when(F.col("row") > at, F.col("row") - 1).otherwise(F.col("row")))


def references(nodes: DataFrame) -> DataFrame:
    """Reference uses with group, name, number by first use, and running use number."""
    refs = nodes.filter((F.col("type") == "ext") & (F.col("name") == "ref") & ~has_ancestor("ext-inner")).select(
        "page_id", "node_id", "start", F.coalesce(attr("group"), F.lit("")).alias("group"), F.when(attr("name") != "", attr("name")).alias("name"), (prop("selfClosing") == "true").alias("reuse"), F.coalesce("text", F.lit("")).alias("text"),
    )
    key = F.coalesce(F.concat(F.lit("n:"), "name"), F.concat(F.lit("#"), F.col("node_id").cast("string")))
    refs = refs.withColumn("_key", key)
    first = F.min("start").over(Window.partitionBy("page_id", "group", "_key"))
    refs = refs.withColumn("_first", first)
    number = F.dense_rank().over(Window.partitionBy("page_id", "group").orderBy("_first"))
    use = F.row_number().over(Window.partitionBy("page_id", "group", "_key").orderBy("start"))
    return refs.select("page_id", "node_id", "group", "name", number.alias("number"), use.alias("use_no"), "reuse")


def matched_tags(nodes: DataFrame, config: SiteConfig = DEFAULT) -> DataFrame:
    """Opening and closing HTML tags paired per parent and name, by a reflected walk over depths.

    ``partner_id`` is null for a tag without one. Void and self-closed flexible tags are left out.
    """
    tags = nodes.filter((F.col("type") == "html") & ~F.col("name").isin(*config.html_void))
    tags = tags.filter(~((prop("selfClosing") == "true") & F.col("name").isin(*config.html_flexible)))
    tags = tags.select("page_id", "parent_id", "node_id", "name", (prop("closing") == "true").alias("closing"))
    group = ["page_id", "parent_id", "name"]
    w = Window.partitionBy(*group).orderBy("node_id")
    s = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tags = tags.withColumn("_s", s)
    floor = F.least(F.lit(0), F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tags = tags.withColumns({"_h": F.col("_s") - floor, "_lost": F.col("closing") & (F.col("_s") < before)})
    level = F.when(F.col("closing"), F.col("_h") + 1).otherwise(F.col("_h"))
    tags = tags.withColumn("_level", F.when(F.col("_lost"), F.lit(-1)).otherwise(level))
    lw = Window.partitionBy(*group, "_level").orderBy("node_id")
    follow, prior = F.lead(F.struct("node_id", "closing")).over(lw), F.lag(F.struct("node_id", "closing")).over(lw)
    partner = F.when(F.col("_lost"), F.lit(None)).when(~F.col("closing") & follow["closing"], follow["node_id"]).when(F.col("closing") & ~prior["closing"], prior["node_id"])
    return tags.select("page_id", "parent_id", "node_id", "name", "closing", partner.cast("int").alias("partner_id"))


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered grid of a table with row and column spans; one row in, its cells out."""
    for batch in batches:
        valued = "inner" in batch.schema.names
        out: dict[str, list] = {k: [] for k in ("page_id", "table_id", "y", "x", "row", "col", "cell_node_id", "is_start", "rowspan", "colspan", "subtype", *["value"] * valued)}
        for t in batch.to_pylist():
            values = {i["node_id"]: i["value"] for i in t["inner"]} if valued else {}
            taken: dict[tuple[int, int], tuple] = {}
            rows: dict[int, list] = {}
            for c in sorted(t["cells"], key=lambda c: c["node_id"]):
                rows.setdefault(c["row_id"], []).append(c)
            for y, (_, cells) in enumerate(sorted(rows.items())):
                x = 0
                for col, c in enumerate(cells):
                    while (y, x) in taken:
                        x += 1
                    down = min(max(c["rowspan"] or 1, 1), 65534) if c["rowspan"] != 0 else len(rows) - y
                    wide = min(max(c["colspan"] or 1, 1), 1000)
                    for dy in range(min(down, len(rows) - y)):
                        for dx in range(wide):
                            taken.setdefault((y + dy, x + dx), (y, col, c, dy == 0 and dx == 0, down, wide))
                    x += wide
            for (y, x), (row, col, c, start, down, wide) in sorted(taken.items()):
                for k, v in zip(out, (t["page_id"], t["table_id"], y, x, row, col, c["node_id"], start, down, wide, c["subtype"], *[values.get(c["node_id"])] * valued), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(
            {k: pa.array(v, pa.int64() if k == "page_id" else pa.bool_() if k == "is_start" else pa.string() if k in ("subtype", "value") else pa.int32()) for k, v in out.items()}
        )


def table_cells(nodes: DataFrame, values: bool = False) -> DataFrame:
    """page_id, table_id, y, x (rendered), row, col (source), cell_node_id, is_start, rowspan, colspan, subtype.

    Cells of one table travel together; a table is bounded by its page. With ``values`` their texts
    travel along from the td-inner rows, as ``value``.
    """
    cell_row = (F.col("type") == "td") & (prop("subtype") != "caption")
    cells = nodes.filter(cell_row | (F.col("type") == "td-inner") if values else cell_row)
    up = lambda k: F.try_element_at(F.col("anc"), F.when(F.col("type") == "td", F.lit(-k)).otherwise(-k - 1) if values else F.lit(-k))
    parent, above = up(1), up(2)
    table = F.when(parent["type"] == "table", parent["id"]).otherwise(above["id"])
    row = F.when(parent["type"] == "table", F.lit(-1)).otherwise(parent["id"])
    cell = F.struct("node_id", row.alias("row_id"), attr("rowspan").try_cast("int").alias("rowspan"), attr("colspan").try_cast("int").alias("colspan"), prop("subtype").alias("subtype"))
    schema = "page_id long, table_id int, y int, x int, row int, col int, cell_node_id int, is_start boolean, rowspan int, colspan int, subtype string"
    found = [F.collect_list(cell).alias("cells")]
    if values:
        inner = F.struct(F.col("parent_id").alias("node_id"), F.btrim("text", F.lit(" \n")).alias("value"))
        found = [F.collect_list(F.when(F.col("type") == kind, x)).alias(name) for kind, x, name in (("td", cell, "cells"), ("td-inner", inner, "inner"))]
        schema += ", value string"
    grouped = cells.groupBy("page_id", table.alias("table_id")).agg(*found)
    return grouped.mapInArrow(_grid, schema)


def lines(pages: DataFrame) -> DataFrame:
    """page_id, line (0-based), start, text."""
    from markloom.plans.parse import cleaned

    rows = pages.select("page_id", F.posexplode(F.split(cleaned(F.col("text")), "\n")).alias("line", "text"))
    w = Window.partitionBy("page_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "line", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int").alias("start"), "text")


def positions(found: DataFrame, pages: DataFrame, at: str = "start") -> DataFrame:
    """Add ``line`` and ``col`` of any offset: the nearest line start at or before it, page by page.

    Nodes have their own positions already, as columns of the parse.
    """
    starts = lines(pages).select("page_id", F.col("start").alias("_at"), F.lit(0).alias("_k"), "line", F.lit(None).cast(found.schema).alias("_row"))
    asked = found.select("page_id", F.col(at).cast("int").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("int").alias("line"), F.struct("*").alias("_row"))
    before = Window.partitionBy("page_id").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    line = F.last(F.when(F.col("_k") == 0, F.struct("line", "_at")), ignorenulls=True).over(before)
    met = starts.unionByName(asked).withColumn("_line", line).filter("_k = 1")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in found.columns if c not in ("line", "col")]
    return met.select(*kept, F.col("_line.line").alias("line"), (F.col("_at") - F.col("_line._at")).alias("col"))


def offsets(points: DataFrame, pages: DataFrame) -> DataFrame:
    """points(page_id, line, col) with ``at``: null beyond the page's lines or the line's end."""
    # The optimizer doesn't see that split and explode make many rows of a small file: neither side may be broadcast.
    known = lines(pages).select("page_id", "line", F.col("start").alias("_a"), F.length("text").alias("_n")).hint("merge")
    inside = (F.col("col") >= 0) & (F.col("col") <= F.col("_n"))
    return points.join(known, ["page_id", "line"], "left").withColumn("at", F.when(inside, F.col("_a") + F.col("col"))).drop("_a", "_n")


def template_closure(edges: DataFrame) -> DataFrame:
    """edges(source, target) -> transitive (source, target), until a round finds nothing new.

    Known paths are joined with known paths, so a chain of n links takes log2 n rounds.
    """
    from markloom.sources.shared import materialise

    known = materialise(edges.select("source", "target").distinct(), "closure")
    fresh = known
    while True:
        on = known.select(F.col("source").alias("target"), F.col("target").alias("next"))
        longer = fresh.join(on, "target").select("source", F.col("next").alias("target"))
        back = known.join(fresh.select(F.col("source").alias("target"), F.col("target").alias("next")), "target").select("source", F.col("next").alias("target"))
        step = longer.unionAll(back).distinct()
        fresh = materialise(step.join(known, ["source", "target"], "left_anti"), "closure")
        if not fresh.head(1):
            return known
        known = materialise(known.unionAll(fresh), "closure")
