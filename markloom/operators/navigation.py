"""Moving between nodes: neighbours, children, ancestors, order, equality, extents, collections, list ranges.

All are windows or equi-joins on (page_id, parent_id) or interval tests on the pre-order
numbers, so none needs more than one shuffle by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.operators.structure import prop

#: Selectors of the usual collections: (types, condition).
IMAGES = ("file", "gallery-image", "imagemap-image")
LINKS = ("link", "redirect-target", "ext-link", "free-ext-link", "magic-link")


def neighbours(nodes: DataFrame) -> DataFrame:
    """Each node with its parent and siblings: next and previous node, element (and its type), and node that shows some text."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("ordinal")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    element = F.when(F.col("type") != "text", F.struct("node_id", "type"))
    shown = F.when(F.col("text") != "", F.col("node_id"))
    root = F.col("parent_id").isNull()
    some = lambda c: F.when(~root, c)  # noqa: E731 - a root has no siblings
    near = nodes.select(
        "page_id", "node_id", "type", "parent_id", F.try_element_at("anc", F.lit(-1))["type"].alias("parent_type"),
        some(F.lead("node_id").over(w)).alias("next"), some(F.lag("node_id").over(w)).alias("previous"),
        some(F.first(element, ignorenulls=True).over(after)).alias("_next"), some(F.last(element, ignorenulls=True).over(before)).alias("_previous"),
        some(F.first(shown, ignorenulls=True).over(after)).alias("next_visible"), some(F.last(shown, ignorenulls=True).over(before)).alias("previous_visible"),
    )
    return near.select(
        "page_id", "node_id", "type", "parent_id", "parent_type", "next", "previous", F.col("_next.node_id").alias("next_element"), F.col("_previous.node_id").alias("previous_element"),
        "next_visible", "previous_visible", F.col("_next.type").alias("next_element_type"), F.col("_previous.type").alias("previous_element_type"),
    )


def children(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, n_children, n_elements, first_child, last_child, first_element, last_element, child_ids."""
    below = nodes.filter("parent_id is not null")
    element = F.col("type") != "text"
    return below.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(element).alias("n_elements"), F.min_by("node_id", "ordinal").alias("first_child"), F.max_by("node_id", "ordinal").alias("last_child"),
        F.min(F.when(element, F.col("node_id"))).alias("first_element"), F.max(F.when(element, F.col("node_id"))).alias("last_element"), F.array_sort(F.collect_list("node_id")).alias("child_ids"),
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """A row for each node and ancestor: distance 1 is the parent."""
    rows = nodes.select("page_id", "node_id", F.posexplode("anc").alias("k", "a"), F.size("anc").alias("n"))
    return rows.select("page_id", "node_id", F.col("a.id").alias("ancestor_id"), F.col("a.type").alias("ancestor_type"), (F.col("n") - F.col("k")).alias("distance"))


def _pairs(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(page_id, a, b) with the columns of both nodes as a_... and b_..."""
    for side in ("a", "b"):
        named = nodes.select("page_id", F.col("node_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(named, ["page_id", side])
    return pairs


def compare(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(page_id, a, b) with ``contains`` (b is a or below it) and ``order``: -1 if a comes first or holds b, 1 the other way, 0 if they are one."""
    met = _pairs(pairs, nodes, ["last_id"])
    holds = (F.col("b") >= F.col("a")) & (F.col("b") <= F.col("a_last_id"))
    return met.select("page_id", "a", "b", holds.alias("contains"), F.sign(F.col("a") - F.col("b")).cast("int").alias("order"))


def equal(pairs: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """pairs(page_id, a, b) with ``equal``: same type, name and source, so the same tree wherever it stands."""
    from markloom.plans.parse import wikitext

    asked = pairs.select("page_id", F.explode(F.array("a", "b")).alias("node_id")).distinct()
    told = wikitext(nodes.join(asked, ["page_id", "node_id"], "left_semi").select("page_id", "node_id", "type", "name", "start", "end"), pages)
    met = _pairs(pairs, told, ["type", "name", "source"])
    same = (F.col("a_type") == F.col("b_type")) & F.col("a_name").eqNullSafe(F.col("b_name")) & (F.col("a_source") == F.col("b_source"))
    return met.select("page_id", "a", "b", same.alias("equal"))


def ends(nodes: DataFrame) -> DataFrame:
    """Nodes with nothing but blank text after them up to the end of their parents and page (eof), with the root's id."""
    blank = F.when((F.col("type") == "text") & (F.trim(F.translate("data", "\n\t", "  ")) == ""), F.lit(0)).otherwise(1)
    after = Window.partitionBy("page_id", "parent_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    last = F.coalesce(F.sum(blank).over(after), F.lit(0)) == 0
    own = nodes.select("page_id", "node_id", "type", last.alias("last"), F.transform("anc", lambda a: a["id"]).alias("up"))
    open_ones = own.filter("not last").groupBy("page_id").agg(F.collect_set("node_id").alias("followed"))
    met = own.filter("last").join(open_ones, "page_id", "left")
    return met.filter(F.col("followed").isNull() | (F.size(F.array_intersect("up", "followed")) == 0)).select("page_id", "node_id", "type", F.lit(0).alias("root_id"))


def extents(nodes: DataFrame) -> DataFrame:
    """Place in page and parent, and size: index, relative_index, top, left, height (lines), width (of the last line)."""
    parents = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("start").alias("_from"))
    met = nodes.join(parents, ["page_id", "parent_id"], "left")
    width = F.when(F.col("line") == F.col("end_line"), F.col("end_col") - F.col("col")).otherwise(F.col("end_col"))
    return met.select(
        "page_id", "node_id", "type", F.col("start").alias("index"), (F.col("start") - F.coalesce("_from", F.lit(0))).alias("relative_index"),
        F.col("line").alias("top"), F.col("col").alias("left"), (F.col("end_line") - F.col("line") + 1).alias("height"), width.alias("width"),
    )


def images(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin(*IMAGES))


def links(nodes: DataFrame) -> DataFrame:
    """Internal, external and magic links, and the ``link=`` options of images."""
    option = (F.col("type") == "image-parameter") & (F.col("name") == "link")
    inside = F.exists("anc", lambda a: a["type"] == "image-parameter")
    return nodes.filter((F.col("type").isin(*LINKS) & ~inside) | option)


def embeds(nodes: DataFrame) -> DataFrame:
    """Templates and modules."""
    return nodes.filter((F.col("type") == "template") | ((F.col("type") == "magic-word") & (F.col("name") == "invoke")))


def document_order(nodes: DataFrame, descending: bool = False) -> DataFrame:
    """Rows in document order, or against it."""
    return nodes.orderBy("page_id", F.desc("node_id") if descending else F.asc("node_id"))


def first_match(found: DataFrame) -> DataFrame:
    """The first of the found nodes on each page."""
    return found.groupBy("page_id").agg(F.min_by(F.struct(*found.columns), "node_id").alias("r")).select("r.*")


def list_ranges(nodes: DataFrame) -> DataFrame:
    """What belongs to a list mark: from its end to the next mark of its line (a ``dd``) or the line's end, within its parent.

    page_id, node_id, type, prefix, common (levels shared with the line before), start, end.
    """
    marks = F.col("type").isin("list", "dd")
    breaks = F.when((F.col("type") == "text") & F.contains("data", F.lit("\n")), F.col("start") + F.instr("data", "\n") - 1)
    w = Window.partitionBy("page_id", "parent_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    stop = F.least(F.first(F.when(marks, F.col("start")), ignorenulls=True).over(w), F.first(breaks, ignorenulls=True).over(w))
    last = F.max("end").over(Window.partitionBy("page_id", "parent_id"))
    told = nodes.withColumns({"_stop": stop, "_last": last}).filter(marks)
    return told.select("page_id", "node_id", "type", F.col("name").alias("prefix"), F.coalesce(prop("common").cast("int"), F.lit(0)).alias("common"), F.col("end").alias("start"), F.coalesce("_stop", "_last").alias("end"))


def caret(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """points(page_id, at) -> the text node that the caret stands in (the one that ends there, at a boundary) and the offset in it.

    Where no text touches the point, the deepest element around it and its offset from that element's start.
    """
    n = nodes.select(F.col("page_id").alias("_p"), "node_id", "type", "depth", "start", "end")
    met = points.join(n, (F.col("page_id") == F.col("_p")) & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end")))
    text = F.col("type") == "text"
    rank = F.struct(text.cast("int"), F.when(text, -F.col("start")).otherwise(F.col("depth")))
    best = met.groupBy("page_id", "at").agg(F.max_by(F.struct("node_id", "type", "start"), rank).alias("r"))
    return best.select("page_id", "at", "r.node_id", "r.type", (F.col("at") - F.col("r.start")).alias("offset"))


def elements_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """points(page_id, at) -> all elements around each offset, the outermost first."""
    n = nodes.filter("type <> 'text'").select(F.col("page_id").alias("_p"), "node_id", "type", "depth", "start", "end")
    met = points.join(n, (F.col("page_id") == F.col("_p")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return met.groupBy("page_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node_id", "type"))), lambda e: e["type"]).alias("types"))


def chosen_options(nodes: DataFrame) -> DataFrame:
    """page_id, file_id, option, value: of equal options the last counts, but the first ``manualthumb``."""
    options = nodes.filter(F.col("type") == "image-parameter").select("page_id", F.col("parent_id").alias("file_id"), F.col("name").alias("option"), prop("value").alias("value"), "start")
    rank = F.when(F.col("option") == "manualthumb", -F.col("start")).otherwise(F.col("start"))
    return options.groupBy("page_id", "file_id", "option").agg(F.max_by("value", rank).alias("value"))


def argument_keys(args: DataFrame) -> DataFrame:
    """arguments -> page_id, call_id, keys (distinct, by first place), all_values (key to its values in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "key", "value")))
    told = args.groupBy("page_id", "call_id").agg(ordered.alias("a"))
    keys = F.array_distinct(F.transform("a", lambda x: x["key"]))
    values = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter("a", lambda x: x["key"] == k), lambda x: x["value"])))
    return told.select("page_id", "call_id", keys.alias("keys"), values.alias("all_values"))


def other_arguments(args: DataFrame, keep: list[str]) -> DataFrame:
    """Keys of each call that are not to be kept."""
    return argument_keys(args).select("page_id", "call_id", F.array_except("keys", F.array(*[F.lit(k) for k in keep])).alias("keys"))


def table_sizes(nodes: DataFrame) -> DataFrame:
    """page_id, table_id, n_rows, n_columns (most cells of a source row), n_cells; cells before the first row mark are a row."""
    cells = nodes.filter((F.col("type") == "td") & (prop("subtype") != "caption"))
    parent, above = F.element_at("anc", -1), F.try_element_at("anc", F.lit(-2))
    direct = parent["type"] == "table"
    rows = cells.groupBy("page_id", F.when(direct, parent["id"]).otherwise(above["id"]).alias("table_id"), F.when(direct, F.lit(-1)).otherwise(parent["id"]).alias("row_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("page_id", "table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n_columns"), F.sum("n").alias("n_cells"))


# -- ranges: rows (page_id, start, end) of page text


def range_of(nodes: DataFrame, inner: bool = False) -> DataFrame:
    """The span of each node, or of what is inside it."""
    a, b = ("inner_start", "inner_end") if inner else ("start", "end")
    return nodes.select("page_id", "node_id", F.col(a).alias("start"), F.col(b).alias("end"))


def compare_ranges(pairs: DataFrame) -> DataFrame:
    """pairs(page_id, start, end, other_start, other_end) with ``relation``: before, after, holds, inside, same, overlaps."""
    a, b, c, d = (F.col(n) for n in ("start", "end", "other_start", "other_end"))
    relation = (
        F.when((a == c) & (b == d), "same").when(b <= c, "before").when(a >= d, "after").when((a <= c) & (b >= d), "holds").when((a >= c) & (b <= d), "inside").otherwise("overlaps")
    )
    return pairs.withColumn("relation", relation)


def extract(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """ranges(page_id, start, end) with their ``source``."""
    from markloom.plans.parse import wikitext

    return wikitext(ranges, pages)


def inside_range(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that lie wholly in a range of their page."""
    r = ranges.select(F.col("page_id").alias("_p"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return nodes.join(r, (F.col("page_id") == F.col("_p")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b")), "left_semi")


def enclosing_tag(points: DataFrame, tags: DataFrame) -> DataFrame:
    """points(page_id, at) -> the innermost matched pair of HTML tags around each: opening and closing node and name.

    ``tags`` are html nodes with node_id, name, start, end and the partner_id of ``structure.matched_tags``.
    """
    opening = tags.filter("partner_id > node_id").select("page_id", F.col("node_id").alias("open_id"), F.col("partner_id").alias("close_id"), "name", F.col("end").alias("_a"))
    closing = tags.select("page_id", F.col("node_id").alias("close_id"), F.col("start").alias("_b"))
    pairs = opening.join(closing, ["page_id", "close_id"]).withColumnRenamed("page_id", "_p")
    met = points.join(pairs, (F.col("page_id") == F.col("_p")) & (F.col("at") >= F.col("_a")) & (F.col("at") <= F.col("_b")))
    return met.groupBy("page_id", "at").agg(F.max_by(F.struct("open_id", "close_id", "name"), "_a").alias("r")).select("page_id", "at", "r.*")


def visible(column: str = "text") -> Column:
    """Does a node show any text?"""
    return F.trim(F.translate(F.col(column), "\n\t", "  ")) != ""
