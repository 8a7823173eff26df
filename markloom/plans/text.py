"""Whole-page text operators: expansion, HTML, highlighted source, JSON trees, edits, diffs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig
from markloom.functions.titles import normalise
from markloom.operators.lint import apply_fixes
from markloom.operators.structure import template_closure
from markloom.plans.parse import PageError, parse, spread
from markloom.sources.shared import materialise

#: Template stores of up to this many characters travel as one broadcast map.
BROADCAST_CHARS = 32_000_000


def _map_text(pages: DataFrame, fn: Callable[[dict], str], column: str, extra: tuple[str, ...] = (), errors: str = "raise") -> DataFrame:
    """fn over whole pages. A page on which it fails stops the query; with ``errors="null"`` its text is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                try:
                    out.append(fn(r))
                except Exception as e:
                    if errors == "raise":
                        raise PageError(f"page_id {r['page_id']}: {type(e).__name__}: {e}") from e
                    out.append(None)
            yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array(out, pa.string())], ["page_id", column])

    title = F.col("title") if "title" in pages.columns else F.lit("").alias("title")
    return spread(pages.select("page_id", title, F.coalesce("text", F.lit("")).alias("text"), *extra)).mapInArrow(run, f"page_id long, {column} string")


def _store(templates: DataFrame, redirects: DataFrame | None, config: SiteConfig) -> DataFrame:
    """title, text of templates, and of redirects to them under their own titles: one hop, as on a wiki.

    Redirects are given as a table, or are templates whose text is one.
    """
    named = templates.select(normalise(F.col("title"), 10, config)["title"].alias("title"), "text")
    words = "|".join(config.redirection)
    goal = F.regexp_extract("text", rf"(?i)^\s*(?:{words})\s*:?\s*\[\[([^\n|\[\]#]+)", 1)
    moved = named.filter(goal != "").select(F.col("title").alias("_from"), normalise(goal, 10, config)["title"].alias("title"))
    if redirects is not None:
        told = redirects.select(normalise(F.col("from_title"), 10, config)["title"].alias("_from"), normalise(F.col("to_title"), 10, config)["title"].alias("title"))
        moved = moved.unionByName(told).dropDuplicates(["_from"])
    aliases = moved.join(named, "title").select(F.col("_from").alias("title"), "text")
    return named.join(aliases.select("title"), "title", "left_anti").unionByName(aliases)


def expand(pages: DataFrame, templates: DataFrame, redirects: DataFrame | None = None, config: SiteConfig = DEFAULT, constant: bool = False, errors: str = "raise") -> DataFrame:
    """page_id, text with templates and parser functions expanded.

    A small template store is broadcast; beyond BROADCAST_CHARS every page gets only the
    closure of the templates it calls, by joins. Names that templates compute while they
    expand, such as ``{{T{{{1}}}}}``, are only found in a store that is broadcast.
    """
    from markloom.kernel.expand import Expander

    named = _store(templates, redirects, config)
    size = named.agg(F.sum(F.length("text") + F.length("title"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        store = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in named.collect()})
        return _map_text(pages, lambda r: Expander(store.value, None, r["title"] or "", config, constant=constant).page_text(r["text"]), "text", errors=errors)
    ids = named.select(F.xxhash64("title").alias("page_id"), "title", "text", F.lit(True).alias("include"))
    called = parse(ids, config, ["name"], ["template"], "brace").select("page_id", F.col("name").alias("target"))
    edges = called.join(ids.select("page_id", F.col("title").alias("source")), "page_id").select("source", "target").distinct()
    closure = template_closure(edges)
    first = parse(pages, config, ["name"], ["template"], "brace").select("page_id", F.col("name").alias("source")).distinct()
    needed = first.unionAll(first.join(closure, "source").select("page_id", F.col("target").alias("source"))).distinct()
    bundle = needed.join(named.withColumnRenamed("title", "source"), "source").groupBy("page_id").agg(F.collect_list(F.struct("source", F.col("text").alias("body"))).alias("store"))
    met = pages.join(bundle, "page_id", "left").withColumn("store", F.coalesce("store", F.array().cast("array<struct<source:string,body:string>>")))
    return _map_text(met, lambda r: Expander({t["source"]: t["body"] for t in r["store"]}, None, r["title"] or "", config, constant=constant).page_text(r["text"]), "text", ("store",), errors)


def to_html(pages: DataFrame, templates: DataFrame | None = None, config: SiteConfig = DEFAULT) -> DataFrame:
    """page_id, html of the (expanded) page."""
    from markloom.kernel.render import render

    body = pages
    if templates is not None:
        keep = pages.drop("text")
        body = keep.join(expand(pages, templates, config=config), "page_id")
    return _map_text(body, lambda r: render(r["text"], config, r["title"] or ""), "html")


def highlight(pages: DataFrame, config: SiteConfig = DEFAULT) -> DataFrame:
    """page_id, html: the source with a span for each node."""
    from markloom.kernel.parse import clean
    from markloom.kernel.parse import parse as tree
    from markloom.kernel.render import highlight as mark

    return _map_text(pages, lambda r: mark(tree(r["text"], config), clean(r["text"])), "html")


def to_json(pages: DataFrame, config: SiteConfig = DEFAULT) -> DataFrame:
    """page_id, json: the tree as nested objects with type, name, range and childNodes."""

    def one(r: dict) -> str:
        import json

        from markloom.kernel.parse import clean
        from markloom.kernel.parse import parse as tree
        from markloom.kernel.parse import rows

        text = clean(r["text"])
        made: dict[int, dict] = {}
        for n in rows(tree(text, config), text, config):
            obj = {"type": n["type"], "range": [n["start"], n["end"]]}
            if n["type"] == "text":
                obj["data"] = n["data"]
            else:
                obj |= {k: v for k, v in (("name", n["name"]), ("attributes", n["attrs"] or None)) if v} | n["props"] | {"childNodes": []}
            made[n["node_id"]] = obj
            if n["parent_id"] is not None:
                made[n["parent_id"]]["childNodes"].append(obj)
        return json.dumps(made[0], ensure_ascii=False)

    return _map_text(pages, one, "json")


# -- edits: rows (page_id, start, end, text) that apply_edits splices into the pages


def edit(start: Column, end: Column, text: Column | str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def apply_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    return apply_fixes(pages, edits.select("page_id", F.col("edit").alias("fix")))


def edits_at(nodes: DataFrame, *found: Column) -> DataFrame:
    """Edits of several kinds in one pass over the nodes: each column is an edit, or null where a node has none of that kind."""
    return nodes.select("page_id", F.explode(F.array(*found)).alias("edit")).filter("edit is not null")


def remove(found: DataFrame) -> DataFrame:
    return found.select("page_id", edit(F.col("start"), F.col("end"), "").alias("edit"))


def replace_with(found: DataFrame, text: Column | str) -> DataFrame:
    return found.select("page_id", edit(F.col("start"), F.col("end"), text).alias("edit"))


def insert_before(found: DataFrame, text: Column | str) -> DataFrame:
    return found.select("page_id", edit(F.col("start"), F.col("start"), text).alias("edit"))


def insert_after(found: DataFrame, text: Column | str) -> DataFrame:
    return found.select("page_id", edit(F.col("end"), F.col("end"), text).alias("edit"))


def _part(nodes: DataFrame, owners: DataFrame, part: str) -> DataFrame:
    keys = owners.select("page_id", F.col("node_id").alias("parent_id"))
    return nodes.filter(F.col("type") == part).join(keys, ["page_id", "parent_id"], "left_semi")


def replace_template(nodes: DataFrame, name: str, new: str) -> DataFrame:
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name))
    return replace_with(_part(nodes, calls, "template-name"), new)


def set_argument(nodes: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Set the last argument of that key, or append one."""
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name))
    have = nodes.filter((F.col("type") == "parameter") & (F.col("name") == key)).join(calls.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
    last = have.groupBy("page_id", "parent_id").agg(F.max_by("node_id", "start").alias("node_id"))
    values = nodes.filter(F.col("type") == "parameter-value").join(last.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
    missing = calls.join(last.select("page_id", F.col("parent_id").alias("node_id")), ["page_id", "node_id"], "left_anti")
    appended = missing.select("page_id", edit(F.col("end") - 2, F.col("end") - 2, f"|{key}={value}").alias("edit"))
    return replace_with(values, value).unionByName(appended)


def remove_argument(nodes: DataFrame, name: str, key: str) -> DataFrame:
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name)).select("page_id", F.col("node_id").alias("parent_id"))
    have = nodes.filter((F.col("type") == "parameter") & (F.col("name") == key)).join(calls, ["page_id", "parent_id"], "left_semi")
    return have.select("page_id", edit(F.col("start") - 1, F.col("end"), "").alias("edit"))


def name_anonymous(nodes: DataFrame) -> DataFrame:
    """``|x`` to ``|1=x``: also what an editor shows as inlay hints."""
    anon = nodes.filter((F.col("type") == "parameter") & (F.try_element_at("props", F.lit("anon")) == "true") & (F.element_at("anc", -1)["type"] == "template"))
    return anon.select("page_id", edit(F.col("start"), F.col("start"), F.concat("name", F.lit("="))).alias("edit"))


def fix_duplicate_arguments(nodes: DataFrame) -> DataFrame:
    """Drop all but the last of arguments with one key where the values agree or the earlier is empty."""
    from pyspark.sql import Window

    args = nodes.filter((F.col("type") == "parameter") & (F.element_at("anc", -1)["type"] == "template"))
    value = F.try_element_at("props", F.lit("value"))
    w = Window.partitionBy("page_id", "parent_id", "name").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    args = args.withColumns({"_v": F.trim(value)}).withColumns({"_last": F.last("_v").over(w), "_at": F.max("start").over(w)})
    gone = args.filter((F.col("start") < F.col("_at")) & ((F.col("_v") == F.col("_last")) | (F.col("_v") == "")))
    return gone.select("page_id", edit(F.col("start") - 1, F.col("end"), "").alias("edit"))


def set_link_target(nodes: DataFrame, old: str, new: str) -> DataFrame:
    found = nodes.filter(F.col("type").isin("link", "category", "file") & (F.try_element_at("props", F.lit("target")) == old))
    return replace_with(_part(nodes, found, "link-target"), new)


def set_attribute(nodes: DataFrame, tag: str, key: str, value: str) -> DataFrame:
    tags = nodes.filter((F.col("type") == "html") & (F.col("name") == tag) & (F.try_element_at("props", F.lit("closing")) == "false"))
    with_it = tags.filter(F.map_contains_key("attrs", key))
    attrs = nodes.filter((F.col("type") == "html-attr") & (F.col("name") == key)).join(
        with_it.select("page_id", F.col("node_id").alias("_id"), F.col("last_id").alias("_last")).withColumnRenamed("page_id", "_p"),
        (F.col("page_id") == F.col("_p")) & (F.col("node_id") > F.col("_id")) & (F.col("node_id") <= F.col("_last")), "left_semi",
    )
    added = tags.filter(~F.map_contains_key("attrs", key)).select("page_id", edit(F.col("start") + 1 + len(tag), F.col("start") + 1 + len(tag), f' {key}="{value}"').alias("edit"))
    return replace_with(attrs, f'{key}="{value}"').unionByName(added)


def set_heading_level(nodes: DataFrame, level: int) -> DataFrame:
    marks = "=" * level
    heads = nodes.filter(F.col("type") == "heading")
    return heads.select("page_id", edit(F.col("start"), F.col("inner_start"), marks).alias("edit")).unionByName(
        heads.select("page_id", edit(F.col("inner_end"), F.col("inner_end") + F.try_element_at("props", F.lit("level")).cast("int"), marks).alias("edit"))
    )


def first_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """page_id, at: the first offset at which two versions of a page differ (null if they don't)."""
    met = before.select("page_id", F.col("text").alias("a")).join(after.select("page_id", F.col("text").alias("b")), "page_id", "full")
    n = F.least(F.length("a"), F.length("b"))
    # Binary search by equality of prefixes: log2 of the length steps of native code.
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
            F.left(F.col("a"), F.ceil((s["lo"] + s["hi"]) / 2).cast("int")) == F.left(F.col("b"), F.ceil((s["lo"] + s["hi"]) / 2).cast("int")),
            F.struct(F.ceil((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), (F.ceil((s["lo"] + s["hi"]) / 2) - 1).cast("int").alias("hi"))),
    )
    return met.select("page_id", F.when(F.col("a") == F.col("b"), F.lit(None)).otherwise(F.coalesce(bounds["lo"], F.lit(0))).cast("int").alias("at"))


def checkpoint_nodes(nodes: DataFrame) -> DataFrame:
    """Parse once, query often: the node table in the shared folder."""
    return materialise(nodes, "nodes")


# -- more edits of calls, links, attributes and other nodes


def _rows(found: DataFrame, start: Column, end: Column, text: Column | str) -> DataFrame:
    return found.select("page_id", edit(start, end, text).alias("edit"))


def add_anonymous_argument(nodes: DataFrame, name: str, value: str) -> DataFrame:
    """One more argument without a name; a value with an equals sign gets the magic word for it."""
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name))
    return _rows(calls, F.col("end") - 2, F.col("end") - 2, "|" + value.replace("|", "{{!}}").replace("=", "{{=}}"))


def substitute(nodes: DataFrame, name: str, safe: bool = False) -> DataFrame:
    """``subst:`` or ``safesubst:`` before the name of every call."""
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name) & F.try_element_at("props", F.lit("modifier")).isNull())
    named = _part(nodes, calls, "template-name")
    return _rows(named, F.col("start"), F.col("start"), "safesubst:" if safe else "subst:")


def rename_argument(nodes: DataFrame, name: str, old: str, new: str) -> DataFrame:
    """Another key for an argument; those without a name get one."""
    calls = nodes.filter((F.col("type") == "template") & (F.col("name") == name)).select("page_id", F.col("node_id").alias("parent_id"))
    have = nodes.filter((F.col("type") == "parameter") & (F.col("name") == old)).join(calls, ["page_id", "parent_id"], "left_semi")
    anon = F.try_element_at("props", F.lit("anon")) == "true"
    return _rows(have.filter(anon), F.col("start"), F.col("start"), f"{new}=").unionByName(replace_with(_part(nodes, have.filter(~anon), "parameter-key"), new))


def replace_module(nodes: DataFrame, old: str, new: str, function: str | None = None) -> DataFrame:
    """Another module, and maybe function, in ``#invoke``."""
    calls = nodes.filter((F.col("type") == "magic-word") & (F.col("name") == "invoke") & (F.trim(F.try_element_at("attrs", F.lit("1"))) == old)).select("page_id", F.col("node_id").alias("parent_id"))
    args = nodes.filter(F.col("type") == "parameter").join(calls, ["page_id", "parent_id"], "left_semi")
    out = replace_with(_part(nodes, args.filter(F.col("name") == "1"), "parameter-value"), new)
    return out if function is None else out.unionByName(replace_with(_part(nodes, args.filter(F.col("name") == "2"), "parameter-value"), function))


def renumber_duplicates(nodes: DataFrame) -> DataFrame:
    """Different values under one key ``x`` become ``x``, ``x2``, ``x3``, ...; equal and empty earlier ones go."""
    from pyspark.sql import Window

    args = nodes.filter((F.col("type") == "parameter") & (F.element_at("anc", -1)["type"] == "template") & (F.try_element_at("props", F.lit("anon")) == "false"))
    value = F.trim(F.try_element_at("props", F.lit("value")))
    w = Window.partitionBy("page_id", "parent_id", "name").orderBy("start")
    later = F.collect_set("_v").over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = args.withColumn("_v", value)
    rows = rows.withColumn("_gone", ((F.col("_v") == "") & (F.size(later) > 0)) | F.array_contains(later, F.col("_v")))
    k = F.row_number().over(Window.partitionBy("page_id", "parent_id", "name").orderBy("start"))
    kept = rows.filter("not _gone").withColumn("_k", k).filter("_k > 1")
    keys = nodes.filter(F.col("type") == "parameter-key").select("page_id", F.col("parent_id").alias("node_id"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    named = kept.join(keys, ["page_id", "node_id"])
    return _rows(rows.filter("_gone"), F.col("start") - 1, F.col("end"), "").unionByName(_rows(named, F.col("_a"), F.col("_b"), F.concat("name", F.col("_k").cast("string"))))


def set_link_text(nodes: DataFrame, target: str, text: str) -> DataFrame:
    """The text of links to a page; an empty one takes the text away."""
    found = nodes.filter((F.col("type") == "link") & (F.try_element_at("props", F.lit("target")) == target))
    texts = _part(nodes, found, "link-text")
    bare = found.join(texts.select("page_id", F.col("parent_id").alias("node_id")), ["page_id", "node_id"], "left_anti")
    if not text:
        return _rows(texts, F.col("start") - 1, F.col("end"), "")
    return replace_with(texts, text).unionByName(_rows(bare, F.col("end") - 2, F.col("end") - 2, f"|{text}"))


def set_fragment(nodes: DataFrame, target: str, fragment: str | None) -> DataFrame:
    """The section that links to a page lead to, or none."""
    from markloom.functions.text import encode_fragment

    found = nodes.filter((F.col("type") == "link") & (F.try_element_at("props", F.lit("target")) == target))
    targets = _part(nodes, found, "link-target")
    tail = F.lit("") if fragment is None else F.concat(F.lit("#"), encode_fragment(F.lit(fragment)))
    return replace_with(targets, F.concat(F.split_part("text", F.lit("#"), F.lit(1)), tail))


def self_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Links of pages to their own sections, written without the title."""
    own = pages.select("page_id", normalise(F.col("title"))["title"].alias("_title"))
    found = nodes.filter((F.col("type") == "link") & F.try_element_at("props", F.lit("fragment")).isNotNull()).join(own, "page_id")
    mine = found.filter(F.try_element_at("props", F.lit("target")) == F.col("_title"))
    fragments = mine.select("page_id", F.col("node_id").alias("parent_id"), F.try_element_at("props", F.lit("fragment")).alias("_f"))
    return replace_with(nodes.filter(F.col("type") == "link-target").join(fragments, ["page_id", "parent_id"]), F.concat(F.lit("#"), "_f"))


def pipe_links(nodes: DataFrame) -> DataFrame:
    """``[[a (b)|]]``, as it is after the pipe trick: links with an empty text get the short one."""
    from markloom.functions.titles import pipe_trick

    targets = nodes.filter(F.col("type") == "link-target").select("page_id", "parent_id", F.col("text").alias("_t"))
    empty = nodes.filter((F.col("type") == "link-text") & (F.col("start") == F.col("end"))).join(targets, ["page_id", "parent_id"])
    return replace_with(empty, pipe_trick(F.col("_t")))


def set_sort_key(nodes: DataFrame, category: str, key: str) -> DataFrame:
    found = nodes.filter((F.col("type") == "category") & (F.col("name") == category))
    texts = _part(nodes, found, "link-text")
    bare = found.join(texts.select("page_id", F.col("parent_id").alias("node_id")), ["page_id", "node_id"], "left_anti")
    return replace_with(texts, key).unionByName(_rows(bare, F.col("end") - 2, F.col("end") - 2, f"|{key}"))


def remove_attribute(nodes: DataFrame, tag: str, key: str) -> DataFrame:
    """An attribute and the blank before it."""
    found = nodes.filter((F.col("type") == "html-attr") & (F.col("name") == key) & (F.try_element_at("props", F.lit("tag")) == tag))
    return _rows(found, F.col("start") - 1, F.col("end"), "")


def rename_attribute(nodes: DataFrame, tag: str, old: str, new: str) -> DataFrame:
    found = nodes.filter((F.col("type") == "html-attr") & (F.col("name") == old) & (F.try_element_at("props", F.lit("tag")) == tag))
    return replace_with(_part(nodes, found, "attr-key"), new)


def toggle_attribute(nodes: DataFrame, tag: str, key: str) -> DataFrame:
    """Attributes without a value: taken away where they are, put in where not."""
    tags = nodes.filter((F.col("type") == "html") & (F.col("name") == tag) & (F.try_element_at("props", F.lit("closing")) == "false"))
    added = tags.filter(~F.map_contains_key("attrs", key))
    return remove_attribute(nodes, tag, key).unionByName(_rows(added, F.col("start") + 1 + len(tag), F.col("start") + 1 + len(tag), f" {key}"))


def replace_tag(nodes: DataFrame, matched: DataFrame, old: str, new: str) -> DataFrame:
    """Another name for matched pairs of tags: ``matched`` is that of ``structure.matched_tags``."""
    pairs = matched.filter(F.col("partner_id").isNotNull() & (F.col("name") == old)).select("page_id", "node_id")
    tags = nodes.filter((F.col("type") == "html") & (F.col("name") == old)).join(pairs, ["page_id", "node_id"], "left_semi")
    a = F.col("start") + F.when(F.try_element_at("props", F.lit("closing")) == "true", 2).otherwise(1)
    return _rows(tags, a, a + len(old), new)


def set_image_option(nodes: DataFrame, option: str, text: str) -> DataFrame:
    """``text``, such as ``alt=a``, in place of a file's option, or added to it."""
    return edits_at(nodes, *image_option(option, text))


def image_option(option: str, text: str) -> tuple[Column, Column]:
    """The edits of ``set_image_option``, for ``edits_at``: a file has those options as attributes that are among its parts."""
    have = (F.col("type") == "image-parameter") & (F.col("name") == option) & (F.try_element_at("anc", F.lit(-1))["type"] == "file")
    bare = (F.col("type") == "file") & ~F.map_contains_key("attrs", option)
    return F.when(have, edit(F.col("start"), F.col("end"), text)), F.when(bare, edit(F.col("end") - 2, F.col("end") - 2, f"|{text}"))


def indent_lists(nodes: DataFrame, mark: str = ":") -> DataFrame:
    """One level more for every list line."""
    lists = nodes.filter(F.col("type") == "list")
    return _rows(lists, F.col("start"), F.col("start"), mark)


def wrap(found: DataFrame, before: str, after: str) -> DataFrame:
    """Text around nodes."""
    return insert_before(found, before).unionByName(insert_after(found, after))


def unwrap(nodes: DataFrame, matched: DataFrame, tag: str) -> DataFrame:
    """Matched pairs of a tag go, what they hold stays."""
    pairs = matched.filter(F.col("partner_id").isNotNull() & (F.col("name") == tag)).select("page_id", "node_id")
    return remove(nodes.filter(F.col("type") == "html").join(pairs, ["page_id", "node_id"], "left_semi"))
