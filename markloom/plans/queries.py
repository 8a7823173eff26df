"""Registered queries over rendered wiki pages and the SQL that gives the same rows from the columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.config import DEFAULT
from markloom.functions import magic, titles
from markloom.functions import text as small
from markloom.operators import editor, lint, structure
from markloom.plans import text as pages_text
from markloom.plans.parse import parse
from markloom.plans.registry import QUERIES, SQL, query
from markloom.plans.select import find, select
from markloom.sources import fixtures as fx
from markloom.streaming import revisions

#: What sections are made from.
HEADINGS = ["node_id", "type", "start", "end", "props"]


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("text"))


# -- parsing


@query("SELECT n_nationkey::BIGINT AS page_id, n_name AS name, r_name AS region, n_nationkey::VARCHAR AS first FROM nation JOIN region ON n_regionkey = r_regionkey")
def infobox_args(spark, d):
    calls = select(parse(fx.nations(spark, d), types=["template"], last="brace", columns=["node_id", "type", "name", "attrs"]), "template#Template:Infobox nation")
    return calls.select("page_id", *[F.try_element_at("attrs", F.lit(k)).alias(a) for k, a in (("name", "name"), ("region", "region"), ("1", "first"))])


@query("SELECT page_id, length(html)::BIGINT AS n_chars, md5(html) AS digest FROM pages")
def roundtrip(spark, d):
    leaves = parse(html_pages(spark, d), types=["text"], columns=["start", "type", "data"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "data"))), lambda x: x["data"]), "")
    return leaves.groupBy("page_id").agg(text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query(r"""
SELECT name, count(*)::BIGINT AS n FROM (
  SELECT unnest(regexp_extract_all(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '</?(p|li|b|br|ul|div|h1)(?:\s[^<>]*)?/?>', 1)) AS name FROM pages
) GROUP BY name
""")
def node_counts_html(spark, d):
    nodes = parse(html_pages(spark, d), types=["html"], last="html", columns=["type", "name"])
    return nodes.filter(F.col("name").isin("p", "li", "b", "br", "ul", "div", "h1")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<!--[\s\S]*?-->'))::BIGINT AS n, list_sum([length(c) FOR c IN regexp_extract_all(html, '<!--[\s\S]*?-->')])::BIGINT AS chars FROM pages WHERE contains(html, '<!--')")
def html_comments(spark, d):
    nodes = parse(html_pages(spark, d), types=["comment"], last="ext", columns=["type", "start", "end"])
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


@query("SELECT c_mktsegment AS segment, count(*)::BIGINT AS n_calls, count(DISTINCT c_custkey)::BIGINT AS n_pages FROM customer GROUP BY 1")
def template_call_counts(spark, d):
    nodes = parse(fx.customers(spark, d), types=["template"], last="brace", columns=["type", "name", "attrs"])
    return nodes.filter(F.col("name") == "Template:Segment").groupBy(F.try_element_at("attrs", F.lit("1")).alias("segment")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("page_id").alias("n_pages"))


@query("SELECT n_nationkey::BIGINT AS page_id, 'Category:' || r_name AS category, n_name AS sort_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_members(spark, d):
    found = structure.links(parse(fx.nations(spark, d), types=["category"]))
    return found.select("page_id", F.col("target").alias("category"), "sort_key")


@query("""
SELECT target, count(*)::BIGINT AS n_links FROM (
  SELECT r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Category:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Region ' || n_regionkey FROM nation
) GROUP BY target
""")
def link_graph_degree(spark, d):
    return structure.link_degree(structure.links(parse(fx.nations(spark, d), types=["link"]))).select("target", "n_links")


@query("SELECT p_partkey AS page_id, replace(p_brand, '#', ' ') || ' (brand)' AS resolved FROM part")
def redirect_resolve(spark, d):
    moved = parse(fx.redirects(spark, d), types=["redirect"], last="redirect", columns=["type", "props"]).join(fx.redirects(spark, d).select("page_id", "title"), "page_id")
    table = moved.select(F.col("title").alias("from_title"), F.try_element_at("props", F.lit("target")).alias("to_title"))
    found = structure.links(parse(fx.parts(spark, d), types=["link"]))
    return structure.resolve_redirects(found, table).select("page_id", "resolved")


@query("SELECT p_partkey AS page_id, 'File:' || upper(p_name[1]) || replace(p_name[2:], '_', ' ') || '.png' AS target, p_size::VARCHAR AS width, p_type AS alt, p_name AS caption FROM part")
def file_options(spark, d):
    files = parse(fx.parts(spark, d), types=["file"], columns=["type", "attrs", "props"])
    return files.select("page_id", structure.prop("target").alias("target"), *[structure.attr(k).alias(k) for k in ("width", "alt", "caption")])


@query("""
SELECT p_partkey AS page_id, kind, url FROM (
  SELECT p_partkey, 'ext-link' AS kind, 'http://example.org/' || p_partkey AS url FROM part
  UNION ALL SELECT p_partkey, 'free-ext-link', 'http://example.org/p?id=' || p_partkey FROM part)
""")
def external_links(spark, d):
    return parse(fx.parts(spark, d), types=["ext-link", "free-ext-link"], columns=["type", "props"]).select("page_id", F.col("type").alias("kind"), structure.prop("url").alias("url"))


@query("SELECT n_nationkey::BIGINT AS page_id, 'the map' AS text, 'Region ' || n_regionkey AS target, 'Map' AS fragment FROM nation")
def link_text(spark, d):
    nodes = parse(fx.nations(spark, d), types=["link", "link-text"], columns=["node_id", "parent_id", "type", "text", "props"])
    texts = nodes.filter(F.col("type") == "link-text").select("page_id", F.col("parent_id").alias("node_id"), "text")
    return nodes.filter(F.col("type") == "link").drop("text").join(texts, ["page_id", "node_id"]).select("page_id", "text", structure.prop("target").alias("target"), structure.prop("fragment").alias("fragment"))


@query("SELECT n_nationkey::BIGINT AS page_id, 'NATION bold' AS what, 'open' AS first, 'close' AS last FROM nation UNION ALL SELECT n_nationkey, 'italic', 'open', 'close' FROM nation")
def apostrophe_pairs(spark, d):
    nodes = parse(fx.nations(spark, d), types=["quote", "text"])
    state = editor.bold_italic(nodes)
    both = state.filter("bold is not null").select("page_id", "node_id", F.lit("NATION bold").alias("what"), F.col("bold").alias("s")).unionByName(
        state.filter("italic is not null").select("page_id", "node_id", F.lit("italic").alias("what"), F.col("italic").alias("s"))
    )
    return both.groupBy("page_id", "what").agg(F.min_by("s", "node_id").alias("first"), F.max_by("s", "node_id").alias("last"))


# -- selectors

_LINES = "SELECT l_orderkey AS page_id, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || ' || ' || l_returnflag) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


def _selector(name: str, source: Callable, selector: str, sql: str) -> None:
    """Counts of matches per page."""

    def fn(spark, d):
        return find(source(spark, d), selector, ["node_id"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], SQL[name] = fn, sql


_selector("selector_child", fx.orders, "table > tr", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_descendant", fx.orders, "table td-inner", "SELECT l_orderkey AS page_id, (3 * count(*) + 3)::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_adjacent", fx.orders, "tr + tr", "SELECT l_orderkey AS page_id, (count(*) - 1)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
_selector("selector_sibling", fx.orders, "td[subtype=th] ~ tr", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_nth", fx.orders, "tr:nth-of-type(2n+1)", "SELECT l_orderkey AS page_id, ((count(*) + 1) // 2)::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_first_last", fx.orders, "tr:first-of-type, tr:last-of-type", "SELECT l_orderkey AS page_id, least(count(*), 2)::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_attr", fx.orders, "td[style$=\"1\"], table[class~=wikitable]", "SELECT l_orderkey AS page_id, (1 + count(*) FILTER (l_linenumber % 10 = 1))::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_has", fx.orders, "tr:has(td[style$=\"2\"])", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber % 10 = 2 GROUP BY 1")
_selector("selector_not", fx.orders, "tr:not(:has(td[style$=\"2\"]))", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber % 10 <> 2 GROUP BY 1")
_selector("selector_is", fx.orders, "td:is([subtype=th], [style*=\"0\"])", "SELECT l_orderkey AS page_id, (2 + count(*))::BIGINT AS n FROM lineitem GROUP BY 1")
_selector("selector_contains", fx.orders, "td-inner:contains('A')", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
_selector("selector_regex", fx.orders, "td:regex('style, /0[13]$/')", "SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem WHERE l_linenumber % 10 IN (1, 3) GROUP BY 1")
_selector("selector_lang", fx.customers, "html:lang(en)", "SELECT c_custkey AS page_id, 1::BIGINT AS n FROM customer WHERE c_custkey % 3 = 0")
_selector("selector_header", fx.customers, ":header", "SELECT c_custkey AS page_id, 4::BIGINT AS n FROM customer")
_selector("selector_any_link", fx.parts, ":any-link", "SELECT p_partkey AS page_id, 4::BIGINT AS n FROM part")
_selector("selector_root_empty", fx.customers, "root, ext[selfclosing=\"true\"]:empty, ext:not(:parent)", "SELECT c_custkey AS page_id, 1::BIGINT AS n FROM customer")


@query("SELECT l_orderkey AS page_id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def closest_row(spark, d):
    nodes = parse(fx.orders(spark, d), types=["table-attr", "tr"], columns=["node_id", "last_id", "depth", "type", "name", "anc"])
    start = nodes.filter((F.col("type") == "table-attr") & (F.col("name") == "style"))
    from markloom.plans.select import closest

    # Dealt by page first, as rows dealt by page and node would be dealt again for the counts of pages.
    return closest(nodes, start, "tr").select("page_id", "closest_id").repartition("page_id").groupBy("page_id").agg(F.count_distinct("closest_id").alias("n"))


# -- structure


@query("""
SELECT c_custkey AS page_id, k AS section_no, level, heading, parent, n_chars FROM (
  SELECT c_custkey, 1 AS k, 2 AS level, 'Account' AS heading, NULL AS parent,
         length('== Account ==' || chr(10) || '* nation ' || c_nationkey || chr(10) || '* key ' || c_custkey || chr(10) || '** sub' || chr(10)) + length('=== Details ===' || chr(10) || 'Text<ref name="s">' || c_mktsegment || '</ref> and<ref>n' || c_nationkey || '</ref> again<ref name="s"/>.' || chr(10)) AS n_chars FROM customer
  UNION ALL SELECT c_custkey, 2, 3, 'Details', 'Account', length('=== Details ===' || chr(10) || 'Text<ref name="s">' || c_mktsegment || '</ref> and<ref>n' || c_nationkey || '</ref> again<ref name="s"/>.' || chr(10)) FROM customer
  UNION ALL SELECT c_custkey, 3, 2, c_mktsegment, NULL, length('== ' || c_mktsegment || ' ==' || chr(10)) + CASE WHEN c_custkey % 3 = 0 THEN length('<div lang="en"><span class="a b">x</span></div>') ELSE length('<div lang="de"><p>y</p></div>') END + 1 + length('=== Details ===' || chr(10) || '<references/>' || chr(10)) + CASE WHEN c_custkey % 5 = 0 THEN 36 ELSE 19 END FROM customer
  UNION ALL SELECT c_custkey, 4, 3, 'Details', c_mktsegment, length('=== Details ===' || chr(10) || '<references/>' || chr(10)) + CASE WHEN c_custkey % 5 = 0 THEN 36 ELSE 19 END FROM customer)
""")
def sections_outline(spark, d):
    pages = fx.customers(spark, d)
    found = structure.sections(parse(pages, types=["heading", "root"], last="brace", columns=HEADINGS))
    return found.select("page_id", "section_no", "level", "heading", F.col("parent_heading").alias("parent"), (F.col("end") - F.col("start")).cast("long").alias("n_chars"))


@query("SELECT c_custkey AS page_id, unnest(['Account', 'Details', c_mktsegment, 'Details_2']) AS anchor FROM customer")
def section_anchors(spark, d):
    pages = fx.customers(spark, d)
    return structure.anchors(structure.sections(parse(pages, types=["heading", "root"], last="brace", columns=HEADINGS))).select("page_id", "anchor")


@query("""
SELECT c_custkey AS page_id, name, number, use_no FROM (SELECT c_custkey, 's' AS name, 1 AS number, 1 AS use_no FROM customer
  UNION ALL SELECT c_custkey, NULL, 2, 1 FROM customer UNION ALL SELECT c_custkey, 's', 1, 2 FROM customer)
""")
def ref_numbers(spark, d):
    return structure.references(parse(fx.customers(spark, d), types=["ext"])).select("page_id", "name", "number", "use_no")


@query("SELECT c_custkey AS page_id, 2::BIGINT AS n_uses, 1::BIGINT AS n_definitions FROM customer")
def ref_definitions(spark, d):
    found = editor.reference_definitions(parse(fx.customers(spark, d), types=["ext"]))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_uses"), F.count_distinct("definition_id").alias("n_definitions"))


@query(f"""
SELECT page_id, y::INTEGER AS y, x, value FROM (
  SELECT page_id, k AS y, 0 AS x, l_linenumber::VARCHAR AS value FROM ({_LINES})
  UNION ALL SELECT page_id, k, 1, l_partkey::VARCHAR FROM ({_LINES})
  UNION ALL SELECT page_id, k, 2, l_returnflag FROM ({_LINES})
  UNION ALL SELECT DISTINCT l_orderkey, 0, 0, 'line' FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 0, 1, 'part and flag' FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 0, 2, 'part and flag' FROM lineitem)
""")
def table_grid(spark, d):
    nodes = parse(fx.orders(spark, d), types=["td", "td-inner"], columns=["node_id", "parent_id", "type", "text", "attrs", "props", "anc"])
    return structure.table_cells(nodes, values=True).select("page_id", "y", "x", "value")


@query("SELECT c_custkey AS page_id, 'Category:Gold' AS category, 2::BIGINT AS n FROM customer WHERE c_custkey % 5 = 0")
def dup_categories(spark, d):
    cats = parse(fx.customers(spark, d), types=["category"], columns=["type", "name"])
    return cats.groupBy("page_id", F.col("name").alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT c_custkey AS page_id, 'key' AS key, 'b' AS value, 2::BIGINT AS n FROM customer WHERE c_custkey % 4 = 0")
def dup_args(spark, d):
    pages = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 4 == 0, "{{T|key=a|key = b }}").otherwise("{{T|key=a}}").alias("text"))
    args = structure.arguments(parse(pages, types=["parameter"], last="brace"))
    return structure.effective_arguments(args).join(structure.duplicate_arguments(args).select("page_id", "call_id", "key"), ["page_id", "call_id", "key"]).select("page_id", "key", "value", "n")


@query("SELECT c_custkey AS page_id, name, 2::BIGINT AS n FROM customer, (SELECT unnest(['div', 'span', 'p']) AS name) WHERE name = 'div' OR (name = 'span') = (c_custkey % 3 = 0)")
def matched_tags(spark, d):
    found = structure.matched_tags(parse(fx.customers(spark, d), types=["html"]))
    return found.filter("partner_id is not null").groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS page_id, unnest([1, 2, 3, 4, 6]) AS line, unnest([0, 0, 0, 0, 4]) AS col FROM customer")
def line_col(spark, d):
    pages = fx.customers(spark, d)
    nodes = parse(pages, types=["heading", "list", "ext"], columns=["type", "start", "line", "col"])
    first = nodes.groupBy("page_id", "type").agg(F.array_sort(F.collect_list(F.struct("start", "line", "col"))).alias("s"))
    some = first.select("page_id", F.explode(F.when(F.col("type") == "list", F.col("s")).otherwise(F.slice("s", 1, 1))).alias("s"))
    return some.select("page_id", "s.line", "s.col")


@query(SQL["line_col"])
def offset_to_position(spark, d):
    """The same positions from offsets alone."""
    pages = fx.customers(spark, d)
    nodes = parse(pages, types=["heading", "list", "ext"], columns=["type", "start"])
    first = nodes.groupBy("page_id", "type").agg(F.array_sort(F.collect_list("start")).alias("s"))
    some = first.select("page_id", F.explode(F.when(F.col("type") == "list", F.col("s")).otherwise(F.slice("s", 1, 1))).alias("start"))
    return structure.positions(some, pages).select("page_id", "line", "col")


@query("SELECT c_custkey AS page_id, line, col, CASE WHEN col > len(l[line + 1]) OR line >= len(l) THEN NULL ELSE coalesce(list_sum([len(x) + 1 FOR x IN l[1:line]]), 0) + col END::INTEGER AS at FROM (SELECT c_custkey, ['{{Segment|' || c_mktsegment || '}}', '== Account ==', '* nation ' || c_nationkey] AS l, unnest([1, 2, 2, 0]) AS line, unnest([0, 3, 90, 2]) AS col FROM customer)")
def position_to_offset(spark, d):
    pages = fx.customers(spark, d)
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("line"), F.lit(b).alias("col")) for a, b in ((1, 0), (2, 3), (2, 90), (0, 2))])).alias("p")
    return structure.offsets(pages.select("page_id", asked).select("page_id", "p.line", "p.col"), pages)


@query(f"SELECT page_id, '#aabb0' || (l_linenumber % 10) AS colour, 170 AS red, 187 AS green, (l_linenumber % 10)::INTEGER AS blue FROM ({_LINES})")
def style_colours(spark, d):
    found = editor.colours(parse(fx.orders(spark, d), types=["table-attr"]))
    return found.select("page_id", "colour", "red", "green", "blue")


@query("SELECT c_mktsegment AS hint_page, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def inlay_hints(spark, d):
    pages = fx.customers(spark, d)
    hints = editor.inlay_hints(parse(pages, types=["parameter"], last="brace")).filter(F.col("hint") == "1=")
    segment = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("hint_page"))
    return hints.join(segment, "page_id").groupBy("hint_page").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS page_id, 0 AS start_line, (3 + 2 * count(*))::INTEGER AS end_line FROM lineitem GROUP BY 1")
def folding_ranges(spark, d):
    pages = fx.orders(spark, d)
    return editor.folding_ranges(parse(pages, types=["table", "heading", "root"], last="table", columns=[*HEADINGS, "line", "end_line"])).select("page_id", "start_line", "end_line")


@query("SELECT c_custkey AS page_id, unnest(['1', '1.1', '2', '2.1']) AS number, unnest(['Account', 'Details', c_mktsegment, 'Details']) AS heading FROM customer")
def toc(spark, d):
    pages = fx.customers(spark, d)
    found = structure.sections(parse(pages, types=["heading", "root"], last="brace", columns=HEADINGS))
    return structure.contents(found).select("page_id", "number", "heading")


@query("SELECT l_orderkey AS page_id, (2 * count(*) + 5)::BIGINT AS n_lines FROM lineitem GROUP BY 1")
def text_lines(spark, d):
    return structure.lines(fx.orders(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""
SELECT page_id, '{{| class="wikitable"' || chr(10) || '|+ Order ' || page_id || chr(10) || '|-' || chr(10) || '! colspan=2 | part and flag' || chr(10) || '! line' || chr(10) || string_agg('|-' || chr(10) || '| ' || l_partkey || chr(10) || '| ' || l_linenumber || chr(10) || '| style="color:#aabb0' || (l_linenumber % 10) || '" | ' || l_returnflag, chr(10) ORDER BY k) || chr(10) || '|}}' AS text
FROM ({_LINES}) GROUP BY 1
""")
def table_edit(spark, d):
    rows = structure.tables_as_rows(parse(fx.orders(spark, d), types=["td", "td-inner", "table-attrs"], columns=["node_id", "parent_id", "type", "text", "props", "anc"]))
    return structure.write_tables(structure.move_column(rows, 1, 0)).select("page_id", "text")


@query("SELECT p_name AS name, p_partkey AS page_id, 'link-target' AS type FROM part")
def node_at_offset(spark, d):
    pages = fx.parts(spark, d)
    points = pages.select("page_id", F.lit(5).alias("at"))
    at = editor.node_at(parse(pages), points)
    return at.join(pages.select("page_id", F.col("title").alias("name")), "page_id").select("name", "page_id", "type")


@query("SELECT 'Template:Segment' AS name, count(*)::BIGINT AS n FROM customer")
def name_completions(spark, d):
    return editor.completions(parse(fx.customers(spark, d), types=["template"], last="brace"), "template", "template:se")


@query("SELECT n_nationkey::BIGINT AS page_id, n_nationkey || '/b/c' AS parts, n_nationkey || '/x' AS path, 'Some_' || n_nationkey AS anchor, 'a_b%26' || n_nationkey AS wiki, n_nationkey % 2 = 0 AS isbn FROM nation")
def magic_paths(spark, d):
    key = fx.c("n_nationkey")
    isbn = F.when(F.col("n_nationkey") % 2 == 0, "9780306406157").otherwise("9780306406158")
    return fx.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("page_id"), magic.titleparts(F.concat(key, F.lit("/b/c/d")), F.lit(3), F.lit(0)).alias("parts"), magic.rel2abs(F.lit("../x"), F.concat(key, F.lit("/y"))).alias("path"),
        magic.anchorencode(F.concat(F.lit("''Some'' "), key)).alias("anchor"), magic.urlencode(F.concat(F.lit("a b&"), key), "WIKI").alias("wiki"), magic.isbn_valid(isbn).alias("isbn"),
    )


@query("""
SELECT n_nationkey::BIGINT AS page_id, '&lt;b&gt; &amp; ' || n_name AS escaped, 'a{{!}}b{{=}}' || n_nationkey AS wiki, 'A' || n_nationkey || 'é' AS decoded, n_nationkey || 'px' AS width, 'width: 1px; color: red' AS styled,
       n_nationkey % 2 = 0 AS classed, 'Hello ' || n_name || '!' AS message, 3 AS offset16 FROM nation
""")
def text_functions(spark, d):
    key, name = fx.c("n_nationkey"), fx.c("n_name")
    return fx.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("page_id"), small.escape_html(F.concat(F.lit("<b> & "), name)).alias("escaped"), small.escape_wikitext(F.concat(F.lit("a|b="), key)).alias("wiki"),
        small.decode_numeric(F.concat(F.lit("&#65;"), key, F.lit("&#xE9;"))).alias("decoded"), small.css(F.concat(F.lit("color: red; WIDTH : 1px; width:"), key, F.lit("px;")), "width").alias("width"),
        small.set_css(F.lit("color: blue; width: 1px;"), "color", "red").alias("styled"), small.has_class(F.when(F.col("n_nationkey") % 2 == 0, " a b ").otherwise("ab"), "b").alias("classed"),
        small.message(F.lit("Hello $1!"), name).alias("message"), small.utf16_offset(F.lit("𝒳yz"), F.lit(2)).alias("offset16"),
    )


@query("SELECT n_nationkey::BIGINT AS page_id, CASE n_nationkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'zh-cn' WHEN 2 THEN 'A,H' ELSE 'S' END AS flags FROM nation")
def converter_flags(spark, d):
    k = F.col("n_nationkey")
    body = F.when(k % 4 == 0, "-{R|x}-").when(k % 4 == 1, "-{zh-cn;A|x}-").when(k % 4 == 2, "-{A;H|zh-cn:a;zh-tw:b}-").otherwise("-{x}-")
    pages = fx.read(spark, d, "nation").select(k.cast("long").alias("page_id"), body.alias("text"))
    codes = ["zh-cn", "zh-tw"]
    nodes = parse(pages, replace(DEFAULT, variants=tuple(codes)), types=["converter"], columns=["type", "props"])
    flags = F.coalesce(F.split(structure.prop("flags"), ";"), F.array().cast("array<string>"))
    return nodes.select("page_id", F.array_join(F.array_sort(small.effective_flags(flags, codes)), ",").alias("flags"))


@query("SELECT n_nationkey::BIGINT AS page_id, 1::BIGINT AS n FROM nation WHERE n_nationkey % 3 = 0")
def selector_local_link(spark, d):
    k = F.col("n_nationkey")
    pages = fx.read(spark, d, "nation").select(k.cast("long").alias("page_id"), F.when(k % 3 == 0, "[[#Top]] [[A#Top]]").otherwise("[[A]]").alias("text"))
    return select(parse(pages), ":local-link").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, length(html)::BIGINT AS n FROM pages")
def json_trees(spark, d):
    out = pages_text.to_json(html_pages(spark, d))
    return out.select("page_id", F.get_json_object("json", "$.range[1]").cast("long").alias("n"))


# -- lint


@query(
    "SELECT rule, severity, count(*)::BIGINT AS n FROM (SELECT unnest(rules).rule AS rule, unnest(rules).severity AS severity FROM (SELECT [{'rule': 'no-duplicate', 'severity': 'warning'}, {'rule': 'no-duplicate', 'severity': 'warning'}] AS rules FROM customer WHERE c_custkey % 5 = 0)) GROUP BY ALL"
)
def lint_rollup(spark, d):
    pages = fx.customers(spark, d).withColumns({"ns": F.lit(0), "include": F.lit(False)})
    found = lint.lint(parse(pages), pages, rules=["no-duplicate", "unclosed-table", "h1", "no-arg", "nested-link"])
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def _lint(rule: str) -> None:
    """Reports of one rule over pages with one fault each: page, key, count."""

    def fn(spark, d):
        pages = fx.faults(spark, d)
        found = lint.lint(parse(pages), pages, rules=[rule])
        return found.groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n"))

    name = "lint_" + rule.replace("-", "_")
    QUERIES[name] = fn
    SQL[name] = f"SELECT page_id, key, n FROM ({FAULT_ROWS}) WHERE rule = '{rule}'"


#: Every report of the pages with faults: page_id, rule, key, n.
FAULT_ROWS = " UNION ALL ".join(
    f"SELECT c_custkey AS page_id, '{rule}' AS rule, '{key}' AS key, {n}::BIGINT AS n FROM customer WHERE c_custkey % {len(fx.FAULTS)} = {k}" if (rule, key) != fx.COUNTED[1:] else
    f"SELECT c_custkey, '{rule}', '{key}', {n}::BIGINT + c_custkey % 4 FROM customer WHERE c_custkey % {len(fx.FAULTS)} = {k}"
    for k, (_, found) in enumerate(fx.FAULTS) for rule, key, n in found
)
_COUNTED_ALREADY = ", ".join(str(k) for k, (_, found) in enumerate(fx.FAULTS) if any(f[:2] == fx.COUNTED[1:] for f in found))
FAULT_ROWS += f" UNION ALL SELECT c_custkey, '{fx.COUNTED[1]}', '{fx.COUNTED[2]}', c_custkey % 4 FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % {len(fx.FAULTS)} NOT IN ({_COUNTED_ALREADY})"


@query(f"SELECT rule, key, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_pages FROM ({FAULT_ROWS}) GROUP BY ALL")
def lint_all(spark, d):
    """All rules over pages with faults."""
    pages = fx.faults(spark, d)
    return lint.lint(parse(pages), pages).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query(f"SELECT CASE severity WHEN 0 THEN 'off' WHEN 1 THEN 'warning' ELSE 'error' END AS severity, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN rule = 'h1' AND key = 'html' THEN 0 WHEN rule = 'h1' THEN 2 WHEN rule = 'lonely-http' THEN 1 END AS severity, n FROM ({FAULT_ROWS}) WHERE rule IN ('h1', 'lonely-http') AND NOT (rule = 'lonely-http' AND key = 'PMID')) WHERE severity > 0 GROUP BY ALL")
def lint_severities(spark, d):
    pages = fx.faults(spark, d)
    found = lint.lint(parse(pages), pages, ["h1", "lonely-http"], severity={"h1": [2, {"html": "off"}], "lonely-http": {"PMID": 0}})
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_BARRED = "|".join(n for n in lint.BARRED if n not in DEFAULT.html | DEFAULT.ext)


@query(rf"SELECT page_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '<pre[\s\S]*?</pre>', '', 'g')), '</?(?:{_BARRED})[\s/>]')) AS t FROM pages) GROUP BY 1")
def lint_pages(spark, d):
    """All rules over the web pages; the barred opening tags of each."""
    pages = html_pages(spark, d)
    found = lint.lint(parse(pages), pages).filter((F.col("rule") == "tag-like") & (F.col("key") == "disallowed"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


for _rule in lint.RULES:
    _lint(_rule)


@query("SELECT c_custkey AS page_id, 'h1' AS rule FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, 'obsolete-tag' FROM customer, (SELECT unnest([1, 2])) WHERE c_custkey % 3 <> 1")
def lint_directives(spark, d):
    k = F.col("c_custkey")
    head = F.when(k % 3 == 0, "<!-- lint-disable h1 -->\n").when(k % 3 == 1, "<!-- lint-disable -->\n").otherwise("")
    pages = fx.read(spark, d, "customer").select(k.alias("page_id"), F.concat(head, F.lit("= x =\n<center>a</center>\n<!-- lint-enable -->\n<!-- lint-disable-next-line -->\n<tt>b</tt>")).alias("text"), F.lit(0).alias("ns"), F.lit(False).alias("include"))
    found = lint.lint(parse(pages), pages, rules=["h1", "obsolete-tag"])
    return found.select("page_id", "rule")


@query("SELECT c_custkey AS page_id, '== ' || c_name || ' ==' || chr(10) || '{|' || chr(10) || '| ' || c_nationkey || chr(10) || '|}' AS text, 2 AS n_fixed FROM customer")
def autofix_text(spark, d):
    pages = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), fx.text("= ", fx.c("c_name"), " =\n{|\n| ", fx.c("c_nationkey")).alias("text"), F.lit(0).alias("ns"), F.lit(False).alias("include"))
    found = lint.lint(parse(pages), pages, rules=["h1", "unclosed-table"])
    return lint.apply_fixes(pages, found)


# -- titles and functions


@query("""
SELECT n_nationkey::BIGINT AS page_id, 'Template:' || n_name || ' x' AS title, 10 AS ns, 'Sec tion' AS fragment, '/wiki/Template:' || replace(n_name, ' ', '_') || '_x' AS url, 'Template talk:' || n_name || ' x' AS talk, n_name || ' x' AS base,
       true AS valid FROM (SELECT n_nationkey, replace(n_name, '_', ' ') AS n_name FROM nation)
""")
def title_normalise(spark, d):
    raw = fx.text(" template : ", F.regexp_replace(fx.c("n_name"), "^N", "n"), "__x#Sec_tion")
    rows = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), titles.normalise(raw).alias("t"))
    return rows.select("page_id", F.col("t.title").alias("title"), F.col("t.ns").alias("ns"), F.col("t.fragment").alias("fragment"), titles.url(F.col("t.title")).alias("url"), titles.talk_page(F.col("t")).alias("talk"), titles.base_page(F.col("t")).alias("base"), F.col("t.valid").alias("valid"))


@query("SELECT c_custkey AS page_id, c_custkey % 4 = 0 AS valid FROM customer")
def title_validity(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, fx.text("Page ", fx.c("c_custkey"))).when(k % 4 == 1, "a<b").when(k % 4 == 2, "x/../y").otherwise("")
    return fx.read(spark, d, "customer").select(k.alias("page_id"), titles.normalise(raw)["valid"].alias("valid"))


@query("""
SELECT c_custkey AS page_id, lower(c_name) AS lc, upper(c_mktsegment) AS uc, lower(c_name[1]) || c_name[2:] AS lcfirst, CASE WHEN length(c_custkey::VARCHAR) < 8 THEN lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS padded,
       length(c_name)::INTEGER AS len, CASE WHEN instr(c_name, '#') > 0 THEN (instr(c_name, '#') - 1)::VARCHAR ELSE '' END AS pos, c_name[3:6] AS sub, (length(c_name) - length(replace(c_name, '0', '')))::INTEGER AS n_zero,
       replace(c_name, '#', '_') AS replaced, split_part(c_name, '#', 2) AS part, CASE WHEN c_nationkey = 1 THEN 'one' ELSE 'more' END AS plural, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'm' ELSE '?' END AS switch,
       CASE WHEN c_nationkey = 7 THEN 'y' ELSE 'n' END AS ifeq
FROM customer
""")
def magic_strings(spark, d):
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    return fx.read(spark, d, "customer").select(
        F.col("c_custkey").alias("page_id"), magic.lc(name).alias("lc"), magic.uc(F.col("c_mktsegment")).alias("uc"), magic.lcfirst(name).alias("lcfirst"), magic.padleft(key, F.lit(8)).alias("padded"), magic.length(name).alias("len"),
        magic.pos(name, F.lit("#")).alias("pos"), magic.sub(name, F.lit(2), F.lit(4)).alias("sub"), magic.count(name, F.lit("0")).alias("n_zero"), magic.replace(name, F.lit("#"), F.lit("_")).alias("replaced"), magic.explode(name, F.lit("#"), F.lit(1)).alias("part"),
        magic.plural(F.col("c_nationkey"), F.lit("one"), F.lit("more")).alias("plural"), magic.switch(F.col("c_mktsegment"), [(["BUILDING"], "b"), (["MACHINERY", "AUTOMOBILE"], "m")], "?").alias("switch"),
        magic.ifeq(F.col("c_nationkey").cast("string"), F.lit("7.0"), F.lit("y"), F.lit("n")).alias("ifeq"),
    )


@query("SELECT o_orderkey AS page_id, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%B') AS name, (dayofweek(o_orderdate))::VARCHAR AS dow, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def magic_clock(spark, d):
    t = F.col("o_orderdate")
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), *[magic.current(k, t).alias(a) for k, a in (("year", "y"), ("month", "m"), ("monthname", "name"), ("dow", "dow"), ("timestamp", "stamp"))])


# -- expansion, rendering, edits


@query("SELECT c_custkey AS page_id, 'Dear ' || c_name || ' (' || CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'ok' END || ') ' || (c_nationkey * 2 + 1) || ' ' || upper(c_mktsegment) AS text FROM customer")
def expand_template(spark, d):
    sign = F.when(F.col("c_acctbal") < 0, "1").otherwise("0")
    pages = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"), fx.text("{{Greet|", fx.c("c_name"), "|neg=", sign, "}} {{#expr: ", fx.c("c_nationkey"), " * 2 + 1}} {{uc:", F.lower(fx.c("c_mktsegment")), "}}").alias("text"))
    store = spark.createDataFrame([("Template:Greet", "Dear {{{1}}} ({{State|{{{neg}}}}})<noinclude>doc</noinclude>"), ("State", "{{#ifeq:{{{1}}}|1|owes|ok}}")], "title string, text string")
    return pages_text.expand(pages, store)


@query("""
SELECT n_nationkey::BIGINT AS page_id, '<p><b>' || n_name || '</b> lies in <i><a href="/wiki/' || replace(r_name, ' ', '_') || '" title="' || r_name || '">' || r_name || '</a></i>.' || chr(10) || '</p>' || chr(10) || '<ul><li>' || n_nationkey || '</li>' || chr(10) || '<li>b</li></ul>' AS html
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def render_html(spark, d):
    n = fx.read(spark, d, "nation").join(fx.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("title"), fx.text("'''", fx.c("n_name"), "''' lies in ''[[", F.replace(fx.c("r_name"), F.lit(" "), F.lit("_")), "|", fx.c("r_name"), "]]''.\n* ", fx.c("n_nationkey"), "\n* b").alias("text"))
    return pages_text.to_html(pages)


@query("SELECT page_id, md5(html) AS digest FROM pages")
def highlight_roundtrip(spark, d):
    out = pages_text.highlight(html_pages(spark, d))
    bare = F.regexp_replace("html", r'<span class="wl-[\w-]+">|</span>', "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return out.select("page_id", F.md5(F.encode(bare, "UTF-8")).alias("digest"))


@query("SELECT n_nationkey::BIGINT AS page_id, '{{Country box|name=' || n_name || '|region=Earth|' || n_nationkey || '}}' AS first_line FROM nation")
def edit_template(spark, d):
    pages = fx.nations(spark, d)
    nodes = parse(pages)
    edits = pages_text.replace_template(nodes, "Template:Infobox nation", "Country box").unionByName(pages_text.set_argument(nodes, "Template:Infobox nation", "region", "Earth"))
    return pages_text.apply_edits(pages, edits).select("page_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"))


@query("SELECT c_custkey AS page_id, len(regexp_extract_all(t, '='))::INTEGER AS n_marks FROM (SELECT c_custkey, '====A====' || '====B====' AS t FROM customer)")
def edit_headings(spark, d):
    pages = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.lit("== A ==\n=== B ===\n").alias("text"))
    out = pages_text.apply_edits(pages, pages_text.set_heading_level(parse(pages, types=["heading"]), 4))
    return out.select("page_id", (F.length("text") - F.length(F.replace("text", F.lit("="), F.lit("")))).alias("n_marks"))


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE length(c_name) + 1 END::INTEGER AS at FROM customer")
def text_diff(spark, d):
    base = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), fx.text(fx.c("c_name"), " a").alias("text"))
    other = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), fx.text(fx.c("c_name"), F.when(F.col("c_custkey") % 2 == 0, " a").otherwise(" b")).alias("text"))
    return pages_text.first_difference(base, other).withColumn("at", F.coalesce("at", F.lit(-1)))


# -- streams (the batch form of the same code)


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type AS rule, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_rule_counts(spark, d):
    events = fx.read(spark, d, "events").select("ts", F.col("event_type").alias("rule"))
    return revisions.rule_counts(events)


@query("SELECT user_id AS page_id, max(event_id) AS rev_id FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1")
def stream_newest(spark, d):
    rev = fx.read(spark, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("rev_id"), "ts", F.col("event_type").alias("text"))
    return revisions.newest(rev).select("page_id", "rev_id")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS source, p_partkey // 3 AS target FROM part WHERE p_partkey > 2), r(source, target) AS (SELECT * FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target) SELECT source, target FROM r")
def template_closure(spark, d):
    edges = fx.read(spark, d, "part").filter("p_partkey > 2").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target"))
    return structure.template_closure(edges)


from markloom.plans import edit_queries, node_queries  # noqa: E402, F401 - they register their queries
