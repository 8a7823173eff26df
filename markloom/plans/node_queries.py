"""Registered queries of navigation, collections, ranges, editor services and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import text as small
from markloom.operators import editor, lint, structure
from markloom.operators import navigation as nav
from markloom.plans import text as pages_text
from markloom.plans.parse import parse
from markloom.plans.registry import query
from markloom.sources import fixtures as fx

#: Sizes of the parts of a varied page, as SQL: lines, calls, nested tags, length of a list line, and whether the end is a link.
_V = "(SELECT p_partkey AS page_id, p_partkey AS k, p_size % 5 AS n1, p_size % 4 AS n2, p_size % 3 AS n3, 14 + length(p_partkey::VARCHAR) AS line, p_size % 2 = 0 AS even FROM part)"


def _nodes(spark, d, **kw):
    return parse(fx.varied(spark, d), **kw)


@query(f"SELECT page_id, (8 * n1 + 2 * n2 + 3 * n3 + 5 + even::INT)::BIGINT AS n_children, (4 * n1 + n2 + 2 * n3 + 3 + even::INT)::BIGINT AS n_elements FROM {_V}")
def node_children(spark, d):
    return nav.children(_nodes(spark, d)).filter("node_id = 0").select("page_id", "n_children", "n_elements")


@query(f"SELECT page_id, n1::BIGINT AS n, n1::BIGINT AS n_after_list, (n1 > 1)::INT::BIGINT AS some FROM {_V} WHERE n1 > 0")
def node_neighbours(spark, d):
    around = nav.neighbours(_nodes(spark, d, columns=["node_id", "parent_id", "ordinal", "type", "text", "anc"]))
    links = around.filter("type = 'link' and parent_type = 'root' and previous_element is not null")
    right = links.filter("next_element_type = 'quote' and next = next_element - 1 and previous_visible = previous")
    return right.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("previous_element_type") == "list").alias("n_after_list"), (F.count(F.lit(1)) > 1).cast("long").alias("some"))


@query(f"SELECT page_id, (2 * n2)::BIGINT AS n FROM {_V} WHERE n2 > 0")
def node_ancestors(spark, d):
    found = nav.ancestors(_nodes(spark, d, types=["parameter"], columns=["node_id", "anc"]))
    return found.filter("ancestor_type = 'template' and distance = 1").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, (n1 + even::INT)::BIGINT AS n_contains, (n1 + even::INT)::BIGINT AS n_before, (n1 + even::INT)::BIGINT AS n_after FROM {_V} WHERE n1 + even::INT > 0")
def node_compare(spark, d):
    nodes = _nodes(spark, d, types=["root", "link"], columns=["node_id", "last_id", "type"])
    links = nodes.filter("type = 'link'").select("page_id", F.col("node_id").alias("b"))
    pairs = links.select("page_id", F.lit(0).alias("a"), "b").unionByName(links.select("page_id", F.col("b").alias("a"), F.lit(0).alias("b")))
    return nav.compare(pairs, nodes).groupBy("page_id").agg(F.count_if("contains").alias("n_contains"), F.count_if(F.col("order") == -1).alias("n_before"), F.count_if(F.col("order") == 1).alias("n_after"))


@query(f"SELECT page_id, n2::BIGINT AS n_equal, (n1 + even::INT)::BIGINT AS n_other FROM {_V} WHERE n2 > 0")
def node_equal(spark, d):
    pages = fx.varied(spark, d)
    nodes = parse(pages, types=["template", "link"], columns=["node_id", "type", "name", "start", "end"])
    first = nodes.filter("type = 'template'").groupBy("page_id").agg(F.min("node_id").alias("a"))
    pairs = first.join(nodes.select("page_id", F.col("node_id").alias("b")), "page_id").select("page_id", "a", "b")
    return nav.equal(pairs, nodes, pages).groupBy("page_id").agg(F.count_if("equal").alias("n_equal"), F.count_if(~F.col("equal")).alias("n_other"))


@query(f"SELECT page_id, CASE WHEN even THEN 'link,root,text' ELSE 'root,text' END AS types FROM {_V}")
def node_ends(spark, d):
    return nav.ends(_nodes(spark, d)).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("types"))


@query(f"SELECT page_id, (n1 * line + 12 * n2)::INT AS index, (n1 * line + 12 * n2)::INT AS relative_index, n1::INT AS top, (12 * n2)::INT AS \"left\", 1 AS height, 3 AS width FROM {_V}")
def node_extents(spark, d):
    nodes = _nodes(spark, d, types=["root", "html"], columns=["node_id", "parent_id", "type", "name", "start", "line", "col", "end_line", "end_col", "props"])
    first = nodes.filter("type = 'root'").unionByName(nodes.filter((F.col("name") == "b") & (structure.prop("closing") == "false")))
    return nav.extents(first).filter("type = 'html'").drop("node_id", "type")


@query(f"SELECT page_id, 1::BIGINT AS n_images, (n1 + even::INT)::BIGINT AS n_links, n2::BIGINT AS n_embeds FROM {_V}")
def node_collections(spark, d):
    nodes = _nodes(spark, d, columns=["node_id", "type", "name", "anc"])
    all_ = nav.images(nodes).select("page_id", F.lit("i").alias("k")).unionByName(nav.links(nodes).select("page_id", F.lit("l").alias("k"))).unionByName(nav.embeds(nodes).select("page_id", F.lit("e").alias("k")))
    return all_.groupBy("page_id").agg(*[F.count_if(F.col("k") == k).alias(a) for k, a in (("i", "n_images"), ("l", "n_links"), ("e", "n_embeds"))])


@query(f"SELECT page_id, CASE WHEN n1 > 0 THEN 'L' || k ELSE 'End' END AS name FROM {_V} WHERE n1 > 0 OR even")
def first_link(spark, d):
    return nav.first_match(_nodes(spark, d, types=["link"], columns=["node_id", "name"])).select("page_id", "name")


@query(f"SELECT page_id, n1::BIGINT AS n, (n1 * (line - 2))::BIGINT AS chars FROM {_V} WHERE n1 > 0")
def list_ranges(spark, d):
    found = nav.list_ranges(_nodes(spark, d))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(f"SELECT page_id, 'text' AS type, 1 AS offset, 'root,link,link-target' AS around FROM {_V} WHERE n1 > 0")
def caret_and_elements(spark, d):
    nodes = _nodes(spark, d, columns=["node_id", "type", "depth", "start", "end"])
    pages = fx.varied(spark, d).filter(F.startswith("text", F.lit("*")))
    caret = nav.caret(nodes, pages.select("page_id", F.lit(2).alias("at")))
    around = nav.elements_at(nodes, pages.select("page_id", F.lit(4).alias("at")))
    return caret.join(around.select("page_id", F.array_join("types", ",").alias("around")), "page_id").select("page_id", "type", "offset", "around")


@query("SELECT p_partkey AS page_id, unnest(['left', 'width', 'manualthumb', 'alt']) AS option, unnest(['', '20', 'a.png', p_partkey::VARCHAR]) AS value FROM part")
def image_options(spark, d):
    return nav.chosen_options(_nodes(spark, d, types=["image-parameter"])).select("page_id", "option", "value")


@query(f"SELECT page_id, n2::BIGINT AS n, '1,b' AS keys, '1' AS others, 'c' AS b FROM {_V} WHERE n2 > 0")
def argument_key_sets(spark, d):
    args = structure.arguments(_nodes(spark, d, types=["parameter"], last="brace"))
    told = nav.argument_keys(args).join(nav.other_arguments(args, ["b"]).withColumnRenamed("keys", "others"), ["page_id", "call_id"])
    joined = told.select("page_id", F.array_join("keys", ",").alias("keys"), F.array_join("others", ",").alias("others"), F.array_join(F.try_element_at("all_values", F.lit("b")), ",").alias("b"))
    return joined.groupBy("page_id", "keys", "others", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS page_id, (count(*) + 1)::BIGINT AS n_rows, 3::BIGINT AS n_columns, (3 * count(*) + 2)::BIGINT AS n_cells FROM lineitem GROUP BY 1")
def table_sizes(spark, d):
    return nav.table_sizes(parse(fx.orders(spark, d), types=["td"], last="table", columns=["type", "anc", "props"])).drop("table_id")


@query(f"SELECT page_id, (2 * n2)::BIGINT AS n_inside, CASE WHEN n1 = 0 THEN '' ELSE 'L' || k END AS source, 'before' AS relation FROM {_V} WHERE n2 > 0")
def range_functions(spark, d):
    pages = fx.varied(spark, d)
    nodes = parse(pages, columns=["node_id", "type", "name", "start", "end", "inner_start", "inner_end"])
    calls = nav.range_of(nodes.filter("type = 'template'"))
    inside = nav.inside_range(calls, nodes.filter("type = 'parameter'")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_inside"))
    first = nav.extract(nav.range_of(nav.first_match(nodes.filter("type = 'link' and name <> 'End'")), inner=True), pages).select("page_id", "source")
    files = nodes.filter("type = 'file'").select("page_id", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    order = nav.compare_ranges(calls.join(files, "page_id")).groupBy("page_id").agg(F.max("relation").alias("relation"))
    return inside.join(first, "page_id", "left").join(order, "page_id").select("page_id", "n_inside", F.coalesce("source", F.lit("")).alias("source"), "relation")


@query(f"SELECT page_id, CASE WHEN n3 > 0 THEN 'i' ELSE 'b' END AS name FROM {_V}")
def enclosing_tags(spark, d):
    nodes = _nodes(spark, d, types=["html"], columns=["node_id", "parent_id", "type", "name", "start", "end", "props"])
    tags = nodes.join(structure.matched_tags(nodes).select("page_id", "node_id", "partner_id"), ["page_id", "node_id"])
    b = nodes.filter((F.col("name") == "b") & (structure.prop("closing") == "false")).select("page_id", F.col("end").alias("_e"))
    i = nodes.filter("name = 'i'").groupBy("page_id").agg(F.min("end").alias("_i"))
    points = b.join(i, "page_id", "left").select("page_id", F.coalesce("_i", "_e").alias("at"))
    return nav.enclosing_tag(points, tags).select("page_id", "name")


@query(f"""
SELECT page_id, kind, url, n::BIGINT AS n FROM (
  SELECT page_id, 'link' AS kind, '/wiki/L' || k AS url, n1 AS n FROM {_V} UNION ALL SELECT page_id, 'template', '/wiki/Template:T', n2 FROM {_V}
  UNION ALL SELECT page_id, 'file', '/wiki/File:A.png', 1 FROM {_V} UNION ALL SELECT page_id, 'link', '/wiki/End', even::INT FROM {_V}) WHERE n > 0
""")
def document_links(spark, d):
    return editor.document_links(_nodes(spark, d)).groupBy("page_id", "kind", "url").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_nationkey::BIGINT AS page_id, 'https://datatracker.ietf.org/doc/html/rfc' || n_nationkey AS rfc, 'https://www.ncbi.nlm.nih.gov/pubmed/' || n_nationkey || '?dopt=Abstract' AS pmid, '/wiki/Special:BookSources/9780306406157' AS isbn, 'https://x.org/' || n_nationkey AS ext FROM nation
""")
def magic_link_urls(spark, d):
    key = fx.c("n_nationkey")
    pages = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), fx.text("RFC ", key, " PMID ", key, " ISBN 978-0-306-40615-7 [//x.org/", key, " y]").alias("text"))
    found = editor.document_links(parse(pages))
    pick = lambda p, a: F.max(F.when(F.contains("url", F.lit(p)), F.col("url"))).alias(a)
    return found.groupBy("page_id").agg(pick("datatracker", "rfc"), pick("pubmed", "pmid"), pick("Book", "isbn"), pick("x.org", "ext"))


@query(f"SELECT c_custkey AS page_id, 'h1' AS rule, CASE WHEN c_custkey % {len(fx.FAULTS)} = {[f[0] for f in fx.FAULTS].index('= top =')} THEN 'replace by == top ==' ELSE 'replace by 2' END AS title FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % {len(fx.FAULTS)} IN ({[f[0] for f in fx.FAULTS].index('= top =')}, {[f[0] for f in fx.FAULTS].index('<h1>top</h1>')})")
def code_actions(spark, d):
    pages = fx.faults(spark, d)
    found = lint.lint(parse(pages), pages, ["h1"])
    ranges = pages.select("page_id", F.lit(0).alias("start"), F.when(F.col("page_id") % 2 == 1, 1000).otherwise(10).alias("end"))
    return editor.code_actions(found, ranges).select("page_id", "rule", "title")


@query("SELECT n_nationkey::BIGINT AS page_id, 'a{{!}}b{{=}}' || n_nationkey || '=c' AS text FROM nation")
def escape_selection(spark, d):
    pages = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), fx.text("a|b=", fx.c("n_nationkey"), "=c").alias("text"))
    edits = editor.escape_range(pages.select("page_id", F.lit(0).alias("start"), F.lit(4).alias("end")), pages)
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


@query("SELECT l_orderkey AS page_id, 'color:#aabb0' || (l_linenumber % 10) AS style, 'td' AS tag, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def style_attributes(spark, d):
    nodes = parse(fx.orders(spark, d), types=["table-attr", "attr-value"], last="table", columns=["node_id", "parent_id", "type", "name", "start", "end", "props"])
    return editor.style_attributes(nodes).groupBy("page_id", "style", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT unnest(['Template:Infobox nation', r_name, 'Category:' || r_name, 'Region ' || n_regionkey]) AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def name_suggestions(spark, d):
    nodes = parse(fx.nations(spark, d), types=["template", "link", "category"], columns=["type", "name"])
    return editor.suggestions(*[nodes.filter(F.col("type") == t) for t in ("template", "link", "category")])


@query("SELECT n_nationkey::BIGINT AS page_id, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['a' || n_nationkey, 'b', 'c', 'd'] WHEN n_nationkey % 3 = 1 THEN ['x', 'z'] ELSE ['y', 'e'] END) AS value FROM nation")
def possible_values(spark, d):
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, fx.text("{{#if:x|a", fx.c("n_nationkey"), "|{{#ifeq:1|2|{{#switch:q|m=b|c}}|d}}}}")).when(k % 3 == 1, "{{#switch:{{{1}}}|p=x|q|z}}").otherwise("{{#iferror:y|e}}")
    nodes = parse(fx.read(spark, d, "nation").select(k.cast("long").alias("page_id"), body.alias("text")))
    return editor.possible_values(nodes).filter("node_id = 1").select("page_id", "value")


@query("SELECT n_nationkey::BIGINT AS page_id, 'Module:M' AS module, 'f' AS function, n_name AS first, 'v' AS k FROM nation")
def module_calls(spark, d):
    pages = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), fx.text("{{#invoke:M| f |", fx.c("n_name"), "|k=v}}").alias("text"))
    found = editor.modules(parse(pages, types=["magic-word"], last="brace"))
    return found.select("page_id", "module", "function", *[F.try_element_at("args", F.lit(k)).alias(a) for k, a in (("1", "first"), ("k", "k"))])


@query(r"""
SELECT n_nationkey::BIGINT AS page_id, n_name || '&#10;b' AS newline, n_name || '\nb' AS nowrap, n_name || 'b' AS bare, n_name || chr(10) || 'b' AS lines, n_name || '\.\*' AS regex, n_name || '%23%7C' AS fragment, n_name || ' b' AS value, n_name || '_b&quot;' AS id, n_name || ' &quot;' AS alt,
       n_name || ',b+c' AS items, n_name || '!b' AS inserted, substr(n_name, 2) AS deleted, n_name[:2] || '/' || substr(n_name, 3) AS split, '<!--' || n_name || '--&gt;-->' AS comment, '<p class="' || n_name || '">x</p>' AS element, n_name || '<nowiki>[</nowiki>&lt;' AS plain FROM nation
""")
def small_text_functions(spark, d):
    n = fx.c("n_name")
    cat = lambda *x: fx.text(*x)
    return fx.read(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("page_id"), small.escape_newline(cat(n, "\nb")).alias("newline"), small.no_wrap(cat(n, "\nb")).alias("nowrap"), small.remove_comments(cat(n, "<!-- x\n -->b<!-- y")).alias("bare"),
        small.remove_comment_lines(cat(n, "\n <!-- x --> \nb")).alias("lines"), small.escape_regex(cat(n, ".*")).alias("regex"), small.encode_fragment(cat(n, "#|")).alias("fragment"), small.attribute_value(cat(" ", n, "\n\t b ")).alias("value"),
        small.sanitise_attribute(cat(n, "  b\""), True).alias("id"), small.sanitise_alt(cat(" ", n, "<b> </b>\"")).alias("alt"),
        F.array_join(F.transform(small.charinsert_items(cat(F.replace(n, F.lit(" "), F.lit("_")), " b+c")), lambda x: F.array_join(x, "+")), ",").alias("items"), small.insert_text(cat(n, "b"), F.length(n), "!").alias("inserted"),
        small.delete_text(n, F.lit(0), F.lit(1)).alias("deleted"), F.array_join(small.split_text(n, F.lit(2)), "/").alias("split"), small.make_comment(cat(n, "-->")).alias("comment"),
        small.make_element("p", {"class": n}, "x").alias("element"), small.make_text(cat(n, "[<")).alias("plain"),
    )


@query("SELECT n_nationkey::BIGINT AS page_id, 'a' || chr(10) || '; t' || n_nationkey || ' <b>x:y</b> ' AS term, 'd' AS definition FROM nation")
def definition_lists(spark, d):
    pages = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), fx.text("a\n; t", fx.c("n_nationkey"), " <b>x:y</b> :d").alias("text"))
    marks = parse(pages, types=["dd"], columns=["type", "start", "end"])
    return marks.join(pages, "page_id").select("page_id", F.left("text", F.col("start")).alias("term"), F.substring("text", F.col("end") + 1, F.lit(99)).alias("definition"))


@query("SELECT n_nationkey::BIGINT AS page_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '!' ELSE 'all ' || n_name || ' text' END AS text FROM nation")
def onlyinclude_text(spark, d):
    k = F.col("n_nationkey")
    pages = fx.read(spark, d, "nation").select(k.cast("long").alias("page_id"), F.col("n_name").alias("title"), F.when(k % 2 == 0, fx.text("{{Part|", fx.c("n_name"), "}}")).otherwise(fx.text("{{Whole|", fx.c("n_name"), "}}")).alias("text"))
    store = spark.createDataFrame([("Part", "doc <onlyinclude>{{{1}}}</onlyinclude> more<onlyinclude>!</onlyinclude>"), ("Whole", "all {{{1}}} <noinclude>doc</noinclude>text")], "title string, text string")
    return pages_text.expand(pages, store)


@query("WITH RECURSIVE t AS (SELECT n_nationkey::BIGINT AS page_id, n_name, n_nationkey % 7 AS depth FROM nation) SELECT page_id, repeat('<', depth) || n_name || repeat('>', depth) AS text FROM t")
def expand_deep(spark, d):
    """Chains of templates, beyond the broadcast too: {{D3|x}} is <{{D2|x}}>."""
    pages = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("title"), fx.text("{{D", F.pmod("n_nationkey", F.lit(7)).cast("string"), "|", fx.c("n_name"), "}}").alias("text"))
    store = spark.createDataFrame([(f"D{i}", f"<{{{{D{i - 1}|{{{{{{1}}}}}}}}}}>" if i else "{{{1}}}") for i in range(7)], "title string, text string")
    return pages_text.expand(pages, store)


@query(f"SELECT page_id, repeat('* [[L' || k || '|l]] ''''i''''' || chr(10), n1) || repeat('({{{{T|a|b=c}}}}) ', n2) || repeat('x', n3) || chr(10) || chr(10) || CASE WHEN even THEN '[[End|l]]' ELSE 'end ' || k END AS text FROM {_V}")
def edit_nodes(spark, d):
    """Links get a text, calls brackets; tags and files go."""
    pages = fx.varied(spark, d)
    nodes = parse(pages, types=["link", "template", "html", "file"], columns=["type", "start", "end"])
    kind, start, end, edit = F.col("type"), F.col("start"), F.col("end"), pages_text.edit
    call = kind == "template"
    edits = pages_text.edits_at(
        nodes, F.when(kind == "link", edit(end - 2, end - 2, "|l")), F.when(call, edit(start, start, "(")), F.when(call, edit(end, end, ")")), F.when(kind.isin("html", "file"), edit(start, end, ""))
    )
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


@query(f"SELECT page_id, unnest(['link', 'template']) AS type, unnest([n1 + even::INT, n2])::BIGINT AS n FROM {_V} WHERE n1 + even::INT > 0 AND n2 > 0")
def same_name_uses(spark, d):
    """References of each page's first link and first call."""
    nodes = _nodes(spark, d, types=["link", "template"])
    keys = editor.symbol_key(nodes)
    both = keys.groupBy("page_id").agg(F.count_distinct("type").alias("t")).filter("t = 2")
    return keys.join(both, "page_id").groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))
