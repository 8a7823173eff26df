"""Registered queries of edits, titles, parser functions, more selectors and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import titles
from markloom.operators import editor, lint, structure
from markloom.plans import text as pages_text
from markloom.plans.node_queries import _V
from markloom.plans.parse import parse
from markloom.plans.registry import QUERIES, SQL, query
from markloom.plans.select import select
from markloom.sources import fixtures as fx
from markloom.streaming import revisions


def _nation(spark, d, *parts):
    return fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("title"), fx.text(*parts).alias("text"))


# -- selectors over pages whose parts vary


def _varied(name: str, selector: str, n: str) -> None:
    def fn(spark, d):
        return select(parse(fx.varied(spark, d)), selector).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[name], SQL[name] = fn, f"SELECT page_id, ({n})::BIGINT AS n FROM {_V} WHERE ({n}) > 0"


_varied("selector_has_attr", "parameter[anon=true][name], file[alt]", "1")
_varied("selector_unequal", "parameter[anon!=true]", "n2")
_varied("selector_only_child", "parameter:first-child, parameter:last-child", "n2")
_varied("selector_nth_last", "root > link:nth-last-of-type(-n+2)", "least(n1 + even::INT, 2)")
_varied("selector_nth_list", "root > link:nth-of-type(1, 3)", "CASE WHEN n1 + even::INT >= 3 THEN 2 WHEN n1 + even::INT >= 1 THEN 1 ELSE 0 END")
_varied("selector_visible", "html:hidden, link:visible", "n1 + even::INT")
_varied("selector_type_name", "link#End, template#Template:T", "n2 + even::INT")
_varied("selector_not_name", "link:not(#End)", "n1")


# -- edits


@query("SELECT n_nationkey::BIGINT AS page_id, '{{subst:T|' || n_name || '|b=1|c=x|y{{=}}z}} {{#invoke:New|go|a}}' AS text FROM nation")
def edit_calls(spark, d):
    pages = _nation(spark, d, "{{T|", fx.c("n_name"), "|b=1|a=x}} {{#invoke:Old|f|a}}")
    nodes = parse(pages)
    edits = pages_text.substitute(nodes, "Template:T").unionByName(pages_text.rename_argument(nodes, "Template:T", "a", "c")).unionByName(pages_text.replace_module(nodes, "Old", "New", "go")).unionByName(pages_text.add_anonymous_argument(nodes, "Template:T", "y=z"))
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


@query("SELECT n_nationkey::BIGINT AS page_id, CASE n_nationkey % 3 WHEN 0 THEN '{{T|x=1|x2=2}}' WHEN 1 THEN '{{T|x=1}}' ELSE '{{T|y=1|x=2|x2=' || n_name || '}}' END AS text FROM nation")
def edit_duplicate_arguments(spark, d):
    k = F.col("n_nationkey")
    pages = _nation(spark, d, F.when(k % 3 == 0, F.lit("{{T|x=1|x=2}}")).when(k % 3 == 1, F.lit("{{T|x=|x=1|x=1}}")).otherwise(fx.text("{{T|y=1|x=2|x=", fx.c("n_name"), "}}")))
    return pages_text.apply_edits(pages, pages_text.renumber_duplicates(parse(pages))).select("page_id", "text")


@query("SELECT n_nationkey::BIGINT AS page_id, '[[A|new]] [[A|new]] [[B#s' || n_nationkey || ']] [[#Here]] [[File talk:C (d)|C]] [[Category:K|' || n_nationkey || ']] [[Category:K|' || n_nationkey || ']]' AS text FROM nation")
def edit_links(spark, d):
    pages = _nation(spark, d, "[[A]] [[A|old]] [[B]] [[", fx.c("n_name"), "#Here]] [[File talk:C (d)|]] [[Category:K]] [[Category:K|z]]")
    nodes = parse(pages)
    fragments = pages_text.set_fragment(nodes, "B", "s0")
    numbered = fragments.select("page_id", F.col("edit").withField("text", F.concat(F.lit("B#s"), F.col("page_id").cast("string"))).alias("edit"))
    keyed = pages_text.set_sort_key(nodes, "Category:K", "0").select("page_id", F.col("edit").withField("text", F.regexp_replace("edit.text", "0$", "")).alias("edit"))
    keyed = keyed.select("page_id", F.col("edit").withField("text", F.concat("edit.text", F.col("page_id").cast("string"))).alias("edit"))
    edits = pages_text.set_link_text(nodes, "A", "new").unionByName(numbered).unionByName(pages_text.self_links(nodes, pages)).unionByName(pages_text.pipe_links(nodes)).unionByName(keyed)
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


@query("SELECT n_nationkey::BIGINT AS page_id, '<section hidden lang=\"' || n_nationkey || '\">x</section><p title=\"b\">y</p> z' || chr(10) || ':* i' AS text FROM nation")
def edit_attributes(spark, d):
    pages = _nation(spark, d, "<div id=\"a\" lang=\"", fx.c("n_nationkey"), "\">x</div><p class=\"b\">y</p> <b>z</b>\n* i")
    nodes = parse(pages)
    matched = structure.matched_tags(nodes)
    edits = pages_text.remove_attribute(nodes, "div", "id").unionByName(pages_text.toggle_attribute(nodes, "div", "hidden")).unionByName(pages_text.rename_attribute(nodes, "p", "class", "title"))
    edits = edits.unionByName(pages_text.replace_tag(nodes, matched, "div", "section")).unionByName(pages_text.unwrap(nodes, matched, "b")).unionByName(pages_text.indent_lists(nodes))
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


@query(f"SELECT page_id, (n1 * 2 + n2 * 2)::BIGINT AS n_added, '[[File:A.png|left|10px|20px|thumb=a.png|thumb=b.png|alt=new|x]]' AS file FROM {_V}")
def edit_images(spark, d):
    pages = fx.varied(spark, d)
    nodes = parse(pages, types=["file", "image-parameter", "template", "link"], columns=["type", "name", "start", "end", "attrs", "anc"])
    wrapped, start, end, edit = F.expr("type = 'template' or (type = 'link' and name <> 'End')"), F.col("start"), F.col("end"), pages_text.edit
    options = [*pages_text.image_option("alt", "alt=new"), *pages_text.image_option("caption", "x")]
    edits = pages_text.edits_at(nodes, *options, F.when(wrapped, edit(start, start, "~")), F.when(wrapped, edit(end, end, "~")))
    out = pages_text.apply_edits(pages, edits)
    return out.select("page_id", (F.length("text") - F.length(F.replace("text", F.lit("~"), F.lit("")))).cast("long").alias("n_added"), F.regexp_extract("text", r"\[\[File.*?\]\]", 0).alias("file"))


@query("SELECT n_nationkey::BIGINT AS page_id, '[[' || 'New' || n_nationkey || ']] {{T}} [[New' || n_nationkey || '|x]]' AS text FROM nation WHERE n_nationkey < 3")
def rename_symbol(spark, d):
    pages = _nation(spark, d, "[[a]] {{T}} [[A|x]]").filter("page_id < 3")
    nodes = parse(pages)
    edits = None
    for k in range(3):
        one = editor.rename(nodes, k, 1, f"New{k}")
        edits = one if edits is None else edits.unionByName(one)
    return pages_text.apply_edits(pages, edits).select("page_id", "text")


# -- titles


@query("""
SELECT n_nationkey::BIGINT AS page_id, 'A/' || n_nationkey || '/x' AS up, 'A/' || n_nationkey || '/b/x' AS down, n_name AS piped, CASE WHEN n_nationkey % 2 = 0 THEN 'w' ELSE '' END AS wiki, '//example.org/wiki/Special:Redirect/file/F' || n_nationkey || '.png?width=120' AS file,
       '汉' || n_nationkey || '语' AS converted, 'A & é' || n_nationkey || ' &amp' AS decoded FROM nation
""")
def title_functions(spark, d):
    from dataclasses import replace

    config = replace(titles.DEFAULT, interwiki=("w", "de"))
    k, key = F.col("n_nationkey"), fx.c("n_nationkey")
    file = titles.normalise(fx.text("file:f", key, ".png"))
    return fx.read(spark, d, "nation").select(
        k.cast("long").alias("page_id"), titles.resolve_subpage(F.lit("../x"), fx.text("A/", key, "/b")).alias("up"), titles.resolve_subpage(F.lit("/x"), fx.text("A/", key, "/b")).alias("down"), titles.pipe_trick(fx.text("Help:", fx.c("n_name"), " (x)")).alias("piped"),
        titles.is_interwiki(F.when(k % 2 == 0, "W: a").otherwise("x:a"), config).alias("wiki"), titles.file_url(file, F.lit(120)).alias("file"), titles.convert(fx.text("漢", key, "語言"), {"漢": "汉", "語": "?", "語言": "语"}).alias("converted"),
        titles.decode_entities(fx.text("A &amp; &eacute;", key, " &amp")).alias("decoded"),
    )


# -- parser functions by expansion


@query("""
SELECT n_nationkey::BIGINT AS page_id, concat_ws('~', 'User:' || t || '/b.css', t || '/b.css', 'User_talk:' || n || '/b.css', 'b.css', t, 'User', '2', 'User talk', 'CSS', 'wikitext', 'Template', lower(n), upper(n[1]) || n[2:], '5', (length(n) - 1)::VARCHAR, 'ok', 'bad', '0',
  '/wiki/' || n, '//example.org/wiki/' || n || '?a=b', 'https://example.org/wiki/' || n, 'Special:' || n, '<ref name="x">' || n || '</ref>', 'a&quot;_' || n_nationkey, '1970', '1', '00:02', 'one', 'c') AS text
FROM (SELECT n_nationkey, n_name AS n, replace(n_name, '_', ' ') AS t FROM nation)
""")
def magic_words(spark, d):
    n, key = fx.c("n_name"), fx.c("n_nationkey")
    words = [
        ("{{FULLPAGENAME}}",), ("{{PAGENAME}}",), ("{{TALKPAGENAMEE}}",), ("{{SUBPAGENAME}}",), ("{{ROOTPAGENAME}}",), ("{{NAMESPACE}}",), ("{{NAMESPACENUMBER}}",), ("{{TALKSPACE}}",), ("{{CONTENTMODEL:local}}",), ("{{CONTENTMODEL}}",), ("{{ns:10}}",),
        ("{{lc:", n, "}}"), ("{{ucfirst:", n, "}}"), ("{{#len:abcde}}",), ("{{#rpos:", n, "|", F.right(n, F.lit(1)), "}}"), ("{{#iferror:{{#expr:1+1}}|bad|ok}}",), ("{{#iferror:{{#expr:1/0}}|bad|ok}}",), ("{{NUMBEROFPAGES}}",),
        ("{{localurl:", n, "}}"), ("{{fullurl:", n, "|a=b}}"), ("{{canonicalurl:", n, "}}"), ("{{#special:", n, "}}"), ("{{#tag:ref|", n, "|name=x}}",), ("{{anchorencode:a\" ", key, "}}"), ("{{CURRENTYEAR}}",), ("{{CURRENTWEEK}}",), ("{{LOCALTIME}}",),
        ("{{plural:1|one|more}}",), ("{{#switch:", key, "|x=a|y=b|#default=c}}"),
    ]
    parts = [p for k, w in enumerate(words) for p in ((("~",) if k else ()) + w)]
    pages = _nation(spark, d, *parts).withColumn("title", F.concat(F.lit("User:"), "title", F.lit("/b.css")))
    return pages_text.expand(pages, spark.createDataFrame([], "title string, text string"))


@query("SELECT n_nationkey::BIGINT AS page_id, '<' || n_name || '>' AS text FROM nation")
def expand_redirected(spark, d):
    """A template behind a redirect page, and one behind a table of redirects."""
    k = F.col("n_nationkey")
    pages = _nation(spark, d, F.when(k % 2 == 0, "{{Old|").otherwise("{{Older|"), fx.c("n_name"), "}}")
    store = spark.createDataFrame([("New", "<{{{1}}}>"), ("Old", "#REDIRECT [[Template:New]]")], "title string, text string")
    return pages_text.expand(pages, store, spark.createDataFrame([("Template:older", "template:New")], "from_title string, to_title string"))


# -- lint over the corpus


@query("SELECT coalesce(rule, '*') AS rule, coalesce(severity, '*') AS severity, sum(n)::BIGINT AS n FROM (SELECT unnest(['h1', 'lonely-http']) AS rule, 'warning' AS severity, unnest([c_custkey % 2, c_custkey % 3]) AS n FROM customer) GROUP BY ROLLUP (rule, severity)")
def lint_totals(spark, d):
    k = F.col("c_custkey")
    pages = fx.read(spark, d, "customer").select(k.alias("page_id"), fx.text(F.repeat(F.lit("= x =\n"), (k % 2).cast("int")), F.repeat(F.lit("RFC-1 ''a'' "), (k % 3).cast("int"))).alias("text"))
    found = lint.lint(parse(pages), pages, ["h1", "lonely-http"])
    return found.rollup("rule", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("rule", F.lit("*")).alias("rule"), F.coalesce("severity", F.lit("*")).alias("severity"), "n")


@query("SELECT c_custkey AS page_id, 'lonely-http' AS rule, 'RFC' AS key, unnest(range(c_custkey % 4)) + 1 AS line FROM customer WHERE c_custkey % 4 > 0")
def lint_positions(spark, d):
    k = F.col("c_custkey")
    pages = fx.read(spark, d, "customer").select(k.alias("page_id"), fx.text("Text.\n", F.repeat(F.lit("RFC-1 a\n"), (k % 4).cast("int"))).alias("text"))
    return lint.lint(parse(pages), pages, ["lonely-http"]).select("page_id", "rule", "key", F.col("line").cast("long").alias("line"))


# -- streams (the batch form of the same code)


@query("SELECT user_id AS page_id, min(ts) AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS fresh FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, d):
    events = fx.read(spark, d, "events").select(F.col("user_id").alias("page_id"), "ts")
    return revisions.sessions(events).select("page_id", "start", "n")


@query("SELECT n_nationkey::BIGINT AS page_id, unnest(['#f0a', 'rgb(' || n_nationkey || ', 10%, 0)', 'hsl(120, 100%, 50%)']) AS colour, unnest([255, n_nationkey, 0]) AS red, unnest([0, 26, 255]) AS green, unnest([170, 0, 0]) AS blue FROM nation")
def colour_parts(spark, d):
    pages = _nation(spark, d, '<p style="color:#f0a;background:rgb(', fx.c("n_nationkey"), ', 10%, 0);border-color:hsl(120, 100%, 50%)">x</p>')
    return editor.colours(parse(pages, types=["html-attr"], last="html")).select("page_id", "colour", "red", "green", "blue")


@query("SELECT n_nationkey::BIGINT AS page_id, unnest(['Goal ' || n_nationkey, 'Other', 'Plain']) AS resolved FROM nation")
def redirect_variants(spark, d):
    """Redirects with titles in any writing, and one that only the other variant of a link's title has."""
    key = fx.c("n_nationkey")
    pages = _nation(spark, d, "[[from ", key, "]] [[漢 x]] [[plain]]")
    table = fx.read(spark, d, "nation").select(fx.text("from_", key).alias("from_title"), fx.text(" goal ", key).alias("to_title")).unionByName(spark.createDataFrame([("汉_x", "other")], "from_title string, to_title string"))
    found = structure.links(parse(pages, types=["link"]))
    return structure.resolve_redirects(found, table, variants={"漢": "汉"}).select("page_id", "resolved")


@query("SELECT n_nationkey::BIGINT AS page_id, 'Hello ' || n_name || ' and ' || n_nationkey AS message FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, '⧼none⧽' FROM nation WHERE n_nationkey % 2 = 1")
def interface_messages(spark, d):
    from markloom.functions import text as small

    known = spark.createDataFrame([("greet", "Hello $1 and $2")], "key string, template string")
    asked = fx.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.when(F.col("n_nationkey") % 2 == 0, "greet").otherwise("none").alias("key"), F.array(fx.c("n_name"), fx.c("n_nationkey")).alias("args"))
    return small.messages(asked, known).select("page_id", "message")


@query("SELECT n_nationkey::BIGINT AS page_id, '== ' || n_name || ' ==' || chr(10) || '<h1>x</h1><p class=\"a\">y</p>' AS text FROM nation")
def fix_one_rule(spark, d):
    """Only the fixes of one rule."""
    pages = _nation(spark, d, "= ", fx.c("n_name"), " =\n<h1>x</h1><p class=\"a\">y</p>")
    found = lint.lint(parse(pages), pages, ["h1", "unclosed-quote", "illegal-attr"]).filter("key = ''")
    return lint.fix_all(pages, found, "h1").select("page_id", "text")


@query(f"SELECT page_id, n1::BIGINT AS n, greatest(n1 - 1, 0)::BIGINT AS n_common FROM {_V} WHERE n1 > 0")
def list_prefixes(spark, d):
    """Levels that list lines share with the line before."""
    marks = parse(fx.varied(spark, d), types=["list"], columns=["type", "props"])
    return marks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(structure.prop("common").cast("long")).alias("n_common"))


@query("""
SELECT n_nationkey::BIGINT AS page_id, '{| class="a"' || chr(10) || '|-' || chr(10) || '! b=1 colspan=2 | h i' || chr(10) || '|- id="r' || n_nationkey || '"' || chr(10) || '| c=2 | ' || n_name || chr(10) || '| x'
  || chr(10) || '|- id="r' || n_nationkey || '"' || chr(10) || '| c=2 | ' || n_name || chr(10) || '| x' || chr(10) || '|-' || chr(10) || '| c=2 | p' || chr(10) || '| x' || chr(10) || '|}' AS text FROM nation
""")
def table_cell_edits(spark, d):
    """Merged heads, a row again, another row, a column's attributes and texts."""
    key, name = fx.c("n_nationkey"), fx.c("n_name")
    pages = _nation(spark, d, '{| class="a"\n! b=1 | h !! i\n|- id="r', key, '"\n| ', name, " || q\n|}")
    rows = structure.tables_as_rows(parse(pages, types=["td", "td-inner", "table-attrs"], last="table"))
    rows = structure.insert_row(structure.replicate_row(structure.merge_cells(rows, 0, 0, 2), 1), 3, ["p", "q"])
    body, head = rows.filter("row > 0"), rows.filter("row = 0")
    edited = structure.fill_cells(structure.format_cells(body, "c=2", column=0), "x", column=1).unionByName(head)
    again = structure.merge_cells(structure.split_cell(edited, 0, 0, 2), 0, 0, 2)
    trimmed = again.withColumn("cells", F.transform("cells", lambda c: c.withField("value", F.trim(c["value"]))))
    return structure.write_tables(trimmed).select("page_id", "text")
