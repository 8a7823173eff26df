"""Wiki pages rendered from relational tables, so that answers can be checked from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def c(name: str) -> F.Column:
    return F.col(name).cast("string")


def nations(spark: SparkSession, d: str) -> DataFrame:
    """One page per nation: infobox, bold title, links, category."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = text(
        "{{Infobox nation|name=", c("n_name"), "|region= ", c("r_name"), " |", c("n_nationkey"), "}}\n'''", c("n_name"), "''' lies in ''[[", c("r_name"), "]]''.<!-- key ", c("n_nationkey"),
        " -->\nSee [[:Category:", c("r_name"), "]] and [[region ", c("n_regionkey"), "#Map|the map]].\n[[Category:", c("r_name"), "|", c("n_name"), "]]\n",
    )
    return n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.col("n_name").alias("title"), body.alias("text"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """One page per customer: sections, a list, references, a template call by segment."""
    k = F.col("c_custkey")
    body = text(
        "{{Segment|", c("c_mktsegment"), "}}\n== Account ==\n* nation ", c("c_nationkey"), "\n* key ", c("c_custkey"), "\n** sub\n=== Details ===\nText<ref name=\"s\">", c("c_mktsegment"), "</ref> and<ref>n", c("c_nationkey"),
        "</ref> again<ref name=\"s\"/>.\n== ", c("c_mktsegment"), " ==\n", F.when(k % 3 == 0, "<div lang=\"en\"><span class=\"a b\">x</span></div>").otherwise("<div lang=\"de\"><p>y</p></div>"), "\n=== Details ===\n<references/>\n",
        F.when(k % 5 == 0, "[[Category:Gold]]\n[[Category:Gold]]\n").otherwise("[[Category:Plain]]\n"),
    )
    return read(spark, d, "customer").select(k.alias("page_id"), F.col("c_name").alias("title"), body.alias("text"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """One page per order with a table of its lines; the first row has a cell that spans two columns."""
    row = text("|-\n| ", c("l_linenumber"), " || ", c("l_partkey"), " || style=\"color:#aabb0", F.pmod("l_linenumber", F.lit(10)).cast("string"), "\" | ", c("l_returnflag"), "\n")
    # Lines come together before they are gathered: an order has few of them, so lists made before the shuffle would only be sorted and copied twice.
    met = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").repartition("l_orderkey")
    # Rows are written by a projection, which is compiled; what a list gathers is worked out by interpretation.
    written = met.select("l_orderkey", F.struct("l_linenumber", row.alias("t")).alias("row"))
    lines = written.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    body = text("{| class=\"wikitable\"\n|+ Order ", c("l_orderkey"), "\n! line !! colspan=2 | part and flag\n", F.array_join(F.col("rows")["t"], ""), "|}\n")
    return lines.select(F.col("l_orderkey").alias("page_id"), body.alias("text"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """One page per part: a list of links whose targets are redirected for every fourth part."""
    k = F.col("p_partkey")
    body = text("* [[Alias ", F.replace(c("p_brand"), F.lit("#"), F.lit(" ")), "]]\n* [[File:", F.replace(c("p_name"), F.lit(" "), F.lit("_")), ".png|thumb|", c("p_size"), "px|alt=", c("p_type"), "|", c("p_name"), "]] [http://example.org/", c("p_partkey"), " site] http://example.org/p?id=", c("p_partkey"), ".\n")
    return read(spark, d, "part").select(k.alias("page_id"), F.col("p_name").alias("title"), body.alias("text"))


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Redirect pages, one for each brand."""
    brands = read(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("p_brand")).distinct()
    body = text("#REDIRECT [[", c("p_brand"), " (brand)]]\n")
    return brands.select(F.xxhash64("p_brand").alias("page_id"), text("Alias ", c("p_brand")).alias("title"), body.alias("text"))


def varied(spark: SparkSession, d: str) -> DataFrame:
    """One page per part: size mod 5 list lines, size mod 4 calls, size mod 3 nested tags, a file, and an end that is a link for even sizes."""
    n = lambda m: F.pmod(F.col("p_size"), F.lit(m)).cast("int")
    body = text(
        F.repeat(text("* [[L", c("p_partkey"), "]] ''i''\n"), n(5)), F.repeat(F.lit("{{T|a|b=c}} "), n(4)), "<b>", F.repeat(F.lit("<i>x</i>"), n(3)), "</b>\n[[File:A.png|left|10px|20px|thumb=a.png|thumb=b.png|alt=",
        c("p_partkey"), "]]\n", F.when(n(2) == 0, "[[End]]").otherwise(text("end ", c("p_partkey"))),
    )
    return read(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), body.alias("text"))


#: Wikitext and the reports that it makes: (rule, key, number). Those without reports are near misses.
FAULTS: list[tuple[str, tuple[tuple[str, str, int], ...]]] = [
    ("<poem>{{{x}}}</poem>", (("arg-in-ext", "", 1), ("no-arg", "", 1))),
    ("<poem>x</poem>", ()),
    ("[[File:A.png|alt=]]", (("blank-alt", "", 1),)),
    ("[[File:A.png|alt=b]]", ()),
    ("== a '''b''' ==", (("bold-header", "", 2),)),
    ("== a <strong>b</strong> ==", (("bold-header", "strong", 2),)),
    ("== a <b>b</b> <ref>'''c'''</ref> ==", (("bold-header", "b", 2), ("var-anchor", "ref", 1))),
    ("== a ''b ==", (("format-leakage", "apostrophe", 1),)),
    ("== a ''b'' ==", ()),
    ("== a <i>b ==", (("format-leakage", "i", 1),)),
    ("{|\nstray\n|-\n| a\n|}", (("fostered-content", "", 1),)),
    ("{|\n{{T}}\n|-\n| a\n|}", (("fostered-content", "transclusion", 1),)),
    ("{|\n|-\n| a\n|}", ()),
    ("= top =", (("h1", "", 1),)),
    ("<h1>top</h1>", (("h1", "html", 1),)),
    ("<p foo=\"1\">x</p>", (("illegal-attr", "unknown", 1),)),
    ("<p data-foo=\"1\" title=\"t\">x</p>", ()),
    ("<td colspan=\"2\">x</td>", ()),
    ("<p colspan=\"2\">x</p>", (("illegal-attr", "unknown", 1),)),
    ("<p itemid=\"2\">x</p>", (("illegal-attr", "unknown", 1),)),
    ("<p itemscope itemid=\"2\">x</p>", ()),
    ("<p tabindex=\"1\">x</p>", (("illegal-attr", "tabindex", 1),)),
    ("<p tabindex=\"0\">x</p>", ()),
    ("<p dir=\"up\">x</p>", (("illegal-attr", "value", 1),)),
    ("<p dir=\"rtl\">x</p>", ()),
    ("<p style=\"width: expression(1)\">x</p>", (("insecure-style", "", 1),)),
    ("<p style=\"background: src(x)\">x</p>", (("insecure-style", "", 1),)),
    ("<p style=\"color: red\">x</p>", ()),
    ("<gallery>\nFile:Abc\n</gallery>", (("invalid-gallery", "extension", 1),)),
    ("<gallery>\nTemplate:A.png\n</gallery>", (("invalid-gallery", "image", 1),)),
    ("[[File:A.png|10pxpx]]", ()),
    ("[[File:A.png|thumb=a.txt]]", (("invalid-gallery", "thumb", 1),)),
    ("[[File:A.png|link=a{b]]", (("invalid-gallery", "link", 1), ("lonely-bracket", "single", 1))),
    ("<imagemap>\nFile:A.png\nblob 1 2 [[a]]\n</imagemap>", (("invalid-imagemap", "shape", 1),)),
    ("<imagemap>\nFile:A.png\nrect 1 2 [[a]]\n</imagemap>", (("invalid-imagemap", "coord", 1),)),
    ("<imagemap>\nFile:A.png\nrect 1 2 3 4 a\n</imagemap>", (("invalid-imagemap", "link", 1),)),
    ("<imagemap></imagemap>", (("invalid-imagemap", "image", 1),)),
    ("<imagemap>\nFile:A.png\nrect 1 2 3 4 [[a]]\n</imagemap>", ()),
    ("{{#invoke:M}}", (("invalid-invoke", "function", 1),)),
    ("{{#invoke:a<b|f}}", (("invalid-invoke", "name", 1), ("tag-like", "invalid", 1))),
    ("{{#invoke:M|f}}", ()),
    ("ISBN 1234567890", (("invalid-isbn", "", 1),)),
    ("ISBN 9780306406157", ()),
    ("<templatedata>{\"a\": }</templatedata>", (("invalid-json", "", 1),)),
    ("<templatedata>{\"a\": 1, \"a\": 2}</templatedata>", (("invalid-json", "duplicate", 1),)),
    ("<templatedata>{\"a\": {\"b\": 1}, \"b\": [2, 3]}</templatedata>", ()),
    ("<ref follow=\"1\">x</ref>", (("invalid-ref", "", 1),)),
    ("<ref follow=\"a\" name=\"b\">x</ref>", (("invalid-ref", "", 1),)),
    ("<ref> </ref>", (("invalid-ref", "", 1),)),
    ("<references><ref>x</ref></references>", (("invalid-ref", "", 1),)),
    ("<references><ref name=\"a\">x</ref></references><ref name=\"a\"/>", ()),
    ("[http://%zz text]", (("invalid-url", "", 1),)),
    ("it''''s'''", (("lonely-apos", "", 1),)),
    ("'''it''''", (("lonely-apos", "word", 1),)),
    ("a ]] b", (("lonely-bracket", "double", 1),)),
    ("a [ b", (("lonely-bracket", "single", 1),)),
    ("a [b] c {d}", ()),
    ("a [ ''b'' ] c", ()),
    ("[ http://example.org ]", (("lonely-bracket", "extLink", 1),)),
    ("a http://example.org] b", (("lonely-bracket", "extLink", 1),)),
    ("see http:/example", (("lonely-http", "", 1),)),
    ("PMID:12", (("lonely-http", "PMID", 1),)),
    ("see RFC-12", (("lonely-http", "RFC", 1),)),
    ("see ISBN 12345678", (("lonely-http", "ISBN", 1),)),
    ("see RFC twelve", ()),
    ("[http://example.org a [[b]] c]", (("nested-link", "", 1),)),
    ("[http://example.org a [[File:B.png]] c]", (("nested-link", "file", 1),)),
    ("[http://example.org a [[File:B.png|link=]] c]", ()),
    ("[[a|b<ref>c</ref>]]", (("nested-link", "ref", 1),)),
    ("{{{name|x}}}", (("no-arg", "", 1),)),
    ("[[Category:A]] [[Category:A]]", (("no-duplicate", "category", 2),)),
    ("[[Category:A]] [[Category:B]]", ()),
    ("<p id=\"q\">x</p><p id=\"q\">y</p>", (("no-duplicate", "id", 2),)),
    ("{{T|a=1|a=2}}", (("no-duplicate", "parameter", 2),)),
    ("{{T|a|b|1=c}}", (("no-duplicate", "parameter", 2),)),
    ("<p class=\"a\" class=\"b\">x</p>", (("no-duplicate", "attribute", 2),)),
    ("[[File:A.png|10px|20px]]", (("no-duplicate", "imageParameter", 2),)),
    ("[[File:A.png|left|right|center]]", (("no-duplicate", "imageParameter", 3),)),
    ("[[File:A.png|left|top|a]]", ()),
    ("<inputbox>\ntype=a\ntype=b\n</inputbox>", (("no-duplicate", "inputbox", 2),)),
    ("{{{a|b|c}}}", (("no-arg", "", 1), ("no-ignored", "arg", 1))),
    ("<p>x</p class=\"a\">", (("no-ignored", "closingTag", 1),)),
    ("[[Category:A#b]]", (("no-ignored", "fragment", 1),)),
    ("<p \"x\">y</p>", (("no-ignored", "invalidAttributes", 1),)),
    ("<p />>y", (("unmatched-tag", "selfClosing", 1),)),
    ("<gallery>\n<!-- a\n|b\n</gallery>", (("no-ignored", "galleryComment", 1), ("no-ignored", "galleryNoImage", 1))),
    ("<gallery>\n<b>\n</gallery>", (("no-ignored", "galleryImage", 1),)),
    ("<includeonly x>a</includeonly>", (("no-ignored", "include", 1),)),
    ("<references>x</references>", (("no-ignored", "references", 1),)),
    ("<inputbox>\nnope=a\n</inputbox>", (("no-ignored", "inputbox", 1),)),
    ("<charinsert>a+b+c</charinsert>", (("no-ignored", "charinsert", 1),)),
    ("<categorytree><x></categorytree>", (("no-ignored", "categorytree", 1),)),
    ("<p align=\"left\">x</p>", (("obsolete-attr", "", 1),)),
    ("<img alt=\"left\">", (("tag-like", "disallowed", 1),)),
    ("<li value=\"2\">x</li>", ()),
    ("<center>x</center>", (("obsolete-tag", "", 2),)),
    ("<p class=\"<ref>a</ref>\">x</p>", (("parsing-order", "ext", 1),)),
    ("<p class=\"<nowiki/>\">x</p>", ()),
    ("[[a|b|c]]", (("pipe-like", "link", 1),)),
    ("{|\n! a || b\n|-\n| [[c]] d || e\n|}", ()),
    ("<templatestyles/>", (("required-attr", "templatestyles", 1),)),
    ("<section/>", (("required-attr", "section", 1),)),
    ("<section end=\"a\"/>", ()),
    ("<mapframe>{}</mapframe>", (("required-attr", "mapframe", 2),)),
    ("x #REDIRECT y", (("syntax-like", "redirect", 1),)),
    ("== a", (("syntax-like", "heading", 1),)),
    ("{|\n| a || b\n|-\n| c\n|}", (("table-layout", "", 1),)),
    ("{|\n| a || b\n|-\n| colspan=2 | c\n|}", ()),
    ("<p x", (("tag-like", "", 1),)),
    ("<img>", (("tag-like", "disallowed", 1),)),
    ("a <br", (("tag-like", "invalid", 1),)),
    ("a < b <c", ()),
    ("=== a ==", (("unbalanced-header", "", 1),)),
    ("<p class=\"a>x</p>", (("unclosed-quote", "", 1),)),
    ("{{T|http://example.org/?a=b}}", (("unescaped", "", 1),)),
    ("[[a{{T}}]]", (("unknown-page", "", 1),)),
    ("<b>x", (("unmatched-tag", "opening", 1),)),
    ("x</b>", (("unmatched-tag", "closing", 1),)),
    ("x</b/>", (("unmatched-tag", "both", 1),)),
    ("<b/>", (("unmatched-tag", "selfClosing", 1),)),
    ("{{#if:a|<b>|c}}", (("unmatched-tag", "conditional", 1),)),
    ("<b><i>x</i></b>", ()),
    ("http://example.org/a，b", (("unterminated-url", "punctuation", 1),)),
    ("[http://example.org/a|b c]", ()),
    ("[[a%20b]]", (("url-encoding", "", 1),)),
    ("[[File:A.png|link=a%20b]]", (("url-encoding", "file", 1),)),
    ("== a<ref>b</ref> ==", (("var-anchor", "ref", 1),)),
    ("== a [http://example.org] ==", (("var-anchor", "extLink", 1),)),
    ("<section begin=\"a\">x</section>", (("void-ext", "section", 1),)),
    ("<templatedata/>", (("void-ext", "templatedata", 1),)),
    ("<gallery/>", ()),
    ("<includeonly>open", (("unclosed-comment", "include", 1),)),
    ("<!-- open", (("unclosed-comment", "", 1),)),
    ("{|\n| a", (("unclosed-table", "", 1),)),
]
#: A fault that comes as often as the key says, before the other one: (wikitext, rule, key).
COUNTED = ("RFC-1 ''x''\n", "lonely-http", "RFC")


def faults(spark: SparkSession, d: str) -> DataFrame:
    """One page per customer: COUNTED custkey mod 4 times, then the fault number custkey mod len(FAULTS)."""
    k = F.col("c_custkey")
    fault = F.element_at(F.array(*[F.lit(f[0]) for f in FAULTS]), F.pmod(k, F.lit(len(FAULTS))).cast("int") + 1)
    counted = F.repeat(F.lit(COUNTED[0]), F.pmod(k, F.lit(4)).cast("int"))
    return read(spark, d, "customer").select(k.alias("page_id"), F.col("c_name").alias("title"), F.lit(0).alias("ns"), text("Plain text of a page.\n", counted, fault).alias("text"), F.lit(False).alias("include"))
