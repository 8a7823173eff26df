"""Editor services over a corpus: folding, outline, completion, references, rename, colours, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.config import DEFAULT, SiteConfig
from markloom.functions import titles
from markloom.operators.structure import prop, references, sections


def folding_ranges(nodes: DataFrame) -> DataFrame:
    """page_id, kind, start_line, end_line of sections, tables and multi-line templates, from positions of the parse.

    A section ends on the line before the heading that ends it, or on the page's last line.
    """
    heads = nodes.filter(F.col("type").isin("heading", "root"))
    level, is_root = prop("level").cast("int"), F.col("type") == "root"
    last = F.max(F.when(is_root, F.col("end_line"))).over(Window.partitionBy("page_id"))
    after = Window.partitionBy("page_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    stop = None
    for k in range(1, 7):
        nxt = F.min(F.when(level <= k, F.col("line"))).over(after)
        stop = F.when(level == k, nxt) if stop is None else stop.when(level == k, nxt)
    folded = heads.select("page_id", F.lit("section").alias("kind"), F.col("line").alias("start_line"), F.coalesce(stop - 1, last).alias("end_line"), is_root.alias("_root")).filter("not _root").drop("_root")
    more = nodes.filter(F.col("type").isin("table", "template", "magic-word")).select("page_id", F.col("type").alias("kind"), F.col("line").alias("start_line"), F.col("end_line"))
    return folded.unionByName(more).filter("end_line > start_line")


def document_symbols(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The heading outline: each section with its parent section's node."""
    return sections(nodes, pages).select("page_id", "node_id", "level", "heading", "parent_section", "start", "end")


def symbol_key(nodes: DataFrame) -> DataFrame:
    """Nodes that name something, with the key under which they are the same thing."""
    kinds = nodes.filter(F.col("type").isin("template", "link", "category", "file", "arg", "double-underscore"))
    return kinds.select("page_id", "node_id", "type", F.coalesce(prop("target"), F.col("name")).alias("key"), "start", "end")


def find_references(nodes: DataFrame, page_id: int, node_id: int) -> DataFrame:
    """All uses in the page of what a node names."""
    keys = symbol_key(nodes).filter(F.col("page_id") == page_id)
    mine = keys.filter(F.col("node_id") == node_id).select("page_id", "type", "key")
    return keys.join(mine, ["page_id", "type", "key"], "left_semi")


def rename(nodes: DataFrame, page_id: int, node_id: int, new: str) -> DataFrame:
    """Edits that give all uses a new name."""
    uses = find_references(nodes, page_id, node_id).select("page_id", F.col("node_id").alias("parent_id"))
    parts = nodes.filter(F.col("type").isin("template-name", "link-target", "arg-name")).join(uses, ["page_id", "parent_id"], "left_semi")
    return parts.select("page_id", F.struct("start", "end", F.lit(new).alias("text")).alias("edit"))


def reference_definitions(nodes: DataFrame) -> DataFrame:
    """Named reference uses with the use that holds the content."""
    uses = references(nodes).filter("name is not null")
    bodies = uses.filter(~F.col("reuse")).groupBy("page_id", "group", "name").agg(F.min("node_id").alias("definition_id"))
    return uses.join(bodies, ["page_id", "group", "name"], "left").select("page_id", "node_id", "group", "name", "definition_id")


def completions(nodes: DataFrame, kind: str, prefix: str, limit: int = 20) -> DataFrame:
    """Names of that kind that begin with the prefix, the commonest in the corpus first."""
    named = nodes.filter((F.col("type") == kind) & F.startswith(F.lower("name"), F.lit(prefix.lower())))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def _channels(colour: Column) -> Column:
    """array of red, green and blue of a #hex, rgb() or hsl() colour."""
    full = F.when(F.length(colour) == 4, F.regexp_replace(colour, "([0-9a-fA-F])", "$1$1")).otherwise(colour)
    of_hex = F.array(*[F.conv(F.substring(full, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])
    parts = F.regexp_extract_all(colour, F.lit(r"(-?\d+(?:\.\d+)?%?)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "%", "").try_cast("double")
    of_rgb = F.transform(F.slice(parts, 1, 3), lambda x: F.round(F.when(F.endswith(x, F.lit("%")), number(x) * 2.55).otherwise(number(x))).cast("int"))
    hue, sat, light = (number(F.get(parts, F.lit(k))) for k in range(3))
    sat, light = sat / 100, light / 100
    reach = sat * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(n + hue / 30, F.lit(12.0))
        return F.round(255 * (light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))).cast("int")

    of_hsl = F.array(*[channel(n) for n in (0, 8, 4)])
    return F.when(F.startswith(colour, F.lit("#")), of_hex).when(F.startswith(F.lower(colour), F.lit("rgb")), of_rgb).otherwise(of_hsl)


def colours(nodes: DataFrame) -> DataFrame:
    """#hex, rgb() and hsl() colours in style attributes, with their red, green and blue parts."""
    styles = nodes.filter(F.col("type").isin("html-attr", "table-attr") & (F.col("name") == "style")).select("page_id", "node_id", prop("value").alias("style"))
    hits = F.regexp_extract_all("style", F.lit(r"(#[0-9a-fA-F]{6}\b|#[0-9a-fA-F]{3}\b|(?i:rgb|hsl)a?\([^)]*\))"), F.lit(1))
    found = styles.select("page_id", "node_id", F.posexplode(hits).alias("k", "colour")).withColumn("_c", _channels(F.col("colour")))
    return found.select("page_id", "node_id", "k", "colour", *[F.get("_c", F.lit(k)).alias(name) for k, name in enumerate(("red", "green", "blue"))])


def vocabulary(spark: SparkSession, config: SiteConfig = DEFAULT) -> DataFrame:
    """kind, name of everything a wiki's dialect knows: tags, switches, protocols, functions, variables, image options."""
    lists = {
        "ext": config.ext, "html": config.html, "switch": config.switches | config.switches_exact, "protocol": config.protocols, "function": config.functions,
        "variable": config.variables, "image": config.image, "namespace": [n for n in config.namespaces.values() if n],
    }
    return spark.createDataFrame([(kind, name) for kind, names in lists.items() for name in sorted(names)], "kind string, name string")


def inlay_hints(nodes: DataFrame) -> DataFrame:
    anon = nodes.filter((F.col("type") == "parameter") & (prop("anon") == "true") & (F.element_at("anc", -1)["type"] == "template"))
    return anon.select("page_id", "start", F.concat("name", F.lit("=")).alias("hint"))


def bold_italic(nodes: DataFrame) -> DataFrame:
    """For each apostrophe run, does it open or close bold and italic: parity of runs in its line and parent."""
    q = nodes.filter((F.col("type") == "quote")).select("page_id", "node_id", "parent_id", "start", (prop("bold") == "true").alias("bold"), (prop("italic") == "true").alias("italic"))
    breaks = nodes.filter((F.col("type") == "text") & F.contains("data", F.lit("\n"))).select("page_id", "node_id", "parent_id", "start", F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italic"))
    w = Window.partitionBy("page_id", "parent_id").orderBy("start")
    lined = q.unionByName(breaks).withColumn("_line", F.sum(F.col("bold").isNull().cast("int")).over(w))
    per = Window.partitionBy("page_id", "parent_id", "_line").orderBy("start")
    marks = lined.filter("bold is not null")
    state = lambda c: F.when(F.col(c), F.when(F.sum(F.col(c).cast("int")).over(per) % 2 == 1, "open").otherwise("close"))
    return marks.select("page_id", "node_id", state("bold").alias("bold"), state("italic").alias("italic"))


def node_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """points(page_id, at) -> the deepest element around each offset."""
    n = nodes.filter("type <> 'text'").select(F.col("page_id").alias("_p"), "node_id", "type", "depth", "start", "end")
    met = points.join(n, (F.col("page_id") == F.col("_p")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return met.groupBy("page_id", "at").agg(F.max_by("node_id", "depth").alias("node_id"), F.max_by("type", "depth").alias("type"))


#: Where the numbers of magic links lead.
RFC, PUBMED = "https://datatracker.ietf.org/doc/html/rfc", "https://www.ncbi.nlm.nih.gov/pubmed/"


def document_links(nodes: DataFrame, config: SiteConfig = DEFAULT) -> DataFrame:
    """page_id, node_id, kind, url of everything that leads somewhere: internal links too, by the wiki's article path."""
    kinds = nodes.filter(F.col("type").isin("link", "redirect-target", "category", "file", "template", "ext-link", "free-ext-link", "magic-link"))
    outside = F.when(F.startswith(prop("url"), F.lit("//")), F.concat(F.lit("https:"), prop("url"))).otherwise(prop("url"))
    number = prop("number")
    magic = F.when(F.col("name") == "RFC", F.concat(F.lit(RFC), number)).when(F.col("name") == "PMID", F.concat(F.lit(PUBMED), number, F.lit("?dopt=Abstract"))).otherwise(titles.url(F.concat(F.lit("Special:BookSources/"), number), None, config))
    inside = titles.url(F.coalesce(prop("target"), F.col("name")), prop("fragment"), config)
    url = F.when(F.col("type") == "magic-link", magic).when(F.col("type").isin("ext-link", "free-ext-link"), outside).otherwise(inside)
    return kinds.select("page_id", "node_id", F.col("type").alias("kind"), url.alias("url"), "start", "end")


def code_actions(reports: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(page_id, start, end) -> fixes of the reports that touch them."""
    from markloom.operators.lint import quick_fixes

    asked = ranges.select(F.col("page_id").alias("_p"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    touched = reports.join(asked, (F.col("page_id") == F.col("_p")) & (F.col("start") <= F.col("_b")) & (F.col("end") >= F.col("_a")), "left_semi")
    return quick_fixes(touched)


def escape_range(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits that write the bars and equals signs of ranges as the magic words that stand for them."""
    from markloom.functions.text import escape_wikitext
    from markloom.plans.parse import wikitext

    told = wikitext(ranges.select("page_id", "start", "end"), pages)
    return told.select("page_id", F.struct("start", "end", escape_wikitext(F.col("source")).alias("text")).alias("edit"))


def style_attributes(nodes: DataFrame) -> DataFrame:
    """Style attributes whose value is plain text, with the span of the value."""
    plain = nodes.filter(F.col("type").isin("html-attr", "table-attr", "ext-attr") & (F.col("name") == "style") & (prop("plain") == "true"))
    values = nodes.filter(F.col("type") == "attr-value").select("page_id", F.col("parent_id").alias("node_id"), F.col("start").alias("value_start"), F.col("end").alias("value_end"))
    return plain.select("page_id", "node_id", prop("value").alias("style"), prop("tag").alias("tag")).join(values, ["page_id", "node_id"])


def suggestions(*lists: DataFrame) -> DataFrame:
    """Names of several completion lists, each once."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [x.select("name") for x in lists]).dropDuplicates(["name"])


def possible_values(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, value: what a conditional may come out as, with those inside its branches resolved.

    A branch that is only another conditional is replaced by that one's values, as deep as they nest.
    """
    calls = nodes.filter((F.col("type") == "magic-word") & F.col("name").isin("if", "ifeq", "ifexpr", "ifexist", "iferror", "switch"))
    args = nodes.filter(F.col("type") == "parameter").select("page_id", F.col("parent_id").alias("call_id"), F.col("node_id").alias("param_id"), prop("pos").cast("int").alias("pos"), prop("anon").alias("anon"), F.max(prop("pos").cast("int")).over(Window.partitionBy("page_id", "parent_id")).alias("n"))
    met = calls.select("page_id", F.col("node_id").alias("call_id"), "name").join(args, ["page_id", "call_id"])
    first = F.when(F.col("name").isin("if", "ifexist", "ifexpr"), 2).when(F.col("name") == "ifeq", 3).when((F.col("name") == "iferror") & (F.col("n") > 2), 2).otherwise(1)
    branch = F.when(F.col("name") == "switch", (F.col("pos") > 1) & ((F.col("anon") == "false") | (F.col("pos") == F.col("n")))).otherwise((F.col("pos") >= first) & (F.col("pos") < first + 2))
    values = nodes.filter(F.col("type") == "parameter-value").select("page_id", F.col("parent_id").alias("param_id"), F.col("node_id").alias("value_id"), F.trim("text").alias("value"))
    told = met.filter(branch).join(values, ["page_id", "param_id"]).filter("value <> ''").select("page_id", "call_id", "value_id", "value")
    kids = nodes.filter(F.col("type").isNotNull()).select("page_id", F.col("parent_id").alias("value_id"), F.col("node_id").alias("kid"), "type", "name", "text").filter(F.trim("text") != "")
    only = kids.groupBy("page_id", "value_id").agg(F.count(F.lit(1)).alias("k"), F.first("kid").alias("inner"), F.first("type").alias("t"), F.first("name").alias("f"))
    only = only.filter((F.col("k") == 1) & (F.col("t") == "magic-word") & F.col("f").isin("if", "ifeq", "ifexpr", "ifexist", "iferror", "switch")).select("page_id", "value_id", "inner")
    steps = told.join(only, ["page_id", "value_id"], "left")
    done = steps.filter("inner is null").select("page_id", F.col("call_id").alias("node_id"), "value")
    links = steps.filter("inner is not null").select("page_id", F.col("call_id").alias("outer"), "inner")
    # Conditionals nest as deep as the page says, but each round handles all pages at once.
    from markloom.sources.shared import materialise

    out, links = materialise(done, "values"), materialise(links, "values-links")
    fresh = out
    while links.head(1):
        fresh = materialise(fresh.withColumnRenamed("node_id", "inner").join(links, ["page_id", "inner"]).select("page_id", F.col("outer").alias("node_id"), "value"), "values")
        if not fresh.head(1):
            break
        out = out.unionByName(fresh)
    return out


def modules(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, module, function, args of each ``#invoke``: the arguments after the function, renumbered."""
    calls = nodes.filter((F.col("type") == "magic-word") & (F.col("name") == "invoke"))
    number = lambda k: k.try_cast("int")
    rest = F.map_filter("attrs", lambda k, _: ~k.isin("1", "2"))
    args = F.transform_keys(rest, lambda k, _: F.when(number(k).isNotNull(), (number(k) - 2).cast("string")).otherwise(k))
    return calls.select("page_id", "node_id", F.concat(F.lit("Module:"), F.trim(F.try_element_at("attrs", F.lit("1")))).alias("module"), F.trim(F.try_element_at("attrs", F.lit("2"))).alias("function"), args.alias("args"))
