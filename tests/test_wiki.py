"""Spark operators: every registered query against its SQL, plus what SQL can't show."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from markloom.operators import editor, lint, structure
from markloom.plans import queries, select
from markloom.plans import text as texts
from markloom.plans.parse import bad_records, parse, wikitext
from markloom.sources.shared import site_of, template_directory
from markloom.streaming import revisions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.SQL:
        got.count()
        return
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def page(spark):
    text = "{{A|x=1|y}} [[b|''c'']]\n== H ==\n<div lang=\"en\"><b>q</b></div>\n* i\n"
    return spark.createDataFrame([(1, "P", 0, text, False), (2, "Q", 0, None, False), (3, "R", 0, "", False)], "page_id long, title string, ns int, text string, include boolean")


@pytest.mark.parametrize("bad", ["a >", "> >b", "a[", "a:nope", "a:has(b:has(c))", ":nth-child(x)", "a(", "a b(", ":scope"])
def test_selector_errors(spark, page, bad):
    with pytest.raises(select.SelectorError):
        select.select(parse(page), bad).count()


@pytest.mark.parametrize(
    ("selector", "n"),
    [("template#Template:A > parameter", 2), ("parameter[anon=true]", 1), ("parameter[anon!=true]", 1), ("*", None), ("link quote, heading", 3), ("html:only-child", 0), ("parameter:last-child", 1), ("heading + html", 1), ("html:lang(en)", 1), (":root", 3), ("template:not([x=2])", 1), ("parameter:has(> parameter-key)", 2), ("heading:contains('H')", 1)],
)
def test_selectors(spark, page, selector, n):
    got = select.select(parse(page), selector).count()
    assert got == n if n is not None else got > 20


def test_null_and_empty_pages(spark, page):
    counts = {r.page_id: r["count"] for r in parse(page).groupBy("page_id").count().collect()}
    assert counts[2] == counts[3] == 1
    assert parse(page.limit(0)).count() == 0


def test_long_pages_are_parsed_whole(spark):
    pages = spark.createDataFrame([(9, "ab [[c]] ")], "page_id long, text string").select("page_id", F.repeat("text", 1_000_000).alias("text"))
    row = parse(pages, types=["root"], last="ext", columns=["type", "start", "end"]).first()
    assert (row.start, row.end) == (0, 9_000_000) and bad_records(pages.select("page_id", F.left("text", F.lit(90)).alias("text"))).count() == 0


def test_failing_pages_are_told(spark, page, monkeypatch):
    import markloom.kernel.parse as kernel

    def failing(root, text, *more):
        raise ValueError("odd page")

    monkeypatch.setattr(kernel, "table", failing)
    from markloom.plans import parse as plan

    run = plan._kernel(plan.DEFAULT, ["page_id", "type", "data"], frozenset(["link"]), "convert", "mark")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"page_id": 7, "title": "P", "text": "x", "include": False}])
    assert [b.to_pylist() for b in run(iter([batch]))] == [[{"page_id": 7, "type": "error", "data": "odd page"}]]
    with pytest.raises(plan.PageError, match="page_id 7"):
        list(plan._kernel(plan.DEFAULT, ["page_id"], None, "convert", "raise")(iter([batch])))


def test_source_of_nodes(spark, page):
    got = {r.type: r.source for r in wikitext(parse(page).filter("page_id = 1 and type in ('template', 'heading')"), page).collect()}
    assert got == {"template": "{{A|x=1|y}}", "heading": "== H =="}


def test_streaming_parse_and_counts(spark, page, tmp_path):
    source = str(tmp_path / "in")
    page.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = revisions.nodes(spark.readStream.schema(schema).parquet(source))
    q = stream.groupBy("type").count().writeStream.outputMode("complete").format("memory").queryName("kinds").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.type: r["count"] for r in spark.sql("SELECT * FROM kinds").collect()}["template"] == 1
    rev = spark.readStream.schema(schema).parquet(source).select("page_id", F.lit(1).alias("rev_id"), "ts", "text")
    q = revisions.distinct_revisions(rev).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM once").count() == 3


def test_sql_functions(spark):
    from markloom import sql

    sql.register(spark)
    got = spark.sql("SELECT t.type, t.n FROM VALUES ('{{a}} [[b]]') AS p(x), LATERAL wiki_types(x) t").collect()
    assert {r.type: r.n for r in got}["link"] == 1
    assert spark.sql("SELECT wiki_function('uc', array('ab')) AS x").first().x == "AB"
    assert spark.sql("SELECT count(*) AS n FROM VALUES ('{{a}}') AS p(x), LATERAL wiki_nodes(x) t WHERE t.type = 'template'").first().n == 1


def test_expansion_beyond_the_broadcast(spark, page, monkeypatch):
    store = spark.createDataFrame([("A", "<{{B|{{{x}}}}}>"), ("Template:B", "b{{{1}}}"), ("Unused", "u")], "title string, text string")
    one = texts.expand(page.filter("page_id = 1"), store).first().text
    monkeypatch.setattr(texts, "BROADCAST_CHARS", 0)
    assert texts.expand(page.filter("page_id = 1"), store).first().text == one and one.startswith("<b1>")


def test_edits(spark, page):
    nodes = parse(page.filter("page_id = 1"))
    edits = texts.name_anonymous(nodes).unionByName(texts.set_attribute(nodes, "div", "id", "z")).unionByName(texts.set_link_target(nodes, "B", "Z"))
    got = texts.apply_edits(page, edits).filter("page_id = 1").first()
    assert got.text == "{{A|x=1|1=y}} [[Z|''c'']]\n== H ==\n<div id=\"z\" lang=\"en\"><b>q</b></div>\n* i\n" and got.n_fixed == 3
    dup = spark.createDataFrame([(1, "{{A|x=|x=2|y=3|y=3}}")], "page_id long, text string")
    assert texts.apply_edits(dup, texts.fix_duplicate_arguments(parse(dup))).first().text == "{{A|x=2|y=3}}"
    assert texts.apply_edits(dup, texts.remove_argument(parse(dup), "Template:A", "y")).first().text == "{{A|x=|x=2}}"


def test_overlapping_fixes_are_skipped(spark):
    pages = spark.createDataFrame([(1, "abcdef")], "page_id long, text string")
    fixes = spark.createDataFrame([(1, (1, 3, "X")), (1, (2, 5, "Y")), (1, (5, 6, ""))], "page_id long, fix struct<start:int,end:int,text:string>")
    assert lint.apply_fixes(pages, fixes).first().text == "abY"


def test_spans_in_tables(spark):
    text = "{|\n| rowspan=2 | a || b\n|-\n| c\n|-\n| colspan=2 | d\n|}"
    pages = spark.createDataFrame([(1, text)], "page_id long, text string")
    got = {(r.y, r.x): (r.row, r.col) for r in structure.table_cells(parse(pages)).collect()}
    assert got == {(0, 0): (0, 0), (1, 0): (0, 0), (0, 1): (0, 1), (1, 1): (1, 0), (2, 0): (2, 0), (2, 1): (2, 0)}


def test_tag_matching_like_a_stack(spark):
    import random

    rng = random.Random(4)
    texts_ = ["".join(rng.choice(["<b>", "</b>", "<i>", "</i>", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    nodes = parse(spark.createDataFrame(list(enumerate(texts_)), "page_id long, text string"))
    got = {(r.page_id, r.node_id): r.partner_id for r in structure.matched_tags(nodes).collect()}
    want = {}
    for r in sorted(nodes.filter("type = 'html'").collect(), key=lambda r: (r.page_id, r.node_id)):
        stack = want.setdefault(("stack", r.page_id, r.name), [])
        if r.props["closing"] == "false":
            stack.append(r.node_id)
            want[(r.page_id, r.node_id)] = None
        elif stack:
            a = stack.pop()
            want[(r.page_id, r.node_id)], want[(r.page_id, a)] = a, r.node_id
        else:
            want[(r.page_id, r.node_id)] = None
    assert got == {k: v for k, v in want.items() if k[0] != "stack"}


def test_rename_and_references(spark):
    pages = spark.createDataFrame([(1, "[[a]] {{T}} [[A|x]]")], "page_id long, text string")
    nodes = parse(pages)
    first = nodes.filter("type = 'link'").orderBy("node_id").first()
    assert editor.find_references(nodes, 1, first.node_id).count() == 2
    assert texts.apply_edits(pages, editor.rename(nodes, 1, first.node_id, "New")).first().text == "[[New]] {{T}} [[New|x]]"
    assert [r.name for r in editor.completions(nodes, "template", "template:t").collect()] == ["Template:T"]
    at = editor.node_at(nodes, spark.createDataFrame([(1, 2), (1, 8)], "page_id long, at int")).orderBy("at").collect()
    assert [r.type for r in at] == ["link-target", "template-name"]


def test_template_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A%2Fb.wiki").write_text("x")
    (tmp_path / "Template꞉C.txt").write_text("y")
    got = {(r.title, r.text) for r in template_directory(spark, str(tmp_path)).collect()}
    assert got == {("A/b", "x"), ("Template:C", "y")}


def test_json_and_sites(spark, page):
    import json

    tree = json.loads(texts.to_json(page.filter("page_id = 1")).first().json)
    assert tree["type"] == "root" and tree["childNodes"][0]["name"] == "Template:A"
    got = spark.createDataFrame([("https://zh-yue.wikipedia.org/wiki/X",)], "u string").select(site_of(F.col("u")).alias("s")).first().s
    assert tuple(got) == ("zh_yuewiki", "zh-yue.wikipedia.org")


def test_newest_revisions_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "page_id long, rev_id long, ts timestamp, text string"
    rows = lambda *r: spark.createDataFrame(r, "page_id long, rev_id long, t string, text string").selectExpr("page_id", "rev_id", "to_timestamp(t) AS ts", "text")
    found = []
    for batch in (
        rows((1, 1, "2024-01-01 00:00:00", "a"), (1, 2, "2024-01-01 00:10:00", "b"), (2, 1, "2024-01-01 00:00:00", "c")),
        rows((1, 3, "2024-01-01 00:05:00", "older"), (2, 2, "2024-01-01 00:20:00", "d")),
        rows((1, 4, "2024-01-02 00:00:00", "e"), (1, 5, "2023-12-01 00:00:00", "late")),
    ):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = revisions.newest_stream(spark.readStream.schema(schema).parquet(source))
        seen = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).start()
        q.awaitTermination(120)
        found.append(sorted((r.page_id, r.rev_id, r.text) for r in seen))
    assert found == [[(1, 2, "b"), (2, 1, "c")], [(2, 2, "d")], [(1, 4, "e")]]


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = {}
    for k, ts in enumerate(["2024-01-01 00:01:00", "2024-01-01 09:00:00", "2024-01-01 00:02:00", "2024-01-01 09:01:00"]):
        spark.createDataFrame([(ts, "h1")], "t string, rule string").selectExpr("to_timestamp(t) AS ts", "rule").coalesce(1).write.mode("append").parquet(source)
        stream = revisions.rule_counts(spark.readStream.schema("ts timestamp, rule string").parquet(source))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(lambda df, _: counts.update({str(r.window_start): r.n for r in df.collect()})).start()
        q.awaitTermination(120)
    assert counts == {"2024-01-01 00:00:00": 1, "2024-01-01 09:00:00": 2}


def test_sql_views_and_functions(spark, page):
    from markloom import sql

    sql.register(spark)
    spark.createDataFrame([(1, "= x =\n"), (2, "y")], "page_id long, text string").createOrReplaceTempView("some_pages")
    sql.lint_view(spark, "some_pages")
    assert [tuple(r) for r in spark.sql("SELECT page_id, rule FROM wiki_lint").collect()] == [(1, "h1")]
    assert spark.sql("SELECT wiki_ucfirst(' ab'), wiki_if('', 'a', 'b'), wiki_padleft('7', 3, '0'), wiki_base_page('A/b/c')").first() == ("Ab", "b", "007", "A/b")


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(100, 50)], "source long, target long")
    got = {(r.source, r.target) for r in structure.template_closure(edges).collect()}
    want = {(i, j) for i in range(101) for j in (range(i + 1, 101) if i < 50 else range(50, 101))}
    assert got == want


def test_anchors_with_literal_suffixes(spark):
    pages = spark.createDataFrame([(1, "== x ==\n== x_2 ==\n== X ==\n== x ==\n")], "page_id long, text string")
    found = structure.anchors(structure.sections(parse(pages, types=["heading", "root"])))
    assert [r.anchor for r in found.orderBy("node_id").collect()] == ["x", "x_2", "X_3", "x_4"]


def test_rows_beyond_ten_thousand_columns(spark):
    cells = [("td", "", str(k)) for k in range(10_050)]
    rows = spark.createDataFrame([(1, 1, 0, cells)], "page_id long, table_id int, row int, cells array<struct<subtype: string, attrs: string, value: string>>")
    moved = structure.move_column(rows, 0, 10_049).first().cells
    assert len(moved) == 10_050 and moved[-1].value == "0" and structure.insert_column(rows, 10_050, "z").first().cells[-1].value == "z"


def test_entities_need_semicolons_in_both_forms(spark):
    from markloom.functions import titles as columns
    from markloom.kernel.titles import normalise as one

    names = ["a&amp;b", "a&ampb", "x&eacute;&#233;&#xE9;", "&copy 1", "q&nbsp;&nbsp;r", "&lt;a"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(columns.normalise(F.col("n")).alias("t")).collect()]
    assert [(t.title, t.valid) for t in got] == [(one(n).title, one(n).valid) for n in names]


def test_difference_of_long_texts(spark):
    pages = spark.range(1).select(F.lit(1).alias("page_id"), F.repeat(F.lit("abcdefgh"), 2_200_000).alias("text"))
    other = pages.select("page_id", F.concat(F.left("text", F.lit(17_300_000)), F.lit("X")).alias("text"))
    assert texts.first_difference(pages, other).first().at == 17_300_000


def test_catalogues_vocabulary_and_site_search(spark, tmp_path):
    from markloom.config import SiteConfig
    from markloom.functions import text as small

    (tmp_path / "en.json").write_text('{"@metadata": "x", "greet": "Hi $1"}')
    known = small.catalogue(spark, str(tmp_path / "en.json"))
    asked = spark.createDataFrame([("greet", ["a"]), ("greet", []), ("no", ["a"])], "key string, args array<string>")
    assert sorted(r.message for r in small.messages(asked, known).collect()) == ["Hi ", "Hi a", "⧼no⧽"]
    (tmp_path / "tiny.json").write_text('{"ext": ["nowiki"], "html": [["b"], [], ["br"]], "namespaces": {"0": ""}, "protocol": "http://"}')
    site = SiteConfig.find("tiny", [str(tmp_path / "none"), str(tmp_path)])
    assert site.ext == {"nowiki"} and {r.name for r in editor.vocabulary(spark, site).filter("kind = 'html'").collect()} == {"b", "br"}
    with pytest.raises(FileNotFoundError):
        SiteConfig.find("absent", [str(tmp_path)])


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_positions_of_many_lines_are_not_broadcast(spark):
    plan = plan_of(queries.QUERIES["position_to_offset"](spark, SF))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def parses(frame) -> int:
    """How often a query reads and parses its pages."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_neighbours_in_one_pass(spark):
    frame = queries.QUERIES["node_neighbours"](spark, SF)
    assert parses(frame) == 1 and "Join" not in plan_of(frame)


def test_table_rows_in_one_pass(spark):
    frame = queries.QUERIES["table_edit"](spark, SF)
    assert parses(frame) == 1 and "Join" not in plan_of(frame)
    text = "{| id=t\n|+ Cap\n! a\n|-\n|- class=x\n| b || style=y | c\n|-\n|+ late\n| c\n|}"
    rows = structure.tables_as_rows(parse(spark.createDataFrame([(1, text)], "page_id long, text string")))
    got = sorted((r.table_attrs, r.caption, r.row, r.row_attrs, [(c.subtype, c.attrs, c.value) for c in r.cells]) for r in rows.collect())
    assert got == [
        ("id=t", "Cap", 0, "", [("th", "", "a")]), ("id=t", "Cap", 1, "class=x", [("td", "", "b"), ("td", "style=y", "c")]), ("id=t", "Cap", 2, "", [("td", "", "c")]),
    ]


def test_grid_in_one_pass(spark):
    frame = queries.QUERIES["table_grid"](spark, SF)
    assert parses(frame) == 2 and "Join" not in plan_of(frame)  # the parse and the grid
    text = "{|\n|+ Cap\n| a\n|-\n| rowspan=2 | b ||\n|-\n| {{T}}\n|}"
    nodes = parse(spark.createDataFrame([(1, text)], "page_id long, text string"))
    assert sorted((r.y, r.x, r.value) for r in structure.table_cells(nodes, values=True).collect()) == [(0, 0, "a"), (1, 0, "b"), (1, 1, ""), (2, 0, "b"), (2, 1, "{{T}}")]
    assert "value" not in structure.table_cells(nodes).columns


@pytest.mark.parametrize("name", ["edit_nodes", "edit_images"])
def test_edits_in_one_pass(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    assert parses(frame) == 1 and "BroadcastHashJoin" not in plan_of(frame)


ONE_PASS = [
    "selector_attr",
    "selector_contains",
    "selector_nth",
    "selector_regex",
    "selector_root_empty",
    "closest_row",
    "selector_adjacent",
    "selector_descendant",
    "selector_first_last",
    "selector_child",
    "selector_has",
    "selector_is",
    "selector_not",
    "selector_sibling",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_selectors_in_one_pass(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    assert parses(frame) == 1 and "Join" not in plan_of(frame)
    assert name == "closest_row" or "anc#" not in plan_of(frame)  # only columns that the selector reads are made


def test_selectors_read_what_they_need(spark, page):
    child = select.Selector("table > tr:not([id])")
    assert child.types() == {"table", "tr"} and {"anc", "text"}.isdisjoint(child.columns())
    assert select.Selector("tr:last-child").types() is None and select.Selector("td:is([a], th[b])").types() == {"td", "th"}
    for selector in ("template:has(> parameter[anon=true])", "link, heading:parent", "*:has(+ html)", "template parameter:not(:first-of-type)"):
        got = select.find(page, selector, ["node_id"])
        assert got.columns == ["page_id", "node_id"] and sorted(got.collect()) == sorted(select.select(parse(page), selector).select("page_id", "node_id").collect())


@pytest.mark.parametrize("selector, kept_out", [("td[subtype=th] ~ tr", True), ("tr:has(td[style])", True), ("tr + tr:nth-of-type(2)", False)])
def test_rows_that_match_nothing_stay_out_of_the_shuffle(spark, page, selector, kept_out):
    plan = select.select(parse(page), selector)._jdf.queryExecution().analyzed().toString()
    assert ("Filter (_t0" in plan[plan.index("RepartitionByExpression") :]) is kept_out


def test_lists_that_pages_share_are_made_once_a_batch(monkeypatch):
    import pyarrow as pa

    from markloom.plans import parse as plan

    texts = [f"{{|\n|-\n| {k} || b\n|}}" for k in (1, 2, 3, 44)] + ["{|\n|-\n| c\n|}", "", None]
    made = []
    monkeypatch.setattr(plan, "_column", lambda name, values, f=plan._column: made.append((name, len(values))) or f(name, values))
    run = plan._kernel(plan.DEFAULT, ["page_id", "node_id", "parent_id", "text"], frozenset(["td"]), "convert", "raise")
    batch = pa.RecordBatch.from_pydict({"page_id": [5, None, 7, 8, 9, 10, 11], "title": [""] * 7, "text": texts, "include": [False] * 7})
    got = [tuple(r.values()) for out in run(iter([batch])) for r in out.to_pylist()]
    alone = [tuple(r.values()) for k in range(7) for out in run(iter([batch.slice(k, 1)])) for r in out.to_pylist()]
    assert got == alone and len(got) == 9
    assert dict(made[:4]) == {"page_id": 7, "node_id": 5, "parent_id": 5, "text": 9}


def test_order_lines_meet_before_they_are_gathered(spark):
    from markloom.sources import fixtures

    plan = fixtures.orders(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.rindex("Exchange") :]


@pytest.mark.parametrize(
    "selector, shuffled",
    [
        ("tr:nth-of-type(2n+1)", False), ("tr:first-of-type, tr:last-of-type", False), ("tr + tr", False), ("td + td:not(:last-of-type)", False), ("tr:only-of-type, td:nth-last-of-type(1)", False),
        ("td[style] + td", True), ("tr + tr + tr", True), ("td:is(td + td:nth-of-type(3))", False), ("tr:has(+ tr):nth-of-type(1)", True), ("tr:not(:first-child):first-of-type", True), ("tr td:nth-of-type(2)", True),
    ],
)
def test_places_among_siblings_need_no_shuffle(spark, selector, shuffled):
    """The parse tells them, and nodes that don't know them give the same rows by windows."""
    row = "|-\n| a || style=\"x\" | b || c\n"
    pages = spark.createDataFrame([(k, "{|\n|+ c\n! h\n! i\n" + row * k + "|}\ntext\n{|\n|-\n| d\n|}") for k in range(4)], "page_id long, text string")
    found = select.find(pages, selector, ["node_id"])
    slow = select.select(parse(pages), selector).select("page_id", "node_id")
    assert sorted(found.collect()) == sorted(slow.collect()) and slow.count()
    assert ("RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString()) is shuffled


def test_closest_rows_are_dealt_once(spark):
    from markloom.plans.queries import QUERIES

    plan = QUERIES["closest_row"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("Exchange") == 1


def test_order_rows_are_written_before_they_are_gathered(spark):
    from markloom.sources import fixtures

    plan = fixtures.orders(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "|| style" not in next(line for line in plan.splitlines() if "Aggregate" in line)
