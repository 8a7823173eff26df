"""SQL surface: table functions and scalar functions for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from markloom.kernel.expand import call


def register(spark: SparkSession) -> None:
    """Table functions wiki_nodes(text) and wiki_types(text) for LATERAL joins; wiki_function(name, args) for any
    parser function, in Arrow batches; and SQL functions of the commonest, which stay in the JVM."""

    @F.udtf(returnType="node_id int, parent_id int, depth int, type string, name string, start int, end int, text string")
    class WikiNodes:
        def eval(self, text: str):
            from markloom.kernel.parse import clean, parse, rows

            body = clean(text)
            for r in rows(parse(body), body):
                yield r["node_id"], r["parent_id"], r["depth"], r["type"], r["name"], r["start"], r["end"], r["text"]

    @F.udtf(returnType="type string, n int")
    class WikiTypes:
        def eval(self, text: str):
            from collections import Counter

            from markloom.kernel.parse import clean, parse, rows

            body = clean(text)
            yield from Counter(r["type"] for r in rows(parse(body), body)).items()

    spark.udtf.register("wiki_nodes", WikiNodes)
    spark.udtf.register("wiki_types", WikiTypes)
    spark.udf.register("wiki_function", F.udf(lambda name, args: call(name, list(args or [])), "string", useArrow=True))
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")


#: SQL functions by signature.
SQL_FUNCTIONS = {
    "wiki_lc(s STRING)": "lower(trim(s))", "wiki_uc(s STRING)": "upper(trim(s))",
    "wiki_lcfirst(s STRING)": "concat(lower(left(trim(s), 1)), substring(trim(s), 2))", "wiki_ucfirst(s STRING)": "concat(upper(left(trim(s), 1)), substring(trim(s), 2))",
    "wiki_if(test STRING, yes STRING, no STRING)": "CASE WHEN trim(test) <> '' THEN trim(yes) ELSE trim(no) END",
    "wiki_replace(s STRING, old STRING, new STRING)": "replace(s, CASE WHEN old = '' THEN ' ' ELSE old END, new)",
    "wiki_padleft(s STRING, n INT, fill STRING)": "CASE WHEN length(s) < n THEN lpad(s, n, fill) ELSE s END",
    "wiki_base_page(title STRING)": "regexp_replace(title, '/[^/]*$', '')", "wiki_root_page(title STRING)": "regexp_replace(title, '/.*$', '')",
}


def lint_view(spark: SparkSession, pages: str, name: str = "wiki_lint", rules: list[str] | None = None) -> None:
    """The lint reports of a table or view of pages, as a view for SQL."""
    from markloom.operators.lint import lint
    from markloom.plans.parse import parse

    found = spark.table(pages)
    lint(parse(found), found, rules).createOrReplaceTempView(name)
