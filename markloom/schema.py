"""Schemas of the derived tables."""

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _table(text: str, **more: T.DataType) -> T.StructType:
    """Fields as ``name kind`` pairs; ``more`` holds the types of fields of kind ``nested``."""
    pairs = (f.split() for f in text.split(","))
    return T.StructType([T.StructField(n, more[n] if kind == "nested" else _KINDS[kind]) for n, kind in pairs])


_STRINGS = T.MapType(T.StringType(), T.StringType())

PAGES = _table("page_id long, title string, ns int, text string, include boolean")

NODES = _table(
    "page_id long, node_id int, parent_id int, depth int, last_id int, ordinal int, elem_ordinal int, type string, name string, "
    "start int, end int, inner_start int, inner_end int, anc nested, data string, text string, attrs nested, props nested, "
    "line int, col int, end_line int, end_col int",
    anc=T.ArrayType(_table("id int, type string")),
    attrs=_STRINGS,
    props=_STRINGS,
)

#: Columns that a parse gives if they are asked for: a node's place among siblings of its type, their number, and the type of the element
#: before it. Of nodes whose type was not asked for the parse tells nothing: they are no elements before another.
SIBLINGS = _table("type_ordinal int, type_count int, previous_type string")

BAD = _table("page_id long, title string, error string, text string")
