"""JSON documents as tables: flatten, resolve pointers, set values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import pointers as P
from broadsheet.functions import variants as V
from broadsheet.functions.binding import let

# Levels that are opened natively; what is deeper is walked in one step.
MAX_DEPTH = 8

_NODE = "struct<path:string,parent:string,sort_key:string,value:variant,open:boolean>"


def _node(path: Column, parent: Column, sort_key: Column, value: Column, at_edge: Column) -> Column:
    return F.struct(
        path.alias("path"),
        parent.alias("parent"),
        sort_key.alias("sort_key"),
        value.alias("value"),
        at_edge.alias("open"),
    )


def member_key(name: Column) -> Column:
    """Sort key of an object member below its parent."""
    return F.concat(F.lit("\x01"), name)


def element_key(index: Column) -> Column:
    """Sort key of a list element: indices order as numbers."""
    return F.concat(F.lit("\x01"), F.lpad(index.cast("string"), 12, "0"))


def _opened(node: Column) -> Column:
    """A node as an array: itself, and its children when it is an open container."""
    inside = F.concat(node["path"], F.lit("/"))
    edge = F.when(node["open"], node["value"])
    by_name = F.transform(
        F.map_entries(V.members(edge)),
        lambda e: _node(
            F.concat(inside, P.escape_part(e["key"])),
            node["path"],
            F.concat(node["sort_key"], member_key(e["key"])),
            e["value"],
            F.lit(True),
        ),
    )
    by_index = F.transform(
        V.elements(edge),
        lambda x, i: _node(
            F.concat(inside, i.cast("string")),
            node["path"],
            F.concat(node["sort_key"], element_key(i)),
            x,
            F.lit(True),
        ),
    )
    # A scalar, or a container opened at an earlier level, has no children here.
    itself = F.array(_node(node["path"], node["parent"], node["sort_key"], node["value"], F.lit(False)))
    children = F.coalesce(by_name, by_index, F.array().cast(f"array<{_NODE}>"))
    return F.when(node["open"], F.concat(itself, children)).otherwise(F.array(node))


def flatten_docs(
    docs: DataFrame, key: str = "doc_id", doc: str = "doc", max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``(key, path, parent, type, value, sort_key)``, one row per place of a document, at any depth.

    ``doc`` is a VARIANT. Each level replaces an open container by itself and its
    children within the same scan: no shuffle, no recursion. Documents whose schema shows
    more than ``max_depth`` levels may have containers that are still open then; only their
    rows pass through Python, which lists the places below in one step.
    """
    rows = _once(docs, key, doc, max_depth)
    shallow = _levels(rows.filter("not read.deep"), key, "read.doc", max_depth).select(
        key, "node.path", "node.parent", "node.value", "node.sort_key"
    )
    deep = _with_places_below(_levels(rows.filter("read.deep"), key, "read.doc", max_depth), key)
    return shallow.unionByName(deep).select(key, "path", "parent", V.kind(F.col("value")).alias("type"), "value", "sort_key")


def _once(docs: DataFrame, key: str, doc: str, max_depth: int) -> DataFrame:
    """``(key, read)``: each document that is not NULL, and whether it may be deep.

    Both come out of an explode, so a filter on them does not repeat the expression of the document, which may parse it.
    """

    # Every level of nesting opens a bracket in the schema of a document, unless elements of several
    # kinds hide theirs; names may add more.
    def may_be_deep(schema: Column) -> Column:
        brackets = F.length(schema) - F.length(F.replace(schema, F.lit("<"), F.lit("")))
        return (brackets > max_depth) | schema.contains("VARIANT")

    def read(d: Column) -> Column:
        return F.struct(d.alias("doc"), let(F.schema_of_variant(d), may_be_deep).alias("deep"))

    found = F.filter(F.array(F.col(doc)), lambda d: d.isNotNull())
    return docs.select(key, F.explode(F.transform(found, read)).alias("read"))


def _levels(docs: DataFrame, key: str, doc: str, max_depth: int) -> DataFrame:
    """``(key, node)``: the places of the first levels; containers below them are still open."""
    no_parent = F.lit(None).cast("string")
    rows = docs.select(key, _node(F.lit(""), no_parent, F.lit(""), F.col(doc), F.lit(True)).alias("node"))
    for _ in range(max_depth):
        rows = rows.select(key, F.explode(let(F.col("node"), _opened)).alias("node"))
    return rows


def _with_places_below(rows: DataFrame, key: str) -> DataFrame:
    """The places of nodes, and those below the ones that are still open."""
    deep = F.col("node.open") & V.kind(F.col("node.value")).isin("object", "list")
    itself = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast("array<boolean>").alias("indexed"))
    below = F.when(deep, _places_below(F.to_json("node.value")))
    rows = rows.select(key, "node", F.explode(F.concat(F.array(itself), F.coalesce(below, F.array().cast(_PLACES)))).alias("below"))
    here = F.size("below.parts") == 0
    parts = F.transform("below.parts", P.escape_part)
    path = F.concat(F.col("node.path"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("/"), p)), ""))
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    parent = F.concat(F.col("node.path"), F.array_join(F.transform(above, lambda p: F.concat(F.lit("/"), p)), ""))
    keys = F.zip_with("below.parts", "below.indexed", lambda p, i: F.when(i, element_key(p)).otherwise(member_key(p)))
    return rows.select(
        key,
        path.alias("path"),
        F.when(here, F.col("node.parent")).otherwise(parent).alias("parent"),
        F.when(here, F.col("node.value")).otherwise(P.resolve_parts(F.col("node.value"), F.col("below.parts"))).alias("value"),
        F.concat(F.col("node.sort_key"), F.array_join(keys, "")).alias("sort_key"),
    )


_PLACES = "array<struct<parts:array<string>,indexed:array<boolean>>>"


@F.pandas_udf(
    T.ArrayType(T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("indexed", T.ArrayType(T.BooleanType()))]))
)
def _places_below(texts: pd.Series) -> pd.Series:
    """All places inside each container, as the names and indices that lead to them; a stack, so any depth will do."""

    def walk(text):
        if text is None:
            return None
        out, stack = [], [(json.loads(text), [], [])]
        while stack:
            value, parts, indexed = stack.pop()
            if parts:
                out.append({"parts": parts, "indexed": indexed})
            if isinstance(value, dict):
                stack.extend((v, [*parts, k], [*indexed, False]) for k, v in value.items())
            elif isinstance(value, list):
                stack.extend((v, [*parts, str(i)], [*indexed, True]) for i, v in enumerate(value))
        return out

    return texts.map(walk)


def pointer_join(
    docs: DataFrame, pointers: DataFrame, key: str = "doc_id", doc: str = "doc", pointer: str = "pointer"
) -> DataFrame:
    """``(key, pointer, value, status)`` for a table of pointers that differ per row.

    One equi-join on the document; each pointer is then walked in its row.
    """
    joined = pointers.select(key, pointer).join(docs.select(key, F.col(doc).alias("doc")), key)
    parts = P.pointer_parts(F.col(pointer))
    return joined.select(
        key,
        pointer,
        P.resolve_parts(F.col("doc"), parts).alias("value"),
        P.resolve_status(F.col("doc"), F.col(pointer)).alias("status"),
    )


def rows_where_pointer_equals(docs: DataFrame, pointer: str, value: Column, doc: str = "doc") -> DataFrame:
    """Documents that hold this value at this place."""
    return docs.filter(P.op_test(F.col(doc), pointer, value))


def set_pointer(docs: DataFrame, pointer: str, value: Column, doc: str = "doc") -> DataFrame:
    """Documents with the place set; ``status`` is pointer_error where the parent is missing."""
    new = P.pointer_set(F.col(doc), pointer, value)
    return (
        docs.withColumn("new", new)
        .withColumn("status", F.when(F.col("new").isNull(), "pointer_error").otherwise("ok"))
        .withColumn(doc, F.coalesce("new", doc))
        .drop("new")
    )
