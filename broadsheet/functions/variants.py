"""VARIANT columns: steps, kinds, comparison and editing of one JSON value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.binding import let

INDEX = r"^(?:0|[1-9][0-9]*)\z"
VARIANTS = "array<variant>"
MEMBERS = "map<string,variant>"


def members(value: Column) -> Column:
    """The members of an object as a map; NULL for anything else."""
    return F.try_variant_get(value, "$", MEMBERS)


def elements(value: Column) -> Column:
    """The elements of a list as an array; NULL for anything else."""
    return F.try_variant_get(value, "$", VARIANTS)


def _index(part: Column) -> Column:
    return F.when(part.rlike(INDEX), part.try_cast("int"))


def step(value: Column, part: Column) -> Column:
    """One step into an object (by name) or a list (by index); NULL if there is no such place."""
    return F.coalesce(F.try_element_at(members(value), part), F.get(elements(value), _index(part)))


def kind(value: Column) -> Column:
    """object, list, string, int, float, boolean or null."""
    return let(F.schema_of_variant(value), _kind_of_schema)


def _kind_of_schema(schema: Column) -> Column:
    return (
        F.when(schema.isNull(), F.lit(None).cast("string"))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("ARRAY"), F.lit("list"))
        .when(schema == "STRING", F.lit("string"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema == "VOID", F.lit("null"))
        # Whole numbers beyond 64 bits are held as decimals of scale 0.
        .when((schema == "BIGINT") | schema.rlike(r"^DECIMAL\((?:19|[23][0-9]),0\)"), F.lit("int"))
        .otherwise(F.lit("float"))
    )


def scalar_text(value: Column) -> Column:
    """Canonical text of a scalar that keeps ``1``, ``1.0``, ``"1"`` and ``true`` apart."""

    def text(k: Column) -> Column:
        number = F.try_variant_get(value, "$", "double").cast("string")
        return F.concat_ws(":", k, F.when(k == "float", number).otherwise(F.to_json(value)))

    return let(kind(value), text)


def is_container(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return schema.startswith("OBJECT") | schema.startswith("ARRAY")


def same_value(a: Column, b: Column) -> Column:
    """Equality that respects JSON types."""
    return F.when(
        is_container(a) | is_container(b),
        (F.to_json(a) == F.to_json(b)) & (F.schema_of_variant(a) == F.schema_of_variant(b)),
    ).otherwise(scalar_text(a) == scalar_text(b))


def as_object(entries: Column) -> Column:
    """Object from a map of variants."""
    return F.to_variant_object(entries)


Edit = Callable[[Column, Column], Column]


def edit_at(value: Column, parts: list[str], in_object: Edit, in_list: Edit) -> Column:
    """Rebuild ``value`` with its place ``parts`` edited; NULL if the edit cannot be made.

    ``in_object(map, name)`` and ``in_list(array, part)`` return the edited parent
    or NULL. The walk is unrolled while the plan is built, so the whole edit is one
    expression.
    """
    part = F.lit(parts[0])

    def rebuild(v: Column) -> Column:
        obj, arr = members(v), elements(v)
        if len(parts) == 1:
            new_obj, new_arr = in_object(obj, part), in_list(arr, part)
        else:
            child = edit_at(step(v, part), parts[1:], in_object, in_list)
            new_obj = put_member(obj, part, child)
            i = _index(part)
            new_arr = F.transform(arr, lambda x, n: F.when(n == i, child).otherwise(x))
            new_obj = F.when(child.isNotNull(), new_obj)
            new_arr = F.when(child.isNotNull(), new_arr)
        return F.coalesce(as_object(new_obj), F.to_variant_object(new_arr))

    return let(value, rebuild)


def put_member(obj: Column, name: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(obj, lambda k, _: k != name), F.create_map(name, value))


def drop_member(obj: Column, name: Column) -> Column:
    return F.when(F.map_contains_key(obj, name), F.map_filter(obj, lambda k, _: k != name))


def replace_member(obj: Column, name: Column, value: Column) -> Column:
    return F.when(F.map_contains_key(obj, name), put_member(obj, name, value))


def insert_element(arr: Column, part: Column, value: Column) -> Column:
    """Insert before an index up to the length; ``-`` appends."""
    i, n = _index(part), F.size(arr)
    one = F.array(value)
    return F.when(part == "-", F.concat(arr, one)).when(
        i <= n, F.concat(F.slice(arr, F.lit(1), i), one, F.slice(arr, i + 1, F.greatest(n - i, F.lit(0))))
    )


def set_element(arr: Column, part: Column, value: Column) -> Column:
    i = _index(part)
    return F.when(i < F.size(arr), F.transform(arr, lambda x, n: F.when(n == i, value).otherwise(x)))


def drop_element(arr: Column, part: Column) -> Column:
    i = _index(part)
    return F.when(i < F.size(arr), F.filter(arr, lambda _, n: n != i))
