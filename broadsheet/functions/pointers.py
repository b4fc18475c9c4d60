"""JSON pointer columns: parse, build, compare, resolve and set."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import variants as V

# Escapes of a pointer part, in the order in which they are undone.
ESCAPES = [("~1", "/"), ("~0", "~")]

# Fixed value: an escape that is not allowed.
BAD_ESCAPE = r"~[^01]|~\z"


def unescape_part(part: Column) -> Column:
    for mark, char in ESCAPES:
        part = F.replace(part, F.lit(mark), F.lit(char))
    return part


def escape_part(part: Column) -> Column:
    for mark, char in reversed(ESCAPES):
        part = F.replace(part, F.lit(char), F.lit(mark))
    return part


def pointer_error(pointer: Column) -> Column:
    """Why a pointer is invalid; NULL if it is valid."""
    return F.when(pointer.rlike(BAD_ESCAPE), F.lit("invalid_escape")).when(
        (pointer != "") & ~pointer.startswith("/"), F.lit("no_leading_slash")
    )


def pointer_parts(pointer: Column) -> Column:
    """Unescaped parts; NULL for an invalid pointer."""
    raw = F.split(pointer, "/")
    raw = F.slice(raw, F.lit(2), F.size(raw) - 1)
    return F.when(pointer_error(pointer).isNull(), F.transform(raw, unescape_part))


def pointer_path(parts: Column) -> Column:
    """Pointer text of an array of parts."""
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.transform(parts, escape_part), "/"))
    )


def pointer_contains(a: Column, b: Column) -> Column:
    """True when the place ``b`` is ``a`` itself or one of the places above it."""
    whole, top = pointer_parts(a), pointer_parts(b)
    return F.slice(whole, F.lit(1), F.size(top)) == top


def pointer_join_path(pointer: Column, suffix: Column) -> Column:
    """Pointer extended by a suffix, itself a pointer or an array of parts; NULL if either is invalid."""
    return pointer_path(F.concat(pointer_parts(pointer), pointer_parts(suffix)))


def pointer_join_parts(pointer: Column, parts: Column) -> Column:
    return pointer_path(F.concat(pointer_parts(pointer), parts))


def literal_parts(pointer: str) -> list[str]:
    """Parts of a pointer known while the plan is built; raises on an invalid one."""
    if "~" in pointer and re.search(r"~[^01]|~\Z", pointer):
        raise ValueError(f"invalid escape in pointer {pointer!r}")
    head, *raw = pointer.split("/")
    if head:
        raise ValueError(f"pointer {pointer!r} must be empty or start with /")
    if "~" not in pointer:
        return raw
    parts = []
    for part in raw:
        for mark, char in ESCAPES:
            part = part.replace(mark, char)
        parts.append(part)
    return parts


def pointer_get(doc: Column, pointer: str, default: Column | None = None) -> Column:
    """Value (VARIANT) at one pointer on every row; ``default`` or NULL where it is missing.

    Runs of plain names become one VARIANT path; other parts take one step each.
    """
    value, plain = doc, ""
    for part in literal_parts(pointer):
        if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", part):
            plain += f".{part}"
            continue
        if plain:
            value, plain = F.try_variant_get(value, "$" + plain, "variant"), ""
        value = V.step(value, F.lit(part))
    if plain:
        value = F.try_variant_get(value, "$" + plain, "variant")
    return value if default is None else F.coalesce(value, default)


def resolve_parts(doc: Column, parts: Column) -> Column:
    """Value at a pointer that differs per row."""
    return F.aggregate(parts, doc, V.step)


def resolve_status(doc: Column, pointer: Column) -> Column:
    """ok, missing, end_of_list (a final ``-`` below a list) or invalid."""
    parts = pointer_parts(pointer)
    parent = resolve_parts(doc, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    at_end = F.try_element_at(parts, F.lit(-1)) == "-"
    return (
        F.when(parts.isNull(), F.lit("invalid"))
        .when(resolve_parts(doc, parts).isNotNull(), F.lit("ok"))
        .when(at_end & V.elements(parent).isNotNull(), F.lit("end_of_list"))
        .otherwise(F.lit("missing"))
    )


def pointer_set(doc: Column, pointer: str, value: Column) -> Column:
    """Copy of ``doc`` with the place set; ``-`` appends; NULL when the parent is missing."""
    parts = literal_parts(pointer)
    if not parts:
        return value
    return V.edit_at(
        doc,
        parts,
        lambda obj, name: V.put_member(obj, name, value),
        lambda arr, part: F.when(part == "-", V.insert_element(arr, part, value)).otherwise(
            V.set_element(arr, part, value)
        ),
    )


# Single operations on one place. NULL means that the operation conflicts.


def op_add(doc: Column, pointer: str, value: Column) -> Column:
    parts = literal_parts(pointer)
    if not parts:
        return value
    return V.edit_at(
        doc,
        parts,
        lambda obj, name: V.put_member(obj, name, value),
        lambda arr, part: V.insert_element(arr, part, value),
    )


def op_remove(doc: Column, pointer: str) -> Column:
    parts = literal_parts(pointer)
    if not parts:
        return F.lit(None).cast("variant")
    return V.edit_at(doc, parts, V.drop_member, V.drop_element)


def op_replace(doc: Column, pointer: str, value: Column) -> Column:
    parts = literal_parts(pointer)
    if not parts:
        return value
    return V.edit_at(
        doc,
        parts,
        lambda obj, name: V.replace_member(obj, name, value),
        lambda arr, part: V.set_element(arr, part, value),
    )


def op_copy(doc: Column, from_pointer: str, pointer: str) -> Column:
    value = pointer_get(doc, from_pointer)
    return F.when(value.isNotNull(), op_add(doc, pointer, value))


def op_move(doc: Column, from_pointer: str, pointer: str) -> Column:
    """Remove, then add; the same place is a no-op; a place below itself conflicts."""
    source, target = literal_parts(from_pointer), literal_parts(pointer)
    value = pointer_get(doc, from_pointer)
    if source == target:
        return F.when(value.isNotNull(), doc)
    if target[: len(source)] == source:
        return F.lit(None).cast("variant")
    return F.when(value.isNotNull(), op_add(op_remove(doc, from_pointer), pointer, value))


def op_test(doc: Column, pointer: str, value: Column) -> Column:
    """True when the place exists and holds this value."""
    return F.coalesce(V.same_value(pointer_get(doc, pointer), value), F.lit(False))
