"""JSON text to VARIANT and back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_docs(docs: DataFrame, doc: str = "doc", merge_duplicates: bool = False) -> DataFrame:
    """The column ``doc`` parsed to VARIANT; NULL where the text is not JSON.

    An object that names a key twice is rejected as well, or with
    ``merge_duplicates`` keeps all its values as a list. Only texts that the
    parser rejects go through the slower merge.
    """
    text = F.col(doc)
    if not merge_duplicates:
        return docs.withColumn(doc, F.try_parse_json(text))
    parsed = F.try_parse_json(text)
    retry = F.when(parsed.isNull() & text.isNotNull(), text)
    return docs.withColumn(doc, F.coalesce(parsed, F.try_parse_json(_merge_duplicates(retry))))


@F.pandas_udf(T.StringType())
def _merge_duplicates(texts: pd.Series) -> pd.Series:
    def merged(pairs):
        found: dict[str, list] = {}
        for key, value in pairs:
            found.setdefault(key, []).append(value)
        return {k: v if len(v) > 1 else v[0] for k, v in found.items()}

    def rewrite(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text, object_pairs_hook=merged), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(rewrite)


def to_json_text(value: Column) -> Column:
    """JSON text with sorted keys. The text edge writes ``1.0`` as ``1``."""
    return F.to_json(value)


def patch_to_json(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(doc_id, patch)``: the operations of each document as one JSON text, in order.

    The fields of the change log are ``seq, op, path, from, value`` with ``value``
    a VARIANT; fields that an operation lacks are left out.
    """
    def text(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.to_json(F.col(name).cast("variant")))

    fields = F.array(text("op"), text("path"), text("from"), F.concat(F.lit('"value":'), F.to_json("value")))
    one = F.concat(F.lit("{"), F.array_join(F.array_compact(fields), ","), F.lit("}"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", one.alias("json"))))
    joined = F.array_join(F.transform(ordered, lambda o: o["json"]), ",")
    return changes.groupBy(key).agg(F.concat(F.lit("["), joined, F.lit("]")).alias("patch"))


def patch_from_json(patches: DataFrame, key: str = "doc_id", patch: str = "patch") -> DataFrame:
    """The change log ``(doc_id, seq, op, path, from, value)`` of a table of patch texts.

    ``op`` and ``path`` are NULL when they are missing or not text, which the
    validation reports; so it does a text that is no list, as one row. A NULL text is
    no patch and an empty list has no operations; neither gives a row.
    """
    listed = F.try_variant_get(F.try_parse_json(F.col(patch)), "$", "array<variant>")
    # A text that is no list of operations is one operation without a name.
    broken = F.array(F.lit(None).cast("variant"))
    items = F.when(F.col(patch).isNotNull(), F.coalesce(listed, broken))

    def string(name: str) -> Column:
        field = F.try_variant_get("item", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string")).alias(name)

    return patches.select(key, F.posexplode(items).alias("at", "item")).select(
        key,
        (F.col("at") + 1).alias("seq"),
        string("op"),
        string("path"),
        string("from"),
        F.try_variant_get("item", "$.value", "variant").alias("value"),
    )
