"""Exact dedup: group by a 128-bit hash of the normalised text, compare bytes inside the groups.

Two texts are equal when they are identical after deleting every ASCII white-space
character. Of equal texts the row with the most code points in its original text
stays; ties go to the smallest ``doc_id``.

Defined results: NULL text counts as empty, so all empty texts are one group. A NULL
``doc_id`` loses every tie. Rows that repeat both the ``doc_id`` and the text carry the
same verdict; ``drop_copies`` returns one of them. An empty table gives an empty table.
Extra columns never clash: ``verdicts`` ignores them, ``drop_copies`` returns them.

Scale: the grouping key is the hash followed by the text, so rows of one hash are told
apart by their bytes and a collision makes two groups. Equal texts meet as partial
aggregates: a text that a third of all rows hold reaches the last step as one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _order(doc_id: Column, text: Column) -> Column:
    """Smallest first: most code points, then the smallest id, NULL ids last."""
    length = F.length(F.coalesce(text, F.lit("")))
    return F.struct((-length).alias("len"), doc_id.isNull().alias("no_id"), doc_id.alias("id"))


def verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content_hash: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"), _order(F.col(doc_id), F.col(text)).alias("order")
    ).withColumn("hash", content_hash(F.col("norm")))
    label = F.sha2("norm", 256).alias("text_sha256")
    groups = (
        rows.groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("order").alias("best"))
        .select("hash", label, "group_size", F.col("best.id").alias("keep_id"))
    )
    out = rows.select("doc_id", "hash", label).join(groups, ["hash", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content_hash: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    # The last field only settles which of several rows with the same id and length is returned.
    order = F.struct(_order(F.col(doc_id), F.col(text)), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), normalised(F.col(text)).alias("norm"), order.alias("order"))
    rows = rows.withColumn("hash", content_hash(F.col("norm")))
    return rows.groupBy("hash", "norm").agg(F.min_by("row", "order").alias("row")).select("row.*")
