"""Article output and its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The fields of a saved article.
ARTICLE_FIELDS = ["title", "link", "text", "published", "language"]


def write_articles(articles: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, replacing earlier output; every field is written."""
    articles.select(*ARTICLE_FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_counters(normalized: DataFrame) -> DataFrame:
    """One row: articles pulled, saved and failed."""
    return normalized.agg(
        F.count(F.lit(1)).alias("pulled"),
        F.count_if(F.col("status") == "ok").alias("saved"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )


def observe_counters(normalized: DataFrame) -> tuple[DataFrame, Observation]:
    """The same counters taken while the rows are written, without a second pass."""
    seen = Observation("articles")
    return (
        normalized.observe(
            seen,
            F.count(F.lit(1)).alias("pulled"),
            F.count_if(F.col("status") == "ok").alias("saved"),
            F.count_if(F.col("status") != "ok").alias("failed"),
        ),
        seen,
    )
