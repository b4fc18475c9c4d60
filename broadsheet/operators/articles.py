"""From feed items and crawled pages to normalised articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import extract_text, extract_title
from broadsheet.operators.language import detect_language


def project_item(items: DataFrame) -> DataFrame:
    return items.select("title", "link", "summary", "published")


def fetch_pages(items: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Items with the page they link to; ``fetch_status`` is ok or failed.

    ``pages`` holds one row per URL. Project it first to what is needed of a page:
    whatever ``html`` holds is shuffled. ``extract_pages`` resolves copies.
    """
    crawl = pages.select(F.col(url).alias("link"), F.col(html).alias("html"))
    return items.join(crawl, "link", "left").withColumn(
        "fetch_status", F.when(F.col("html").isNull(), "failed").otherwise("ok")
    )


def extract_pages(
    pages: DataFrame, url: str = "url", html: str = "html", version: str = "page_id"
) -> DataFrame:
    """``(link, title, text)`` per URL, from the newest copy that was fetched.

    Extraction runs in the scan stage, before any shuffle, so that markup is never
    moved; copies of a page meet as partial aggregates.
    """
    extracted = pages.filter(F.col(html).isNotNull()).select(
        F.col(url).alias("link"),
        F.col(version).alias("version"),
        F.struct(
            extract_title(F.col(html)).alias("title"), extract_text(F.col(html)).alias("text")
        ).alias("page"),
    )
    return (
        extracted.groupBy("link")
        .agg(F.max_by("page", "version").alias("page"))
        .select("link", "page.title", "page.text")
    )


def normalize_articles(
    items: DataFrame,
    pages: DataFrame,
    profiles: DataFrame,
    url: str = "url",
    html: str = "html",
    version: str = "page_id",
) -> DataFrame:
    """``(title, link, text, published, language, status)``, one row per item.

    The title is the page's. A missing link or date becomes ``''``. An item whose
    page could not be fetched keeps its row with status failed.
    """
    extracted = extract_pages(pages, url, html, version)
    languages = detect_language(extracted, "link", "text", profiles)
    known = extracted.join(languages, "link")
    fields = items.select(
        F.coalesce("link", F.lit("")).alias("link"), F.coalesce("published", F.lit("")).alias("published")
    )
    found = fields.join(known, "link", "left")
    return found.select(
        "title",
        "link",
        "text",
        "published",
        "language",
        F.when(F.col("text").isNull(), "failed").otherwise("ok").alias("status"),
    )


def only_ok(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("status") == "ok").drop("status")
