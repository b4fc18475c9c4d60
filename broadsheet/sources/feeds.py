"""Feed documents as item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RSS_ITEM = "struct<title:string,link:string,description:string,pubDate:string,date:string>"
_ENTRY = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,"
    "summary:string,published:string,updated:string>"
)
_FEED = f"channel struct<item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ENTRY}>"
_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}

ITEM_FIELDS = ["title", "link", "summary", "published"]


def _rss_item(i: Column) -> Column:
    return F.struct(
        i["title"].alias("title"),
        i["link"].alias("link"),
        i["description"].alias("summary"),
        F.coalesce(i["pubDate"], i["date"]).alias("published"),
    )


def _atom_entry(e: Column) -> Column:
    plain = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        e["title"].alias("title"),
        F.get(plain, F.lit(0))["_href"].alias("link"),
        e["summary"].alias("summary"),
        F.coalesce(e["published"], e["updated"]).alias("published"),
    )


def parse_feeds(feeds: DataFrame, url: str = "feed_url", xml: str = "xml") -> DataFrame:
    """``(feed_url, pos, title, link, summary, published)`` from a table of feed documents.

    Items keep their feed order in ``pos``; a field that an item lacks is NULL. A
    feed that cannot be parsed gives no item here; see ``malformed_feeds``.
    """
    parsed = F.from_xml(F.col(xml), _FEED, _OPTIONS)
    items = F.coalesce(
        F.transform(F.col("f.channel.item"), _rss_item),
        F.transform(F.col("f.item"), _rss_item),
        F.transform(F.col("f.entry"), _atom_entry),
    )
    return (
        feeds.select(url, parsed.alias("f"))
        .select(url, F.posexplode(items).alias("pos", "i"))
        .select(url, "pos", *[F.col(f"i.{name}").alias(name) for name in ITEM_FIELDS])
    )


def _checked(xml: Column) -> Column:
    """The parsed feed; its ``_corrupt_record`` is set if the text is not well formed."""
    return F.from_xml(xml, f"{_FEED}, _corrupt_record string", {**_OPTIONS, "mode": "PERMISSIVE"})


def malformed_feeds(feeds: DataFrame, url: str = "feed_url", xml: str = "xml") -> DataFrame:
    """Feeds without text, or whose text is not well formed."""
    parsed = _checked(F.col(xml))
    return feeds.filter(parsed.isNull() | parsed["_corrupt_record"].isNotNull()).select(url)


def feed_reports(feeds: DataFrame, url: str = "feed_url", xml: str = "xml") -> DataFrame:
    """``(feed_url, status, n_items)`` of every feed: ok, empty (no text) or malformed. Computed in the scan stage."""
    n_items = F.coalesce(F.size("f.channel.item"), F.size("f.item"), F.size("f.entry"), F.lit(0))
    status = F.when(F.trim(F.coalesce(xml, F.lit(""))) == "", "empty").when(
        F.col("f").isNull() | F.col("f._corrupt_record").isNotNull(), "malformed"
    )
    rows = feeds.select(url, xml, _checked(F.col(xml)).alias("f")).withColumn("status", F.coalesce(status, F.lit("ok")))
    return rows.select(url, "status", F.when(F.col("status") == "ok", n_items).otherwise(0).alias("n_items"))


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(feed_url, xml)``, one row per file: a feed is one small document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("xml")
    )


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of all feed files below a path, in feed order."""
    return parse_feeds(feed_files(spark, path))


def scan_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of feed dumps too large to hold one file in a row; the order is not kept."""
    item = F.struct("*")
    if row_tag == "entry":
        fields = "title string, link array<struct<_href:string,_rel:string>>, summary string, published string, updated string"
        shape = _atom_entry
    else:
        fields = "title string, link string, description string, pubDate string, date string"
        shape = _rss_item
    rows = spark.read.schema(fields).options(rowTag=row_tag, **_OPTIONS).xml(path)
    return (
        rows.select(F.col("_metadata.file_path").alias("feed_url"), item.alias("i"))
        .select("feed_url", shape(F.col("i")).alias("i"))
        .select("feed_url", *[F.col(f"i.{name}").alias(name) for name in ITEM_FIELDS])
    )


def stream_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """The same items as an unbounded stream over the files that arrive below a path."""
    return parse_feeds(stream_feed_files(spark, path))


def stream_feed_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``(feed_url, xml)`` of the files that arrive below a path, at most ``max_files`` in a batch."""
    reader = spark.readStream.schema("value string")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed_url"), F.col("value").alias("xml"))


def published_ts(published: Column) -> Column:
    """Timestamp of a raw date text; NULL when it is in neither usual form."""
    text = F.regexp_replace(published, "^[A-Za-z]{3}, *", "")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(published),
    )
