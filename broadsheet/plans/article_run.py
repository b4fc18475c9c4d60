"""Pull, normalise and save: the whole article job, once or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from broadsheet.operators.articles import normalize_articles, only_ok
from broadsheet.sources.articles import observe_counters, write_articles
from broadsheet.sources.feeds import feed_files, feed_reports, parse_feeds, stream_feed_files


def _save(
    feeds: DataFrame, pages: DataFrame, profiles: DataFrame, out: str, quarantine: str | None, columns: dict[str, str]
) -> dict[str, int]:
    normalized, seen = observe_counters(normalize_articles(parse_feeds(feeds), pages, profiles, **columns))
    write_articles(only_ok(normalized), out)
    if quarantine is not None:
        feed_reports(feeds).filter("status <> 'ok'").select("feed_url", "status").write.mode("overwrite").json(quarantine)
    return seen.get


def run_articles(
    spark: SparkSession, feeds: str, pages: DataFrame, profiles: DataFrame, out: str, quarantine: str | None = None, **columns: str
) -> dict[str, int]:
    """Normalise the items of all feed files below ``feeds`` and save them to ``out``.

    One job: the counters (pulled, saved, failed) are observed while it writes. Feeds without
    text and feeds that are not well formed have no items; a second job writes their URL and
    status to ``quarantine``, if it is given, and their number is the counter ``malformed``.
    """
    counters = dict(_save(feed_files(spark, feeds), pages, profiles, out, quarantine, columns))
    if quarantine is not None:
        counters["malformed"] = spark.read.schema("feed_url string, status string").json(quarantine).count()
    return counters


def stream_articles(
    spark: SparkSession,
    feeds: str,
    pages: DataFrame,
    profiles: DataFrame,
    out: str,
    quarantine: str,
    checkpoint: str,
    max_files: int | None = None,
    **columns: str,
) -> StreamingQuery:
    """The same job over the feed files that have arrived since the last run with this ``checkpoint``.

    Each batch writes its articles to ``out/batch=<number>`` and its malformed feeds to
    ``quarantine/batch=<number>``. The checkpoint fixes which files a number has, and a batch that
    is run again replaces its own folders, so no article is written twice after a failure. A
    feed file is read once: items that it gains later belong in a new file.
    """

    def save(batch: DataFrame, number: int) -> None:
        _save(batch, pages, profiles, f"{out}/batch={number}", f"{quarantine}/batch={number}", columns)

    files = stream_feed_files(spark, feeds, max_files)
    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
