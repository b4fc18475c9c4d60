"""Feeds that the pages of a crawl offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions import markup as M
from broadsheet.functions.binding import let
from broadsheet.functions.urls import (
    coerce_url,
    is_feed_data,
    is_feed_url,
    is_feedlike_url,
    url_feed_prob,
    url_join,
)

# Media types of a feed link.
FEED_TYPES = [
    "application/rss+xml",
    "text/xml",
    "application/atom+xml",
    "application/x.atom+xml",
    "application/x-atom+xml",
]

# Feed names worth a guess.
GUESSED_NAMES = ["atom.xml", "index.atom", "index.rdf", "rss.xml", "index.xml", "index.rss"]

# Stages in the order in which they are tried.
PAGE, LINK, LOCAL, REMOTE, GUESS = 0, 1, 2, 3, 4


def _candidate(stage: int, url: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), url.alias("url"))


def page_candidates(page_url: Column, html: Column) -> Column:
    """Array of ``(stage, url)`` from the link and anchor tags of one page."""
    tags = F.filter(M.raw_tokens(html), lambda t: t.rlike(r"(?i)^<(?:a|link)(?![-_.a-zA-Z0-9])[^<>]*>?\z"))
    named = F.transform(
        tags,
        lambda t: let(
            M.attributes(t),
            lambda attrs: F.struct(
                M.start_name(t).alias("tag"),
                M.attribute(attrs, "type").alias("type"),
                M.attribute(attrs, "href").alias("href"),
            ),
        ),
    )

    def stages(t: Column) -> Column:
        is_link = (t["tag"] == "link") & t["type"].isin(FEED_TYPES)
        is_anchor = (t["tag"] == "a") & t["href"].isNotNull()
        is_local = is_anchor & ~t["href"].contains("://") & is_feed_url(t["href"])
        is_remote = is_anchor & is_feedlike_url(t["href"])
        tried = F.array(F.when(is_link, F.lit(LINK)), F.when(is_local, F.lit(LOCAL)), F.when(is_remote, F.lit(REMOTE)))
        return F.struct(t["href"].alias("href"), F.array_compact(tried).alias("stages"))

    offers = F.filter(F.transform(named, stages), lambda o: F.size(o["stages"]) > 0)
    resolved = F.transform(
        offers,
        lambda o: let(
            url_join(page_url, F.coalesce(o["href"], F.lit(""))),
            lambda url: F.transform(o["stages"], lambda s: F.struct(s.alias("stage"), url.alias("url"))),
        ),
    )
    return F.array_distinct(F.flatten(resolved))


def guesses(page_url: Column) -> Column:
    """Array of ``(stage, url)`` for the guessed names next to a page."""
    names = F.array(*[F.lit(name) for name in GUESSED_NAMES])
    return F.transform(names, lambda n: _candidate(GUESS, url_join(page_url, n)))


def _rows(pages: DataFrame, url: str, found: Column) -> DataFrame:
    return pages.select(F.col(url).alias("page_url"), F.explode(found).alias("c")).select(
        "page_url", "c.stage", F.col("c.url").alias("url")
    )


def tag_candidates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return _rows(pages, url, page_candidates(F.col(url), F.col(html)))


def link_candidates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return tag_candidates(pages, url, html).filter(F.col("stage") == LINK)


def anchor_candidates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Local (2) and remote (3) candidates; one anchor can be both."""
    return tag_candidates(pages, url, html).filter(F.col("stage").isin(LOCAL, REMOTE))


def guess_candidates(pages: DataFrame, url: str = "url") -> DataFrame:
    return _rows(pages, url, guesses(F.col(url)))


def is_feed(candidates: DataFrame, fetched: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Candidates whose URL was fetched and is a feed. Only URLs of feeds are shuffled."""
    feeds = fetched.filter(is_feed_data(F.col(body))).select(F.col(url).alias("url"))
    return candidates.join(feeds, "url", "left_semi")


def rank_feeds(found: DataFrame) -> DataFrame:
    """Distinct feeds of each page, the likeliest first; equal ones by URL."""
    order = Window.partitionBy("page_url").orderBy(F.desc("prob"), "url")
    return (
        found.groupBy("page_url", "url")
        .agg(F.min("stage").alias("stage"))
        .withColumn("prob", url_feed_prob(F.col("url")))
        .withColumn("rank", F.row_number().over(order))
    )


def find_feeds(
    sites: DataFrame,
    fetched: DataFrame,
    check_all: bool = False,
    site: str = "url",
    url: str = "url",
    body: str = "body",
) -> DataFrame:
    """``(page_url, url, stage, prob, rank)``: the feeds each site offers.

    A site that is a feed yields itself. Otherwise the first stage with a feed is
    the answer, or with ``check_all`` all of them. Bodies are reduced to short
    candidate lists where they are read and are never shuffled.
    """
    is_a_feed = is_feed_data(F.col(body))
    digest = (
        fetched.filter(F.col(body).isNotNull())
        .select(
            F.col(url).alias("page_url"),
            is_a_feed.alias("is_feed"),
            F.when(~is_a_feed, page_candidates(F.col(url), F.col(body))).alias("found"),
        )
        .groupBy("page_url")
        # Of several copies of a page, what any of them offers.
        .agg(F.max("is_feed").alias("is_feed"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    )
    wanted = sites.select(coerce_url(F.col(site)).alias("page_url")).distinct().join(digest, "page_url")
    itself = F.array(_candidate(PAGE, F.col("page_url")))
    offered = F.when(F.col("is_feed"), itself).otherwise(F.concat("found", guesses(F.col("page_url"))))
    candidates = wanted.select("page_url", F.explode(offered).alias("c")).select(
        "page_url", "c.stage", "c.url"
    )
    feeds = digest.filter("is_feed").select(F.col("page_url").alias("url"))
    checked = candidates.join(feeds, "url", "left_semi").repartition("page_url")
    if not check_all:
        first = F.min("stage").over(Window.partitionBy("page_url"))
        checked = checked.withColumn("first", first).filter("stage = first").drop("first")
    return rank_feeds(checked)
