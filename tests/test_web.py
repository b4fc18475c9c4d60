"""Feeds, URLs, discovery, files, articles."""

import json
import os
from urllib.parse import urljoin

from pyspark.sql import functions as F

from broadsheet.functions import urls as U
from broadsheet.functions.text import extract_text, extract_title
from broadsheet.operators import discovery as FD
from broadsheet.operators import language as L
from broadsheet.operators import topics as T
from broadsheet.plans.article_run import run_articles, stream_articles
from broadsheet.session import scratch_path
from broadsheet.sources import feeds as SF
from broadsheet.sources import files as SFI

RSS = (
    '<?xml version="1.0"?><rss version="2.0"><channel><title>F</title><item><title> a &amp; b </title><link>http://x/1</link>'
    "<description>d</description><pubDate>Tue, 01 Dec 2026 10:00:00 GMT</pubDate></item><item><title><![CDATA[x &amp; y]]></title>"
    '<link>http://x/2</link></item></channel></rss>'
)
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">e1</title><link rel="self" href="s"/><link href="http://a"/>'
    "<summary>sm</summary><updated>2026-01-01T00:00:00Z</updated></entry></feed>"
)


def test_url_join_agrees_with_the_standard_library(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/", "https://x.org/a/b/?z#f", "http://h/x/../y", "http://a//b//c"]
    refs = (
        "g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. ..g ./../g ./g/. g/./h "
        "g/../h http:g https:g mailto:x http://z/q/../r atom.xml a//b /a//b ? x?y=/../z"
    ).split() + ["", " g", "g\n"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    rows = df.withColumn("got", U.url_join(F.col("b"), F.col("r"))).collect()
    assert [(r.b, r.r, r.got) for r in rows if r.got != urljoin(r.b, r.r)] == []


def test_url_rules(spark):
    df = spark.createDataFrame(
        [(" feed://x/y ", 0), ("https://a/comments/rss", -2), ("a.org/georss.xml", -1), ("http://a/atom.xml", 5), ("x/rss", 4), ("x/rdf", 3), ("x.xml", 2), ("myfeed", 1), ("ATOM", 0)],
        "u string, want int",
    )
    rows = df.select("want", U.url_feed_prob(F.col("u")).alias("p"), U.coerce_url(F.col("u")).alias("c")).collect()
    assert [r.p for r in rows][1:] == [r.want for r in rows][1:]
    assert rows[0].c == "http://x/y" and rows[1].c.startswith("https://a") and rows[2].c == "http://a.org/georss.xml"
    again = df.select(U.coerce_url(U.coerce_url(F.col("u"))).alias("c")).collect()
    assert [r.c for r in again] == [r.c for r in rows]


CRAWL = {
    "http://self/feed": "<RSS>",
    "http://link/": '<link type="text/xml" href="/f"><link type="text/css" href="/rss"><a href="l.rss">x</a>',
    "http://link/f": "<feed>",
    "http://link/l.rss": "<rss>",
    "http://local/a/": '<a href="n.xml">x</a><a>none</a><a href="http://remote/rss">r</a>',
    "http://local/a/n.xml": "<rdf>",
    "http://remote/rss": "<rss>",
    "http://guess/d/page": "<p>nothing</p>",
    "http://guess/d/rss.xml": "<rss>",
    "http://html/": "<html><p>about <rss></p></html>",
    "http://dead/": None,
    "http://nohref/": '<link type="application/rss+xml"><p>',
}


def test_find_feeds(spark):
    crawl = spark.createDataFrame(list(CRAWL.items()), "url string, body string")
    sites = spark.createDataFrame(
        [(u,) for u in ["self/feed", "http://link/", "http://local/a/", "http://guess/d/page", "http://html/", "http://dead/", "http://gone/", "http://link/", "http://nohref/"]],
        "url string",
    )
    first = {(r.page_url, r.url, r.stage) for r in FD.find_feeds(sites, crawl).collect()}
    assert first == {
        ("http://self/feed", "http://self/feed", 0),
        ("http://link/", "http://link/f", 1),
        ("http://local/a/", "http://local/a/n.xml", 2),
        ("http://guess/d/page", "http://guess/d/rss.xml", 4),
    }
    every = [(r.page_url, r["rank"], r.url) for r in FD.find_feeds(sites, crawl, check_all=True).collect()]
    assert ("http://link/", 1, "http://link/l.rss") in every and ("http://link/", 2, "http://link/f") in every
    assert ("http://local/a/", 1, "http://remote/rss") in every and ("http://local/a/", 2, "http://local/a/n.xml") in every


def test_feed_files(spark, tmp_path):
    for name, text in [("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<rss><channel>")]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    items = SF.feed_items(spark, str(tmp_path)).orderBy("feed_url", "pos").collect()
    assert [(i.pos, i.title, i.link, i.summary) for i in items] == [
        (0, " a & b ", "http://x/1", "d"), (1, "x &amp; y", "http://x/2", None), (0, "e1", "http://a", "sm"),
    ]
    bad = SF.malformed_feeds(SF.feed_files(spark, str(tmp_path))).collect()
    assert [os.path.basename(r.feed_url) for r in bad] == ["c.xml"]
    assert SF.scan_items(spark, str(tmp_path / "a.xml")).count() == 2
    assert [r.link for r in SF.scan_items(spark, str(tmp_path / "b.xml"), "entry").collect()] == ["http://a"]
    stamp = spark.createDataFrame([("Tue, 01 Dec 2026 10:00:00 GMT",), ("1 Dec 2026 11:00:00 +0100",), ("x",)], "p string")
    got = [r[0] for r in stamp.select(SF.published_ts(F.col("p"))).collect()]
    assert got[0] == got[1] and got[2] is None


def test_files(spark, tmp_path):
    (tmp_path / "a b+c.txt").write_bytes(b"hello")
    (tmp_path / "secret.txt").write_bytes(b"s")
    d = str(tmp_path)
    cases = [
        ("GET", f"file://{d}/a%20b+c.txt", 200), ("HEAD", f"file://localhost{d}/a%20b%2Bc.txt", 200), ("GET", f"file://{d}/no.txt", 404),
        ("GET", f"file://{d}%2Fa%20b+c.txt", 404), ("GET", "file:///", 400), ("GET", f"file://{d}/secret.txt", 403),
        ("GET", f"file://host{d}/no.txt", None), ("POST", f"file://{d}/no.txt", None), ("GET", f"file:///C|{d}/x", 404),
    ]
    requests = spark.createDataFrame([(m, u) for m, u, _ in cases], "method string, url string")
    denied = spark.createDataFrame([(f"{d}/secret.txt",)], "path string")
    got = {(r.method, r.url): r for r in SFI.resolve_file_urls(requests, SFI.list_files(spark, d), denied).collect()}
    assert [got[m, u].status for m, u, _ in cases] == [s for *_, s in cases]
    ok = got[cases[0][:2]]
    assert (bytes(ok.body), ok.content_length) == (b"hello", 5)
    missing = got[cases[2][:2]]
    assert missing.content_length == len(missing.body)
    assert spark.range(1).select(SFI.file_url_path(F.lit("file:///C|//x/y"))).first()[0] == "C:/x/y"


def test_extraction(spark):
    html = (
        "<html><head><title> A &amp;amp; B&#8364; </title><script>var a='<p>';</script></head><body><nav>menu</nav>"
        "<p>One&nbsp;<b>two</b></p><!-- x --><ul><li>three</li></ul>\t four<br>five &unknown;<footer>foot</footer></body></html>"
    )
    row = spark.createDataFrame([(html,)], "h string").select(extract_title(F.col("h")), extract_text(F.col("h"))).first()
    assert tuple(row) == ("A &amp; B€", "One two\nthree\nfour\nfive &unknown;")


def test_run_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS, encoding="utf-8")
    pages = spark.createDataFrame(
        [(1, "http://x/1", "<title>old</title><p>x</p>"), (2, "http://x/1", "<title>Straße</title><body><p>und der die</p></body>")],
        "page_id long, url string, html string",
    )
    profiles = L.fit_language_profiles(
        spark.createDataFrame([("und der die das", "de"), ("the and of that", "en")], "text string, lang string")
    )
    out = scratch_path(spark, "articles")
    assert run_articles(spark, str(tmp_path), pages, profiles, out) == {"pulled": 2, "saved": 1, "failed": 1}
    lines = [line for r in spark.read.text(out).collect() if (line := r.value)]
    assert "Straße" in lines[0]
    assert json.loads(lines[0]) == {
        "title": "Straße", "link": "http://x/1", "text": "und der die", "published": "Tue, 01 Dec 2026 10:00:00 GMT", "language": "de",
    }


def test_stream_articles_restarts_and_sets_broken_feeds_aside(spark, tmp_path):
    feeds = tmp_path / "feeds"
    feeds.mkdir()
    pages = spark.createDataFrame([(1, "http://x/1", "<p>und der</p>"), (2, "http://a", "<p>the of</p>")], "page_id long, url string, html string")
    profiles = L.fit_language_profiles(
        spark.createDataFrame([("und der die das", "de"), ("the and of that", "en")], "text string, lang string")
    )
    out, bad, state = (scratch_path(spark, x) for x in ("articles", "quarantine", "state"))

    def run():
        stream_articles(spark, str(feeds), pages, profiles, out, bad, state, max_files=1).awaitTermination()
        saved = sorted(r.link for r in spark.read.schema("link string").json(out).collect())
        set_aside = spark.read.schema("feed_url string, status string").json(bad).collect()
        return saved, sorted((os.path.basename(r.feed_url), r.status) for r in set_aside)

    (feeds / "a.xml").write_text(RSS.replace("<item>", "\n<item>\n"), encoding="utf-8")
    (feeds / "b.xml").write_text(RSS[:-10], encoding="utf-8")
    (feeds / "c.xml").write_text(" ", encoding="utf-8")
    aside = [("b.xml", "malformed"), ("c.xml", "empty")]
    assert run() == (["http://x/1"], aside)
    # Again from the same checkpoint, and once more with a file that has come since.
    assert run() == (["http://x/1"], aside)
    (feeds / "d.xml").write_text(ATOM, encoding="utf-8")
    assert run() == (["http://a", "http://x/1"], aside)
    once = scratch_path(spark, "articles")
    counters = run_articles(spark, str(feeds), pages, profiles, once, scratch_path(spark, "quarantine"))
    assert counters == {"pulled": 3, "saved": 2, "failed": 1, "malformed": 2}


def test_language_paths_agree(spark):
    docs = spark.createDataFrame(
        [(1, "und der"), (2, "the of"), (3, "123"), (4, ""), (5, None), (6, "zzz qqq")], "id long, text string"
    )
    profiles = L.fit_language_profiles(
        spark.createDataFrame([("und der die das", "de"), ("the and of that", "en")], "text string, lang string")
    )
    fast = {tuple(r) for r in L.detect_language(docs, "id", "text", profiles).collect()}
    slow = {tuple(r) for r in L.detect_language(docs, "id", "text", profiles, max_broadcast_rows=0).collect()}
    assert fast == slow
    assert {(1, "de"), (2, "en"), (3, "unknown"), (4, "unknown"), (5, "unknown")} <= fast


def test_topic_without_score(spark):
    docs = spark.createDataFrame([(1, "goal goal vote"), (2, "nothing"), (3, "vote goal")], "id long, text string")
    seeds = spark.createDataFrame([("vote", 0, "Politics", 1), ("goal", 4, "Sports", 1)], "word string, ord int, label string, weight int")
    got = {tuple(r) for r in T.classify_topic(docs, "id", T.token_scorer("id", "text", seeds)).collect()}
    assert got == {(1, "Sports"), (2, "Unknown"), (3, "Politics")}


def test_language_without_a_row_for_each_character(spark, monkeypatch):
    """Trigrams are counted and matched where texts are read, whatever the size of a piece; both ways of scoring agree."""
    rows = [(1, "Die Straße\n", "de"), (1, "the 😀 cat", "en"), (2, "", "de"), (3, None, "en"), (4, "123", None), (None, "der die das", "de"), (5, "日本語 zzz", "ja"), (6, "qqq", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = docs.select("lang", F.explode(L.trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").count()
    for size in (400_000, 2):
        monkeypatch.setattr(L, "BATCH_CHARS", size)
        counted = L._counted_grams(docs, "text", "lang")
        assert "Generate" not in counted._jdf.queryExecution().toString()
        assert sorted(map(repr, counted.collect())) == sorted(map(repr, grams.withColumnRenamed("count", "n").collect()))
        profiles = L.fit_language_profiles(docs.filter("lang <> 'xx'"))
        small = L.language_scores(docs, "doc_id", "text", profiles)
        large = L.language_scores(docs, "doc_id", "text", profiles, max_broadcast_rows=0)
        assert "Generate" not in small._jdf.queryExecution().toString()
        assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
