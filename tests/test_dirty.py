"""Ordinary dirty input: nothing is lost, nothing crashes, and every case has a status."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.text import decode_references
from broadsheet.operators import changes as C
from broadsheet.operators import diff as D
from broadsheet.operators import discovery as FD
from broadsheet.operators import markup as M
from broadsheet.operators import segment as G
from broadsheet.operators import topics as T
from broadsheet.sources.documents import patch_from_json
from broadsheet.sources.files import plain_path

LOG = "doc_id long, seq long, op string, path string, `from` string, value string"


def applied(spark, docs, log, **options):
    docs = spark.createDataFrame(docs, "doc_id long, doc string")
    got = C.apply_changes(docs, spark.createDataFrame(log, LOG), **options)
    return {r.doc_id: (r.doc and json.loads(r.doc), r.status, r.failed_seq) for r in got.withColumn("doc", F.to_json("doc")).collect()}


def test_bad_values_and_documents(spark):
    docs = [(1, '{"a":1,"b":2}'), (2, "no json"), (3, '{"a":1,"a":2}'), (4, "no json"), (5, '{"a":1}'), (6, None), (7, '{"k":1,"k":2}')]
    log = [(1, 1, "replace", "/a", None, "not json"), (4, 1, "add", "/x", None, "1"), (5, 1, "add", "/a", None, "2"), (7, 1, "add", "/x", None, "[1"), (9, 3, "add", "/x", None, "1")]
    got = applied(spark, docs, log)
    assert got[1] == ({"a": 1, "b": 2}, "invalid", 1)
    assert got[2] == got[3] == (None, "invalid", None)
    assert got[4][:2] == got[7][:2] == (None, "invalid")
    assert got[5] == ({"a": 2}, "ok", None)
    assert got[6] == (None, "ok", None)
    assert got[9] == (None, "orphan", 3)


def test_sequence_numbers(spark):
    docs = [(i, '{"a":1,"l":[1]}') for i in range(1, 6)]
    log = [
        (1, None, "add", "/b", None, "2"),
        (2, -9, "add", "/b", None, "2"), (2, -5, "add", "/l/-", None, "3"),
        (3, 4, "add", "/b", None, "2"), (3, 4, "remove", "/b", None, None),
        (4, 4, "add", "/l/-", None, "2"), (4, 4, "add", "/l/-", None, "3"),
        (5, -3, "add", "/b", None, "2"),
    ]
    got = applied(spark, docs, log)
    before = {"a": 1, "l": [1]}
    assert got[1] == (before, "invalid", None)
    assert got[2] == ({"a": 1, "l": [1, 3], "b": 2}, "ok", None)
    assert got[3] == got[4] == (before, "invalid", 4)
    assert got[5] == ({"a": 1, "l": [1], "b": 2}, "ok", None)


def test_numbers_survive_the_fold(spark):
    docs = spark.createDataFrame([(1, '{"n":12345678901234567.89,"m":1.50,"l":[]}'), (2, '{"x":1e400,"l":[]}')], "doc_id long, doc string")
    log = spark.createDataFrame([(i, 1, "add", "/l/-", None, "98765432109876543.21") for i in (1, 2)], LOG)
    got = {r.doc_id: r for r in C.apply_changes(docs, log).withColumn("doc", F.to_json("doc")).collect()}
    assert "12345678901234567.89" in got[1].doc and "98765432109876543.21" in got[1].doc and got[1].status == "ok"
    assert got[2].status == ("invalid" if got[2].doc is None else "ok")


def test_own_operations_leave_other_logs_flat(spark):
    def upper(doc, change):
        doc[change["path"][1:]] = doc[change["path"][1:]].upper()
        return doc

    known = {**C.OPERATIONS, "upper": upper}
    got = applied(spark, [(1, '{"a":"x"}'), (2, '{"a":"x"}')], [(1, 1, "upper", "/a", None, None), (2, 1, "add", "/b", None, "1")], operations=known)
    assert got == {1: ({"a": "X"}, "ok", None), 2: ({"a": "x", "b": 1}, "ok", None)}


def test_patch_texts_that_are_no_patch(spark):
    texts = spark.createDataFrame([(1, "not json"), (2, '{"op":"add"}'), (3, "[]"), (4, None), (5, '[{"op":"add","path":"/a","value":1}]')], "doc_id long, patch string")
    log = patch_from_json(texts)
    assert {r.doc_id: r.op for r in log.collect()} == {1: None, 2: None, 5: "add"}
    docs = spark.createDataFrame([(i, "{}") for i in range(1, 6)], "doc_id long, doc string")
    assert {r.doc_id: r.status for r in C.apply_changes(docs, log).collect()} == {1: "invalid", 2: "invalid", 3: "ok", 4: "ok", 5: "ok"}


def test_documents_of_one_snapshot_only(spark):
    src = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1}')], "doc_id long, doc string")
    dst = spark.createDataFrame([(2, '{"a":2}'), (3, "[3]")], "doc_id long, doc string")
    log = D.diff_docs(src, dst)
    assert {(r.doc_id, r.op, r.path) for r in log.collect()} == {(1, "remove", ""), (2, "replace", "/a"), (3, "add", "")}
    got = C.apply_changes(src, log).withColumn("doc", F.to_json("doc")).collect()
    assert {r.doc_id: (r.doc, r.status) for r in got} == {1: (None, "removed"), 2: ('{"a":2}', "ok"), 3: ("[3]", "ok")}


def test_long_stray_tag_and_missing_page(spark):
    pages = spark.createDataFrame([(1, "<y " + "word " * 300_000), (2, None), (3, "<p>x</p>")], "page_id long, html string")
    rows = M.tokenize_markup(pages)
    assert rows.count() > 0
    assert {r.page_id for r in M.close_events(pages).collect()} >= {3}
    crawl = pages.select(F.concat(F.lit("http://a.b/"), "page_id").alias("url"), F.col("html").alias("body"))
    assert FD.find_feeds(crawl, crawl).collect() == []


def test_copies_of_a_page_offer_all_their_feeds(spark):
    link = '<html><link type="application/rss+xml" href="{}"></html>'
    rows = [("http://a.b/", link.format("/one.xml")), ("http://a.b/", link.format("/two.xml"))]
    rows += [(f"http://a.b/{n}.xml", "<rss></rss>") for n in ("one", "two")]
    crawl = spark.createDataFrame(rows, "url string, body string")
    sites = spark.createDataFrame([("http://a.b/",)], "url string")
    assert {r.url for r in FD.find_feeds(sites, crawl, check_all=True).collect()} == {"http://a.b/one.xml", "http://a.b/two.xml"}


def test_long_references(spark):
    row = spark.range(1).select(decode_references(F.lit("&#00000065;&#x000000041;&#99999999999999999999;&#xFFFFFFFFFF;&#0;")).alias("t")).first()
    assert row.t == "AA&#99999999999999999999;&#xFFFFFFFFFF;&#0;"


def test_private_use_characters_stay(spark):
    words = "ab\ue006cd\ue000e\ue003"
    docs = spark.createDataFrame([(1, words), (2, "a"), (3, ""), (4, "😀a")], "doc_id long, text string")
    weights = spark.createDataFrame([("BIAS", "", 1)], "feature string, key string, weight int")
    got = {r.doc_id: r.tokens for r in G.segment(docs, weights).collect()}
    assert "".join(got[1]) == words and "" not in got[1] and got[3] == [] and "".join(got[4]) == "😀a"


def test_many_labels(spark):
    models = spark.createDataFrame([(f"{i:05d}", [float(i + 1), 1.0]) for i in range(1500)], "label string, prototype array<double>")
    docs = spark.createDataFrame([(1, [7.0, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = T.classify_topic(docs, "vec_id", T.prototype_scorer("vec_id", "embedding", models))
    assert {r.vec_id: r.topic for r in got.collect()} == {1: "00006", 2: "Unknown"}


@pytest.mark.parametrize("path, plain", [("/a//b", "/a/b"), ("/a/./b/../c/", "/a/c"), ("/../x", "/x"), ("C:/a//b", "C:/a/b"), ("/", "/"), ("", "")])
def test_plain_path(spark, path, plain):
    assert spark.range(1).select(plain_path(F.lit(path)).alias("p")).first().p == plain
