import random

import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.operators import markup as M
from broadsheet.session import scratch_path
from broadsheet.streaming.markup_stream import markup_stream

PAGES = [
    "<b x=1 Y='a&amp;b&#65;' z q=\"&foo;\" x=2>t<>u</>&#65;&#300;&lt &unk; a < b & c",
    "<i<u>x</ I ><!-- a > b --><?pi x><!DOCTYPE y><![CDATA[a>b]]><b/x/ <script>if(a<b)</p></script>z",
    "tail <a href=",
    "tail <!-- open",
    "tail &#65",
    "tail &amp",
    "<![ never closed > <b>",
    "<a b='>'>",
    "",
    "<script>open < to the end",
    "<p>a<p>b</p></b><br></div>",
]


def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")


def tokens(spark, page, **options):
    rows = M.tokenize_markup(pages(spark).filter(F.col("page_id") == page), **options).orderBy("pos").collect()
    return [(r.kind, r.tag, r.data) for r in rows]


def test_rare_tokens(spark):
    got = tokens(spark, 0)
    assert got[0][:2] == ("start", "b") and got[2][:2] == ("start", "b") and got[4][:2] == ("end", "")
    assert got[5:10] == [
        ("charref", "65", "A"), ("charref", "300", None), ("entityref", "lt", "<"), ("data", None, " "), ("entityref", "unk", None),
    ]
    assert [d for k, _, d in got[10:] if k == "data"] == [" a ", "<", " b ", "&", " c"]
    row = M.tokenize_markup(pages(spark)).filter("page_id = 0 AND pos = 0").first()
    assert [(a["name"], a["value"]) for a in row.attrs] == [("x", "1"), ("y", "a&bA"), ("z", "z"), ("q", "&foo;"), ("x", "2")]


def test_kinds(spark):
    got = tokens(spark, 1)
    assert [k for k, *_ in got] == [
        "start", "start", "data", "end", "comment", "instruction", "declaration", "declaration", "start", "start", "data", "end", "data",
    ]
    assert got[3][1] == "i" and got[4][2] == " a > b " and got[5][2] == "pi x"


def test_open_end_is_data(spark):
    for page in range(2, 6):
        assert all(k == "data" for k, *_ in tokens(spark, page)), PAGES[page]
    assert tokens(spark, 6)[-1][0] == "data"
    assert [k for k, *_ in tokens(spark, 9)] == ["start", "data"]


def test_short_tags_and_no_literal_tags(spark):
    got = tokens(spark, 1, short_tags=True, literal_tags=())
    assert ("start", "b", None) in got and ("data", None, "x") in got
    assert ("end", "p", None) in got


def test_lossless(spark):
    rows = M.tokenize_markup(pages(spark)).orderBy("page_id", "pos").collect()
    for page, html in enumerate(PAGES):
        assert "".join(r.raw for r in rows if r.page_id == page) == html


def test_entity_table(spark):
    table = spark.createDataFrame([("unk", "?")], "name string, char string")
    got = M.tokenize_markup(pages(spark), entities=table).filter("kind = 'entityref'").collect()
    assert {(r.tag, r.data) for r in got if r.page_id == 0} == {("lt", None), ("unk", "?")}


def test_stack(spark):
    rows = M.close_events(pages(spark)).filter("page_id = 10").collect()
    assert [(r.tag, r.action, r.depth) for r in rows] == [
        ("p", "open", 1), ("p", "open", 2), ("p", "close", 1), ("b", "unbalanced", 1), ("div", "unbalanced", 1),
    ]


def test_stream_equals_batch(spark):
    """Random pieces in random order over several micro-batches."""
    rng = random.Random(3)
    rows = []
    for page, html in enumerate(PAGES):
        cuts = sorted(rng.sample(range(1, len(html)), min(6, len(html) - 1))) if len(html) > 1 else []
        pieces = [html[a:b] for a, b in zip([0, *cuts], [*cuts, len(html)])]
        rows += [(page, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "page_id long, seq long, chunk string, is_last boolean")
    source, out, progress = (scratch_path(spark, n) for n in ("chunks", "tokens", "progress"))
    chunks.repartition(3).write.parquet(source)
    arriving = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (
        markup_stream(arriving, "page_id").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    got, want = spark.read.parquet(out), M.tokenize_markup(pages(spark))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_after_a_rest_tag_all_is_text(spark):
    html = "a<!--<plaintext>--><plaintexts><b><PlainText x=1><i>c</i> &amp; <plaintext>"
    rows = spark.createDataFrame([(1, html), (2, "<plaintext>"), (3, "<b>x"), (4, None), (5, "")], "page_id long, html string")
    got = M.tokenize_markup(rows, rest_tags=["plaintext"]).orderBy("page_id", "pos").collect()
    first = [(r.kind, r.raw) for r in got if r.page_id == 1]
    assert first[-2:] == [("start", "<PlainText x=1>"), ("data", "<i>c</i> &amp; <plaintext>")]
    assert [k for k, _ in first] == ["data", "comment", "start", "start", "start", "data"]
    assert "".join(raw for _, raw in first) == html
    assert [(r.page_id, r.kind) for r in got if r.page_id > 1] == [(2, "start"), (3, "start"), (3, "data")]


def test_tag_stacks_hold_few_pages_at_a_time(spark, monkeypatch):
    """However many pages a batch has, only those of one slice are objects of the worker."""
    most = []
    pages = [(i, "<a><b></a></c><i></b></>" * (i % 3)) for i in range(50)]
    tagged = [{"page_id": i, "t": [{"kind": "start", "tag": "a", "pos": 0}] * (i % 3)} for i in range(50)]

    class Frame:
        dtypes = [("page_id", "bigint")]

        def mapInArrow(self, run, schema):  # noqa: N802
            out = list(run(iter([pa.RecordBatch.from_pylist(tagged)])))
            most.extend(b.num_rows for b in out)

    monkeypatch.setattr(M, "WALKED_PAGES", 4)
    M._walked(Frame(), "page_id")
    assert len(most) == 13 and max(most) <= 8 and sum(most) == sum(i % 3 for i in range(50))
    few = M.close_events(spark.createDataFrame(pages, "page_id long, html string")).collect()
    monkeypatch.setattr(M, "WALKED_PAGES", 64)
    assert sorted(map(repr, few)) == sorted(map(repr, M.close_events(spark.createDataFrame(pages, "page_id long, html string")).collect()))
    assert {r.action for r in few} == {"open", "close", "implied_close", "unbalanced"}
