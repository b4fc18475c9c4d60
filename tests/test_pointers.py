from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from broadsheet.functions import pointers as P
from broadsheet.operators import documents as DOC

DOC_TEXT = '{"foo":{"anArray":[{"prop":44}],"another prop":{"baz":"A string"}},"a%20b":1,"c d":2,"":7,"m~n":8,"x/y":9,"t":"ab"}'


def parsed(spark, text=DOC_TEXT):
    return spark.createDataFrame([(1, text)], "doc_id long, doc string").withColumn("doc", F.parse_json("doc"))


@pytest.mark.parametrize(
    "pointer, want",
    [
        ("/foo/another prop/baz", '"A string"'),
        ("/foo/anArray/0", '{"prop":44}'),
        ("/foo/anArray/0/prop", "44"),
        ("/a%20b", "1"),
        ("/c d", "2"),
        ("/c%20d", None),
        ("/", "7"),
        ("/m~0n", "8"),
        ("/x~1y", "9"),
        ("/some/path", None),
        ("/foo/anArray/00", None),
        ("/foo/anArray/-", None),
        ("/t/0", None),
    ],
)
def test_get_literal_and_per_row(spark, pointer, want):
    docs = parsed(spark)
    assert docs.select(F.to_json(P.pointer_get(F.col("doc"), pointer))).first()[0] == want
    asked = spark.createDataFrame([(1, pointer)], "doc_id long, pointer string")
    row = DOC.pointer_join(docs, asked).select(F.to_json("value"), "status").first()
    assert row[0] == want
    if pointer.endswith("/-"):
        assert row[1] == "end_of_list"
    else:
        assert row[1] == ("ok" if want else "missing")


def test_root_and_default(spark):
    docs = parsed(spark, '{"a":null}')
    row = docs.select(
        F.to_json(P.pointer_get(F.col("doc"), "")),
        F.to_json(P.pointer_get(F.col("doc"), "/a", F.parse_json(F.lit("1")))),
        F.to_json(P.pointer_get(F.col("doc"), "/b", F.parse_json(F.lit("1")))),
    ).first()
    assert tuple(row) == ('{"a":null}', "null", "1")


def test_set(spark):
    docs = parsed(spark, '{"foo":{"anArray":[{"prop":44}]}}')
    five = F.parse_json(F.lit("55"))
    for pointer, want in [
        ("/foo/anArray/0/prop", '{"foo":{"anArray":[{"prop":55}]}}'),
        ("/foo/yet another", '{"foo":{"anArray":[{"prop":44}],"yet another":55}}'),
        ("/foo/anArray/-", '{"foo":{"anArray":[{"prop":44},55]}}'),
        ("/foo/anArray/1", None),
        ("/none/x", None),
        ("", "55"),
    ]:
        assert docs.select(F.to_json(P.pointer_set(F.col("doc"), pointer, five))).first()[0] == want


@given(st.lists(st.text(alphabet="a~/01 é", max_size=4), max_size=4))
def test_literal_escape_round_trip(parts):
    text = "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)
    assert P.literal_parts(text) == parts


def test_escape_round_trip(spark):
    cases = [["a", "~", "/", "0"], [""], ["~1", "~01"], ["é/", ""], []]
    df = spark.createDataFrame([(c,) for c in cases], "parts array<string>")
    path = P.pointer_path(F.col("parts"))
    rows = df.select("parts", path.alias("path"), P.pointer_parts(path).alias("again")).collect()
    assert [r.parts for r in rows] == [r.again for r in rows]
    assert rows[0].path == "/a/~0/~1/0"


def test_invalid(spark):
    df = spark.createDataFrame([("/~",), ("/~2",), ("a",), ("/ok",)], "p string")
    rows = df.select(P.pointer_error(F.col("p")), P.pointer_parts(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["invalid_escape", "invalid_escape", "no_leading_slash", None]
    assert [r[1] for r in rows] == [None, None, None, ["ok"]]


def test_flatten_reaches_any_depth(spark):
    for depth in (1, 2, 8):
        flat = DOC.flatten_docs(parsed(spark, '{"a":[{"b/":[1, 1.50]}, {}]}'), max_depth=depth).orderBy("sort_key")
        got = [(r.path, r.parent, r.type, r.v) for r in flat.selectExpr("*", "to_json(value) AS v").collect()]
        assert [g[0] for g in got] == ["", "/a", "/a/0", "/a/0/b~1", "/a/0/b~1/0", "/a/0/b~1/1", "/a/1"]
        assert [g[1] for g in got] == [None, "", "/a", "/a/0", "/a/0/b~1", "/a/0/b~1", "/a"]
        assert got[4][3] == "1" and got[5][3] in ("1.5", "1.50")
    deep = "[" * 40 + "7" + "]" * 40
    assert DOC.flatten_docs(parsed(spark, deep)).count() == 41


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_lists_of_several_kinds_hide_no_depth(spark, depth):
    text = '[1,{"a":[2,{"b":[3,{"c":{"d":4}}]}]}]'
    flat = DOC.flatten_docs(parsed(spark, text), max_depth=depth)
    assert "/1/a/1/b/1/c/d" in {r.path for r in flat.collect()} and flat.count() == 11


def test_flatten_reads_a_document_once_a_branch(spark):
    """Deciding whether a document is deep repeats no parsing: once for shallow documents, once for deep ones."""
    texts = spark.createDataFrame([(1, '{"a":[1,{"b":2}]}'), (2, None), (3, "[[[[5]]]]"), (3, "null"), (None, "7")], "doc_id long, text string")
    flat = DOC.flatten_docs(texts.select("doc_id", F.parse_json("text").alias("doc")), max_depth=2)
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2
    got = sorted(((r.doc_id, r.path, r.type) for r in flat.collect()), key=repr)
    one = [(1, "", "object"), (1, "/a", "list"), (1, "/a/0", "int"), (1, "/a/1", "object"), (1, "/a/1/b", "int")]
    three = [(3, "/0" * n, "list") for n in range(4)] + [(3, "/0" * 4, "int"), (3, "", "null")]
    assert got == sorted([*one, *three, (None, "", "int")], key=repr)
