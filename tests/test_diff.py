import json
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import json_walk as W
from broadsheet.functions import variants as V
from broadsheet.operators import changes as C
from broadsheet.operators import diff as D

PAIRS = [
    ({"foo": "bar", "numbers": [1, 3, 4, 8]}, {"baz": "qux", "numbers": [1, 4, 7]}),
    ({"a": 1, "b": [1, 2, 3, {"x": 1}], "k": {"old": [1, 2]}}, {"a": 1.0, "b": [1, 5], "m": {"old": [1, 2]}}),
    ({"l": [1, 2, 3, 4, 5], "q": []}, {"l": [1, 2], "q": [3, 9], "z": 5}),
    ({"a/b": 1, "c~": 2}, {"a/b": 2}),
    ({"l": [[1], [2, 3]]}, {"l": {"0": 1}}),
    ({"x": True, "y": 1, "e": {}}, {"x": 1, "y": True, "e": []}),
    ({"l": list(range(13))}, {"l": [0], "m": [12, 3], "t": 7}),
    ({"a": [1, 1.0]}, {"b": [1.0, 1]}),
    ([1, 2], {"a": 1}),
    ({"1": "a", "2": "b"}, {"1": "b", "3": "a"}),
    ({"d": {"d": {"d": {"d": {"d": [1]}}}}}, {"d": {"d": {"d": {"d": {"d": [1.0, 2]}}}}}),
    ({"same": [1]}, {"same": [1]}),
]


def random_value(rng, depth=0):
    kind = rng.choice(["int", "float", "str", "bool", "null"] + (["list", "dict"] * 2 if depth < 3 else []))
    if kind == "list":
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == "dict":
        return {rng.choice("abc/~01"): random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    return {"int": rng.randint(0, 2), "float": float(rng.randint(0, 2)), "str": rng.choice("xy"), "bool": rng.random() < 0.5, "null": None}[kind]


def tables(spark):
    rng = random.Random(7)
    pairs = PAIRS + [({"r": random_value(rng), "s": random_value(rng)}, {"r": random_value(rng), "s": random_value(rng)}) for _ in range(150)]
    rows = [(i, json.dumps(s), json.dumps(d)) for i, (s, d) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, s string, d string")
    return df.select("doc_id", F.col("s").alias("doc")), df.select("doc_id", F.col("d").alias("doc"))


@pytest.mark.parametrize("moves", [False, True])
def test_apply_of_diff_is_the_target(spark, moves):
    src, dst = tables(spark)
    applied = C.apply_changes(src, D.diff_docs(src, dst, moves=moves))
    want = dst.select("doc_id", F.parse_json("doc").alias("want"))
    joined = applied.join(want, "doc_id")
    wrong = joined.filter((F.col("status") != "ok") | ~V.same_value(F.col("doc"), F.col("want")))
    assert joined.count() == src.count()
    assert wrong.select("doc_id", "status", F.to_json("doc"), F.to_json("want")).collect() == []


def test_moves_are_found(spark):
    src, dst = tables(spark)
    ops = D.diff_docs(src, dst, moves=True).filter("op = 'move'")
    got = {(r.doc_id, r["from"], r.path) for r in ops.filter(f"doc_id < {len(PAIRS)}").collect()}
    assert (1, "/k", "/m") in got
    assert {p for i, _, p in got if i == 2} == {"/q/0", "/z"}
    assert not [g for g in got if g[0] == 7], "values that differ in number kind are no move"


def nested(depth, leaf):
    for i in range(depth):
        leaf = {"d": leaf, "n": i} if i % 2 else [0, leaf]
    return leaf


@pytest.mark.parametrize("depth", [12, 400])
def test_deep_documents_name_the_single_changed_leaf(spark, depth):
    rows = [(1, json.dumps(nested(depth, 1)), json.dumps(nested(depth, 1.0))), (2, json.dumps(nested(depth, {"a": [5]})), json.dumps(nested(depth, {"b": [5]})))]
    df = spark.createDataFrame(rows, "doc_id long, s string, d string")
    src, dst = df.selectExpr("doc_id", "s AS doc"), df.selectExpr("doc_id", "d AS doc")
    leaf = "".join("/d" if i % 2 else "/1" for i in reversed(range(depth)))
    got = [(r.doc_id, r.op, r.path, r["from"]) for r in D.diff_docs(src, dst, moves=True).orderBy("doc_id").collect()]
    assert got == [(1, "replace", leaf, None), (2, "move", leaf + "/b", leaf + "/a")]


def test_taken_indices_against_a_list():
    rng = random.Random(2)
    for size in (1, 2, 7, 200):
        first = rng.randint(0, 3)
        left, taken, order = [*range(first + size)], W.Taken(first, size), [*range(first, first + size)]
        rng.shuffle(order)
        for index in order:
            assert taken.now(index) == left.index(index)
            left.remove(index)


def test_many_moves_out_of_one_list(spark):
    """Ten thousand elements leave one list for an object, in the order of its names."""
    names = {f"k{(i * 7919) % 10_000:05d}": i for i in range(10_000)}
    rows = [(1, json.dumps({"l": [*range(-5, 10_000)], "o": {}}), json.dumps({"l": [*range(-5, 0)], "o": names}))]
    df = spark.createDataFrame(rows, "doc_id long, s string, d string")
    src, dst = df.selectExpr("doc_id", "s AS doc"), df.selectExpr("doc_id", "d AS doc")
    log = D.diff_docs(src, dst, moves=True)
    assert log.groupBy("op").count().collect() == [("move", 10_000)]
    left = [*range(-5, 10_000)]
    for r in log.orderBy("seq").collect():
        assert names[r.path.split("/")[2]] == left.pop(int(r["from"].split("/")[2]))


def test_one_sided_and_broken_documents(spark):
    src = spark.createDataFrame([(1, "{}"), (2, '{"a":1}'), (3, "no json"), (4, None), (None, "[1]"), (6, "[1e2]")], "doc_id long, doc string")
    dst = spark.createDataFrame([(2, "no json"), (3, "5"), (5, "null"), (6, "[100.0]")], "doc_id long, doc string")
    got = {(r.doc_id, r.op, r.path, r.value and r.value.toJson()) for r in D.diff_docs(src, dst, moves=True).collect()}
    assert got == {(1, "remove", "", None), (2, "remove", "", None), (3, "add", "", "5"), (5, "add", "", "null"), (None, "remove", "", None)}
    nothing = spark.createDataFrame([], "doc_id long, doc string")
    assert D.diff_docs(nothing, nothing).collect() == []


def test_plan_of_moves(spark):
    src, dst = tables(spark)
    plan = D.diff_docs(src, dst, moves=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2 and plan.count("MapInArrow") == 1


def test_merge_replaces(spark):
    ops = spark.createDataFrame(
        [(1, 1, "remove", "/a"), (1, 2, "add", "/a"), (1, 3, "remove", "/b"), (1, 4, "add", "/c"), (2, 1, "add", "/a")],
        "doc_id long, seq int, op string, path string",
    )
    got = sorted((r.doc_id, r.seq, r.op, r.path) for r in D.merge_replaces(ops).collect())
    assert got == [(1, 2, "replace", "/a"), (1, 3, "remove", "/b"), (1, 4, "add", "/c"), (2, 1, "add", "/a")]
