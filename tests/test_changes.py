import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import json_edits
from broadsheet.functions.json_edits import OPERATIONS
from broadsheet.operators import changes as C

# document, operations (op, path, from, value), status, failing operation, result
CASES = [
    ('{"a":1}', [("add", "/b", None, "2"), ("replace", "/a", None, "3"), ("remove", "/b", None, None)], "ok", None, {"a": 3}),
    ('{"a":1}', [("remove", "/a", None, None), ("replace", "/a", None, "3")], "conflict", 2, {"a": 1}),
    ('{"a":1}', [("remove", "/a", None, None), ("add", "/a", None, "3"), ("remove", "/a", None, None)], "ok", None, {}),
    ('{"a":1}', [("replace", "/z", None, "3")], "conflict", 1, {"a": 1}),
    ('{"a":1}', [("add", "/b", None, "1"), ("remove", "/z", None, None), ("remove", "/y", None, None)], "conflict", 2, {"a": 1}),
    (
        "{}",
        [
            ("add", "/foo", None, '"bar"'),
            ("add", "/baz", None, "[1,2,3]"),
            ("remove", "/baz/1", None, None),
            ("test", "/baz", None, "[1,3]"),
            ("replace", "/baz/0", None, "42"),
            ("remove", "/baz/1", None, None),
        ],
        "ok",
        None,
        {"foo": "bar", "baz": [42]},
    ),
    ('{"a":1}', [], "ok", None, {"a": 1}),
    ('{"a":{"x":1}}', [("move", "/a/x", "/a", None)], "conflict", 1, {"a": {"x": 1}}),
    ('{"a":{"x":1}}', [("move", "/a", "/a", None), ("move", "/b", "/a/x", None)], "ok", None, {"a": {}, "b": 1}),
    ('{"a":1}', [("add", "/b", None, "2"), ("frob", "/b", None, "2")], "invalid", 2, {"a": 1}),
    ('{"a":1}', [("add", "b", None, "2")], "pointer_error", 1, {"a": 1}),
    ('{"a":1}', [(None, "/b", None, "2")], "invalid", 1, {"a": 1}),
    ('{"a":1}', [("add", None, None, "2")], "invalid", 1, {"a": 1}),
    ('{"a":1}', [("test", "/a", None, "1.0")], "test_failed", 1, {"a": 1}),
    ('{"a":1}', [("test", "/q", None, "1")], "test_failed", 1, {"a": 1}),
    ("[1,2]", [("add", "/-", None, "3"), ("add", "/0", None, "0"), ("copy", "/1", "/0", None), ("add", "/9", None, "0")], "conflict", 4, [1, 2]),
    ('{"a":1}', [("add", "/b", None, None)], "invalid", 1, {"a": 1}),
    ('{"a":1}', [("move", "/b", None, None)], "invalid", 1, {"a": 1}),
    ('{"a":1}', [("copy", "/b", "/q", None)], "conflict", 1, {"a": 1}),
    ("[1]", [("add", "", None, '{"q":1}'), ("move", "/r", "/q", None)], "ok", None, {"r": 1}),
    ('{"a":[1]}', [("remove", "/a/-", None, None)], "pointer_error", 1, {"a": [1]}),
    ('{"a":[1]}', [("add", "/a/01", None, "1")], "pointer_error", 1, {"a": [1]}),
    ('{"a":[1]}', [("replace", "/a/-", None, "1")], "invalid", 1, {"a": [1]}),
    ('{"a":[1]}', [("replace", "/a/1", None, "1")], "conflict", 1, {"a": [1]}),
    ('{"a":[1],"b":2}', [("add", "/b/x", None, "1")], "pointer_error", 1, {"a": [1], "b": 2}),
]


def tables(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, doc string")
    log = [(i, n + 1, *op) for i, c in enumerate(CASES) for n, op in enumerate(c[1])]
    changes = spark.createDataFrame(
        log, "doc_id long, seq int, op string, path string, from string, value string"
    )
    return docs, changes


@pytest.mark.parametrize("block", [1, 2, 100_000])
def test_cases(spark, block):
    docs, changes = tables(spark)
    applied = C.apply_changes(docs, changes, block=block)
    got = {r.doc_id: r for r in applied.withColumn("doc", F.to_json("doc")).collect()}
    assert len(got) == len(CASES)
    for i, (_, _, status, failed, result) in enumerate(CASES):
        assert (got[i].status, got[i].failed_seq, json.loads(got[i].doc)) == (status, failed, result), CASES[i]


def test_variant_values_give_the_same(spark):
    docs, changes = tables(spark)
    typed = changes.withColumn("value", F.try_parse_json("value"))
    a = C.apply_changes(docs, changes).withColumn("doc", F.to_json("doc"))
    b = C.apply_changes(docs, typed).withColumn("doc", F.to_json("doc"))
    assert sorted(a.collect()) == sorted(b.collect(), key=tuple) or {tuple(r) for r in a.collect()} == {
        tuple(r) for r in b.collect()
    }


def test_added_operation(spark):
    def bump(doc, change):
        doc[change["path"][1:]] += 1
        return doc

    docs = spark.createDataFrame([(1, '{"n":1}')], "doc_id long, doc string")
    log = spark.createDataFrame(
        [(1, 1, "bump", "/n", None, None), (1, 2, "bump", "/n", None, None)],
        "doc_id long, seq int, op string, path string, from string, value string",
    )
    row = C.apply_changes(docs, log, operations={**OPERATIONS, "bump": bump}).select(F.to_json("doc"), "status").first()
    assert tuple(row) == ('{"n":3}', "ok")


def hot_log(n, seed=3):
    """Operations on lists and objects of one document that all succeed, and what they give."""
    rng = random.Random(seed)
    doc = {"l": [*range(50)], "o": {"p": [1, 2]}, "m": {}}
    start, ops = copy.deepcopy(doc), []
    for i in range(n):
        k = i % 7
        at = rng.randrange(len(doc["l"]))
        op = [
            ("add", f"/l/{at}", None, str(i)), ("remove", f"/l/{at}", None, None), ("replace", f"/l/{at}", None, f'{{"v":{i}}}'),
            ("add", f"/m/k{rng.randrange(40)}", None, str(i)), ("copy", "/o/last", f"/l/{at}", None), ("move", "/o/taken", f"/l/{at}", None),
            ("add", f"/l/{at}", None, f"[{i}.50]"),
        ][k]
        change = {"op": op[0], "path": op[1]} | ({"from": op[2]} if op[2] else {}) | ({"value": json.loads(op[3])} if op[3] else {})
        doc = OPERATIONS[op[0]](doc, change)
        ops.append((1, i + 1, *op))
    return start, ops, doc


@pytest.mark.parametrize("broken_at", [None, 7_000])
def test_a_hot_log_that_is_not_flat(spark, broken_at):
    """One document, blocks in many tasks, lists that shift: the result is that of the loop."""
    start, ops, want = hot_log(20_000)
    if broken_at is not None:
        ops[broken_at - 1] = (1, broken_at, "remove", "/m/absent", None, None)
    docs = spark.createDataFrame([(1, json.dumps(start)), (2, "{}")], "doc_id long, doc string")
    log = spark.createDataFrame(ops, "doc_id long, seq long, op string, path string, from string, value string").repartition(4)
    got = {r.doc_id: r for r in C.apply_changes(docs, log, block=512).withColumn("doc", F.to_json("doc")).collect()}
    assert got[2].status == "ok"
    if broken_at is None:
        assert got[1].status == "ok" and json.loads(got[1].doc) == want
    else:
        assert (got[1].status, got[1].failed_seq, json.loads(got[1].doc)) == ("conflict", broken_at, start)


def test_blocks_of_a_hot_log_become_tries_in_many_tasks(spark):
    _, ops, _ = hot_log(6_000)
    log = spark.createDataFrame(ops, "doc_id long, seq long, op string, path string, from string, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = C._log_blocks(C.validate_changes(log), "doc_id", OPERATIONS, 512).select("n", F.col("trie").isNotNull().alias("t"), F.spark_partition_id().alias("p")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in rows) == 6_000 and all(r.t for r in rows) and len({r.p for r in rows}) > 1


def test_both_tables_are_read_once(spark, tmp_path):
    docs, changes = tables(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    changes.write.parquet(str(tmp_path / "log"))
    got = C.apply_changes(spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "log")))
    plan = got.filter("doc_id IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("tmp_path") == 0 and plan.count("/log]") == 1 and plan.count("Exchange ") == 2


def test_long_log_of_one_document(spark):
    """One hot member, many blocks: the last writer wins and no removal clashes."""
    log = spark.range(1, 20_001).select(
        F.lit(1).cast("long").alias("doc_id"),
        F.col("id").alias("seq"),
        F.expr("if(id % 2 = 1, 'add', 'remove')").alias("op"),
        F.lit("/x").alias("path"),
        F.lit(None).cast("string").alias("from"),
        F.expr("if(id % 2 = 1, cast(id as string), null)").alias("value"),
    )
    docs = spark.createDataFrame([(1, '{"a":0}')], "doc_id long, doc string")
    row = C.apply_changes(docs, log, block=1000).select(F.to_json("doc"), "status").first()
    assert tuple(row) == ('{"a":0}', "ok")
    clash = log.withColumn("op", F.when(F.col("seq") == 15_001, "remove").otherwise(F.col("op")))
    row = C.apply_changes(docs, clash, block=1000).select("status", "failed_seq").first()
    assert tuple(row) == ("conflict", 15_001)


def test_no_decoder_or_encoder_is_made_for_each_value(monkeypatch):
    """Values are read and written with ones made once, as they would be otherwise."""
    texts = ['{"a/é":[1,-2,1.50,1e400,"\\u0001\\ud83d\\ude00\\"",null,true],"":{}}', "12345678901234567.89", '"x"', "[]", "-0"]
    made = [json.loads(t, parse_float=json_edits._number, object_pairs_hook=json_edits._members) for t in texts]

    def no(*_, **__):
        raise AssertionError("made anew")

    for name in ("JSONDecoder", "JSONEncoder"):
        monkeypatch.setattr(json, name, no)
    read = [json_edits.from_text(t) for t in texts]
    assert read == made and [json_edits.to_text(v) for v in read] == ['{"a/é":[1,-2,1.50,1e400,"\\u0001😀\\"",null,true],"":{}}', *texts[1:4], "0"]
    assert json_edits.typed_text({"b": 1, "a": "é"}) == '{"a": "\\u00e9", "b": 1}' and json_edits.plain_text([1, None, "é"]) == '[1, null, "é"]'
    for bad in ('{"a":1,"a":2}', "", "x", "\ufeff1"):
        with pytest.raises(ValueError):
            json_edits.from_text(bad)


def test_the_decoder_goes_to_other_processes():
    import pickle

    again = pickle.loads(pickle.dumps(json_edits._DECODER))
    assert again.decode('{"a":1.50}')["a"].text == "1.50"
