"""Mixing along a curriculum against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import curriculum
from broadsheet.llm.curriculum import MAX_PASSES, SCHEDULES

DOCS = "doc_id long, text string, source string, size long, place string, bucket long, target double, row string"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, most):
    """Share by weight, cut what is above, share the rest again, until nothing is above."""
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        open_weight = sum(weights[s] for s in sizes if s not in fixed)
        share = {s: weights[s] * left / open_weight for s in sizes if s not in fixed}
        above = [s for s in share if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def plain_mix(rows, weights=(5, 2, 1), most=MAX_PASSES):
    """``(doc_id, size, source_size, target, taken)`` by walking each source's stream word by word."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = plain_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(ranked)}, most)
    out = []
    for source in ranked:
        stream = [(hashlib.md5((str(i) if i is not None else "null:" + (t or "")).encode()).hexdigest(), n_words(t), i) for i, t, s in rows if s == source]
        stream.sort(key=lambda r: (r[0], r[1]))
        left, taken = math.floor(wanted[source] + 0.5), [0] * len(stream)
        for _ in range(most):
            for n, (_, size, _) in enumerate(stream):
                some = min(left, size)
                taken[n], left = taken[n] + some, left - some
        out += [(i, size, sizes[source], round(wanted[source], 6), t) for (_, size, i), t in zip(stream, taken, strict=True)]
    return sorted(out, key=repr)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, t, s, -1, "p", 9, 0.5, "row") for i, t, s in rows], DOCS)
    got = curriculum.mix(table, **options).collect()
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=repr), got


def some_rows(n, seed, sources):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40])), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_streams(spark, seed, monkeypatch):
    # Many buckets, so that running sums cross them.
    monkeypatch.setattr(curriculum, "ROWS_PER_BUCKET", 4)
    rows = some_rows(150, seed, ["a"] * 6 + ["b", "B", "é", None, ""])
    got, _ = run(spark, rows)
    assert got == plain_mix(rows)


def test_awkward_documents(spark):
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n", None),
        (4, "one two", None),
        (None, "one two three", "a"),
        (None, None, "a"),
        (5, "x " * 20000, "b"),
        (6, "y", "b"),
        (6, "y", "b"),
        (6, "y z", "b"),
    ]
    got, _ = run(spark, rows)
    assert got == plain_mix(rows)
    assert run(spark, [])[0] == []
    # No words at all: nothing is taken and nothing has a position.
    got, raw = run(spark, [(1, None, "a"), (2, "", None)])
    assert [r[1:] for r in got] == [(0, 0, 0.0, 0)] * 2 and {r["position"] for r in raw} == {None}


def test_targets_are_met_and_capped(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = curriculum.mix(docs).collect()
    assert len(rows) == docs.count()
    by_target = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        got = by_target.setdefault((r["target"], r["source_size"]), [0])
        got[0] += r["taken"]
    for (target, size), (taken,) in by_target.items():
        assert abs(taken - target) <= 0.5 and target <= 3 * size
    assert sum(t for t, in by_target.values()) == pytest.approx(sum(r["size"] for r in rows), abs=len(by_target))


def test_partitioning_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [tuple(r) for r in curriculum.mix(docs).collect()]
    assert [tuple(r) for r in curriculum.mix(docs.repartition(5)).collect()] == want
    positions = [r[5] for r in want if r[5] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)


@pytest.mark.parametrize(
    "schedule",
    [((0, 1), (1, 1)), ((0, 0), (1, 2)), ((0, 3), (0.25, 0), (0.5, 0), (1, 4)), ((0, 0), (0.5, 0), (0.75, 2), (1, 2))],
)
def test_positions_invert_the_integral(spark, schedule):
    shares = [i / 200 for i in range(200)]
    table = spark.createDataFrame([(s, 0) for s in shares], "share double, n int")
    got = table.select(curriculum.position(F.col("share"), F.col("n"), [schedule]).alias("t")).collect()

    def demand(t):
        done = 0.0
        for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:], strict=True):
            if t > t0:
                end = min(t, t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                done += (w0 + w) / 2 * (end - t0)
        return done

    for share, r in zip(shares, got, strict=True):
        assert demand(r["t"]) == pytest.approx(share * demand(1), abs=1e-9)


def test_bad_schedules():
    for bad in [((0, 1),), ((0, 1), (0.5, 1)), ((0.1, 1), (1, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3)), ((0, 1), (0, 1), (1, 1))]:
        with pytest.raises(ValueError):
            curriculum.segments(bad)


def test_training_order_follows_the_schedules(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["early", "late"] * 60)]
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id long, text string, source string, passes string")
    schedules = (((0, 2), (1, 0)), ((0, 0), (1, 2)))
    got = curriculum.training_order(docs, schedules).collect()
    assert sum(r["words"] for r in got) == 1200 and got[0]["row"]["passes"] == "clash"
    positions = [r["position"] for r in got]
    assert positions == sorted(positions)
    first = [r["row"]["source"] for r in got[:40]]
    last = [r["row"]["source"] for r in got[-40:]]
    assert first.count("early") > 30 and last.count("late") > 30
    # A small source repeats, pass after pass.
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")] + [(i, "w " * 9, "y") for i in range(3, 20)], "doc_id long, text string, source string")
    got = [(r["row"]["doc_id"], r["pass"]) for r in curriculum.training_order(docs).collect() if r["row"]["source"] == "x"]
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert [p for _, p in got] == [1, 1, 2, 2, 3, 3]


def test_plan_has_no_python_and_the_mean_weights(spark, sf):
    assert [curriculum.segments(s)[1] for s in SCHEDULES] == [5.0, 2.0, 1.0]
    plan = curriculum.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
