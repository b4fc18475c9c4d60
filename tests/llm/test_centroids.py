"""Centroid clustering against plain Python."""

import hashlib
import math
import random

import pytest

from broadsheet.llm import centroids

KIND = "vec_id long, embedding array<float>, label int, cluster string, v string, distance double"


def plain(rows, k, rounds, dim):
    """Rows ``(vec_id, vector)`` to result rows, one vector at a time."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(max(min(c * 64.0, 2.0**27), -(2.0**27))) for c in x]))
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(c) // len(members[n]) for c in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, n in found:
        sums[n] = sums.get(n, 0) + d
    total = sum(sums.values())
    return [(i, n, d, sums[n], total, hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, d, n in found]


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, x, 0, "c", "v", 0.5) for i, x in rows], KIND)
    return [tuple(r) for r in centroids.cluster(table, **options).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_against_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows = [(i, [float(f"{c:.3f}") for c in x]) for i, x in rows]
    import numpy as np

    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in rows]
    got = run(spark, rows, k=5, dim=4)
    assert ordered(got) == ordered(plain(rows, 5, 3, 4))
    # Without rounds the first centroids decide.
    assert ordered(run(spark, rows, k=5, rounds=0, dim=4)) == ordered(plain(rows, 5, 0, 4))


def test_awkward_vectors(spark):
    rows = [
        (1, [0.0, 0.0]),
        (2, None),
        (3, []),
        (4, [1.0]),
        (5, [1.0, 2.0, 3.0]),
        (6, [float("nan"), 0.0]),
        (7, [float("inf"), 0.0]),
        (8, [None, 0.0]),
        (None, [0.5, 0.5]),
        (None, [0.25, 0.5]),
        (9, [-0.5, -0.25]),
        (9, [-0.5, -0.25]),
        (9, [0.5, -0.25]),
        (10, [3.0e38, -3.0e38]),
        (11, [-0.0, 0.0]),
    ]
    import numpy as np

    exact = [(i, x and [c if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    for k in (1, 3, 16):
        got = run(spark, rows, k=k, dim=2)
        assert ordered(got) == ordered(plain(exact, k, 3, 2))
    assert run(spark, [], k=3, dim=2) == []
    assert run(spark, [(2, None)], k=3, dim=2) == []


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    # Equal vectors: all later centroids equal the first and stay empty.
    rows = [(i, [0.25, -0.25]) for i in range(40)]
    got = run(spark, rows, k=4, dim=2)
    assert {r[1] for r in got} == {0} and {r[2] for r in got} == {0}


def test_the_plan_stays_in_the_jvm(spark, sf):
    plan = centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_changes_nothing(spark, sf, parts):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(map(tuple, centroids.cluster(table).collect()))
    assert sorted(map(tuple, centroids.cluster(table.repartition(parts)).collect())) == want
