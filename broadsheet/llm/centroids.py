"""Centroid clustering of integer vectors in JVM expressions: rounds of assignment and exact means.

A vector becomes integers (``floor(64 * x)``). Each centroid is a literal array; ``zip_with``
and ``aggregate`` give the squared distance to it, and ``array_min`` over structs of
distance and number chooses the cluster, so ties go to the smaller number. A round is one
pass with one column sum for each component, grouped by cluster: partial sums leave a
task as one row a cluster. Only centroids (``k`` times ``dim`` numbers, at most) and
totals come to the driver.

The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, so
reruns agree on any partitioning. A new centroid is the floor of the exact mean of its
vectors; one without vectors stays.

Defined results: a vector that is NULL, has another number of components, or holds a NULL,
NaN or infinite one has no row. A component beyond ``LARGEST`` counts as ``LARGEST``, so that
every squared distance fits a long; a total beyond a long is NULL. A NULL ``vec_id`` is
clustered like others and chosen as a first centroid only after all others. Repeated ids
take part as often as they occur; of equal ids the smaller vector comes first. With
fewer than ``k`` vectors there are so many centroids. An empty table gives an empty
table. Extra columns are ignored.

Fitting runs jobs while the plan is built: one for the first centroids, one a round and
one for the totals.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS, DIM, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
# 64 squared differences of twice this sum up to less than 2^63.
LARGEST = 2**27


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: the usable vectors as arrays of longs."""
    found = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))

    def usable(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(float(-LARGEST))))

    found = found.filter((F.size("x") == dim) & F.forall("x", usable))
    return found.select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return [list(r["v"]) for r in rows.orderBy(order, "v").select("v").limit(k).collect()]


def _nearest(number: int, centroid: list[int]) -> str:
    """Distance and number of one centroid; as text, since each literal made from Python is a call to the JVM."""
    point = ", ".join(f"{c}L" for c in centroid)
    distance = f"aggregate(zip_with(v, array({point}), (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
    return f"named_struct('distance', {distance}, 'cluster', {number})"


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` (with ``v``) and ``cluster``, ``distance`` of the nearest centroid."""
    each = ", ".join(_nearest(n, c) for n, c in enumerate(centroids))
    nearest = F.expr(f"array_min(array({each}))") if each else F.lit(None).cast("struct<distance:bigint,cluster:int>")
    return rows.withColumn("nearest", nearest).select(*rows.columns, "nearest.cluster", "nearest.distance")


def update(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each cluster's vectors, by exact column sums; an empty cluster keeps its centroid."""
    dim = len(centroids[0])
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(dim)]
    found = assign(rows, centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    new = list(centroids)
    for r in found:
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return new


@dataclass
class Clusters:
    """What fitting leaves: the centroids, and the summed distances of each cluster."""

    centroids: list[list[int]]
    inertia: list[int | None]

    @property
    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]

    @property
    def total(self) -> int | None:
        sums = [i for i in self.inertia if i is not None]
        return sum(sums) if len(sums) == len(self.inertia) and sum(sums) < 2**63 else None


def fit(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    """Centroids after ``rounds`` rounds over integer vectors ``vec_id, v``, with their inertia."""
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = update(rows, centroids)
    sums = {r[0]: r[1] for r in assign(rows, centroids).groupBy("cluster").agg(F.try_sum("distance")).collect()} if centroids else {}
    return Clusters(centroids, [sums.get(n, 0) for n in range(len(centroids))])


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    rows = integer_vectors(vectors, dim, scale, vec_id, vector)
    found = fit(rows, k, rounds, seed)

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return assign(rows, found.centroids).select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(found.inertia, "long").alias("cluster_inertia"),
        F.lit(found.total).cast("long").alias("inertia"),
        of_cluster(found.digests, "string").alias("centroid_sha256"),
    )
