"""Topic of a text or vector: score nine labels, keep the best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import broadcast_within

# The candidate topics, in order, and the answer without one.
TOPICS = [
    "Politics", "Technology", "Health", "Entertainment", "Sports",
    "Finance", "Science", "World", "Business",
]
NO_TOPIC = "Unknown"

Scorer = Callable[[DataFrame], DataFrame]


def topic_labels(spark: SparkSession, labels: list[str] | None = None) -> DataFrame:
    """``(ord, label)``: the closed set of topics."""
    names = TOPICS if labels is None else labels
    rows = F.posexplode(F.array(*[F.lit(name) for name in names])).alias("ord", "label")
    return spark.range(1).select(rows)


def classify_topic(docs: DataFrame, key: str, scorer: Scorer) -> DataFrame:
    """``(key, topic)``: the best label by ``scorer(docs) -> (key, ord, label, score)``.

    Equal scores go to the label that comes first; without a score the topic is
    ``Unknown``. The plain rows are united with the scores, so there is one shuffle.
    """
    fallback = docs.select(
        key, F.lit(-1).alias("ord"), F.lit(NO_TOPIC).alias("label"), F.lit(float("-inf")).alias("score")
    )
    scores = scorer(docs).select(key, "ord", "label", F.col("score").cast("double"))
    rank = F.struct(F.col("score"), (-F.col("ord")).alias("ord"))
    return fallback.unionByName(scores).groupBy(key).agg(F.max_by("label", rank).alias("topic"))


def token_scorer(key: str, text: str, seeds: DataFrame) -> Scorer:
    """Sum of seed-word weights; ``seeds`` is ``(word, ord, label, weight)``."""

    def score(docs: DataFrame) -> DataFrame:
        words = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
        table, _ = broadcast_within(seeds)
        return words.join(table, "word").groupBy(key, "ord", "label").agg(F.sum("weight").alias("score"))

    return score


def fit_prototypes(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """``(label, prototype)``: the mean vector of each label."""
    means = (
        vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("prototype"))


def prototype_scorer(key: str, vector: str, prototypes: DataFrame) -> Scorer:
    """The best cosine similarity to a prototype, to six digits; labels rank by name.

    The model is one vector a label and enters as a scalar subquery, so vectors are
    scored where they are read, without a shuffle; each vector gives one row, however
    many labels there are. The model must fit in a row.
    """
    model = prototypes.agg(F.sort_array(F.collect_list(F.struct("label", "prototype"))).alias("model")).scalar()

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def score(docs: DataFrame) -> DataFrame:
        v = F.col("v")
        scored = F.transform(
            "model",
            lambda m, i: F.struct(
                F.round(
                    F.try_divide(dot(v, m["prototype"]), F.sqrt(dot(v, v) * dot(m["prototype"], m["prototype"]))), 6
                ).alias("score"),
                (-i).alias("rank"),
                i.alias("ord"),
                m["label"].cast("string").alias("label"),
            ),
        )
        # A vector or prototype without a direction has no similarity.
        best = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull() & ~F.isnan(s["score"])))
        rows = docs.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"), model.alias("model"))
        return rows.select(key, best.alias("s")).filter("s IS NOT NULL").select(key, "s.ord", "s.label", "s.score")

    return score


def model_scorer(key: str, text: str, labels: DataFrame, score_batches: Callable) -> Scorer:
    """Scores of an outside model. ``score_batches`` is an iterator Pandas UDF
    ``text -> array<double>`` in label order, so the model loads once per worker. Where it
    gives NULL, for a text or a label, there is no score, and without any the topic is
    ``Unknown``."""

    def score(docs: DataFrame) -> DataFrame:
        scored = docs.select(key, F.posexplode(score_batches(F.col(text))).alias("ord", "score"))
        table, _ = broadcast_within(labels)
        return scored.join(table, "ord")

    return score
