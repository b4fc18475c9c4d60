"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: its weight as a piecewise linear function of training time from
0 to 1. The integral of the schedule is the source's weight, which decides how many words it
gives in all (``targets``). The integral up to a time is the demand met by then, so the
place of a word in its source's stream of documents, taken through the inverse of that
integral, is the time at which it is trained on. Documents are range-sorted by this position.

The stream of a source is its documents in the order of a hash of their id, then the same
again, up to ``max_passes`` times; it ends at the target, so the last document that is
taken may give part of its words only, and a source misses its target by less than one word.

Where a document stands in its stream is a running sum. Documents are dealt into buckets of
a source by the leading bits of the hash; sums of buckets are added up first, so a source
with a third of all rows spreads over as many tasks as it has buckets. The number of
buckets follows from the number of rows (``ROWS_PER_BUCKET``).

Defined results: NULL and empty texts have no words, are not taken and have no position.
A NULL source is a source of its own, after all others. Rows with a NULL id are
ordered by their text. Repeated rows are documents of their own, which stand next to each
other. Without any words nothing is taken; an empty table gives an empty table. Extra
columns never clash: ``mix`` ignores them, ``training_order`` returns them. Sources are few
against rows: one row for each of them is ranked in a single task.

The table of sizes is written to a checkpoint while the plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.session import cut_lineage

Schedule = Sequence[tuple[float, float]]
# Weights 5, 2 and 1 in all: the heaviest sources early, the lightest late.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
MAX_PASSES = 3
ROWS_PER_BUCKET = 1000
WORD = r"[^\x20\x09-\x0D]+"


def segments(schedule: Schedule) -> tuple[list[tuple[float, float, float, float]], float]:
    """``(demand before, start, weight, slope)`` of each linear piece, and the whole integral."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule goes from time 0 to 1 in ascending knots without negative weights")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:], strict=True):
        out.append((before, float(t0), float(w0), (w1 - w0) / (t1 - t0)))
        before += (w0 + w1) / 2 * (t1 - t0)
    if before <= 0:
        raise ValueError("a schedule needs some weight")
    return out, before


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measured(docs: DataFrame, carried: Sequence[Column], doc_id: str, source: str, text: str) -> DataFrame:
    """``source, no_source, place, size`` beside the carried columns; ``place`` is 128 bits as hexadecimal text."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col(text), F.lit(""))))
    return docs.select(
        *carried,
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(source).isNull().alias("no_source"),
        F.md5(key).alias("place"),
        n_words(F.col(text)).alias("size"),
    )


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_passes: int = MAX_PASSES) -> DataFrame:
    """``source, no_source, source_size, schedule, target`` from rows of ``source, no_source, size``.

    Sources take the schedules in turn. All words are shared by weight; a source stops at
    ``max_passes`` times its size and what it can't take is shared again. In the order of
    size against weight the sources that stop come first, so running sums find them.
    """
    weights = F.array(*[F.lit(segments(s)[1]) for s in schedules])
    rows = sizes.groupBy("source", "no_source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_source", "source"))
    rows = rows.withColumn("schedule", ((rank - 1) % len(schedules)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(weights, F.col("schedule") + 1))
    rows = rows.withColumn("most", F.col("source_size") * max_passes)
    by_need = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "source")
    everything = Window.partitionBy()
    rows = rows.withColumn("all", F.sum("source_size").over(everything))
    rows = rows.withColumn("stopped", F.sum("most").over(by_need) - F.col("most"))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_need) + F.col("weight"))
    rows = rows.withColumn("stops", F.col("most") * F.col("open") <= F.col("weight") * (F.col("all") - F.col("stopped")))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0))
    shared_by = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("weight") * left / shared_by)
    return rows.select("source", "no_source", "source_size", "schedule", target.alias("target"))


def _bucket(n_rows: int) -> Column:
    """The leading bits of ``place``: as many as leave about ``ROWS_PER_BUCKET`` rows of the largest source in a bucket."""
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / ROWS_PER_BUCKET)))
    return F.shiftright(F.conv(F.substring("place", 1, 15), 16, 10).cast("long"), 60 - bits)


def _offsets(sizes: DataFrame, schedules: Sequence[Schedule], max_passes: int) -> DataFrame:
    """One row a bucket: what comes before it in its source, beside the source's targets."""
    buckets = sizes.groupBy("source", "no_source", "bucket").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source", "no_source").orderBy("bucket")) - F.col("size")
    buckets = buckets.select("source", "no_source", "bucket", before.alias("before"))
    return buckets.join(targets(sizes, schedules, max_passes), ["source", "no_source"])


def position(share: Column, schedule: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """The time by which a source has met ``share`` (0 to 1) of its demand: the inverse of the integral of its schedule."""
    names = ("demand", "start", "weight", "slope")
    cut = [segments(s) for s in schedules]
    all_pieces = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, piece, strict=True)]) for piece in pieces]) for pieces, _ in cut])
    whole = F.element_at(F.array(*[F.lit(w) for _, w in cut]), schedule + 1)
    demand = share * whole
    piece = F.element_at(F.filter(F.element_at(all_pieces, schedule + 1), lambda p: p["demand"] <= demand), -1)
    rest = demand - piece["demand"]
    root = F.sqrt(F.greatest(piece["weight"] * piece["weight"] + F.lit(2.0) * piece["slope"] * rest, F.lit(0.0)))
    width = piece["weight"] + root
    return piece["start"] + F.when(width > 0, F.lit(2.0) * rest / width).otherwise(F.lit(0.0))


def _placed(rows: DataFrame, offsets: DataFrame, ties: Sequence[Column], schedules: Sequence[Schedule], max_passes: int) -> DataFrame:
    """Measured rows with ``source_size, target`` and ``passes``: number, words and position of each time a row is taken."""
    keys = ["source", "no_source", "bucket"]
    in_bucket = Window.partitionBy(*keys).orderBy("place", *ties, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(in_bucket) - F.col("size")).join(offsets, keys)
    rows = rows.withColumn("start", F.col("before") + F.col("within")).withColumn("limit", F.floor(F.col("target") + F.lit(0.5)))

    def taken(n: int) -> Column:
        at = F.col("start") + F.lit(n).cast("long") * F.col("source_size")
        words = F.greatest(F.least(F.col("limit") - at, F.col("size")), F.lit(0).cast("long"))
        time = F.when(words > 0, position(at / F.col("limit"), F.col("schedule"), schedules))
        return F.struct(F.lit(n + 1).alias("pass"), words.alias("words"), time.alias("position"))

    passes = F.filter(F.array(*[taken(n) for n in range(max_passes)]), lambda p: p["words"] > 0)
    return rows.withColumn("passes", passes).drop(*keys, "within", "before", "start", "limit", "schedule")


def _planned(docs: DataFrame, carried: Sequence[Column], doc_id: str, source: str, text: str, schedules, max_passes) -> tuple[DataFrame, DataFrame, Column]:
    """Measured rows (checkpointed, with their buckets), the offsets of the buckets, and how a bucket is found."""
    sizes = cut_lineage(_measured(docs, carried, doc_id, source, text))
    bucket = _bucket(sizes.count())
    sizes = sizes.withColumn("bucket", bucket)
    return sizes, _offsets(sizes, schedules, max_passes), bucket


def mix(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_passes: int = MAX_PASSES,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` of every row, sorted by the first position; rows that are not taken come last."""
    sizes, offsets, _ = _planned(docs, [F.col(doc_id).alias("doc_id")], doc_id, source, text, schedules, max_passes)
    rows = _placed(sizes, offsets, ["doc_id"], schedules, max_passes)
    words = F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"])
    rows = rows.select("doc_id", "size", "source_size", "target", words.alias("taken"), F.get("passes", F.lit(0))["position"].alias("position"), "place")
    return rows.orderBy(F.col("position").asc_nulls_last(), "place").drop("place")


def training_order(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_passes: int = MAX_PASSES,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """``row`` (all columns of a document), ``pass``, ``words`` and ``position`` of each time a document is taken, sorted by position.

    The texts move twice: to their buckets and to their positions.
    """
    _, offsets, bucket = _planned(docs, [], doc_id, source, text, schedules, max_passes)
    whole = _measured(docs, [F.struct(*docs.columns).alias("row")], doc_id, source, text)
    whole = whole.withColumn("bucket", bucket)
    rows = _placed(whole, offsets, [F.col("row").getField(doc_id)], schedules, max_passes)
    rows = rows.select("row", "place", F.explode("passes").alias("p")).select("row", "p.pass", "p.words", "p.position", "place")
    return rows.orderBy("position", "place", "pass").drop("place")
