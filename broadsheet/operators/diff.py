"""The change log between two snapshots of a document table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.json_edits import from_text
from broadsheet.functions.json_walk import MISSING, operations

# Nesting that parsed documents can have; writing a value takes two frames a level.
_FRAMES = 10_000


def diff_docs(
    src: DataFrame, dst: DataFrame, key: str = "doc_id", doc: str = "doc", moves: bool = False
) -> DataFrame:
    """``(key, seq, op, path, from, value)`` that turns ``src`` into ``dst``.

    ``doc`` is JSON text on both sides. Removed places come first, then added ones, then
    replacements, each in path order with list indices as numbers. Surplus list elements
    are removed at the index where the shorter list ends. With ``moves``, an added value
    that equals a removed one becomes a move, which runs where the addition would; of
    several removals the last is paired with the first addition.

    One join brings the two versions of a document together; those of equal text are
    dropped. Each pair is then walked in step in its Arrow batch, to any depth, and its
    whole patch is made there, so nothing else is shuffled. A document of one side only
    is added or removed as a whole, at the root; text that is no JSON counts as none.
    """
    left = src.select(key, F.col(doc).alias("s_text"))
    right = dst.select(key, F.col(doc).alias("d_text"))
    both = left.join(right, key, "full_outer").filter("NOT s_text <=> d_text")
    known = [F.when(F.try_parse_json(c).isNotNull(), F.col(c)).alias(c) for c in ("s_text", "d_text")]
    rows = both.select(key, *known)

    def patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _FRAMES))
        for b in batches:
            places, seqs, ops = [], [], []
            for row, texts in enumerate(zip(b.column("s_text").to_pylist(), b.column("d_text").to_pylist(), strict=True)):
                s, d = (MISSING if t is None else from_text(t) for t in texts)
                own = operations(s, d, moves)
                places += [row] * len(own)
                seqs += range(1, len(own) + 1)
                ops += own
            columns = [b.column(key).take(pa.array(places, pa.int64())), pa.array(seqs, pa.int32())]
            columns += [pa.array([o[k] for o in ops], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, [key, "seq", "op", "path", "from", "text"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.mapInArrow(patches, f"`{key}` {kind}, seq int, op string, path string, `from` string, text string")
    return found.select(key, "seq", "op", "path", "from", F.parse_json("text").alias("value"))


def merge_replaces(ops: DataFrame, key: str = "doc_id") -> DataFrame:
    """A remove followed at once by an add at the same place becomes a replace."""
    order = Window.partitionBy(key).orderBy("seq")
    here = F.struct("op", "path")
    paired = (
        ops.withColumn("before", F.lag(here).over(order))
        .withColumn("after", F.lead(here).over(order))
    )
    merged = (F.col("op") == "add") & (F.col("before.op") == "remove") & (F.col("before.path") == F.col("path"))
    absorbed = (F.col("op") == "remove") & (F.col("after.op") == "add") & (F.col("after.path") == F.col("path"))
    return (
        paired.filter(~F.coalesce(absorbed, F.lit(False)))
        .withColumn("op", F.when(merged, "replace").otherwise(F.col("op")))
        .drop("before", "after")
    )
