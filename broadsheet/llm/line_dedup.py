"""Line dedup, reversible: cuckoo filters in shards before exact reference tables.

The key of a line is the line stripped of ASCII white space at both ends, with A-Z
lower-cased. ``line_references`` is the exact table: one row for each key and document
that holds it. ``insert`` adds documents to it, ``remove`` takes documents out, and
``counts`` gives each key its number of documents and the largest ``doc_id``; removing
what was inserted gives back the same counts and therefore the same texts.

Keys held by at least ``min_docs`` documents lose their lines everywhere but in the
largest ``doc_id``. A bank of cuckoo filters holds a fingerprint of each such key. It is
probed first, so only lines that may be repeated are shuffled to meet the exact counts;
the filters decide nothing alone. They take insertions and deletions
(``update_filters``), hold a fixed number of bytes whatever the data, and a shard that
is full lets everything pass, so results stay exact at any size.

Defined results: NULL or empty text is one empty line. A NULL ``doc_id`` is one document
below all others. Repeated rows of a ``doc_id`` are one document. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage

SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The filter bank: SHARDS * BUCKETS * SLOTS fingerprints of two bytes, 16 MB in all.
SHARDS, BUCKETS, SLOTS, MAX_KICKS = 64, 1 << 15, 4, 200


def line_key(line: Column) -> Column:
    """Stripped at both ends and lower-cased in A-Z only."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """``doc_id, version, pos, h1, h2``: the lines long enough, their keys as 128-bit hashes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("version"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    rows = rows.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return rows.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


# The exact tables


def line_references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """``h1, h2, doc_id``: one row for each key and document that holds it."""
    return _hashed(docs, doc_id, text, min_chars).select("h1", "h2", "doc_id").distinct()


def insert(references: DataFrame, docs: DataFrame, **names) -> DataFrame:
    """The reference table with the lines of more documents; inserting twice changes nothing."""
    return references.unionByName(line_references(docs, **names)).distinct()


def remove(references: DataFrame, gone: DataFrame) -> DataFrame:
    """The reference table without the documents of ``gone`` (a column ``doc_id``): the inverse of ``insert``."""
    gone = gone.select(F.col("doc_id").alias("gone_id")).distinct()
    return references.join(gone, references["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def counts(references: DataFrame) -> DataFrame:
    """``h1, h2, n_docs, keep_id``: in how many documents a key is, and the largest of them."""
    return references.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))


# The filters


def _places(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, fingerprint (never 0) and the two buckets of each hash."""
    h = h1.astype(np.int64).view(np.uint64)
    shard = (h >> np.uint64(58)) % np.uint64(SHARDS)
    mark = ((h >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    first = (h % np.uint64(BUCKETS)).astype(np.int64)
    return shard.astype(np.int64), mark, first, first ^ _shift(mark)


def _shift(mark: np.ndarray) -> np.ndarray:
    """What leads from one bucket of a fingerprint to the other, either way."""
    return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) % np.uint64(BUCKETS)).astype(np.int64)


class CuckooFilter:
    """One shard: ``BUCKETS`` buckets of ``SLOTS`` fingerprints. Full means that everything may be in it."""

    def __init__(self, cells: np.ndarray | None = None, full: bool = False):
        self.cells = np.zeros((BUCKETS, SLOTS), np.uint16) if cells is None else cells
        self.full = full

    @classmethod
    def from_bytes(cls, blob: bytes, full: bool) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(BUCKETS, SLOTS).copy(), full)

    def insert(self, h1: np.ndarray) -> None:
        _, marks, firsts, seconds = _places(h1)
        for mark, a, b in zip(marks, firsts.tolist(), seconds.tolist(), strict=True):
            if self.full:
                return
            self._put(mark, a, b)

    def _put(self, mark, a: int, b: int) -> None:
        at = a
        for kick in range(MAX_KICKS):
            for bucket in (a, b) if kick == 0 else (at,):
                free = np.flatnonzero(self.cells[bucket] == 0)
                if len(free):
                    self.cells[bucket, free[0]] = mark
                    return
            slot = kick % SLOTS
            mark, self.cells[at, slot] = self.cells[at, slot], mark
            at = int(at ^ _shift(np.array([mark], np.uint16))[0])
        self.full = True

    def delete(self, h1: np.ndarray) -> None:
        """Take out keys that were inserted before. A full shard stays full until it is rebuilt."""
        _, marks, firsts, seconds = _places(h1)
        for mark, a, b in zip(marks, firsts.tolist(), seconds.tolist(), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.cells[bucket] == mark)
                if len(found):
                    self.cells[bucket, found[0]] = 0
                    break

    def may_hold(self, h1: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(h1), bool)
        _, marks, firsts, seconds = _places(h1)
        return (self.cells[firsts] == marks[:, None]).any(1) | (self.cells[seconds] == marks[:, None]).any(1)


FILTERS = "shard long, cells binary, is_full boolean"


def _shard(h1: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 58), F.lit(SHARDS)).cast("long")


def build_filters(repeated: DataFrame) -> DataFrame:
    """``shard, cells, is_full`` of the keys ``h1``: each shard is filled where its keys are, batch by batch."""
    return update_filters(None, repeated, None)


def update_filters(filters: DataFrame | None, added: DataFrame, removed: DataFrame | None) -> DataFrame:
    """The filters after insertions and deletions. A row is an old shard, a deletion or an insertion, in this order."""
    rows = added.select(_shard(F.col("h1")).alias("shard"), F.lit(2).alias("step"), "h1", F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("boolean").alias("is_full"))
    if removed is not None:
        rows = rows.unionByName(removed.select(_shard(F.col("h1")).alias("shard"), F.lit(1).alias("step"), "h1", F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("boolean").alias("is_full")))
    if filters is not None:
        rows = rows.unionByName(filters.select("shard", F.lit(0).alias("step"), F.lit(None).cast("long").alias("h1"), "cells", "is_full"))

    def fill(batches):
        """Sorted by shard and step, so that one filter is open at a time."""
        shard, bank = None, CuckooFilter()
        for batch in batches:
            key = batch.column("shard").to_numpy(zero_copy_only=False) * 3 + batch.column("step").to_numpy(zero_copy_only=False)
            h1 = batch.column("h1").fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                number, step = divmod(int(key[a]), 3)
                if number != shard:
                    if shard is not None:
                        yield _filter_row(shard, bank)
                    shard, bank = number, CuckooFilter()
                if step == 0:
                    bank = CuckooFilter.from_bytes(batch.column("cells")[int(a)].as_py(), batch.column("is_full")[int(a)].as_py())
                elif step == 1:
                    bank.delete(h1[a:b])
                else:
                    bank.insert(h1[a:b])
        if shard is not None:
            yield _filter_row(shard, bank)

    ordered = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "step", "h1")
    return ordered.mapInArrow(fill, FILTERS)


def _filter_row(shard: int, bank: CuckooFilter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([int(shard)], pa.int64()), "cells": pa.array([bank.cells.tobytes()], pa.binary()), "is_full": pa.array([bank.full])})


def probe(lines: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows whose ``h1`` may be in the filters, which are at most 16 MB and go to every task."""
    spark: SparkSession = lines.sparkSession
    bank = spark.sparkContext.broadcast({r["shard"]: (bytes(r["cells"]), r["is_full"]) for r in filters.toLocalIterator()})

    def passing(batches):
        shards = {k: CuckooFilter.from_bytes(*v) for k, v in bank.value.items()}
        for batch in batches:
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            at = _places(h1)[0]
            keep = np.zeros(len(h1), bool)
            for number in np.unique(at):
                if (one := shards.get(int(number))) is not None:
                    mine = np.flatnonzero(at == number)
                    keep[mine] = one.may_hold(h1[mine])
            yield batch.filter(pa.array(keep))

    return lines.mapInArrow(passing, lines.schema)


# The operator


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: each document without the lines that belong to a larger ``doc_id``."""
    repeated = counts(line_references(docs, doc_id, text, min_chars)).filter(F.col("n_docs") >= min_docs)
    return drop_lines(docs, cut_lineage(repeated), doc_id, text, min_chars)


def drop_lines(docs: DataFrame, repeated: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """As ``dedup_lines``, for a given table of repeated keys (``h1, h2, keep_id``)."""
    lines = _hashed(docs, doc_id, text, min_chars)
    hits = probe(lines, build_filters(repeated)).join(repeated.select("h1", "h2", "keep_id"), ["h1", "h2"])
    hits = hits.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = hits.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("version"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "gone")
    same = rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["version"] == gone["gone_version"])
    joined = rows.join(gone, same, "left")

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def without(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, places, strict=True):
            lines = text.split("\n")
            if drop is None or len(drop) == 0:
                out.append((len(lines), 0, text))
            else:
                drop = set(drop.tolist())
                out.append((len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return joined.select("doc_id", without("text", "gone").alias("row")).select("doc_id", "row.*")
