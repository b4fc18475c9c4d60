"""Change logs: validate them, order them and apply them to a document table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions import pointers as P
from broadsheet.functions.edit_tries import Fails, apply_block, block_from_text, block_to_text, compile_block
from broadsheet.functions.json_edits import INVALID, OPERATIONS, POINTER_ERROR, Fault, Number, from_text, plain_text, to_text

# Numbers of operations in a block of one log: a log longer than this is worked on in parallel.
BLOCK = 2048
# Operations from which a block is made a trie.
MIN_TRIE = 64


def validate_changes(changes: DataFrame, operations: dict[str, Callable] | None = None) -> DataFrame:
    """The log with ``error``: why an operation is malformed, or NULL.

    ``value`` and ``from`` are not needed by every operation and are only checked
    when the log is applied.
    """
    names = list(OPERATIONS if operations is None else operations)
    error = (
        F.when(F.col("op").isNull(), F.lit("missing_op"))
        .when(~F.col("op").isin(names), F.lit("unknown_op"))
        .when(F.col("path").isNull(), F.lit("missing_path"))
        .when(P.pointer_error(F.col("path")).isNotNull(), F.lit("bad_pointer"))
    )
    if "seq" in changes.columns:
        # Without a number an operation has no place in the log.
        error = F.coalesce(error, F.when(F.col("seq").isNull(), F.lit("missing_seq")))
    return changes.withColumn("error", error)


def error_status(error: Column) -> Column:
    """Status of a document whose log holds a malformed operation."""
    return F.when(error == "bad_pointer", F.lit(POINTER_ERROR)).when(error.isNotNull(), F.lit(INVALID))


def order_changes(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ops)``: the operations of each document in order, as one array.

    A patch in this form is one value, so it must fit in a row. ``apply_changes``
    does not need it and takes logs of any length.
    """
    ops = F.struct("seq", "op", "path", "from", "value")
    # VARIANT has no order, so only the position decides.
    by_seq = F.array_sort(F.collect_list(ops), lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int"))
    return changes.groupBy(key).agg(by_seq.alias("ops"))


def apply_changes(
    docs: DataFrame,
    changes: DataFrame,
    key: str = "doc_id",
    doc: str = "doc",
    operations: dict[str, Callable] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, doc, status, failed_seq)``: every document after its log, all or nothing.

    ``doc`` is JSON text, the result is VARIANT. A log is cut into blocks of ``block``
    numbers, which are worked on in parallel: a block of many operations becomes one trie
    of net edits (``edit_tries``), so a log that edits one document a million times spreads
    over many tasks. Blocks then meet their document in order. A trie whose preconditions
    hold is one edit; else the operations of its block run one by one, as do short blocks.
    A document with a failing log keeps its content.

    Both tables are read once. The log is shuffled by document and block, then its blocks
    by document; they are consumed as a stream, one document and one block at a time.

    A document that is no JSON, or names a key twice, is ``invalid`` and NULL, log or
    not. So is a log with a NULL ``seq``, or one that gives a ``seq`` to two operations:
    on one member, where the log only adds, replaces and removes direct members of an
    object, and any two in other logs. A log whose single operation adds a value
    at the root creates a document that was not there; one that removes the root gives
    NULL and ``removed``. Any other log without a document is ``orphan``.
    """
    known = OPERATIONS if operations is None else operations
    blocks = _log_blocks(validate_changes(changes, operations), key, known, block)
    none = F.lit(None)
    valid = F.try_parse_json(F.col(doc)).isNotNull()
    base = docs.select(key, F.lit(-1).alias("part"), F.col(doc).alias("text"), valid.alias("valid"))
    # A NULL key joins no log.
    with_key = base.filter(F.col(key).isNotNull())
    events = with_key.unionByName(blocks, allowMissingColumns=True)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("part") >= 0, "block", "part"))
    done = _applied_blocks(events.withColumn("turn", turn), key, known)
    alone = base.filter(F.col(key).isNull()).select(key, "text", F.lit("ok").alias("status"), none.cast("long").alias("failed_seq"))
    rows = done.unionByName(alone).withColumn("doc", F.try_parse_json("text"))
    unread = (F.col("status") == "ok") & F.col("doc").isNull() & F.col("text").isNotNull()
    return rows.select(key, "doc", F.when(unread, INVALID).otherwise(F.col("status")).alias("status"), "failed_seq")


# What is known of a block: how many operations, their first number and whether all are flat; the first number that is
# given twice (to any two, to two on one member); the first malformed operation; the operations as text and as a trie.
_BLOCK = "block long, part int, n long, first_seq long, flat boolean, twice long, member_twice long, bad_seq long, bad string, ops string, trie string"


def _log_blocks(checked: DataFrame, key: str, operations: dict[str, Callable], block: int) -> DataFrame:
    """``key`` and ``_BLOCK``: one row for each block of a log, or several if a number is given very often."""
    plain = [name for name in ("add", "replace", "remove") if operations.get(name) is OPERATIONS[name]]
    own = {name for name, fn in operations.items() if OPERATIONS.get(name) is not fn}
    is_text = dict(checked.dtypes)["value"] != "variant"
    readable = F.try_parse_json("value").isNotNull() if is_text else F.lit(True)
    rows = checked.select(
        key, F.floor(F.col("seq") / block).cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), "op", "path", "from", "value", "error", readable.alias("readable")
    )
    turn = F.row_number().over(Window.partitionBy(key, "block").orderBy("seq", "path"))
    rows = rows.withColumn("turn", turn)
    columns = [key, *[f.split()[0] for f in _BLOCK.split(", ")]]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current, before = _Held(), None, None
        for batch in batches:
            finished = []
            names = (key, "block", "seq", "op", "path", "from", "value", "error", "readable", "turn")
            for doc_id, at, seq, op, path, source, value, error, readable, turn in zip(*(batch[c].tolist() for c in names), strict=True):
                # A missing number is None, or NaN among others.
                seq = None if seq is None or seq != seq else int(seq)
                if turn == 1 or held.n == block:
                    if held.n:
                        finished.append((*current, *held.row(own)))
                    part = 0 if turn == 1 else current[2] + 1
                    before = None if turn == 1 else before
                    held, current = _Held(), (doc_id, None if at is None or at != at else int(at), part)
                held.add(seq, op, path, source, value, error, readable, plain, before)
                before = (seq, path)
            yield pd.DataFrame(finished, columns=columns).astype(_DTYPES)
        if held.n:
            yield pd.DataFrame([(*current, *held.row(own))], columns=columns).astype(_DTYPES)

    return rows.mapInPandas(cut, f"`{key}` {dict(checked.dtypes)[key]}, {_BLOCK}")


_DTYPES = {c: "Int64" for c in ("block", "n", "first_seq", "twice", "member_twice", "bad_seq")} | {"part": "int32", "flat": "boolean"}


class _Held:
    """The operations of one block as they come."""

    def __init__(self):
        self.n, self.flat, self.first = 0, True, None
        self.twice = self.member_twice = None
        self.bad: tuple | None = None
        self.ops: list[tuple] = []

    def add(self, seq, op, path, source, value, error, readable, plain, before) -> None:
        self.n += 1
        self.first = seq if self.first is None else self.first
        if error is not None:
            # A missing number comes before all others.
            self.bad = min(self.bad or (True, seq or 0, error), (seq is not None, seq or 0, error))
            return
        if before is not None and seq == before[0]:
            self.twice = seq if self.twice is None else self.twice
            if path == before[1]:
                self.member_twice = seq if self.member_twice is None else self.member_twice
        text = value if isinstance(value, str) or value is None else to_text(_plain(value))
        if not readable and value is not None:
            # Marked as a value that can't be read.
            text = ""
        self.flat = self.flat and op in plain and path.count("/") == 1 and (text != "" and (text is not None or op == "remove"))
        self.ops.append((seq, op, path, source, text))

    def row(self, own: set[str]) -> tuple:
        trie = None
        sound = self.bad is None and self.twice is None and not any(o[1] in own for o in self.ops)
        if sound and len(self.ops) >= MIN_TRIE:
            found = compile_block(o[1:] for o in self.ops)
            trie = None if found is None else block_to_text(found)
        bad_seq, bad = (self.bad[1] if self.bad[0] else None, self.bad[2]) if self.bad else (None, None)
        ops = None if self.bad else plain_text(self.ops)
        return self.n, self.first, self.flat, self.twice, self.member_twice, bad_seq, bad, ops, trie


class _Applied:
    """One document on its way through the blocks of its log."""

    def __init__(self, text: str | None, valid: bool):
        self.text, self.doc, self.fault = text, None, None
        if valid:
            try:
                self.doc = from_text(text)
            except ValueError:
                valid = False
        self.valid = valid
        self.is_object = valid and isinstance(self.doc, dict)

    def take(self, ops: str, trie: str | None, operations: dict[str, Callable]) -> None:
        if trie is not None:
            try:
                self.doc = apply_block(block_from_text(trie), self.doc)
                return
            except Fails:
                pass
        for seq, op, path, source, value in json.loads(ops):
            change = {"op": op, "path": path}
            try:
                if source is not None:
                    change["from"] = source
                if value is not None:
                    change["value"] = from_text(value)
                self.doc = operations[op](self.doc, change)
            except Fault as fault:
                self.fault = (seq, fault.status)
                return
            except ValueError:
                self.fault = (seq, INVALID)
                return


class _Log:
    """What the blocks of one log say together."""

    def __init__(self):
        self.docs: list[_Applied] = []
        self.n, self.flat, self.first = 0, True, None
        self.twice = self.member_twice = self.bad = self.only = None

    def take(self, n, first, flat, twice, member_twice, bad_seq, bad, ops, trie, operations) -> None:
        self.n += n
        self.flat = self.flat and flat
        self.only = ops if self.n == 1 else None
        self.first = first if self.first is None else self.first
        self.twice = twice if self.twice is None else self.twice
        self.member_twice = member_twice if self.member_twice is None else self.member_twice
        if bad is not None:
            self.bad = min(self.bad or (True, bad_seq or 0, bad), (bad_seq is not None, bad_seq or 0, bad))
        if ops is not None and self.bad is None:
            for doc in self.docs:
                if doc.valid and doc.fault is None:
                    doc.take(ops, trie, operations)

    def results(self) -> Iterator[tuple]:
        """``text, status, failed_seq`` of every document, or of the log alone."""
        only = json.loads(self.only)[0] if self.only and not self.bad else (None,) * 5
        at_root = only[1] if only[2] == "" else None
        if not self.docs:
            if at_root == "add" and only[4] is not None:
                yield only[4], "ok", None
            else:
                yield None, "orphan", self.first
            return
        for doc in self.docs:
            twice = self.member_twice if self.flat and doc.is_object else self.twice
            if not self.n:
                yield doc.text, "ok", None
            elif self.bad:
                yield doc.text, POINTER_ERROR if self.bad[2] == "bad_pointer" else INVALID, self.bad[1] if self.bad[0] else None
            elif at_root == "remove":
                yield None, "removed", None
            elif not doc.valid:
                yield doc.text, INVALID, None
            elif twice is not None and (doc.fault is None or twice <= doc.fault[0]):
                yield doc.text, INVALID, twice
            elif doc.fault is not None:
                yield doc.text, doc.fault[1], doc.fault[0]
            else:
                yield to_text(doc.doc), "ok", None


def _applied_blocks(events: DataFrame, key: str, operations: dict[str, Callable]) -> DataFrame:
    """``key, text, status, failed_seq``: rows come by document, its text first, then its blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, current = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (key_type, pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [key, "text", "status", "failed_seq"])

        for batch in batches:
            key_type, finished = batch.column(key).type, []
            names = (key, "turn", "part", "text", "valid", "n", "first_seq", "flat", "twice", "member_twice", "bad_seq", "bad", "ops", "trie")
            for doc_id, turn, part, text, valid, *known in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if turn == 1:
                    if log is not None:
                        finished += [(current, *r) for r in log.results()]
                    log, current = _Log(), doc_id
                if part < 0:
                    log.docs.append(_Applied(text, valid))
                else:
                    log.take(*known, operations)
            yield batch_of(finished)
        if log is not None:
            yield batch_of([(current, *r) for r in log.results()])

    return events.mapInArrow(run, f"`{key}` {dict(events.dtypes)[key]}, text string, status string, failed_seq long")


def _plain(value):
    """A value from the log as plain JSON types."""
    if isinstance(value, str):
        return from_text(value)
    return _no_decimals(value.toPython())


def _no_decimals(value):
    if isinstance(value, dict):
        return {k: _no_decimals(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_no_decimals(v) for v in value]
    if isinstance(value, Decimal):
        return int(value) if value.as_tuple().exponent >= 0 else Number(format(value, "f"))
    return value
