"""Benchmark decontamination by pigeonhole edit matching.

A document is contaminated by an item when some passage of it can be turned into the
item with at most ``k = error_rate * length`` edits (insert, delete, replace a code
point), both lower-cased and with white space runs as one blank. The item is split into
``k + 1`` pieces; a passage within ``k`` edits holds one of them unchanged. Exact hits
of all pieces are found in one pass of an Aho-Corasick automaton, and the passage around
each hit is verified with Myers' bit-parallel distance. The result is exact for any
error rate; a higher rate means shorter pieces and more hits to verify.

Defined results: NULL and empty texts hold nothing; NULL and blank items match nothing.
Repeated items give one row each ``item_id`` and document. Rows of one ``doc_id`` are
taken one by one and the smallest distance counts; a NULL ``doc_id`` is an id like any
other. Empty tables give no rows. Extra columns are ignored.

Scale: documents are never shuffled; only matches are. Items reach the tasks in rounds of
bounded size (``ROUND_CHARS``), each one pass over the documents, so an automaton fits in
memory however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edits allowed for each code point of an item.
ERROR_RATE = 0.08
# Characters of items in one automaton.
ROUND_CHARS = 8_000_000


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, error_rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length and where they begin; none for an empty item."""
    k = int(len(item) * error_rate)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


class Myers:
    """The smallest distance between one pattern and any passage of a text, by bit-parallel columns."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.full = (1 << self.length) - 1
        self.last = 1 << (self.length - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """The smallest distance and the end of the first passage that has it."""
        up, down, score, full = self.full, 0, self.length, self.full
        best, end = score, 0
        for i, c in enumerate(text, 1):
            eq = self.places.get(c, 0)
            vertical = eq | down
            cross = (((eq & up) + up) ^ up) | eq
            right = down | ~(cross | up) & full
            left = up & cross
            if right & self.last:
                score += 1
            elif left & self.last:
                score -= 1
            right = right << 1 & full
            left = left << 1 & full
            up = left | ~(vertical | right) & full
            down = right & vertical
            if score < best:
                best, end = score, i
        return best, end


class Matcher:
    """All items of one round."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE):
        self.items = items
        self.error_rate = error_rate
        self.myers = [Myers(text) for _, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            for at, piece in pieces(text, error_rate):
                found.setdefault(piece, []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Number of an item to its smallest distance, for the items within their budget."""
        best: dict[int, int] = {}
        if not self.myers or not text:
            return best
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for number, at in where:
                length = self.myers[number].length
                k = int(length * self.error_rate)
                begin = end + 1 - size - at
                low, high = max(0, begin - k), min(len(text), begin + length + k)
                # Hits come by their end, so windows of one item that touch can be verified as one.
                held = spans.setdefault(number, [])
                if held and low <= held[-1][1] and low >= held[-1][0]:
                    held[-1][1] = max(held[-1][1], high)
                else:
                    held.append([low, high])
        for number, held in spans.items():
            k = int(self.myers[number].length * self.error_rate)
            for low, high in held:
                distance, _ = self.myers[number].best(text[low:high])
                if distance <= k and distance < best.get(number, k + 1):
                    best[number] = distance
                    if distance == 0:
                        break
        return best


def _rounds(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, in lists of about ``ROUND_CHARS`` characters, none on the driver but one at a time."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // ROUND_CHARS))
    for number in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == number)
        texts = ((r["item_id"], normalised(r["text"])) for r in part.toLocalIterator())
        yield [(key, text) for key, text in texts if text]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
) -> DataFrame:
    """``doc_id, item_id, distance``: each document and each item that a passage of it matches."""
    doc_kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for listed in _rounds(items):
        shared = docs.sparkSession.sparkContext.broadcast(listed)
        parts.append(rows.mapInArrow(_scan(shared, error_rate), f"doc_id {doc_kind}, item_id {item_kind.simpleString()}, distance int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _scan(shared, error_rate: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        ids = [key for key, _ in shared.value]
        for batch in batches:
            docs, items, distances = [], [], []
            names = batch.column("doc_id").to_pylist()
            for name, text in zip(names, batch.column("text"), strict=True):
                for number, distance in matcher.matches(normalised(text.as_py())).items():
                    docs.append(name)
                    items.append(ids[number])
                    distances.append(distance)
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(items, _kind_of(ids)), pa.array(distances, pa.int32())], ["doc_id", "item_id", "distance"])

    return scan


def _kind_of(ids: list) -> pa.DataType:
    """Arrow type of item ids; whole numbers are long."""
    kind = pa.array(ids).type
    return pa.int64() if pa.types.is_null(kind) else kind


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    gone = contaminated(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]), "left_anti")
