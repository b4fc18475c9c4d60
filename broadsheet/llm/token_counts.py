"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest piece of the vocabulary that begins it, then the
longest that begins the rest, and so on. The number of pieces is found in one step a byte,
without building pieces: the vocabulary is a trie; where a node has no child for the next
byte, its failure link leads to the node of what remains after the pieces that are now
certain, and the number of those pieces is stored beside the link. Links are followed once
when the table is built, so it has for each node and byte the next node and the pieces popped.

Words are runs of anything but ASCII white space, each with one blank before it. Vocabulary
files of byte-level kind have all single bytes, so every word has pieces. The count is that
of greedy longest match, which may differ from merge order (``bpe.py``).

Defined results: NULL and empty texts have no words and no tokens. Rows are independent.
Extra columns are ignored.

Scale: one pass, no shuffle; distinct words of a block of texts are stepped through
together, a byte a step, so memory is bounded by the block and the table.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bpe import byte_of_letter, default_path
from broadsheet.llm.shingles import slices, word_hashes

# Words longer than this are stepped through one by one.
LONG = 256


class Automaton:
    """Next node and popped pieces for each node and byte; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = children[node][byte]
            ends[node] = node != 0
        if len(children[0]) < 256:
            raise ValueError("the vocabulary lacks a byte")
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.popped = np.zeros((n, 256), np.uint8)
        # Where a failed node goes on, and how many pieces are certain then.
        link, certain = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for byte, child in children[0].items():
            self.next[0, byte] = child
        level = [(0, byte, child) for byte, child in children[0].items()]
        while level:
            deeper = []
            for parent, byte, node in level:
                if ends[node]:
                    link[node], certain[node] = 0, 1
                elif parent:
                    # What is left of the parent reads the byte as well: its links lead to shorter words, done before.
                    z = link[parent]
                    link[node] = self.next[z, byte]
                    certain[node] = certain[parent] + self.popped[z, byte]
                self.next[node] = self.next[link[node]]
                self.popped[node] = self.popped[link[node]] + certain[node]
                for b, child in children[node].items():
                    self.next[node, b], self.popped[node, b] = child, 0
                    deeper.append((node, b, child))
            level = deeper
        # At the end of a word what is left is popped link by link.
        self.rest = np.zeros(n, np.int32)
        order = sorted(range(1, n), key=lambda v: self._depth(v, link))
        for node in order:
            self.rest[node] = certain[node] + self.rest[link[node]]

    @staticmethod
    def _depth(node: int, link: np.ndarray) -> int:
        depth = 0
        while node:
            node, depth = int(link[node]), depth + 1
        return depth

    def count_one(self, word: bytes) -> int:
        node = total = 0
        step, popped = self.next, self.popped
        for byte in word:
            total += int(popped[node, byte])
            node = int(step[node, byte])
        return total + int(self.rest[node])

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of the words at ``starts`` to ``ends`` of the bytes, each with a blank before it."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        first = self.next[0, 32]
        nodes, total = np.full(len(starts), first, np.int32), np.zeros(len(starts), np.int64)
        begin = int((sizes > LONG).sum())
        for i in order[:begin]:
            total[i] = self.count_one(b" " + data[starts[i] : ends[i]].tobytes())
        short = order[begin:]
        at, states, sums = starts[short], nodes[short], total[short]
        lengths = sizes[short]
        live = len(short)
        for step in range(int(lengths[0]) if live else 0):
            # Sorted by length, so the words that go on are a beginning of the list.
            while live and lengths[live - 1] <= step:
                live = int(np.searchsorted(-lengths, -step, side="left"))
            byte = data[at[:live] + step]
            sums[:live] += self.popped[states[:live], byte]
            states[:live] = self.next[states[:live], byte]
        total[short] = sums + self.rest[states]
        return total


def pieces_of(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    letters = byte_of_letter()
    return [bytes(letters[c] for c in name) for name in names]


def load(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in each process."""
    home = sys.modules.setdefault("broadsheet_llm_loaded", types.ModuleType("broadsheet_llm_loaded"))
    loaded = home.__dict__.setdefault("automata", {})
    if path not in loaded:
        loaded[path] = Automaton(pieces_of(path))
    return loaded[path]


def count_texts(automaton: Automaton, texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Words and pieces of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    hashes, starts, ends = word_hashes(data, lower=False)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    cuts = np.searchsorted(starts, begins)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    each = automaton.count(data, starts[first], ends[first])[number]
    sums = np.concatenate(([0], np.cumsum(each)))
    return np.diff(cuts).tolist(), (sums[cuts[1:]] - sums[cuts[:-1]]).tolist()


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    where = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(where)
        for batch in (part for whole in batches for part in slices(whole)):
            words, tokens = count_texts(automaton, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
