"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

Every prefix of a word has exactly one last token in its encoding: the token that ends
the prefix and may stand after the last token of what remains. So the words of a batch
that are new are put into a trie, which is walked depth first: each node gets its last
token from the nodes above it, once for all the words that share the prefix, and the
encoding of a word is read off by stepping back through last tokens. Sorted words are
the trie in depth-first order; the path from the root is kept as a stack.

The result is that of byte-level BPE with the given vocabulary file: the text is cut at
special tokens, then into words by the vocabulary's pattern, then each word is encoded.
Decoding turns ids into bytes and bytes into text.

Defined results: NULL and empty texts have no tokens and decode to the empty text. Rows
are independent, so repeated rows and ids give repeated results. Extra columns are ignored.

Scale: one pass, no shuffle. Encodings of words are kept between batches up to a bound.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.shingles import slices

# The pattern that byte-level vocabularies of this kind are made with: a fixed value.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words whose encodings are kept, and the longest that is.
KEPT_WORDS, KEPT_LENGTH = 120_000, 40
# Verdicts on neighbouring tokens that are kept.
KEPT_PAIRS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*names.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for name, i in names.items():
            self.bytes[i] = bytes(letters[c] for c in name)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self._link()
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = names[left], names[right]
            self.rank[pair], self.merged[pair] = rank, names[left + right]
            self.parts.setdefault(names[left + right], pair)
        self.order = {i: -1 for i in names.values()} | {i: self.rank[p] for i, p in self.parts.items()}
        self.sound: list[bool | None] = [None] * size
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.words = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _link(self) -> None:
        """A trie of all tokens with failure links: the tokens that end at a place are found longest first.

        ``step`` leads from a node (of the trie of tokens) and a byte to the next; ``ends`` gives the longest token that
        ends a node's path, ``shorter`` the next one that ends a token.
        """
        self.step: dict[int, int] = {}
        own, by_depth = [-1], [[(0, 0, 0)]]
        for data, token in sorted(self.ids.items()):
            node = 0
            for depth, byte in enumerate(data, 1):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(own)
                    own.append(-1)
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append((len(own) - 1, node, byte))
                node = self.step[key]
            own[node] = token
        self.fail, self.ends = [0] * len(own), [-1] * len(own)
        self.shorter: dict[int, int] = {}
        for nodes in by_depth[1:]:
            for node, above, byte in nodes:
                back = self.fail[above]
                self.fail[node] = self._next(back, byte) if above else 0
                below = self.ends[self.fail[node]]
                self.ends[node] = own[node] if own[node] >= 0 else below
                if own[node] >= 0:
                    self.shorter[own[node]] = below
        self.size = list(map(len, self.bytes))

    def _next(self, node: int, byte: int) -> int:
        while True:
            found = self.step.get(node << 8 | byte)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.fail[node]

    def merge_all(self, data: bytes) -> list[int]:
        """The encoding by definition: the merge of lowest rank first, until none is left."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(zip(ids, ids[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best:
                    out.append(self.merged[best])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def is_sound(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        got = self.sound[token]
        if got is None:
            got = self.sound[token] = self.merge_all(self.bytes[token]) == [token]
        return got

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes: no merge across their border comes first."""
        key = left << 32 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > KEPT_PAIRS:
                self.fits.clear()
            got = self.fits[key] = self._border_holds(left, right)
        return got

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens from the last; a merge across that was possible before one of them breaks the border."""
        order, limit = self.order, 1 << 60
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            # Merges of one rank run from left to right, so a tie is the left token's.
            if order[left] > order[right] and order[left] >= 0:
                limit, left = order[left], self.parts[left][1]
            elif order[right] >= 0:
                limit, right = order[right] + (order[left] != order[right]), self.parts[right][0]
            else:
                return True

    def walk(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word and its encoding, in depth-first order of the trie of all words.

        The last token of a prefix is, of the tokens that end there, the longest that is its own
        encoding and may stand after the last token of what is before it.
        """
        path, last, nodes = b"", [-1], [0]
        size, step, ends, shorter, sound, fits = self.size, self.step, self.ends, self.shorter, self.sound, self.fits
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(path), len(data))
            while shared < most and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for end in range(shared + 1, len(data) + 1):
                found = step.get(node << 8 | data[end - 1])
                node = self._next(node, data[end - 1]) if found is None else found
                token = ends[node]
                while token >= 0:
                    if sound[token] or (sound[token] is None and self.is_sound(token)):
                        begin = end - size[token]
                        if not begin or fits.get(last[begin] << 32 | token) or self.may_follow(last[begin], token):
                            break
                    token = shorter[token]
                else:
                    raise ValueError("the vocabulary lacks a byte")
                nodes.append(node)
                last.append(token)
            path = data
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            yield word, ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        pieces = [self._pieces(t) for t in texts]
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        words = set().union(*(part for text in pieces for part in text if not isinstance(part, bytes)))
        long = []
        for word, ids in self.walk(words - kept.keys()):
            kept[word] = np.array(ids, "<u4").tobytes()
            if len(word) > KEPT_LENGTH:
                long.append(word)
        of_word = kept.__getitem__
        out = [b"".join([part if isinstance(part, bytes) else b"".join(map(of_word, part)) for part in text]) for text in pieces]
        for word in long:
            del kept[word]
        return out

    def _pieces(self, text: str | None) -> list[list[str] | bytes]:
        """Special tokens as their ids, and the words of what is between them."""
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return [self.words.findall(text)]
        out: list[list[str] | bytes] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.append(self.words.findall(part))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """The vocabulary, read once in each process."""
    home = sys.modules.setdefault("broadsheet_llm_loaded", types.ModuleType("broadsheet_llm_loaded"))
    loaded = home.__dict__.setdefault("bpe", {})
    if path not in loaded:
        loaded[path] = Bpe(path)
    return loaded[path]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (little-endian 32-bit numbers) of every row."""
    where = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` of every row of ``encode``'s result."""
    where = path or default_path()
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            for part in slices(batch):
                texts = [bpe.decode(x or b"") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def encode_and_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` of every row: both steps in one pass, in one worker."""
    where = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text they decode to."""
    rows = encode_and_decode(docs, doc_id, text, path)
    tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
