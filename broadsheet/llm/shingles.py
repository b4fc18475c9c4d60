"""Word shingles of whole texts as sorted sets of 64-bit hashes, many texts at a time in numpy.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text of at least
``SIZE`` words has the set of its ``SIZE``-word shingles, a shorter one its whole
sequence as one shingle, a text without words the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SIZE = 5
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: int) -> np.uint64:
    return _U(pow(odd, -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept for the life of the process."""

    up = _powers(_BASE, 1)
    down = up

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_inverse(int(_BASE)), n)
        return cls.up, cls.down


def word_hashes(data: np.ndarray, is_space: np.ndarray = _IS_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte position of every word in UTF-8 bytes; ``is_space`` tells of each byte value.

    With ``lower`` words that differ in the case of A-Z only have one hash.
    """
    value = _BYTE[_LOWER] if lower else _BYTE
    edge = np.diff(np.concatenate(([True], is_space[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    del edge
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        # Whole words of about a chunk together, so that the sums stay small.
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, side="right")))
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = _Powers.get(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[data[low:high]] * down[: high - low], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        hashes[a:b] = mix((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64))
        a = b
    return hashes, starts, ends


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts, which bounds what is held beside it."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; NULL counts as empty."""
    block, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > CHUNK_BYTES:
            yield from _block(block)
            block, size = [], 0
        block.append(data)
        size += len(data) + 1
    yield from _block(block)


def _block(parts: list[bytes]) -> Iterator[np.ndarray]:
    if not parts:
        return
    data = np.frombuffer(b" ".join(parts), np.uint8)
    words, starts, _ = word_hashes(data)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    firsts = np.append(np.searchsorted(starts, begins), len(words))
    rolled = None
    if len(words) >= SIZE:
        n = len(words) - SIZE + 1
        rolled = words[:n].copy()
        for k in range(1, SIZE):
            rolled = mix(rolled) + words[k : k + n]
        rolled = mix(rolled)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= SIZE:
            yield np.unique(rolled[a : b - SIZE + 1])
        elif b > a:
            whole = _U(b - a)
            for word in words[a:b]:
                whole = mix(np.array([whole], np.uint64))[0] ^ word
            yield mix(np.array([whole ^ _U(0x5851F42D4C957F2D)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
