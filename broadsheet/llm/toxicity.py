"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

Every text is cut into windows of ``WINDOW`` words that overlap; the score of a
document is that of its most toxic window. A word enters as a learned vector of the word
(one of a bounded vocabulary) and the mean of learned vectors of its character
trigrams. Words are runs of letters and digits, lower-cased, so `IDIOT!!` is `idiot`. Training is in numpy, on the driver, from at most ``MAX_TOXIC`` and
``MAX_CLEAN`` labelled documents, chosen by a hash of their id. A label belongs to a
document and not to a window, so each step trains on the window that scores highest now,
and on another one of each clean document. The toxic documents that least look it
(``WRONG_LABELS``) are left out of a step, as some labels are wrong.

Scoring is one pass over the documents: nothing is shuffled and memory is bounded by one
batch and one block of texts.

Defined results: NULL and empty texts are one window without words and have a score. A
label row without a document, or with a NULL id or label, is not used; of repeated labels
the larger counts, of repeated documents the row with the smallest text hash. Without
labelled documents of both kinds there is no model, and all scores are the share of toxic
ones (0 if there are none). Extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.shingles import word_hashes

# Bounds of the training sample, in documents.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
VOCABULARY, CHAR_BUCKETS = 1000, 2048
EPOCHS, MIN_STEPS, RATE, BATCH, DECAY = 8, 100, 0.015, 128, 1e-4
THRESHOLD = 0.3
# Windows that are scored together, and characters of texts that are cut into windows together.
BLOCK, BLOCK_CHARS = 2048, 250_000
# What an error on a toxic document costs against one on a clean document.
TOXIC_WEIGHT = 2.0
# Share of the toxic labels of the sample that may be wrong.
WRONG_LABELS = 0.1


def is_held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: ``crc32(doc_id as text) mod 4`` is 2. A NULL id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


# Words are runs of digits, letters a to z and bytes beyond ASCII in lower-cased text.
_IS_GAP = np.ones(256, bool)
_IS_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """The distinct words of some texts, and the texts as numbers of words."""

    hashes: np.ndarray
    buckets: np.ndarray  # of all trigrams of all words, one after the other
    sizes: np.ndarray  # trigrams of each word
    texts: list[np.ndarray]

    def only(self, used: np.ndarray) -> Words:
        """These words alone, without texts."""
        begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))[used]
        sizes = self.sizes[used]
        place = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return Words(self.hashes[used], self.buckets[place], sizes, [])


def words_of(texts: list[str | None]) -> Words:
    """Word 0 is no word: it has no letters and stands for what lies beyond the end of a text."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    hashes, starts, ends = word_hashes(data, _IS_GAP)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    cuts = np.searchsorted(starts, begins)
    found, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    sizes = ends - starts
    # Places fit 32 bits: texts come in blocks, or are a bounded sample.
    before_word = (starts - np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(np.int32)
    place = np.repeat(before_word, sizes) + np.arange(sizes.sum(), dtype=np.int32) if len(found) else np.zeros(0, np.int32)
    own = data[place].astype(np.int32)
    before = np.where(np.repeat(starts, sizes) == place, 60, data[place - 1])
    after = np.where(np.repeat(ends, sizes) == place + 1, 62, data[np.minimum(place + 1, len(data) - 1)])
    buckets = (before.astype(np.int32) * 961 + own * 31 + after) % (CHAR_BUCKETS - 1) + 1
    return Words(
        np.concatenate(([np.uint64(0)], found)),
        np.concatenate(([0], buckets)),
        np.concatenate(([1], sizes)),
        [(number[a:b] + 1).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
    )


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of ``n`` words begin: every ``STRIDE`` words until the end is reached."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0]


class Model:
    """Parameters, as plain arrays in ``p``, and both passes."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, seed: int = 7):
        """``vocabulary``: sorted hashes of the known words; ``weight``: the evidence of each, after that of all others."""
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM

        def small(*shape, scale=0.3):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.vocabulary = vocabulary
        self.p = {"word": small(len(vocabulary) + 1, WORD_DIM, scale=0.05), "char": small(CHAR_BUCKETS, CHAR_DIM, scale=0.05)}
        # A start from the evidence of each word alone; training does the rest.
        self.p["word"][:, 0] = weight
        for side in "fb":
            self.p |= {f"W{side}": small(d, 3 * h), f"b{side}": np.zeros(3 * h, np.float32), f"U{side}": small(h, 3 * h)}
        self.p |= {"att": small(2 * h), "out": small(2 * h), "bias": np.full(1, -2, np.float32)}

    def arrays(self) -> dict[str, np.ndarray]:
        """All that makes up the model, as plain arrays: they can be broadcast to executors without this package."""
        return {"vocabulary": self.vocabulary, **self.p}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Model:
        model = cls.__new__(cls)
        model.p = {k: v for k, v in arrays.items() if k != "vocabulary"}
        model.vocabulary = arrays["vocabulary"]
        return model

    def numbers(self, words: Words) -> np.ndarray:
        """Rows of the word vectors; 0 for words that aren't known."""
        if not len(self.vocabulary):
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """The vector of each distinct word."""
        ends = np.concatenate(([0], np.cumsum(words.sizes)[:-1]))
        chars = np.add.reduceat(self.p["char"][words.buckets], ends, axis=0) / words.sizes[:, None]
        return np.concatenate([self.p["word"][self.numbers(words)], chars], axis=1).astype(np.float32)

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {side: inputs @ self.p[f"W{side}"] + self.p[f"b{side}"] for side in "fb"}

    def fast(self, inputs: np.ndarray) -> FastScores:
        """For scoring without gradients."""
        return FastScores(self.p, inputs)

    def run(self, gates: dict[str, np.ndarray], rows: np.ndarray, mask: np.ndarray):
        """Logits of windows given as word rows ``[n, WINDOW]``, with all that the gradients need; ``mask`` is 0 beyond the end."""
        n, h = len(rows), HIDDEN
        states = np.empty((n, WINDOW, 2 * h), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for side, at, steps in (("f", 0, range(WINDOW)), ("b", h, range(WINDOW - 1, -1, -1))):
            u, state = self.p[f"U{side}"], np.zeros((n, h), np.float32)
            for t in steps:
                x, own = gates[side][rows[:, t]], state @ u
                zr = 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + own[:, : 2 * h])) + 0.5
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
                nxt = np.where(mask[:, t : t + 1], new + z * (state - new), state)
                tape[side].append((t, state, own, z, r, new))
                state = states[:, t, at : at + h] = nxt
        scores = np.where(mask, states @ self.p["att"], np.float32(-1e9))
        weights = np.exp(scores - scores.max(1, keepdims=True)) * mask
        weights /= np.maximum(weights.sum(1, keepdims=True), 1e-9)
        pooled = np.matmul(weights[:, None, :], states)[:, 0]
        return pooled @ self.p["out"] + self.p["bias"][0], states, weights, pooled, tape

    def gradients(self, words: Words, rows: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross entropy over the given windows."""
        used, flat = np.unique(rows, return_inverse=True)
        part, rows = words.only(used), flat.reshape(rows.shape)
        inputs = self.inputs(part)
        gates, h = self.gates(inputs), HIDDEN
        logits, states, weights, pooled, tape = self.run(gates, rows, mask)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(labels == 1, TOXIC_WEIGHT, 1) / len(labels)
        d_logit = ((1 / (1 + np.exp(-logits)) - labels) * weight).astype(np.float32)
        grad["out"], grad["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weights = np.einsum("nth,nh->nt", states, d_pooled)
        d_scores = weights * (d_weights - (weights * d_weights).sum(1, keepdims=True))
        grad["att"] = np.einsum("nt,nth->h", d_scores, states)
        d_states = weights[:, :, None] * d_pooled[:, None, :] + d_scores[:, :, None] * self.p["att"]
        d_inputs = np.zeros_like(inputs)
        for side, at in (("f", 0), ("b", h)):
            u, carried = self.p[f"U{side}"], np.zeros((len(rows), h), np.float32)
            d_gates = np.zeros_like(gates[side])
            for t, state, own, z, r, new in reversed(tape[side]):
                live = mask[:, t : t + 1]
                total = carried + d_states[:, t, at : at + h]
                d_next = total * live
                d_new = d_next * (1 - z) * (1 - new * new)
                d_z = d_next * (state - new) * z * (1 - z)
                d_r = d_new * own[:, 2 * h :] * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad[f"U{side}"] += state.T @ d_own
                np.add.at(d_gates, rows[:, t], d_x)
                carried = d_next * z + d_own @ u.T + total * ~live
            grad[f"W{side}"], grad[f"b{side}"] = inputs.T @ d_gates, d_gates.sum(0)
            d_inputs += d_gates @ self.p[f"W{side}"].T
        np.add.at(grad["word"], self.numbers(part), d_inputs[:, :WORD_DIM])
        each = np.repeat(d_inputs[:, WORD_DIM:] / part.sizes[:, None], part.sizes, axis=0)
        np.add.at(grad["char"], part.buckets, each)
        return grad


class FastScores:
    """Both directions with one table for each gate, so that every step works on whole arrays."""

    def __init__(self, p: dict[str, np.ndarray], inputs: np.ndarray):
        h = HIDDEN
        self.p, self.sides = p, []
        for side in "fb":
            gates = inputs @ p[f"W{side}"] + p[f"b{side}"]
            # A sigmoid is a tanh of the half, so the halves are taken here once.
            cut = [(gates[:, i * h : (i + 1) * h], p[f"U{side}"][:, i * h : (i + 1) * h], s) for i, s in enumerate((0.5, 0.5, 1.0))]
            self.sides.append([(np.ascontiguousarray(g * np.float32(s)), np.ascontiguousarray(u * np.float32(s))) for g, u, s in cut])

    def logits(self, rows: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows ``[n, WINDOW]``; without a mask all are whole."""
        n, h, half = len(rows), HIDDEN, np.float32(0.5)
        columns = np.ascontiguousarray(rows.T)
        states = np.empty((2, WINDOW, n, h), np.float32)
        for side, steps in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
            (xz, uz), (xr, ur), (xn, un) = self.sides[side]
            state = np.zeros((n, h), np.float32)
            for t in steps:
                at = columns[t]
                z, r, new = xz.take(at, 0), xr.take(at, 0), state @ un
                z += state @ uz
                r += state @ ur
                np.tanh(z, out=z)
                np.tanh(r, out=r)
                r += 1
                r *= half
                new *= r
                new += xn.take(at, 0)
                np.tanh(new, out=new)
                nxt = np.subtract(state, new, out=states[side, t])
                z += 1
                z *= half
                nxt *= z
                nxt += new
                if mask is not None:
                    nxt[...] = np.where(mask[:, t : t + 1], nxt, state)
                state = nxt
        scores = states[0] @ self.p["att"][:h] + states[1] @ self.p["att"][h:]
        values = states[0] @ self.p["out"][:h] + states[1] @ self.p["out"][h:]
        if mask is not None:
            scores = np.where(mask.T, scores, np.float32(-1e9))
        weights = np.exp(scores - scores.max(0))
        if mask is not None:
            weights *= mask.T
        return (weights * values).sum(0) / np.maximum(weights.sum(0), 1e-9) + self.p["bias"][0]


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows ``[n, WINDOW]``, mask and document number of all windows of the texts; row 0 stands beyond the end."""
    sizes = [len(t) for t in texts]
    begins = np.cumsum([0] + sizes[:-1]) if sizes else np.zeros(0, np.int64)
    starts = [window_starts(n) for n in sizes]
    of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    local = np.array([x for s in starts for x in s], np.int64)
    place = local[:, None] + np.arange(WINDOW)
    mask = place < np.array(sizes, np.int64)[of][:, None] if len(of) else np.zeros((0, WINDOW), bool)
    flat = np.concatenate([*texts, np.zeros(1, np.int32)])
    rows = flat[np.where(mask, begins[of][:, None] + place, len(flat) - 1)] if len(of) else np.zeros((0, WINDOW), np.int32)
    return rows, mask, of


def _logits(fast: FastScores, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Block by block; whole windows need no mask."""
    out = np.empty(len(rows), np.float32)
    whole = mask.all(1)
    for where, masked in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
        for a in range(0, len(where), BLOCK):
            some = where[a : a + BLOCK]
            out[some] = fast.logits(rows[some], mask[some] if masked else None)
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Fit a model on labelled texts; None without both kinds."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    words = words_of(texts)
    seen = np.zeros((2, len(words.hashes)))
    for numbers, label in zip(words.texts, y, strict=True):
        seen[int(label), np.unique(numbers)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    common = np.flatnonzero(seen.sum(0) >= 3)
    chosen = common[np.lexsort((words.hashes[common], -np.abs(odds[common])))][:VOCABULARY]
    chosen = chosen[np.argsort(words.hashes[chosen])]
    weight = np.concatenate(([0], np.clip(odds[chosen] / 3, -1.5, 1.5))).astype(np.float32)
    model, rng = Model(words.hashes[chosen], weight, seed), np.random.default_rng(seed)
    rows, mask, of = _windows(words.texts)
    first = np.searchsorted(of, np.arange(len(y)))
    count = np.diff(np.append(first, len(of)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    # A small sample is gone through more often.
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        logits = _logits(model.fast(model.inputs(words)), rows, mask)
        top = np.array([a + int(np.argmax(logits[a : a + n])) for a, n in zip(first, count, strict=True)])
        # The toxic documents that least look it are taken for wrong labels, once the model tells some.
        doubt = np.quantile(logits[top[y == 1]], WRONG_LABELS) if epoch >= 2 else -np.inf
        trusted = (y == 0) | (logits[top] > doubt)
        other = first + (rng.random(len(y)) * count).astype(np.int64)
        picked = np.concatenate([top[trusted], other[y == 0]])
        target = np.concatenate([y[trusted], np.zeros(int((y == 0).sum()), np.float32)])
        order = rng.permutation(len(picked))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            grad = model.gradients(words, rows[picked[some]], mask[picked[some]], target[some])
            step += 1
            for k, g in grad.items():
                g += DECAY * model.p[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The score of each text: that of its most toxic window."""
    words = words_of(texts)
    rows, mask, of = _windows(words.texts)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, of, _logits(model.fast(model.inputs(words)), rows, mask))
    return 1 / (1 + np.exp(-best))


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Lists of texts of about ``BLOCK_CHARS`` characters, at least one text each."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: at most ``MAX_TOXIC`` and ``MAX_CLEAN``, none of them held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label is not null")
    known = known.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.filter("label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.filter("label = 0").orderBy(*order).limit(MAX_CLEAN))
    # The ids are a few thousand at most, so they go to the documents.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    found = sorted(rows.collect(), key=lambda r: (str(r["id"]), r["text"] or ""))
    once = {r["id"]: (r["text"] or "", r["label"]) for r in reversed(found)}
    return [t for t, _ in once.values()], [y for _, y in once.values()]


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    texts, known = labelled_sample(docs, labels, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = _scored(scored, texts, known).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _share(rows: DataFrame, model: Model | None) -> Broadcast[dict[str, np.ndarray]]:
    """A broadcast is pickled by reference, so it holds arrays and no class of this package; empty without a model."""
    # The driver lives on for the whole job: what training no longer needs goes back to the system.
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    return rows.sparkSession.sparkContext.broadcast(model.arrays() if model is not None else {})


def _scored(rows: DataFrame, texts: list[str], known: list[int]) -> DataFrame:
    """``rows`` (any columns, the text as ``text``) with a column ``score`` after them."""
    share = float(np.mean(known)) if known else 0.0
    shared = _share(rows, train(texts, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value) if shared.value else None
        for batch in batches:
            blocks = _blocks(batch.column("text").to_pylist())
            parts = [scores(model, some) if model is not None else np.full(len(some), share) for some in blocks]
            values = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Only texts go to Python and only scores come back; the rows stay where they are.
    """
    texts, known = labelled_sample(docs, labels, doc_id, text)
    share = float(np.mean(known)) if known else 0.0
    shared = _share(docs, train(texts, known))

    @F.pandas_udf(T.DoubleType())
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model.of(shared.value) if shared.value else None
        for batch in batches:
            parts = [scores(model, some) if model is not None else np.full(len(some), share) for some in _blocks(batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    # A column of the rows themselves: beside a struct of them the text would wait for its score twice.
    name = "score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, toxic(F.col(text))).filter(F.col(name) < threshold).drop(name)
