"""Decisions over a text in parallel: blocks as maps of states that compose.

A decision depends on the three before it, so a gap is a map of the 15 states of
``STATES``, a block of gaps is the composition of its maps, and composition is
associative: every block finds its own map at once, a scan over the maps of a text gives
each block the state it starts in, and then all blocks decide at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.binding import let
from broadsheet.functions.chars import class_table

# Characters of a block, and characters that are scored together.
BLOCK, BATCH_CHARS = 4096, 400_000
# Blocks of a text above which they go to several tasks.
LONG_BLOCKS = 64
# What stands outside a text: each edge is one code point that is no character.
EDGES_BEFORE, EDGES_AFTER = "\ufdd0\ufdd1\ufdd2", "\ufdd3\ufdd4\ufdd5"
# The decisions that can precede a gap, oldest first (U before the first, B split, O not);
# the position is the state number.
STATES = ["UUU"] + ["UU" + a for a in "BO"] + ["U" + a + b for a in "BO" for b in "BO"] + [
    a + b + c for a in "BO" for b in "BO" for c in "BO"
]
NEXT = [[STATES.index(s[1:] + d) for d in "OB"] for s in STATES]


def run_states(masks: list[int], state: int) -> tuple[list[int], int]:
    """The gaps that are boundaries, and the state after all of them. Bit ``s`` of a mask says that state ``s`` splits."""
    begins = []
    for at, mask in enumerate(masks):
        split = mask >> state & 1
        if split:
            begins.append(at)
        state = NEXT[state][split]
    return begins, state


def map_of(masks: list[int]) -> list[int]:
    """Where a block leads from every state. States that meet go on as one."""
    reached, group = list(range(len(STATES))), list(range(len(STATES)))
    for at, mask in enumerate(masks):
        if len(reached) == 1:
            return [run_states(masks[at:], reached[0])[1]] * len(STATES)
        reached = [NEXT[s][mask >> s & 1] for s in reached]
        distinct = sorted(set(reached))
        if len(distinct) < len(reached):
            group = [distinct.index(reached[g]) for g in group]
            reached = distinct
    return [reached[g] for g in group]


def compose(first: list[int], then: list[int]) -> list[int]:
    return [then[s] for s in first]


def boundaries(masks: np.ndarray, state: int) -> list[int]:
    """The gaps that are boundaries. Only where the three decisions before a gap matter is it looked at by itself."""
    begins, state = run_states(masks[:3].tolist(), state)
    # From the fourth gap on a state is three decisions, of which an O counts.
    own = masks >> 7
    kept = bytearray((own != 255).astype(np.uint8).tobytes())
    kept[:3] = bytes(int(at not in begins) for at in range(min(3, len(masks))))
    open_gaps = np.flatnonzero((own[3:] != 0) & (own[3:] != 255)) + 3
    for at, mask in zip(open_gaps.tolist(), own[open_gaps].tolist(), strict=True):
        kept[at] = ~mask >> (kept[at - 3] << 2 | kept[at - 2] << 1 | kept[at - 1]) & 1
    return np.flatnonzero(np.frombuffer(kept, np.uint8) == 0).tolist()


# Characters of a model, with one for all others of each class, up to which its n-grams are one table of all triples.
MAX_DENSE = 128


class GapScorer:
    """Masks of gaps by a model of bounded size, as sorted n-grams with their weights."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.table = model, None
        low = (1 << 21) - 1
        known = np.unique(np.concatenate([model[f"keys{n}"] >> 21 * k & low for n in (1, 2, 3) for k in range(n)]))
        if len(known) + 7 > MAX_DENSE:
            return
        codes = np.concatenate((known, 0x110000 + np.arange(7)))
        kinds = np.concatenate((model["kinds"][np.minimum(known, 65535)], np.arange(7))).astype(np.int64)
        self.ids = np.full(0x110000, len(known) + 6, np.int64)
        self.ids[:65536] = len(known) + model["kinds"]
        self.ids[known] = np.arange(len(known))
        self.base = len(codes)
        at = np.indices((len(codes),) * 3).reshape(3, -1)
        # Rows of three characters: the n-grams that begin with the first one.
        runs = [codes[at[k]] for k in range(3)]
        self.table = model["classes"][kinds[at[0]] * 49 + kinds[at[1]] * 7 + kinds[at[2]]].copy()
        for n in (1, 2, 3):
            self.table += self._weights(runs[:n], n)

    def _weights(self, runs: list[np.ndarray], n: int) -> np.ndarray:
        keys, weights = self.model[f"keys{n}"], self.model[f"grams{n}"]
        own = runs[0]
        for more in runs[1:]:
            own = own << 21 | more
        if not len(keys):
            return np.zeros((len(own), weights.shape[1]), np.int32)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return weights[np.where(keys[at] == own, at, len(keys))]

    def _grams(self, codes: np.ndarray, n: int) -> np.ndarray:
        return self._weights([np.concatenate((codes[k:], np.zeros(k, np.int64))) for k in range(n)], n)

    def scores(self, padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of the gap before every character of the joined texts without its decisions, and the four classes around it.

        Edges count as characters; their scores mean nothing.
        """
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds = self.model["kinds"][np.minimum(codes, 65535)].astype(np.int64)
        size = len(codes)
        codes, kinds = (np.concatenate((np.zeros(3, np.int64), a, np.zeros(3, np.int64))) for a in (codes, kinds))
        triples = kinds[:-2] * 49 + kinds[1:-1] * 7 + kinds[2:]
        if self.table is None:
            parts = [self._grams(codes, n) for n in (1, 2, 3)] + [self.model["classes"][np.concatenate((triples, [0, 0]))]]
        else:
            own, base = self.ids[np.concatenate((codes, [0, 0]))], self.base
            parts = [self.table[(own[:-2] * base + own[1:-1]) * base + own[2:]]]
        static = np.full(size, self.model["bias"][0], np.int64)
        for offset in range(-2, 4):
            for part in parts:
                static += part[3 - offset : 3 - offset + size, offset + 2]
        return static, triples[:size] * 7 + kinds[3 : 3 + size]

    def masks(self, padded: list[str]) -> np.ndarray:
        """The mask of the gap before every character of the joined texts, counting their edges (whose masks mean nothing)."""
        static, history = self.scores(padded)
        splits = static[:, None] + self.model["history"][history] > 0
        return np.packbits(splits, axis=1, bitorder="little").view(np.uint16)[:, 0]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BATCH_CHARS`` characters, at least one text each."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > BATCH_CHARS:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _masks_by_text(scorer: GapScorer, padded: list[str]) -> Iterator[np.ndarray]:
    """For each padded text the masks of the gaps before all its characters."""
    sizes = [len(p) for p in padded]
    for a, b in _groups(sizes):
        found, at = scorer.masks(padded[a:b]), 0
        for size in sizes[a:b]:
            yield found[at + 3 : at + size - 3]
            at += size


def token_lists(texts: list[str | None], begins: list[list[int]]) -> pa.Array:
    """Lists of tokens: each text cut at its first character and at the given ones. NULL stays NULL."""
    known = [t or "" for t in texts]
    joined = "".join(known)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    places = np.concatenate(([0], np.cumsum(widths)))
    starts, counts, at = [], [0], 0
    for text, own in zip(known, begins, strict=True):
        if text:
            starts.append(np.array([0, *own], np.int64) + at)
        counts.append(counts[-1] + (len(own) + 1 if text else 0))
        at += len(text)
    cuts = places[np.concatenate([*starts, [len(codes)]]).astype(np.int64)] if starts else np.zeros(1, np.int64)
    data = pa.py_buffer(joined.encode("utf-8", "surrogatepass"))
    tokens = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), data)
    offsets = pa.array(counts, pa.int32())
    mask = pa.array([t is None for t in texts]) if None in texts else None
    return pa.ListArray.from_arrays(offsets, tokens.cast(pa.string()), mask=mask)


def segment_short(docs: DataFrame, model: Broadcast, key: str, text: str, is_long: Column) -> DataFrame:
    """``(key, tokens)`` of the texts that are not ``is_long``, each decided where it is read.

    No filter goes before it: one would derive every text twice.
    """
    rows = docs.select(F.col(key).alias("key"), F.when(~is_long, F.col(text)).alias("text"), is_long.alias("is_long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = GapScorer(model.value)
        for b in batches:
            b = b.filter(pc.invert(b.column("is_long")))
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t]
            begins: list[list[int]] = [[] for _ in texts]
            padded = [EDGES_BEFORE + texts[i] + EDGES_AFTER for i in known]
            for i, masks in zip(known, _masks_by_text(scorer, padded), strict=True):
                begins[i] = [at + 1 for at in boundaries(masks[1:], 0)]
            yield pa.RecordBatch.from_arrays([b.column("key"), token_lists(texts, begins)], ["key", "tokens"])

    return rows.mapInArrow(run, f"key {_kind(rows, 'key')}, tokens array<string>")


def static_rows(docs: DataFrame, model: Broadcast, key: str, text: str) -> DataFrame:
    """``(key, pos, static, c4)`` per gap, each text scored where it is read, in pieces of bounded size."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = GapScorer(model.value)
        names = pa.array(["".join("MHIKANO"[i // 7**k % 7] for k in (3, 2, 1, 0)) for i in range(7**4)])
        for b in batches:
            pieces = []
            for row, own in enumerate(b.column("text").to_pylist()):
                padded = EDGES_BEFORE + (own or "") + EDGES_AFTER
                pieces += [(row, at, padded[at : at + BATCH_CHARS + 6]) for at in range(0, len(own or ""), BATCH_CHARS)]
            sizes = [len(p[2]) for p in pieces]
            for i, j in _groups(sizes):
                static, c4 = scorer.scores([p[2] for p in pieces[i:j]])
                pos = np.concatenate([np.arange(at - 3, at - 3 + size) for (_, at, _), size in zip(pieces[i:j], sizes[i:j], strict=True)])
                inside = np.concatenate([(np.arange(size) >= 3) & (np.arange(size) < size - 3) for size in sizes[i:j]])
                # No gap lies before the first character.
                gaps = np.flatnonzero(inside & (pos >= 1))
                keys = b.column("key").take(pa.array(np.repeat([p[0] for p in pieces[i:j]], sizes[i:j])[gaps]))
                columns = [keys, pa.array(pos[gaps], pa.int32()), pa.array(static[gaps], pa.int32()), names.take(pa.array(c4[gaps]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "static", "c4"])

    return rows.mapInArrow(run, f"key {_kind(rows, 'key')}, pos int, static int, c4 string").withColumnRenamed("key", key)


def class_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class, n)``: how often a text has each class, counted where the text is read; a class it lacks has no row.

    An empty text counts as one piece of no class, as splitting it gives.
    """
    kinds = class_table()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = np.frombuffer(kinds, np.uint8), pa.array(list("MHIKANO"))
        for b in batches:
            found = np.zeros((b.num_rows, 7), np.int64)
            for row, own in enumerate(b.column("text").to_pylist()):
                if own:
                    codes = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.uint32)
                    found[row] = np.bincount(table[np.minimum(codes, 65535)], minlength=7)
                elif own is not None:
                    found[row, 6] = 1
            at, kind = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at)), names.take(pa.array(kind)), pa.array(found[at, kind])], ["key", "class", "n"])

    found = rows.mapInArrow(run, f"key {_kind(rows, 'key')}, class string, n long")
    return found.groupBy(F.col("key").alias(key), "class").agg(F.sum("n").alias("n"))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, id, copies, block, before, part, after)``: blocks of distinct texts and the three characters on both sides.

    Outside the text the sides are empty. ``id`` is one key and text.
    """
    distinct = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
    name = F.coalesce(F.concat(F.lit("key "), F.col("key").cast("string")), F.lit("null"))
    parts = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))

    def beside(all_parts):
        def one(part, i):
            before = F.coalesce(F.substring(F.get(all_parts, i - 1), -3, 3), F.lit(""))
            # The last part may be shorter than what is looked at; the edges follow it.
            after = F.substring(F.coalesce(F.get(all_parts, i + 1), F.lit("")), 1, 3)
            return F.struct(before.alias("before"), part.alias("part"), after.alias("after"))

        return F.transform(all_parts, one)

    rows = distinct.select("key", F.md5(F.concat(name, F.lit(" "), "text")).alias("id"), "copies", F.posexplode(let(parts, beside)).alias("block", "p"))
    return rows.select("key", "id", "copies", "block", "p.before", "p.part", "p.after")


def score_blocks(blocks: DataFrame, model: Broadcast) -> DataFrame:
    """``(key, id, copies, block, part, masks)``: 16 bits for the gap before each character of a block; blocks are spread over all tasks."""
    spread = blocks.repartition("id", "block")
    before = F.when(F.col("before") == "", F.lit(EDGES_BEFORE)).otherwise(F.col("before"))
    after = F.substring(F.concat("after", F.lit(EDGES_AFTER)), 1, 3)
    rows = spread.select("key", "id", "copies", "block", "part", F.concat(before, "part", after).alias("padded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = GapScorer(model.value)
        for b in batches:
            found = _masks_by_text(scorer, b.column("padded").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([m.tobytes() for m in found], pa.binary())], [*b.schema.names[:5], "masks"])

    return rows.mapInArrow(run, f"key {_kind(rows, 'key')}, id string, copies long, block int, part string, masks binary")


def _own_masks(block: int, masks: bytes) -> np.ndarray:
    """Masks as numbers; no gap lies before the first character of a text."""
    return np.frombuffer(masks, np.uint16)[int(block == 0) :]


def block_starts(scored: DataFrame) -> DataFrame:
    """``(id, block, state)``: the state each block starts in, by a scan over the maps of the blocks of a text."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [map_of(_own_masks(*x).tolist()) for x in zip(b.column("block").to_pylist(), b.column("masks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("block"), pa.array(found, pa.list_(pa.int32()))], ["id", "block", "map"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, reached = None, []
        for b in batches:
            states = []
            for own, step in zip(b.column("id").to_pylist(), b.column("map").to_pylist(), strict=True):
                if own != text:
                    text, reached = own, list(range(len(STATES)))
                states.append(reached[0])
                reached = compose(reached, step)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("block"), pa.array(states, pa.int32())], ["id", "block", "state"])

    rows = scored.select("id", "block", "masks").mapInArrow(maps, "id string, block int, map array<int>")
    rows = rows.repartition("id").sortWithinPartitions("id", "block")
    return rows.mapInArrow(follow, "id string, block int, state int")


def block_tokens(scored: DataFrame) -> DataFrame:
    """``(key, id, copies, block, goes_on, tokens)``: each block cut by itself; its first token may go on from the block before."""
    rows = scored.join(block_starts(scored), ["id", "block"]).select("key", "id", "copies", "block", "part", "masks", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins, on = [], []
            for block, masks, state in zip(*(b.column(c).to_pylist() for c in ("block", "masks", "state")), strict=True):
                own = boundaries(_own_masks(block, masks), state)
                on.append(block > 0 and (not own or own[0] > 0))
                # A boundary before the first character of a block is where its tokens begin anyway.
                begins.append([at + int(block == 0) for at in own if at > 0 or block == 0])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(on, pa.bool_()), token_lists(b.column("part").to_pylist(), begins)], [*b.schema.names[:4], "goes_on", "tokens"])

    return rows.mapInArrow(run, f"key {_kind(rows, 'key')}, id string, copies long, block int, goes_on boolean, tokens array<string>")


def join_blocks(rows: DataFrame) -> DataFrame:
    """``(key, tokens)`` from the tokens of blocks, once for each copy of a text."""
    in_order = F.array_sort(F.collect_list(F.struct("block", "goes_on", "tokens")))
    texts = rows.groupBy("id").agg(F.any_value("key").alias("key"), F.any_value("copies").alias("copies"), in_order.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                # Parts of the token that is still open are joined once it ends.
                tokens, held = [], []
                for part in parts:
                    first, rest = part["tokens"][0], part["tokens"][1:]
                    if not part["goes_on"] and held:
                        tokens.append("".join(held))
                        held = []
                    held.append(first)
                    if rest:
                        tokens.append("".join(held))
                        tokens += rest[:-1]
                        held = [rest[-1]]
                out.append([*tokens, "".join(held)])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), pa.array(out, pa.list_(pa.string()))], ["key", "copies", "tokens"])

    done = texts.select("key", "copies", "parts").mapInArrow(run, f"key {_kind(rows, 'key')}, copies long, tokens array<string>")
    copies = done.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("key", "tokens")


# The marks of gaps in counted windows: kept, split, and none (outside the text).
MARKS = "OBX"


def _window_numbers(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """All runs of ``width`` values as one number each."""
    out = np.zeros(max(len(values) - width + 1, 0), np.int64)
    for k in range(width):
        out = out * base + values[k : k + len(out)]
    return out


def _digits(numbers: np.ndarray, width: int, letters: str) -> list[str]:
    """Numbers as ``width`` letters each."""
    table = np.array([ord(c) for c in letters], np.uint8)
    cols = [table[numbers // len(letters) ** k % len(letters)] for k in reversed(range(width))]
    text = np.stack(cols, axis=1).tobytes().decode() if len(numbers) else ""
    return [text[i : i + width] for i in range(0, len(text), width)]


# Characters of some texts up to which a triple of them, with the marks around it, is one number.
MAX_ALPHABET = 20_000


def _counted(texts: list[str], kinds: np.ndarray, spaced: bool = True) -> Iterator[tuple[str, list[str], list[str], np.ndarray]]:
    """Distinct windows of texts with their counts: of classes and decisions (``c``), of characters and marks (``t``).

    Blanks of ``spaced`` texts are boundaries; else they are characters, and no gap is a boundary.
    """
    edges = [np.array([ord(c) for c in e], np.int64) for e in (EDGES_BEFORE, EDGES_AFTER + EDGES_AFTER[:2])]
    outside, none, start = np.full(3, 6), np.full(6, 2), np.full(3, 2)
    classes, triples, around = [], [], []
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        places = np.flatnonzero(codes != 32) if spaced else np.arange(len(codes))
        if not len(places):
            continue
        own, marks = codes[places], (np.diff(places) > 1).astype(np.int64)
        kind = kinds[np.minimum(own, 65535)].astype(np.int64)
        seen = _window_numbers(np.concatenate((outside, kind, outside)), 6, 7)[1:-1]
        classes.append(seen * 81 + _window_numbers(np.concatenate((start, marks)), 4, 3))
        triples.append(np.concatenate((edges[0], own, edges[1])))
        around.append(_window_numbers(np.concatenate((none, marks, none)), 6, 3))
    if not classes:
        return
    found, counts = np.unique(np.concatenate(classes), return_counts=True)
    # Before the first gap the decisions are U.
    yield "c", _digits(found // 81, 6, "MHIKANO"), _digits(found % 81, 4, "OBU"), counts
    # A text has as many triples as characters with edges, less two.
    used = np.concatenate(triples)
    starts = np.ones(len(used), bool)
    ends = np.cumsum([len(t) for t in triples])
    starts[ends - 1] = starts[ends - 2] = False
    present = np.zeros(0x110000, bool)
    present[used] = True
    alphabet = np.flatnonzero(present)
    if len(alphabet) <= MAX_ALPHABET:
        numbers = np.zeros(0x110000, np.int64)
        numbers[alphabet] = np.arange(len(alphabet))
        number, base = numbers[used], len(alphabet)
        number = ((number[:-2] * base + number[1:-1]) * base + number[2:])[starts[:-2]]
        found, counts = np.unique(number * 729 + np.concatenate(around), return_counts=True)
        parts = found // 729
        parts = np.stack([alphabet[parts // base**2], alphabet[parts // base % base], alphabet[parts % base]], axis=1)
    else:
        grams, number = np.unique(_window_numbers(used, 3, 1 << 21)[starts[:-2]], return_inverse=True)
        found, counts = np.unique(number * 729 + np.concatenate(around), return_counts=True)
        parts = grams[found // 729]
        parts = np.stack([parts >> 42, parts >> 21 & 0x1FFFFF, parts & 0x1FFFFF], axis=1)
    text = parts.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    yield "t", [text[i : i + 3] for i in range(0, len(text), 3)], _digits(found % 729, 6, MARKS), counts


def window_counts(corpus: DataFrame, text: str = "text", spaced: bool = True) -> DataFrame:
    """``(kind, window, marks, n)`` over a corpus with blanks between words, or without words if it is not ``spaced``.

    Kind ``c``: six classes around a gap, with the three decisions before it and its own.
    Kind ``t``: three characters, with the marks of the six gaps around them. Windows are counted
    in each task first, so distinct ones are shuffled and not one for each character.
    """
    kinds = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(kinds, np.uint8)
        for b in batches:
            texts = [t for t in b.column("text").to_pylist() if t]
            for i, j in _groups([len(t) for t in texts]):
                for kind, windows, marks, counts in _counted(texts[i:j], table, spaced):
                    columns = [pa.array([kind] * len(windows), pa.string()), pa.array(windows, pa.string()), pa.array(marks, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "window", "marks", "n"])

    rows = corpus.select(F.col(text).alias("text")).mapInArrow(run, "kind string, window string, marks string, n long")
    return rows.groupBy("kind", "window", "marks").agg(F.sum("n").alias("n"))
