"""N-gram Jaccard join by PartEnum signatures: documents whose shingle sets are similar enough.

Two documents link when ``100 * |intersection| >= 80 * |union|`` of their sets of 5-word
shingles (``shingles.py``). The join is exact, set hashes of 64 bits per shingle aside.

*Signatures.* Sizes are cut into bands that reach from ``l`` to ``l / 0.8``. A set takes
part in its own band and in the next one, so two similar sets always share a band. Within
a band similar sets differ in at most ``k`` elements. The domain is cut by hash into
``n > k`` partitions, and the enumerated subsets are the single partitions: two similar
sets agree on at least ``n - k`` of them. A signature is the hash of band, partition and
the elements in it. More levels of subsets would make signatures longer, at the price of
more of them; the groups are small enough as they are.

*Empty partitions* say nothing, and all sets of a band would meet there. A set with fewer
empty partitions than ``n - k`` agrees with each partner on one that is not empty, so it
leaves them out. Only the other sets keep them.

*Small groups* of one signature give all their pairs; *large groups* first link every
member to one leader, the member that is in most large groups, which is as a rule what the
others were copied from. After that only members outside the largest component of their
group are held against the group, in blocks. Every pair must pass an exact bound before any
text is fetched: sets that differ in ``k`` elements differ in at most ``k`` of the parities
of their elements by hash bucket.

Equal sets are collapsed to one before all this, by hash and size of the set. Signatures carry
the *key* of their set, one number of 48 bits of its hash and 16 bits of the logarithm of its
size. Keys that two sets share lead to candidates of both, which are checked as all others.

Defined results: NULL or empty text has an empty set, which links with nothing. A NULL
``doc_id`` links with nothing and has a NULL component. Rows of one ``doc_id`` are one
document: with several texts it has the links of all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.components import connected_components
from broadsheet.llm.line_dedup import build_filters, probe
from broadsheet.llm.shingles import mix, shingle_sets, slices
from broadsheet.session import scratch_path

# Similarity as a fraction of whole numbers.
NEED, OF = 80, 100
# Partitions for each element that similar sets may differ in; the excess makes up for empty ones.
EXCESS = 1.1
# Groups up to this size give all their pairs at once.
SMALL_GROUP = 24
# Members of one block when a large group is held against those outside its main component.
BLOCK = 256
# Shingles of the texts for each signature block, which has about six signatures for ten; one block is in memory at a time.
BLOCK_SHINGLES = 100_000
# Bytes of a signature that are kept beside its block.
SIG_BYTES = 6
# Steps of the natural logarithm of a size in the key of a set; sizes of 64 bits fit 16 bits of it.
SIZE_STEPS = 1024
# Sets with more rows than one in this many for each shuffle partition are frequent, so there are at most that many.
FREQUENT = 4
# What tells sets apart.
SET = ["set_hash", "n_shingles"]
# Bits of the profile of a large set; beyond about 9,000 elements it rules out less.
MOST_BITS = 4096
# Texts of this many bytes make signatures together.
SIGN_CHARS = 8 << 20


def stored(rows: DataFrame) -> DataFrame:
    """Written as a table in the shared folder and read again: computed once, whatever happens to executors.

    A table is compressed and a checkpoint is not.
    """
    path = scratch_path(rows.sparkSession, "jaccard")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _band_starts(largest: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= largest * 2:
        starts.append(starts[-1] * OF // NEED + 1)
    return np.array(starts)


def _set_id(values: np.ndarray) -> int:
    return int(np.add.reduce(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64).astype(np.int64))


def _set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """48 bits of the hash, then 16 of the logarithm of the size."""
    steps = np.floor(np.log(np.maximum(sizes, 1)) * SIZE_STEPS).astype(np.uint64)
    return ((hashes.astype(np.int64).view(np.uint64) << np.uint64(16)) | steps).view(np.int64)


def _may_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these keys may have sizes that are near enough; never false for those that are."""
    apart = np.abs((x & 0xFFFF) - (y & 0xFFFF))
    return apart <= np.ceil(np.log(OF / NEED) * SIZE_STEPS) + 1


# Sets


def _profile(values: np.ndarray) -> bytes:
    """Parities of the number of elements by hash bucket: a power of two of bits, two to four for an element."""
    bits = 128
    while bits < min(len(values) * 2, MOST_BITS):
        bits *= 2
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(profiles: np.ndarray, width: int) -> np.ndarray:
    """Profiles of fewer bits: the halves of a power of two, added up as parities."""
    while profiles.shape[-1] > width:
        half = profiles.shape[-1] // 2
        profiles = profiles[..., :half] ^ profiles[..., half:]
    return profiles


def _far(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in one set only: each changes one parity."""
    width = min(len(a), len(b))
    x, y = _fold(np.frombuffer(a, np.uint8), width), _fold(np.frombuffer(b, np.uint8), width)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def document_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, set_hash, n_shingles, set_key, profile`` of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [(_set_id(s), len(s), _profile(s)) for s in shingle_sets(batch.column("text").to_pylist())]
            hashes, sizes, profiles = zip(*sets, strict=True) if sets else ((), (), ())
            keys = _set_keys(np.array(hashes, np.int64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(profiles, pa.binary())],
                ["doc_id", "set_hash", "n_shingles", "set_key", "profile"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(build, f"doc_id {kind}, set_hash long, n_shingles long, set_key long, profile binary")


# Signatures


def signatures(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For all given sets, own bands first, then next bands: signatures and the number of their set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes) or not sizes.sum():
        return
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    starts = _band_starts(int(sizes.max()))
    own = np.searchsorted(starts, np.maximum(sizes, 1), side="right") - 1
    places, marks = mix(values + np.uint64(0x632BE59BD9B4E019)), mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F))
    for step in (0, 1):
        band = own + step
        largest = starts[band + 1] - 1
        # Both in the band: sizes up to largest each. One from the band below: at most its own largest.
        partner = largest if step == 0 else starts[band] - 1
        k_parts = 2 * largest * (OF - NEED) // (OF + NEED)
        k = (partner + largest) * (OF - NEED) // (OF + NEED)
        parts = np.ceil((k_parts + 1) * EXCESS).astype(np.int64)
        # Equal sets are one, so sets that can differ in nothing have no partner here.
        active = (k >= 1) & (sizes > 0)
        offsets = np.concatenate(([0], np.cumsum(np.where(active, parts, 0))))
        use = active[of]
        member = of[use]
        part = (places[use] % parts[member].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(offsets[-1], np.uint64)
        filled = np.zeros(offsets[-1], bool)
        np.add.at(sums, offsets[member] + part, marks[use])
        filled[offsets[member] + part] = True
        owner = np.repeat(np.arange(len(sets)), np.where(active, parts, 0))
        number = np.arange(offsets[-1]) - offsets[owner]
        empties = np.bincount(owner[~filled], minlength=len(sets))
        keep = filled | (empties >= parts - k)[owner]
        owner, number, sums = owner[keep], number[keep], sums[keep]
        place = (band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        yield mix(sums + mix(place + np.uint64(1))), owner


def _signature_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``block, sigs, sets``: packed signatures of many documents, dealt out by signature.

    A pack has a row for each block that it has signatures of, so the rows are at most packs times blocks
    and at most signatures. The number of blocks follows the shingles, not the partitions of a session.
    """

    def pack(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        unique: dict[tuple[int, int], np.ndarray] = {}
        for s in sets:
            if len(s):
                unique[(_set_id(s), len(s))] = s
        sets = list(unique.values())
        keys = _set_keys(np.array([x[0] for x in unique], np.int64), np.array([x[1] for x in unique], np.int64))
        for sigs, owner in signatures(sets):
            block, sigs = (sigs % np.uint64(n_blocks)).astype(np.int64), sigs >> np.uint64(8 * (8 - SIG_BYTES))
            order = np.argsort(block, kind="stable")
            block, sigs, owner = block[order], sigs[order], owner[order]
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.array([0])
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([int(block[a]) for a, _ in spans], pa.int64()),
                    "sigs": pa.array([sigs[a:b].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes() for a, b in spans], pa.binary()),
                    "sets": pa.array([keys[owner[a:b]].tobytes() for a, b in spans], pa.binary()),
                }
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (part for whole in batches for part in slices(whole)):
            for s in shingle_sets(batch.column("text").to_pylist()):
                held.append(s)
                size += len(s) * 8
                if size > SIGN_CHARS:
                    yield from pack(held)
                    held, size = [], 0
        yield from pack(held)

    return docs.mapInArrow(build, "block long, sigs binary, sets binary")


def _shared(blocks: DataFrame) -> DataFrame:
    """Keys of pairs of sets in small groups (``sig`` NULL), and of the members of large groups (``b`` NULL)."""
    columns = ["sig", "a", "b"]

    def meet(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        short = np.concatenate([np.frombuffer(x[0], np.uint8) for x in held]).reshape(-1, SIG_BYTES)
        sigs = np.pad(short, ((0, 0), (0, 8 - SIG_BYTES))).view(np.uint64).ravel()
        sets = np.concatenate([np.frombuffer(x[1], np.int64) for x in held])
        order = np.lexsort((sets, sigs))
        sigs, sets = sigs[order], sets[order]
        new = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1])))
        sigs, sets = sigs[new], sets[new]
        begins = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        counts = np.diff(np.append(begins, len(sigs)))
        out = []
        for size in range(2, SMALL_GROUP + 1):
            rows = begins[counts == size]
            if not len(rows):
                continue
            i, j = np.triu_indices(size, 1)
            x, y = sets[(rows[:, None] + i[None, :]).ravel()], sets[(rows[:, None] + j[None, :]).ravel()]
            fits = _may_fit(x, y)
            out.append(np.stack([x[fits], y[fits]]))
        if out:
            pairs = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), *(pa.array(p) for p in pairs)], columns)
        large = np.repeat(counts > SMALL_GROUP, counts)
        if large.any():
            none = pa.nulls(int(large.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sigs[large].view(np.int64)), pa.array(sets[large]), none], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "sigs", "sets")), strict=True):
                if row[0] != block and held:
                    yield from meet(held)
                    held = []
                block = row[0]
                held.append(row[1:])
        if held:
            yield from meet(held)

    dealt = blocks.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "sig long, a long, b long")


# Checks


def _within_bound(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b, n_a, n_b, profile_a, profile_b`` that the bucket counts don't rule out, as ``a, b``."""
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
            profiles = zip(batch.column("profile_a").to_pylist(), batch.column("profile_b").to_pylist(), strict=True)
            keep = [_far(x, y) * (OF + NEED) <= (m + n) * (OF - NEED) for (m, n), (x, y) in zip(sizes, profiles, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "profile_a", "profile_b").mapInArrow(check, f"a {kind}, b {kind}")


@F.pandas_udf(T.BooleanType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether the shingle sets of two texts reach the similarity."""
    out = []
    for a, b in zip(shingle_sets(left), shingle_sets(right), strict=True):
        shared = len(np.intersect1d(a, b, assume_unique=True))
        out.append(shared > 0 and OF * shared >= NEED * (len(a) + len(b) - shared))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of documents that have a text each which are similar."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # The rows that meet in a join are the candidates' texts only.
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(_similar("text_a", "text_b")).select("a", "b").distinct()


def _candidate_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that pairs need. A filter of bounded size passes these and few others, so only they are shuffled."""
    wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    marked = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h1"))
    passed = probe(marked, build_filters(wanted.select(F.xxhash64("doc_id").alias("h1"))))
    return passed.select("doc_id", "text").join(wanted, "doc_id", "left_semi").distinct()


# The operator


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest id that its links reach)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = stored(document_sets(docs))
    known = sets.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    links = similar_links(docs, known)
    chosen = known.groupBy(SET).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # A document with several texts ties their sets together.
    several = known.groupBy("doc_id").agg(F.min(F.struct("set_hash", "n_shingles")).alias("x"), F.max(F.struct("set_hash", "n_shingles")).alias("y"))
    several = several.filter("x <> y").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").join(chosen, SET)
    links = links.unionByName(ties.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    parts = connected_components(links)
    named = chosen.join(parts, chosen["first"] == parts["node"], "left").select(*SET, "copies", F.coalesce("component", "first").alias("component_id"))
    named = stored(named)
    # Rows of frequent sets would meet in one task; such sets are few, whatever the data, and go to the rows.
    tasks = FREQUENT * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = named.filter(F.col("copies") > sets.count() / tasks).select(*SET, "component_id")
    rows = known.select("doc_id", *SET).join(F.broadcast(often), SET, "left")
    rare = rows.filter("component_id is null").drop("component_id").join(named.drop("copies"), SET)
    alone = sets.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    return alone.select(out).unionByName(rows.filter("component_id is not null").select(out)).unionByName(rare.select(out))


def similar_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links that hold together all similar documents, between the first documents of equal sets.

    ``sets`` are the rows of ``document_sets`` with a ``doc_id`` and at least one shingle.
    Within a component not all links are given, but those given reach all its members.
    """
    chosen = sets.groupBy("set_hash", "n_shingles").agg(
        F.min("doc_id").alias("first"), F.min("set_key").alias("set_key"), F.min("profile").alias("profile")
    )
    n_blocks = 1 + (sets.agg(F.sum("n_shingles")).first()[0] or 0) // BLOCK_SHINGLES
    found = stored(_shared(_signature_blocks(docs.filter("doc_id is not null").select("text"), n_blocks)))
    pairs = found.filter("sig is null").select("a", "b").distinct()
    left = chosen.select(F.col("set_key").alias("a"), F.col("n_shingles").alias("n_a"), F.col("first").alias("first_a"), F.col("profile").alias("profile_a"))
    right = chosen.select(F.col("set_key").alias("b"), F.col("n_shingles").alias("n_b"), F.col("first").alias("first_b"), F.col("profile").alias("profile_b"))
    small = pairs.join(left, "a").join(right, "b")
    small = small.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"), "n_a", "n_b", "profile_a", "profile_b")

    members = found.filter("sig is not null").select("sig", F.col("a").alias("set_key"))
    members = stored(members.join(chosen.select("set_key", "first"), "set_key").select("sig", "first"))
    often = members.groupBy("first").agg(F.count(F.lit(1)).alias("groups"))
    leaders = members.join(often, "first").groupBy("sig").agg(F.min_by("first", F.struct(-F.col("groups"), F.col("first"))).alias("lead"))
    # One leader leads many groups, so the pairs are far fewer than the members.
    stars = members.join(leaders, "sig").filter("first <> lead").select(F.col("lead").alias("a"), F.col("first").alias("b")).distinct()
    near = stored(_within_bound(small.unionByName(_with_profiles(stars, chosen))).filter("a <> b").distinct())
    links = stored(_verified(near, _candidate_texts(docs, near)))
    if members.isEmpty():
        return links

    # Members of large groups outside the main component of their group, against the whole group.
    parts = connected_components(links)
    named = members.join(parts, members["first"] == parts["node"], "left")
    named = stored(named.select("sig", "first", F.coalesce("component", "first").alias("part")))
    sizes = named.groupBy("sig", "part").count()
    main = sizes.groupBy("sig").agg(F.max(F.struct("count", "part")).alias("main")).select("sig", F.col("main.part").alias("main"))
    outside = stored(named.join(main, "sig").filter("part <> main").drop("main"))
    profiles = chosen.select("first", "n_shingles", "profile")
    rest = _cross(named.join(profiles, "first"), outside.join(profiles, "first"), named, outside).distinct()
    rest = stored(rest.join(near, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(rest, _candidate_texts(docs, rest)))


def _with_profiles(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of documents with size and profile of their sets."""
    left = chosen.select(F.col("first").alias("a"), F.col("n_shingles").alias("n_a"), F.col("profile").alias("profile_a"))
    right = chosen.select(F.col("first").alias("b"), F.col("n_shingles").alias("n_b"), F.col("profile").alias("profile_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "profile_a", "profile_b")


def _cross(members: DataFrame, outside: DataFrame, all_members: DataFrame, all_outside: DataFrame) -> DataFrame:
    """Pairs of a member and one outside, of one signature and different components, that the bound leaves; ``a < b``.

    Those outside are dealt into lots of about ``BLOCK``, the members into as many salts as
    they have blocks. A lot and a salt meet in a task: the lot is held, the members stream by.
    The numbers of lots and salts are counted without profiles.
    """
    kind = members.schema["first"].dataType.simpleString()
    member = ["sig", "first", "n_shingles", "profile", "part"]
    lots = all_outside.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("lots"))
    salts = all_members.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / (BLOCK * 16)).cast("long").alias("salts"))
    grid = lots.join(salts, "sig")
    mine = F.pmod(F.xxhash64("first"), F.col("lots")), F.pmod(F.xxhash64("first"), F.col("salts"))
    held = outside.join(grid, "sig").select(*member, mine[0].alias("lot"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    passing = members.join(grid, "sig").select(*member, F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), mine[1].alias("salt"), F.lit(1).alias("side"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lot = None, []
        for batch in batches:
            a, b = [], []
            chunk = []
            columns = [batch.column(c).to_pylist() for c in ("sig", "lot", "salt", "side", "first", "n_shingles", "profile", "part")]
            for sig, number, salt, side, *one in zip(*columns, strict=True):
                if (sig, number, salt) != key or len(chunk) >= 64:
                    _near_pairs(lot, chunk, a, b)
                    chunk = []
                if (sig, number, salt) != key:
                    key, lot = (sig, number, salt), []
                (chunk if side else lot).append(one)
            _near_pairs(lot, chunk, a, b)
            kind = batch.schema.field("first").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    dealt = held.unionByName(passing).repartition("sig", "lot", "salt").sortWithinPartitions("sig", "lot", "salt", "side")
    return dealt.mapInArrow(meet, f"a {kind}, b {kind}")


def _near_pairs(lot: list, chunk: list, a: list, b: list) -> None:
    """Add the pairs of two lists of ``(id, size, profile, component)`` that the bound leaves."""
    for width in sorted({len(x[2]) for x in lot}):
        left = [x for x in lot if len(x[2]) == width]
        profiles = np.array([np.frombuffer(x[2], np.uint8) for x in left])
        sizes = np.array([x[1] for x in left], np.int64)
        for first, n, profile, part in chunk:
            fits = np.minimum(sizes, n) * OF >= np.maximum(sizes, n) * NEED
            fits &= np.array([x[3] != part for x in left])
            if not fits.any():
                continue
            common = min(width, len(profile))
            apart = _fold(profiles[fits], common) ^ _fold(np.frombuffer(profile, np.uint8), common)
            near = np.bitwise_count(apart).sum(1, dtype=np.int64) * (OF + NEED) <= (sizes[fits] + n) * (OF - NEED)
            for i in np.flatnonzero(fits)[near]:
                a.append(min(first, left[i][0]))
                b.append(max(first, left[i][0]))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, and all without an id."""
    gone = similar_components(docs, doc_id, text).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[doc_id] == gone["gone_id"], "left_anti")
