"""Exact dedup, line dedup and the Jaccard join against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, jaccard_join, line_dedup
from broadsheet.llm.components import connected_components
from broadsheet.llm.queries import CATALOGUE
from tests.llm.conftest import ROWS

SPACE = "[\x20\x09-\x0d]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_verdicts(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), i is None, i))
    out = []
    for i, text in rows:
        norm = re.sub(SPACE, "", text or "")
        best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, best, len(groups[norm]), i == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashed", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)], ids=["md5", "colliding"])
def test_exact_dedup(awkward, hashed):
    got = sorted((tuple(r) for r in exact_dedup.verdicts(awkward, content_hash=hashed).collect()), key=repr)
    assert got == plain_verdicts(ROWS)
    kept = exact_dedup.drop_copies(awkward, content_hash=hashed)
    assert kept.columns == awkward.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for i, t in ROWS if (i, True) in {(v[0], v[3]) for v in plain_verdicts(ROWS)}} - {""} - {"x"}) or kept.count() == len({re.sub(SPACE, "", t or "") for _, t in ROWS})


def test_exact_dedup_empty(nothing):
    assert exact_dedup.verdicts(nothing).collect() == []
    assert exact_dedup.drop_copies(nothing).columns == nothing.columns


def plain_lines(rows, min_docs=3, min_chars=20):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip("\t\n\x0b\x0c\r ").translate(LOWER)].add(i)
    out = []
    for i, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            key = line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
            largest = max((x for x in holders[key] if x is not None), default=None)
            if len(key) < min_chars or len(holders[key]) < min_docs or i == largest:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = [
    (1, "a line of more than twenty letters\nown one"),
    (2, "  A LINE of more than twenty letters \r\nown two\n"),
    (3, "x\na line of more than twenty letters\na line of more than twenty letters"),
    (3, "x\na line of more than twenty letters\na line of more than twenty letters"),
    (None, "a line of more than twenty letters"),
    (4, "in two documents only, so it stays\n\n"),
    (5, "in two documents only, so it stays"),
    (6, None),
    (7, ""),
]


def test_line_dedup(spark, awkward):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("gone", F.lit("x"))
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(docs).collect()), key=repr) == plain_lines(LINES)
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(awkward).collect()), key=repr) == plain_lines(ROWS)


def test_line_dedup_empty(nothing):
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_line_references_are_reversible(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    before = line_dedup.line_references(docs.filter("doc_id < 3"))
    after = line_dedup.insert(before, docs.filter("doc_id >= 3"))
    assert line_dedup.counts(after).filter("n_docs >= 3").count() == 1
    back = line_dedup.remove(after, docs.filter("doc_id >= 3").select("doc_id"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, before.collect()))


def test_cuckoo_filter_takes_insertions_and_deletions(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 3000)
    one = line_dedup.CuckooFilter()
    one.insert(keys)
    assert one.may_hold(keys).all() and not one.full
    one.delete(keys[:1500])
    assert one.may_hold(keys[1500:]).all() and one.may_hold(keys[:1500]).mean() < 0.01
    table = spark.createDataFrame([(int(k),) for k in keys[:400]], "h1 long")
    filters = line_dedup.update_filters(line_dedup.build_filters(table), table.limit(0), table.filter("h1 > 0"))
    left = {r["h1"] for r in line_dedup.probe(table, filters).collect()}
    assert left >= {int(k) for k in keys[:400] if k <= 0} and len(left) < 300


def test_full_filter_lets_all_pass():
    one = line_dedup.CuckooFilter(full=True)
    assert one.may_hold(np.arange(5)).all()


# The Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b) and root(i) != root(j):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def test_jaccard_awkward(awkward, nothing):
    assert sorted((tuple(r) for r in jaccard_join.similar_components(awkward).collect()), key=repr) == plain_components(ROWS)
    assert jaccard_join.similar_components(nothing).collect() == []
    kept = jaccard_join.drop_similar(awkward)
    assert kept.columns == awkward.columns


def near_copies():
    """Clusters of texts a few words apart, with passages that many share, sizes on both sides of the bound."""
    rng, rows, number = np.random.default_rng(5), [], 0
    passage = [f"shared{i}" for i in range(60)]
    for cluster in range(12):
        base = [f"w{cluster}x{i}" for i in range(int(rng.integers(6, 120)))]
        if cluster % 2:
            base = base[:20] + passage + base[20:]
        for _ in range(9):
            words = list(base)
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(len(words)))] = f"edit{rng.integers(1000)}"
            rows.append((number, " ".join(words)))
            number += 1
    return rows


@pytest.mark.parametrize("small", [24, 2])
def test_jaccard_against_brute_force(spark, monkeypatch, small):
    """Also with nearly every group taken for a large one, in lots of three."""
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3 if small == 2 else 256)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.similar_components(docs).collect()), key=repr) == plain_components(rows)


def test_jaccard_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join.similar_components(docs).collect()), key=repr) == plain_components(rows)


def test_packed_rows_do_not_grow_with_partitions(spark, monkeypatch):
    """The same texts make as many rows of packed signatures, however many shuffle partitions a session has."""

    class Counted(Exception):
        pass

    def count(blocks):
        raise Counted(blocks.count())

    monkeypatch.setattr(jaccard_join, "_shared", count)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            with pytest.raises(Counted) as found:
                jaccard_join.similar_links(docs, jaccard_join.document_sets(docs))
            made += found.value.args
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] > 0


def test_jaccard_query(spark, sf, documents):
    assert sorted((tuple(r) for r in CATALOGUE["op1_jaccard_join"](spark, sf).collect()), key=repr) == plain_components(documents)


def test_signatures_meet_for_every_similar_pair():
    """Sets within the bound share a signature, for sizes across bands."""
    rng = np.random.default_rng(3)
    for size in [4, 5, 6, 9, 17, 40, 200, 1500]:
        for _ in range(20):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            shared = int(rng.integers(int(np.ceil(size * 0.8)), size + 1))
            extra = int(rng.integers(0, max(1, int(shared / 0.8 - size)) + 1))
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, extra, dtype=np.uint64)])
            if 100 * shared < 80 * (size + extra) or (shared == size and extra == 0):
                continue
            found = [set(), set()]
            for sigs, owner in jaccard_join.signatures([np.unique(a), np.unique(b)]):
                for s, o in zip(sigs.tolist(), owner.tolist(), strict=True):
                    found[o].add(s)
            assert found[0] & found[1], (size, shared, extra)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (5, None), (30, 3), (30, 30)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(links.limit(0)).collect() == []
