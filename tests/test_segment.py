"""Segmentation against a plain loop over characters."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.chars import CHARACTER_CLASSES, class_table
from broadsheet.operators import boundaries as B
from broadsheet.operators import segment as G

TEXTS = ["", "東", "東京", "私の名前は中野です。", "ABC123、「東京都」一二三", "あいあいあいカタカナ", "B1E2B1", "１２ａｂé😀ー々"]


def class_of(char):
    return next((name for name, pattern in CHARACTER_CLASSES if re.match(pattern, char)), "O")


def plain_segment(text, table):
    if not text:
        return []
    w = ["B3", "B2", "B1", *text, "E1", "E2", "E3"]
    c = ["O"] * 3 + [class_of(x) for x in text] + ["O"] * 3
    word, tokens, past = text[0], [], "UUU"
    for i in range(4, len(w) - 3):
        items = {f"w{k}": w[i - 4 + k] for k in range(1, 7)} | {f"c{k}": c[i - 4 + k] for k in range(1, 7)}
        items |= {f"p{k}": past[k - 1] for k in (1, 2, 3)}
        features = [*G.CHARACTER_FEATURES.items(), *G.CLASS_FEATURES.items(), *G.HISTORY_FEATURES]
        score = table.get((G.BIAS, ""), 0) + sum(
            table.get((f, "".join(items[x] for x in names.split())), 0) for f, names in features
        )
        if score > 0:
            tokens.append(word)
            word = ""
        past = past[1:] + ("B" if score > 0 else "O")
        word += w[i]
    return [*tokens, word]


def random_weights(seed):
    """Weights for keys that occur in the texts, edges and history included."""
    rng = random.Random(seed)
    table = {(G.BIAS, ""): rng.randint(-200, 100)}
    for text in TEXTS:
        w = ["B3", "B2", "B1", *text, "E1", "E2", "E3"]
        c = ["O"] * 3 + [class_of(x) for x in text] + ["O"] * 3
        for i in range(4, len(w) - 3):
            items = {f"w{k}": w[i - 4 + k] for k in range(1, 7)} | {f"c{k}": c[i - 4 + k] for k in range(1, 7)}
            for past in ("UUU", "UUB", "OBO", "BBB", "OOB"):
                items |= {f"p{k}": past[k - 1] for k in (1, 2, 3)}
                for f, names in [*G.CHARACTER_FEATURES.items(), *G.CLASS_FEATURES.items(), *G.HISTORY_FEATURES]:
                    if rng.random() < 0.5:
                        table[f, "".join(items[x] for x in names.split())] = rng.randint(-300, 300)
    return table


@pytest.mark.parametrize("seed, max_broadcast_rows", [(1, 1_000_000), (2, 1_000_000), (3, 0)])
def test_equals_the_plain_loop(spark, seed, max_broadcast_rows):
    table = random_weights(seed)
    weights = spark.createDataFrame([(f, k, v) for (f, k), v in table.items()], "feature string, key string, weight int")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in G.segment(docs, weights, max_broadcast_rows=max_broadcast_rows).collect()}
    assert got == {i: plain_segment(t, table) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("block, max_broadcast_rows", [(3, 1_000_000), (4, 0)])
def test_blocks_equal_the_plain_loop(spark, monkeypatch, block, max_broadcast_rows):
    monkeypatch.setattr(B, "BLOCK", block)
    table = random_weights(block)
    weights = spark.createDataFrame([(f, k, v) for (f, k), v in table.items()], "feature string, key string, weight int")
    rows = [*enumerate(TEXTS), (5, TEXTS[4]), (5, TEXTS[4]), (None, TEXTS[5]), (90, "".join(TEXTS) * 5), (91, None), (92, "😀" * 7)]
    got = G.segment(spark.createDataFrame(rows, "doc_id long, text string"), weights, max_broadcast_rows=max_broadcast_rows).collect()
    want = [(i, None if t is None else plain_segment(t, table)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_long_text_goes_to_many_tasks(spark):
    """A text of many blocks whose decisions hang together: its blocks are cut in several tasks, and none of it is lost."""
    table = random_weights(7)
    weights = spark.createDataFrame([(f, k, v) for (f, k), v in table.items()], "feature string, key string, weight int")
    rng = random.Random(7)
    text = "".join(rng.choice("".join(TEXTS)) for _ in range(200_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shared = spark.sparkContext.broadcast(G._model_arrays(weights, 10**6))
    scored = B.score_blocks(B.text_blocks(docs, "doc_id", "text"), shared)
    places = B.block_tokens(scored).select("block", F.spark_partition_id().alias("p")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(places) == -(-200_000 // B.BLOCK) and len({r.p for r in places}) > 1
    assert G.segment(docs, weights).first().tokens == plain_segment(text, table)


def test_maps_of_states_compose():
    rng = random.Random(4)
    masks = [rng.choice([0, 32767, rng.randrange(32768)]) for _ in range(300)]
    for cut in (0, 1, 7, 150, 300):
        assert B.compose(B.map_of(masks[:cut]), B.map_of(masks[cut:])) == B.map_of(masks)
    assert B.map_of(masks) == [B.run_states(masks, s)[1] for s in range(15)]


def test_class_table_equals_the_patterns():
    table = class_table()
    assert len(table) == 65536
    for code in [*range(0x250), *range(0x3000, 0x3100), *range(0x4E00, 0x4F00), *range(0x9F00, 0xA000), *range(0xFE00, 0x10000), 0xD800]:
        assert "MHIKANO"[table[code]] == class_of(chr(code))


def test_learns_word_boundaries(spark):
    corpus = spark.createDataFrame([(1, "東京 の 空 東京 の 海"), (2, "海 の 空")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "東京の海")], "doc_id long, text string")
    assert G.segment(docs, G.fit_segment_weights(corpus)).first().tokens == ["東京", "の", "海"]


def test_features_name_edges(spark):
    docs = spark.createDataFrame([(1, "東京")], "doc_id long, text string")
    got = {(r.feature, r.feature_key) for r in G.segment_features(docs).collect()}
    assert {("UW1", "B2"), ("BW1", "B1東"), ("TW1", "B2B1東"), ("UW6", "E2"), ("TW4", "京E1E2"), ("TC2", "OHH")} <= got
    assert len(got) == 26


def plain_gaps(text):
    """The windows of a text: place, characters and classes."""
    w, c = ["B3", "B2", "B1", *text, "E1", "E2", "E3"], ["O"] * 3 + [class_of(x) for x in text] + ["O"] * 3
    for i in range(4, len(w) - 3):
        yield i - 3, {f"w{k}": w[i - 4 + k] for k in range(1, 7)} | {f"c{k}": c[i - 4 + k] for k in range(1, 7)}


def plain_features(text):
    for pos, items in plain_gaps(text):
        for f, names in [*G.CHARACTER_FEATURES.items(), *G.CLASS_FEATURES.items()]:
            yield pos, f, "".join(items[x] for x in names.split()), "".join(items[f"c{k}"] for k in range(1, 5))


def test_feature_counts_equal_the_plain_loop(spark):
    rows = [*enumerate(TEXTS), (5, TEXTS[4]), (None, "東 京"), (9, None)]
    got = G.segment_feature_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((f, k) for _, t in rows if t for _, f, k, _ in plain_features(t))
    assert len(got) == len(want) and {(r.feature, r.feature_key): r.n for r in got} == want


def test_alphabets_of_any_size_count_alike(monkeypatch):
    texts = [" ".join(TEXTS), "東  京", "😀 a", "", " "]
    one = [list(map(list, x[1:])) for x in B._counted(texts, B.np.frombuffer(class_table(), B.np.uint8))]
    monkeypatch.setattr(B, "MAX_ALPHABET", 0)
    assert one == [list(map(list, x[1:])) for x in B._counted(texts, B.np.frombuffer(class_table(), B.np.uint8))]


@pytest.mark.parametrize("dense, batch", [(128, 400_000), (0, 400_000), (128, 3)])
def test_static_scores_need_no_shuffle(spark, monkeypatch, dense, batch):
    """Scores are made where a text is read, in pieces; a key may be missing."""
    monkeypatch.setattr(B, "MAX_DENSE", dense)
    monkeypatch.setattr(B, "BATCH_CHARS", batch)
    table = random_weights(11)
    weights = spark.createDataFrame([(f, k, v) for (f, k), v in table.items()], "feature string, key string, weight int")
    rows = [*enumerate(TEXTS), (50, "".join(TEXTS)), (51, None), (None, TEXTS[3])]
    got = G.segment_static_scores(spark.createDataFrame(rows, "doc_id long, text string"), weights)
    assert not re.search(r"\b(Window|Exchange)\b", got._jdf.queryExecution().toString())
    want = []
    for key, text in rows:
        scores: dict = {}
        for pos, f, k, c4 in plain_features(text or ""):
            scores[pos, c4] = scores.get((pos, c4), table[G.BIAS, ""]) + table.get((f, k), 0)
        want += [(key, pos, score, c4) for (pos, c4), score in scores.items()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_boundaries_equal_the_states():
    rng = random.Random(6)
    for size in (0, 1, 2, 3, 4, 200):
        masks = [rng.choice([0, 32767, rng.randrange(32768), 127, 32640]) for _ in range(size)]
        for state in range(15):
            assert B.boundaries(B.np.array(masks, B.np.uint16), state) == B.run_states(masks, state)[0]


def test_short_texts_are_derived_once(spark):
    """The texts come from an expression, which neither a filter before the task nor the task repeats."""
    docs = spark.createDataFrame([(1, "東京")], "doc_id long, text string").select("doc_id", F.regexp_replace("text", "x+", "y").alias("text"))
    weights = spark.createDataFrame([(G.BIAS, "", -1)], "feature string, key string, weight int")
    short = B.segment_short(docs, spark.sparkContext.broadcast(G._model_arrays(weights, 10)), "doc_id", "text", F.length("text") > 9)
    assert "Filter" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_class_counts_equal_the_patterns(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, TEXTS[3]), (None, "a1"), (70, None)], "doc_id long, text string")
    got = B.class_counts(docs, "doc_id", "text")
    assert "Generate" not in got._jdf.queryExecution().toString()
    want: dict = {}
    for key, text in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a1")]:
        for c in text or " ":
            want[key, class_of(c)] = want.get((key, class_of(c)), 0) + 1
    assert {(r.doc_id, r["class"]): r.n for r in got.collect()} == want
