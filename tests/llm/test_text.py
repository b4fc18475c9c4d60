"""BPE, token counts, toxicity, secrets and decontamination against libraries, brute force and held-out rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import bpe, decontaminate, secret_scan, token_counts, toxicity
from broadsheet.llm.queries import CATALOGUE
from tests.llm.conftest import ROWS

# BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    loaded = tokenizers.Tokenizer.from_file(bpe.default_path())
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


def expected_tokens(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_query(spark, sf, documents, library):
    assert sorted((tuple(r) for r in CATALOGUE["op2_bpe"](spark, sf).collect()), key=repr) == expected_tokens(library, documents)


def test_bpe_awkward(awkward, nothing, library):
    assert sorted((tuple(r) for r in bpe.round_trip(awkward).collect()), key=repr) == expected_tokens(library, ROWS)
    assert bpe.round_trip(nothing).collect() == []


def test_bpe_random_texts(library):
    rng = random.Random(3)
    parts = ["'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "a", "the", "XX", "1", "23", "é", "漢字", "😀", "<|endoftext|>", "<|endof", "|>", "!!", "́", "​", "\x00", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choice("aabbcdeth inersou") for _ in range(rng.randrange(60))) for _ in range(3000)]
    own = bpe.Bpe(bpe.default_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in own.encode(texts)] == texts


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    own = bpe.Bpe(bpe.default_path())
    for i in range(20):
        assert own.decode(own.encode([f"word{i} other{i} " + "x" * 100])[0]) == f"word{i} other{i} " + "x" * 100
    assert len(own.kept) <= 5 + 10


# Token counts


def greedy(word, vocabulary):
    n = i = 0
    while i < len(word):
        j = min(len(word), i + 80)
        while word[i:j] not in vocabulary:
            j -= 1
        n, i = n + 1, j
    return n


def plain_counts(rows, vocabulary):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        out.append((i, len(words), sum(greedy(b" " + w.encode(), vocabulary) for w in words)))
    return sorted(out, key=repr)


def test_token_counts(spark, sf, documents, awkward, nothing):
    vocabulary = set(token_counts.pieces_of(bpe.default_path()))
    assert sorted((tuple(r) for r in CATALOGUE["op3_token_counts"](spark, sf).collect()), key=repr) == plain_counts(documents, vocabulary)
    assert sorted((tuple(r) for r in token_counts.token_counts(awkward).collect()), key=repr) == plain_counts(ROWS, vocabulary)
    assert token_counts.token_counts(nothing).collect() == []


def test_automaton_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(40):
        vocabulary = {bytes([i]) for i in range(256)} | {bytes(rng.choice(b" abc") for _ in range(rng.randrange(1, 7))) for _ in range(25)}
        automaton = token_counts.Automaton(sorted(vocabulary))
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 20))) for _ in range(20)] + [b"ab" * 300]
        assert [automaton.count_one(b" " + w) for w in words] == [greedy(b" " + w, vocabulary) for w in words]
        text = b" ".join(words).decode()
        assert token_counts.count_texts(automaton, [text])[1] == [sum(greedy(b" " + w, vocabulary) for w in words)]
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


# Decontamination


def edit_distance_within(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def plain_matches(docs, items, rate=decontaminate.ERROR_RATE):
    found = {}
    for i, text in docs:
        norm = decontaminate.normalised(text)
        for key, item in items:
            item = decontaminate.normalised(item)
            if item and norm:
                d = edit_distance_within(item, norm)
                if d <= int(len(item) * rate):
                    found[(i, key)] = min(d, found.get((i, key), d))
    return sorted(((*k, d) for k, d in found.items()), key=repr)


def test_decontamination_against_brute_force(spark, nothing):
    rng = random.Random(8)
    items = [(n, " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(12))) for n in range(6)]
    items += [(6, items[0][1]), (7, ""), (8, None), (9, "   ")]
    docs = []
    for n in range(40):
        body = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(30))
        text = list(items[n % 6][1])
        for _ in range(n % 9):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
        docs.append((n, body[:60] + " " + "".join(text).upper().replace(" ", "\n ") + " " + body[60:]))
    docs += [(100, None), (101, ""), (None, items[2][1]), (3, "nothing here")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", F.lit("x"))
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contaminated(table, marks).collect()), key=repr)
    assert got == plain_matches(docs, items)
    kept = decontaminate.drop_contaminated(table, marks)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {r[0] for r in got}
    assert decontaminate.contaminated(nothing, marks).collect() == [] and decontaminate.contaminated(table, marks.limit(0)).collect() == []


def test_decontamination_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROUND_CHARS", 30)
    items = [(n, f"an item with the number {n} in it") for n in range(9)]
    docs = spark.createDataFrame([(n, f"before an item with the number {n} in it after") for n in range(9)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["distance"] == 0} == {(n, n) for n in range(9)}


def test_decontamination_query(spark, sf, documents):
    items = [(r["item_id"], decontaminate.normalised(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in CATALOGUE["op10_decontaminate"](spark, sf).collect()}
    whole = {(i, key) for i, text in documents for key, item in items if item in decontaminate.normalised(text)}
    assert whole and whole <= got
    texts, marks = dict(documents), dict(items)
    for i, key in got - whole:
        assert edit_distance_within(marks[key], decontaminate.normalised(texts[i])) <= int(len(marks[key]) * decontaminate.ERROR_RATE)


# Toxicity


def toxic_table(n=240):
    rng = random.Random(4)
    calm = ["the", "river", "house", "walks", "green", "paper", "stone", "under", "table", "seven", "light", "music"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "SCUM!!", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_table()
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, "idiot"), (3, rows[3][1])], "doc_id long, text string").withColumn("label", F.lit(1))
    marks = spark.createDataFrame(labels + [(None, 1), (5000, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 0


def test_toxicity_without_labels(spark, nothing):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score(nothing, none).collect() == []
    assert toxicity.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).first()["score"] == 1.0


def test_toxicity_query(spark, sf, documents):
    got = CATALOGUE["op8_toxicity"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in documents)


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 47, 48, 56, 57, 200]:
        rows, mask, of = toxicity._windows([np.arange(1, n + 1, dtype=np.int32)])
        assert set(rows[mask].tolist()) == set(range(1, n + 1)) and len(of) == len(rows) >= 1


def test_gradients():
    """Numeric differences on a tiny batch."""
    words = toxicity.words_of(["alpha beta gamma delta", "beta beta epsilon"])
    model = toxicity.Model(words.hashes[1:4].copy(), np.zeros(4, np.float32))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, mask, _ = toxicity._windows(words.texts)
    labels = np.array([1.0, 0.0])
    weight = np.where(labels == 1, toxicity.TOXIC_WEIGHT, 1)

    def loss():
        logits = model.run(model.gates(model.inputs(words)), rows, mask)[0].astype(np.float64)
        return float((weight * (np.logaddexp(0, logits) - labels * logits)).mean())

    grad = model.gradients(words, rows, mask, labels)
    rng = np.random.default_rng(0)
    for name in ("out", "att", "Wf", "Wb", "Uf", "Ub", "bf", "word"):
        flat = model.p[name].reshape(-1)
        for at in rng.choice(len(flat), 3):
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-2 - grad[name].reshape(-1)[at]) < 2e-3, name


def test_fast_scores_agree_with_training_pass():
    words = toxicity.words_of(["one two three " * 30, "four", ""])
    model = toxicity.Model(words.hashes[1:3].copy(), np.zeros(3, np.float32))
    rows, mask, _ = toxicity._windows(words.texts)
    slow = model.run(model.gates(model.inputs(words)), rows, mask)[0]
    assert np.allclose(slow, toxicity._logits(model.fast(model.inputs(words)), rows, mask), atol=1e-4)


# Secrets


def test_secret_scan(spark, nothing):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        words = [rng.choice(["the", "and", "internationalization", "1234567890123456", "stone"]) for _ in range(30)]
        if i % 4 == 0:
            words.insert(9, 'token = "%040x"' % rng.getrandbits(160))
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (0, rows[0][1]), (None, rows[4][1]), (902, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = secret_scan.scan(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted([*(str(i) for i in range(0, 200, 4)), "0", "None"])
    assert all(re.fullmatch("[0-9a-f]{40}", r["secret"]) for r in got)
    assert secret_scan.scan(nothing).collect() == []


def test_secret_scan_learns_from_given_findings(spark):
    base = [("%032x" % (i * 7919 + 2**120), "key: ", "", 1.0) for i in range(40)] + [(f"plainlongword{'abcdefgh'[i % 8] * 4}", "the ", " ", 0.0) for i in range(40)]
    labelled = spark.createDataFrame(base, "candidate string, before string, after string, label double")
    docs = spark.createDataFrame([(1, "key: " + "%032x" % (99991 + 2**121)), (2, "the plainlongworddddd ")], "doc_id long, text string")
    assert [r["doc_id"] for r in secret_scan.scan(docs, labelled).collect()] == [1]


def test_candidates_keep_their_context(spark):
    docs = spark.createDataFrame([(1, "a=bbbbbbbbbbbbbbbbbbbb c /dddddddddddddddddd. eeeeeeeeeeeeeeeee")], "doc_id long, text string")
    got = [tuple(r) for r in secret_scan.candidates(docs).orderBy("place").collect()]
    assert [(r[1], r[2]) for r in got] == [(0, "a=bbbbbbbbbbbbbbbbbbbb"), (1, "/dddddddddddddddddd"), (2, "eeeeeeeeeeeeeeeee")]
    assert got[1][3:] == (" c ", ". ")


@pytest.mark.parametrize(
    "text, secrets",
    [
        ("password = 'hunter2!x'", ["hunter2!x"]),
        ("API_TOKEN=9f8e7d6c5b4a39281706f5e4d3c2b1a0\nX=1", ["9f8e7d6c5b4a39281706f5e4d3c2b1a0"]),
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG+bPxRfiCY==", ["AWS_SECRET_ACCESS_KEY", "wJalrXUtnFEMI/K7MDENG+bPxRfiCY=="]),
        ('{"api-key": "a.b!c@d#e$f g"}, passwd: x7$k.', ["a.b!c@d#e$f g"]),
        ("DB_PASSWORD=p.a!s@s#1$, http://h/?token=abc123&page=2", ["p.a!s@s#1$", "abc123"]),
        ("Authorization: Bearer ab.cd-ef1", ["ab.cd-ef1"]),
        ("name=0123456789abcdef0 the password is unknown, see `token: no`", ["0123456789abcdef0"]),
    ],
)
def test_candidates_end_at_assignments(spark, text, secrets):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = secret_scan.with_features(secret_scan.candidates(docs), []).orderBy("place").collect()
    assert [r["candidate"] for r in rows] == secrets
    if "name=" not in text and "Bearer" not in text:
        assert rows[-1]["key_word"] and rows[-1]["assigned"]


def test_short_and_unquoted_secrets_are_found(spark):
    rng, rows, planted = random.Random(7), [], {}
    for i in range(300):
        words = [rng.choice(["the", "and", "internationalization", "1234567890123456", "stone"]) for _ in range(30)]
        if i % 3 == 0:
            planted[i] = "".join(rng.choice("abcdXYZ0123456789") for _ in range(5)) + rng.choice(".!@#$") + "".join(rng.choice("abcdXYZ0123456789") for _ in range(4))
            words.insert(9, f"password = '{planted[i]}'")
        if i % 3 == 1:
            planted[i] = "%032x" % rng.getrandbits(128)
            words.insert(9, f"API_TOKEN={planted[i]}")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["secret"] for r in secret_scan.scan(docs).collect()} == planted
