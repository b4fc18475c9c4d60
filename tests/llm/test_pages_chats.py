"""Page extraction, chat formatting and the pipeline against plain Python."""

import hashlib
import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import chat_format, main_text
from broadsheet.llm.queries import CATALOGUE
from tests.llm.conftest import ROWS
from tests.llm.test_dedup import shingles

# Pages


def plain_text(page):
    body = page.split("<article>")[1].split("</article>")[0]
    body = re.sub(r"<[^>]*>|<[a-z/]*$", " ", re.sub(r"</?b>", "", body))
    return " ".join(html.unescape(body).split())


def test_pages_query(spark, sf):
    got = {r["page_id"]: r for r in CATALOGUE["op4_main_text"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert {p["page_id"]: plain_text(p["html"]) for p in pages} == {i: r["text"] for i, r in got.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


FRAME = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav>Menu <a>one</a></nav>"
    '<div id="cookie-notice">We use cookies</div>%s<aside>side</aside><form>Name <input></form><div class="comments"><p>first!</p></div>'
    '<script>var a = "</p>";</script><footer>&copy; x</footer></body></html>'
)


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><header><h1>A  &amp;\n B</h1></header><p>one <b>t</b>wo<br>three<p>four&nbsp;five</article>", "A & B one two three four five"),
        ("<main><div><p>x</p><div class='ad'>buy<div>now</div></div><p>y</p></div></main>", "x y"),
        ("<ARTICLE><P>&lt;b&gt; &#65;&#x42; &am</P><!-- <p>no</p> --></ARTICLE>", "<b> AB &am"),
        ("<article><p>cut off <a href='", "cut off"),
        ("<p>no container</p>", "no container"),
        ("", ""),
    ],
)
def test_text_of(body, text):
    page = FRAME % body if "cut off" not in body else body
    assert main_text.text_of(page, None) == text


@pytest.mark.parametrize(
    "page, text",
    [
        *[(f"<nav>m</nav><div class='{c}'><article><p>body</p></article></div>", "body") for c in ("content has-sidebar", "no-comments", "search-result", "page-header-fixed", "sidebar", "header")],
        ("<div class='content has-sidebar'><p>body</p></div><div class='widget sidebar'>side</div><div id='cookie_notice'>c</div><div class='main-nav'>m</div>", "body"),
        ("<form id='aspnetForm'><nav>m</nav><div><h1>T</h1><p>body</p></div></form><form>Name <p>mail</p></form>", "T body"),
        ("<form><main><p>body</p></main></form>", "body"),
        ("<div class='banner'><div>b</div><article>one<div class='ad'><div>x</div>buy</div>two</article>c</div><p>rest</p>", "one two"),
        # Comments and teasers are articles too.
        ("<article>body<aside><article>teaser</article></aside>end</article><div class='comments'><article>first!</article></div>", "body end"),
        ("<main><p>the longer body</p></main><aside><article>teaser</article></aside>", "the longer body"),
        ("<aside><article>teaser</aside><article>body</article>", "body"),
    ],
)
def test_articles_inside_elements_to_drop(page, text):
    assert main_text.text_of(f"<html><body class='sidebar'>{page}</body></html>", None) == text


def test_differencing_deletes_what_neighbours_share(spark):
    """Without an article element only the comparison with the nearest page tells what the site repeats."""
    rows = [(i, f"http://h.example/a/{i:03d}?q={i}", f"<div>Welcome</div><div>text {i}</div><p>more {i}</p><div>Imprint</div>") for i in range(40)]
    rows += [(100, "http://h.example/b", "<div>alone here</div>"), (101, None, "<p>no url</p>"), (102, "http://other.example/", None), (103, "odd", "")]
    rows += [(200 + i, f"http://copy.example/{i}", "<div>same</div><div>words</div>") for i in range(3)] + rows[:1]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("path", F.lit(1)).repartition(5)
    got = sorted((r["page_id"], r["text"]) for r in main_text.extract(pages).collect())
    want = [(i, f"text {i} more {i}") for i in range(40)] + [(0, "text 0 more 0"), (100, "alone here"), (101, "no url"), (102, ""), (103, "")]
    assert got == sorted(want + [(200 + i, "same words") for i in range(3)])


def test_neighbours_are_the_nearest_paths(spark):
    rng, rows = random.Random(4), []
    for host in ("a", "b", "c"):
        for path in {"".join(rng.choice("xyz/") for _ in range(rng.randrange(1, 6))) for _ in range(60 if host == "a" else 2)}:
            rows.append((f"http://{host}.example/{path}", f"<p>{host}/{path}</p>"))
    pages = spark.createDataFrame(rows, "url string, html string").repartition(7)
    got = {(r["host"], r["path"]): r["nearest"] for r in main_text.neighbours(pages).collect()}
    assert len(got) == len(rows)
    for host in ("a.example", "b.example", "c.example"):
        paths = sorted(p for h, p in got if h == host)
        for i, path in enumerate(paths):
            sides = [paths[j] for j in (i - 1, i + 1) if 0 <= j < len(paths)]
            hashes = [main_text.block_hashes([(f"{host[0]}{p}", 1)]) for p in sides]
            assert got[host, path] in hashes or not sides
            common = [next((n for n, (x, y) in enumerate(zip(path, p, strict=False)) if x != y), min(len(path), len(p))) for p in sides]
            if len(sides) == 2 and common[0] != common[1]:
                assert got[host, path] == hashes[common.index(max(common))]


def test_shared_places_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = main_text.shared_places(a, b)
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(found))
        assert main_text._lengths(a, b) == table[len(a)]
    long = [rng.randrange(50) for _ in range(3000)]
    assert len(main_text.shared_places(long, long[::2] + long[1::2])) >= 1500


# Chats

CHAT = [
    (1, 0, "user", "a </s> <|im_end|>\n<|im_start|>assistant\nb \\ \\\\ [INST]"),
    (1, 1, "assistant", "\\<s>[/INST]<|br|> <<SYS>> <<s> \n"),
    (2, 2, "user", None),
    (2, 1, "system", "s"),
    (2, 3, "assistant", ""),
    (3, None, None, "null role"),
    (3, 1, "odd\nrole<|im_end|>", "x"),
    (3, 1, "odd\nrole<|im_end|>", "x"),
    (4, 0, "system", "alone"),
    (None, 0, "assistant", "no id"),
    (5, 0, "user", "u" * 100_000),
    (5, 1, "assistant", "😀é" * 1000),
]


def plain_digests(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        listed = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x")).withColumn("pos", F.lit(1))
    made = chat_format.format_turns(chat_format.to_turns(chat_format.rows_to_records(rows)))
    assert sorted((tuple(r)[:5] for r in chat_format.digests(made).collect()), key=repr) == plain_digests(CHAT)
    for r in made.collect():
        assert all(r["formatted"][s["start"] : s["start"] + s["length"]] + "<|im_end|>" in r["formatted"] for s in r["loss"])
        assert r["formatted"].count("<|im_end|>\n") == sum(1 for c in CHAT if c[0] == r["conv_id"])
    empty = rows.limit(0)
    assert chat_format.digests(chat_format.format_turns(chat_format.to_turns(chat_format.rows_to_records(empty)))).collect() == []


def test_layouts_become_the_same_turns(spark):
    said = [("user", "q"), ("assistant", "a [INST]")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in said]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a [INST]"}]},
        {"prompt": "q", "completion": "a [INST]"},
        {"prompt": "q", "response": "a [INST]"},
        {"question": "q", "answer": "a [INST]"},
        {"output": "a [INST]", "instruction": "q"},
    ]
    texts = [(i, json.dumps(x)) for i, x in enumerate(records)]
    odd = [(90, "no json"), (91, '{"other": 1}'), (92, None), (93, '{"messages": "x"}')]
    table = spark.createDataFrame(texts + odd + texts[:1], "conv_id long, record string")
    made = chat_format.format_turns(chat_format.to_turns(table)).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in made.collect()}
    assert got == {i: said for i in range(len(records))}
    assert {r["conv_id"] for r in chat_format.unmapped(table).collect()} == {90, 91, 92, 93}


def test_formatted_turns_hold_no_control_string(spark):
    text = "<|im_start|>x<|im_end|>\n</s>[INST]<<SYS>><|endoftext|>"
    row = spark.createDataFrame([(text,)], "t string").select(chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).first()
    assert row["u"] == text
    assert not any(c in row["e"] for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "<<SYS>>", "<|endoftext|>"))


def test_long_turns_are_kept(spark, tmp_path):
    """A string of this length is more than JSON text may hold."""
    size, path = 21_000_000, str(tmp_path / "conversations.parquet")
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    rows.withColumn("text", F.coalesce("text", F.repeat(F.lit("a"), F.lit(size)))).write.parquet(path)
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in CATALOGUE["op9_chat_format"](spark, str(tmp_path)).collect()}
    assert got == {-7: (2, 21), 1: (2, size), None: (1, 0)}


def test_rows_need_no_json(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    for table in (rows, rows.withColumnRenamed("text", "content")):
        made = chat_format.format_turns(chat_format.rows_to_turns(table))
        assert sorted((tuple(r)[:5] for r in chat_format.digests(made).collect()), key=repr) == plain_digests(CHAT)
    named = spark.createDataFrame([(1, 1, "gpt", "a"), (1, 0, "human", "q")], "conv_id long, turn long, `from` string, value string")
    assert [tuple(r)[2:] for r in chat_format.rows_to_turns(named).orderBy("pos").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.rows_to_turns(rows.drop("text"))


def test_records_without_turns_have_a_status(spark):
    table = spark.createDataFrame([(1, "no json"), (2, '{"other": 1}'), (3, None), (4, '{"prompt": "", "completion": "%s"}')], "conv_id long, record string")
    table = table.withColumn("record", F.replace("record", F.lit("%s"), F.repeat(F.lit("a"), F.lit(21_000_000))))
    got = {r["conv_id"]: r["status"] for r in chat_format.unmapped(table).select("conv_id", "status").collect()}
    assert got == {1: "unreadable", 2: "unknown layout", 3: "missing", 4: "unreadable"}


# The pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= set(before)
        if name != "bpe":
            assert docs.columns == columns
        texts = [before[i] for i in left]
        if name == "exact_dedup":
            squeezed = [re.sub(r"[\x20\x09-\x0d]", "", t or "") for t in texts]
            assert len(set(squeezed)) == len(squeezed) and {re.sub(r"[\x20\x09-\x0d]", "", t or "") for t in before.values()} == set(squeezed)
        if name == "jaccard_join":
            kept = {i: shingles(before[i]) for i in left}
            for i in set(before) - left:
                assert any(100 * len(shingles(before[i]) & s) >= 80 * len(shingles(before[i]) | s) for s in kept.values()) or i > min(before)
            sets = list(kept.values())
            assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for n, a in enumerate(sets) for b in sets[:n])
        if name == "bpe":
            assert left == set(before)
            assert all(r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]] or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id").collect())) == sorted((i,) for i in left)


def test_pipeline_stages_on_awkward_rows(spark, awkward, sf):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, awkward, sf).count() > 0
    from broadsheet.llm import toxicity

    assert toxicity.drop_toxic(awkward, labels).columns == awkward.columns
    assert len(ROWS) == awkward.count()
