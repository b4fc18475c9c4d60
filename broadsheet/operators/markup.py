"""Token tables from page tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions import markup as M
from broadsheet.functions.text import BASIC_ENTITIES
from broadsheet.session import broadcast_within

# Tags that never have an end tag.
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
]


def _events(html: Column, literal_tags: tuple[str, ...], short_tags: bool, rest_tags: tuple[str, ...] = ()) -> Column:
    """Array of ``(token, last, again, rest)``: the tag that a bare ``<>`` repeats, and whether all markup has ended before."""
    tokens = M.raw_tokens(html, literal_tags, short_tags, rest_tags)

    def from_array(found: Column) -> Column:
        n = F.size(found)

        def event(token: Column, i: Column) -> Column:
            earlier = F.filter(F.slice(found, F.lit(1), i), lambda t: t.rlike("^<[a-zA-Z]"))
            again = F.coalesce(M.start_name(F.try_element_at(earlier, F.lit(-1))), F.lit("???"))
            # What follows such a start tag is the last token.
            rest = F.coalesce(F.get(found, i - 1).rlike(M.rest_start(rest_tags) + r"\z"), F.lit(False)) if rest_tags else F.lit(False)
            return F.struct(
                token.alias("token"), (i == n - 1).alias("last"), F.when(token == "<>", again).alias("again"), rest.alias("rest")
            )

        return F.transform(found, event)

    # Bind the token array once: the lambda reads it three times.
    return F.flatten(F.transform(F.array(tokens), from_array))


def tokenize_markup(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    literal_tags: Iterable[str] = M.DEFAULT_LITERAL_TAGS,
    short_tags: bool = False,
    entities: dict[str, str] | DataFrame | None = None,
    rest_tags: Iterable[str] = (),
) -> DataFrame:
    """``(key, pos, kind, tag, attrs, data, raw)``, one row per token, in one pass without a shuffle.

    After a start tag of ``rest_tags`` there is no markup: the rest of the page is one token of data.

    For references ``tag`` holds the name or number and ``data`` the character, or
    NULL when it is unknown. ``entities`` replaces the table of known names, as a
    dict or as a table ``(name, char)``.
    """
    if short_tags and rest_tags:
        raise ValueError("short tags and rest tags exclude each other")
    events = _events(F.col(html), tuple(literal_tags), short_tags, tuple(rest_tags))
    rows = pages.select(key, F.posexplode(events).alias("at", "e")).select(
        key, "at", F.col("e.token").alias("raw"), "e.last", "e.again", "e.rest"
    )
    if short_tags:
        rows = _open_short_tags(rows, key)
    else:
        kind = F.when(F.col("rest"), "data").otherwise(M.token_kind(F.col("raw"), F.col("last")))
        rows = rows.withColumn("part", F.lit(0)).withColumn("kind", kind)
    pos = F.col("at") * 3 + F.col("part") if short_tags else F.col("at")
    return describe_tokens(rows.withColumn("pos", pos), key, entities)


def describe_tokens(rows: DataFrame, key: str, entities: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Tag, attributes and data of rows ``(key, pos, part, kind, raw, again)``."""
    raw, kind = F.col("raw"), F.col("kind")
    tag = (
        F.when(kind == "start", F.coalesce(F.col("again"), M.start_name(raw)))
        .when((kind == "end") & (F.col("part") == 2), F.col("again"))
        .when(kind == "end", M.end_name(raw))
        .when(kind.isin("charref", "entityref"), F.regexp_extract(raw, "^&#?([-.a-zA-Z0-9]+)", 1))
    )
    number = F.when(kind == "charref", F.regexp_extract(raw, "([0-9]+)", 1).try_cast("int"))
    table = BASIC_ENTITIES if entities is None else entities
    by_name = F.lit(None).cast("string")
    if isinstance(table, dict):
        for name, char in table.items():
            by_name = F.when(F.col("tag") == name, F.lit(char)).otherwise(by_name)
    data = (
        F.when(kind == "data", raw)
        .when(kind == "comment", F.regexp_extract(raw, r"(?s)^<!--(.*)--\s*>\z", 1))
        .when(kind.isin("declaration", "instruction"), F.regexp_extract(raw, r"(?s)^<[?!](.*)>\z", 1))
        .when((kind == "charref") & number.between(0, 127), F.char(number))
        .when(kind == "entityref", by_name)
    )
    attrs = F.when(kind == "start", M.attributes(raw))
    out = rows.withColumn("tag", tag)
    if isinstance(table, DataFrame):
        names, _ = broadcast_within(table.select(F.col("name").alias("tag"), "char", F.lit("entityref").alias("kind")))
        out = out.join(names, ["tag", "kind"], "left").withColumn(
            "data", F.coalesce(data, F.col("char"))
        )
    else:
        out = out.withColumn("data", data)
    return out.select(key, "pos", "kind", "tag", attrs.alias("attrs"), "data", "raw")


def _open_short_tags(rows: DataFrame, key: str) -> DataFrame:
    """``<b/text/`` stands for a start tag, its text and an end tag."""
    short = r"(?s)^<([a-zA-Z][-.a-zA-Z0-9]*)/([^/]*)/\z"
    raw = F.col("raw")
    name = F.regexp_extract(raw, short, 1)

    def piece(part: int, kind: Column, text: Column, again: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), kind.alias("kind"), text.alias("raw"), again.alias("again")
        )

    none = F.lit(None).cast("string")
    opened = F.array(
        piece(0, F.lit("start"), F.concat(F.lit("<"), name, F.lit("/")), none),
        piece(1, F.lit("data"), F.regexp_extract(raw, short, 2), none),
        piece(2, F.lit("end"), F.lit("/"), F.lower(name)),
    )
    plain = F.array(piece(0, M.token_kind(raw, F.col("last")), raw, F.col("again")))
    return rows.select(
        key, "at", F.explode(F.when(raw.rlike(short), opened).otherwise(plain)).alias("p")
    ).select(key, "at", "p.*")


def of_kind(tokens: DataFrame, kind: str) -> DataFrame:
    return tokens.filter(F.col("kind") == kind)


def start_tags(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "start").drop("kind", "data")


def end_tags(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "end").drop("kind", "attrs", "data")


def comments(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "comment").drop("kind", "tag", "attrs")


def declarations(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "declaration").drop("kind", "tag", "attrs")


def instructions(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "instruction").drop("kind", "tag", "attrs")


def text_runs(tokens: DataFrame) -> DataFrame:
    return of_kind(tokens, "data").drop("kind", "tag", "attrs", "raw")


def charrefs(tokens: DataFrame) -> DataFrame:
    """Numbered references; ``data`` is NULL for numbers outside 0 to 127."""
    return of_kind(tokens, "charref").drop("kind", "attrs")


def entityrefs(tokens: DataFrame) -> DataFrame:
    """Named references; ``data`` is NULL for unknown names."""
    return of_kind(tokens, "entityref").drop("kind", "attrs")


def attribute_rows(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, pos, tag, n, name, value)``, one row per attribute."""
    return (
        of_kind(tokens, "start")
        .select(key, "pos", "tag", F.posexplode("attrs").alias("n", "a"))
        .select(key, "pos", "tag", "n", "a.name", "a.value")
    )


def tag_census(tokens: DataFrame) -> DataFrame:
    """How often each tag starts and ends."""
    return (
        tokens.filter(F.col("kind").isin("start", "end"))
        .groupBy("tag")
        .agg(
            F.count_if(F.col("kind") == "start").alias("starts"),
            F.count_if(F.col("kind") == "end").alias("ends"),
        )
    )


def tag_depth(tokens: DataFrame, key: str = "page_id", void_tags: Iterable[str] = VOID_TAGS) -> DataFrame:
    """Running count of open minus closed tags, the cheap form of the tag stack."""
    move = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tokens.filter(F.col("kind").isin("start", "end") & ~F.col("tag").isin(list(void_tags)))
        .select(key, "pos", "kind", "tag", F.sum(move).over(order).alias("depth"))
    )


# Pages whose tags are walked together; only their tags are held as objects.
WALKED_PAGES = 64


def _walk(kinds: list[str], tags: list[str], places: list[int]) -> Iterator[tuple]:
    """What the open-tag stack of a page does: place, tag, action, depth and the place where it was opened."""
    stack: list[tuple] = []
    held: dict[str, int] = {}
    for k, t, p in zip(kinds, tags, places, strict=True):
        if k == "start":
            stack.append((t, p))
            held[t] = held.get(t, 0) + 1
            yield p, t, "open", len(stack), p
            continue
        if not stack or (t and not held.get(t)):
            yield p, t, "unbalanced", len(stack), None
            continue
        target = t or stack[-1][0]
        while True:
            name, at = stack.pop()
            held[name] -= 1
            done = name == target
            yield p, name, "close" if done else "implied_close", len(stack), at
            if done:
                break


def _walked(tagged: DataFrame, key: str) -> DataFrame:
    """Rows of ``close_events`` from ``(key, t)``, few pages at a time, so that a worker's memory does not grow with a batch."""
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, WALKED_PAGES):
                some = b.slice(begin, WALKED_PAGES)
                lists = some.column("t")
                parts = [pc.struct_field(lists.flatten(), name).to_pylist() for name in ("kind", "tag", "pos")]
                places, out, at = [], [], 0
                for row, size in enumerate(pc.list_value_length(lists).to_pylist()):
                    out += _walk(*(part[at : at + size] for part in parts))
                    places += [row] * (len(out) - len(places))
                    at += size
                columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
                keys = some.column(key).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *columns], [key, "pos", "tag", "action", "depth", "opened_at"])

    return tagged.mapInArrow(run, f"`{key}` {dict(tagged.dtypes)[key]}, pos int, tag string, action string, depth int, opened_at int")


def close_events(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    balanced_tags: Iterable[str] | None = None,
    void_tags: Iterable[str] = VOID_TAGS,
    literal_tags: Iterable[str] = M.DEFAULT_LITERAL_TAGS,
) -> DataFrame:
    """``(key, pos, tag, action, depth, opened_at)``: what the open-tag stack does at each tag.

    An end tag closes up to its innermost open match; ``</>`` closes the top; an end
    tag without a match is unbalanced. ``balanced_tags`` are the tags to stack; by
    default all but the void ones. Pages stay whole rows, so nothing is shuffled.
    """
    tokens = F.transform(
        _events(F.col(html), tuple(literal_tags), False),
        lambda e, i: F.struct(
            M.token_kind(e["token"], e["last"]).alias("kind"),
            F.coalesce(
                e["again"],
                F.when(e["token"].startswith("</"), M.end_name(e["token"])).otherwise(M.start_name(e["token"])),
            ).alias("tag"),
            i.alias("pos"),
        ),
    )

    def wanted(e: Column) -> Column:
        if balanced_tags is None:
            stacked = ~e["tag"].isin(list(void_tags))
        else:
            stacked = e["tag"].isin(list(balanced_tags)) | (e["tag"] == "")
        return e["kind"].isin("start", "end") & stacked

    # A failed fetch has no page and no tags.
    tagged = pages.filter(F.col(html).isNotNull()).select(key, F.filter(tokens, wanted).alias("t"))
    return _walked(tagged, key)


def unbalanced_tags(closes: DataFrame) -> DataFrame:
    """End tags that close nothing."""
    return closes.filter(F.col("action") == "unbalanced").drop("action", "opened_at")


def tag_balance(tokens: DataFrame, void_tags: Iterable[str] = VOID_TAGS) -> DataFrame:
    """Open minus closed per tag."""
    return (
        tag_census(tokens)
        .filter(~F.col("tag").isin(list(void_tags)))
        .select("tag", "starts", "ends", (F.col("starts") - F.col("ends")).alias("unclosed"))
    )


def reassemble_chunks(
    chunks: DataFrame, key: str = "doc_id", seq: str = "seq", chunk: str = "chunk"
) -> DataFrame:
    """``(key, html)`` from pieces of a text; one group is one document."""
    pieces = F.sort_array(F.collect_list(F.struct(seq, chunk)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p[chunk]), "").alias("html"))


def register_markup_tokens(spark: SparkSession, name: str = "markup_tokens") -> None:
    """SQL table function ``LATERAL name(html)`` returning ``(pos, raw)``; stays in the JVM."""
    pattern = M.token_pattern(()).replace("'", "\\'")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(html STRING) RETURNS TABLE (pos INT, raw STRING) "
        f"RETURN SELECT pos, col FROM posexplode(regexp_extract_all(html, r'{pattern}', 0))"
    )
