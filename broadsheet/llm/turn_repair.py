"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Roles must read ``(s?(ua)+)?`` by their initials. A row is kept (0), given the role user or
assistant (2) or deleted (3); an empty user or assistant turn is inserted anywhere (2). Blank
rows (no character but white space) and duplicates (role and text seen earlier in the
conversation) must be deleted; a truncated row (its last visible character is none of
``.!?``) costs 1 more unless it is deleted. Of the cheapest edits the ones whose initials
are least in ASCII are chosen; they are the audit.

Method: the costs to the end from the four states of the pattern are a vector, and each
row maps the vector behind it to the one before it (minimum and plus). A conversation is
cut into chunks of at most ``CHUNK`` rows that are worked on in parallel. Every chunk but the
last starts from a speculative vector. Fix-up passes rerun the chunks whose vector turned
out otherwise, from their end up to the row where old and new vectors differ only by a
constant: from there on nothing else changes, as only differences decide. Passes end when
no chunk changes. Then each chunk knows the costs behind it, tells where each state at its
start leads, and is traced from the state that it is entered in.

Defined results: rows are ordered by turn (NULLs first), then role, then a hash of the
text. A NULL role, text or key counts as one space. Rows of a NULL ``conv_id`` are one
conversation. Rows that are equal in all are counted before they are shuffled; all but the
first are duplicates. ``times`` says how often a row occurs; a conversation with zeros only has an
empty audit and the hash of the empty text. An empty table gives an empty table. Extra columns are ignored.

Scale: rows are range-sorted without their texts, so one conversation may hold most rows.
Texts move once to the rows that are kept and once to the digest of their conversation, which
reads them in order, a batch at a time: SHA-256 has no parts. Three tables without texts are
checkpointed, and each fix-up pass writes one row a chunk, while the plan is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.session import cut_lineage

SPACE = "\t\n\x0b\x0c\r "
CHUNK = 4096
# States: nothing yet, after a system, a user, an assistant turn. Costs of ending in each.
END = (0, 4, 2, 0)
# Where the turn that is due leads, whether inserted or given that role, and what its role is.
DUE, DUE_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
# By role (system, user, assistant, other): where a kept row leads from each state, -1 if nowhere.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
# Codes of a row: role in the low bits, then whether it may stay, then whether it is truncated.
STAYS, CUT = 4, 8


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: one fault a row, drawn from the CRC of ``conv_id:turn``; dropped rows have ``times`` 0."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("fault")
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def before_row(code: int, deleted: int, after: list[int]) -> list[int]:
    """Costs to the end before a row with ``deleted`` more copies behind it, from the costs after them."""
    after = [c + DELETE * deleted for c in after]
    if not code & STAYS:
        return after
    extra, kept = TRUNCATED * bool(code & CUT), KEPT[code & 3]
    e = [min(DELETE + after[s], REROLE + extra + after[DUE[s]], extra + after[kept[s]] if kept[s] >= 0 else 1 << 62) for s in range(4)]
    user, assistant = min(e[2], INSERT + e[3]), min(e[3], INSERT + e[2])
    return [min(e[0], INSERT + user), min(e[1], INSERT + user), user, assistant]


def level(costs: list[int]) -> list[int]:
    """The costs less the smallest of them: vectors that differ by a constant become the same."""
    low = min(costs)
    return [c - low for c in costs]


def backward(codes: list[int], deleted: list[int], end: list[int]) -> list[list[int]]:
    """Costs before each row and, last, behind the rows."""
    out = [end]
    for code, more in zip(reversed(codes), reversed(deleted), strict=True):
        out.append(before_row(code, more, out[-1]))
    return out[::-1]


def fix_up(codes: list[int], deleted: list[int], old: list[int], new: list[int], start: list[int]) -> tuple[list[int], int]:
    """The levelled costs at the start for another vector at the end, and how many rows had to be walked for it."""
    for n, (code, more) in enumerate(zip(reversed(codes), reversed(deleted), strict=True)):
        if level(old) == level(new):
            return start, n
        old, new = before_row(code, more, old), before_row(code, more, new)
    return level(new), len(codes)


def trace(codes: list[int], deleted: list[int], costs: list[list[int]], state: int, is_last: bool) -> tuple[str, list[tuple[int, str | None]], int, int]:
    """Least audit, turns of the result (row or -1, new role or None), cost and last state, from the costs at every row."""
    audit, turns, spent = [], [], 0
    for i, (code, more) in enumerate(zip(codes, deleted, strict=True)):
        if code & STAYS:
            extra, kept = TRUNCATED * bool(code & CUT), KEPT[code & 3]
            after = [c + DELETE * more for c in costs[i + 1]]
            while DELETE + after[state] != costs[i][state] and INSERT + costs[i][DUE[state]] == costs[i][state]:
                audit.append("I")
                turns.append((-1, DUE_ROLE[state]))
                spent, state = spent + INSERT, DUE[state]
            if DELETE + after[state] == costs[i][state]:
                audit.append("D")
                spent += DELETE
            elif kept[state] >= 0 and extra + after[kept[state]] == costs[i][state]:
                audit.append("K")
                turns.append((i, None))
                spent, state = spent + extra, kept[state]
            else:
                audit.append("R")
                turns.append((i, DUE_ROLE[state]))
                spent, state = spent + REROLE + extra, DUE[state]
        audit.append("D" * more)
        spent += DELETE * more
    while is_last and END[state]:
        audit.append("I")
        turns.append((-1, DUE_ROLE[state]))
        spent, state = spent + INSERT, DUE[state]
    return "".join(audit), turns, spent, state


def _text(value: Column) -> Column:
    """Text and its length, so that joined values stay apart."""
    return F.concat(F.length(value).cast("string"), F.lit(":"), value)


def _keyed(rows: DataFrame, times: str | None) -> DataFrame:
    """Rows with 128-bit keys of all they hold (``k``) and of conversation, role and text (``said``)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("conv_id", "turn"))
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    gone = n == 0
    rows = rows.select("conv_id", "turn", F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), n.alias("n"))
    said = F.concat(conv, F.lit(" "), _text(F.col("role")), F.col("text"))
    return rows.withColumn("said", F.unhex(F.md5(said))).withColumn("k", F.unhex(F.md5(F.concat(turn, F.lit(" "), said))))


def _sorted_rows(keyed: DataFrame) -> DataFrame:
    """Distinct rows without texts, in order over the whole table: ``seq`` ascends; ``n`` says how often each occurs."""
    seen = F.rtrim("text", F.lit(SPACE))
    flags = [(seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut")]
    rows = keyed.select("conv_id", "turn", "role", "k", "said", *flags, "n")
    rows = rows.groupBy("conv_id", "turn", "role", "k", "said", "blank", "cut").agg(F.sum("n").alias("n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("k")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(rows.withColumn("seq", F.monotonically_increasing_id()))


def _chunks(rows: DataFrame) -> DataFrame:
    """One row a chunk: its rows as codes, counts of faults, and where the chunk stands in its conversation.

    Partitions of the sorted table number their rows from multiples of 2^33, so no chunk spans two of them.
    """
    rows = rows.filter("n > 0")
    first = rows.filter("not blank").groupBy("said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    rows = rows.join(first, "seq", "left").withColumn("stays", F.coalesce("first", F.lit(False)))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = kind + F.when(F.col("stays"), STAYS).otherwise(0) + F.when(F.col("cut"), CUT).otherwise(0)
    more = F.col("n") - F.col("stays").cast("long")
    chunks = rows.groupBy("conv_id", F.expr(f"seq div {CHUNK}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("seq", code.alias("code"), more.alias("more"), "k", "role"))).alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), more).otherwise(0)).alias("duplicate"),
        F.sum((F.col("stays") & F.col("cut")).cast("long")).alias("truncated"),
    )
    chunks = chunks.select(
        "conv_id", F.col("rows")[0]["seq"].alias("head"), F.col("rows.code").alias("codes"), F.col("rows.more").alias("more"),
        F.transform("rows", lambda r: F.struct(r["k"], r["role"])).alias("rows"), "blank", "duplicate", "truncated",
    )
    chunks = cut_lineage(chunks)
    in_order = Window.partitionBy("conv_id").orderBy("head")
    ends = chunks.select("conv_id", "head", (F.element_at("codes", -1) % 4).alias("kind"))
    ends = ends.select("head", F.lag("kind").over(in_order).alias("kind_before"), F.lead("head").over(in_order).alias("next"))
    return cut_lineage(chunks.join(ends, "head"))


def _stitched(chunks: DataFrame) -> DataFrame:
    """``conv_id, head, behind``: the costs behind each chunk of a conversation with several, up to a constant."""
    some = chunks.select("conv_id", "head", "next", "codes", "more")

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            behind = [list(END) if n is None else [0, 0, 0, 0] for n in b.column("next").to_pylist()]
            work = zip(b.column("codes").to_pylist(), b.column("more").to_pylist(), behind, strict=True)
            start = [level(backward(codes, more, end)[0]) for codes, more, end in work]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _ints(behind), _ints(start)], ["conv_id", "head", "next", "behind", "start"])

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            work = zip(*(b.column(c).to_pylist() for c in ("codes", "more", "behind", "found", "start")), strict=True)
            start = [fix_up(codes, more, old, new, at)[0] for codes, more, old, new, at in work]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column("found"), _ints(start)], ["conv_id", "head", "next", "behind", "start"])

    kind = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, head long, next long, behind array<long>, start array<long>"
    state = some.mapInArrow(speculate, kind)
    while True:
        found = state.select(F.col("head").alias("next"), F.col("start").alias("found"))
        state = cut_lineage(state.join(found, "next", "left").select("conv_id", "head", "next", "behind", "start", "found"))
        wrong = (F.col("found") != F.col("behind")) & F.col("found").isNotNull()
        if state.filter(wrong).isEmpty():
            return state.select("conv_id", "head", "behind")
        again = state.filter(wrong).join(some.select("head", "codes", "more"), "head").select("conv_id", "head", "next", "behind", "start", "found", "codes", "more")
        state = state.filter(~wrong | F.col("found").isNull()).drop("found").unionByName(again.mapInArrow(rerun, kind))


def _ints(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _entered(chunks: DataFrame, behind: DataFrame) -> DataFrame:
    """``head, behind, state``: the state that each chunk is entered in, from where each chunk leads from every state."""
    some = chunks.join(behind.select("head", "behind"), "head").select("conv_id", "head", "behind", "codes", "more")

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = []
            for codes, more, end in zip(*(b.column(c).to_pylist() for c in ("codes", "more", "behind")), strict=True):
                costs = backward(codes, more, end)
                to.append([trace(codes, more, costs, s, False)[3] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _ints(to)], ["conv_id", "head", "behind", "to"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, fresh = None, 0, True
        for b in batches:
            states = []
            for own, to in zip(b.column("conv_id").to_pylist(), b.column("to").to_pylist(), strict=True):
                if fresh or own != conv:
                    conv, state, fresh = own, 0, False
                states.append(state)
                state = to[state]
            yield pa.RecordBatch.from_arrays([b.column("head"), b.column("behind"), pa.array(states, pa.int32())], ["head", "behind", "state"])

    kind = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, head long, behind array<long>, to array<long>"
    maps = some.mapInArrow(leads, kind).repartition("conv_id").sortWithinPartitions("conv_id", "head")
    return maps.mapInArrow(follow, "head long, behind array<long>, state int")


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _traced(chunks: DataFrame, entered: DataFrame) -> DataFrame:
    """``conv_id, head, rows, blank, duplicate, truncated, illegal, cost, audit, turns`` of each chunk."""
    rows = chunks.join(entered, "head", "left").select(
        "conv_id", "head", "rows", "blank", "duplicate", "truncated", "codes", "more", "kind_before", "next", "behind", "state"
    )
    turn = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            illegal, cost, audits, turns = [], [], [], []
            for codes, more, kind, nxt, end, state in zip(*(b.column(c).to_pylist() for c in ("codes", "more", "kind_before", "next", "behind", "state")), strict=True):
                kinds = [code & 3 for code in codes]
                pairs = zip([kind, *kinds[:-1]], kinds, strict=True)
                copies = sum(m + bool(c & STAYS) - 1 for c, m in zip(codes, more, strict=True))
                illegal.append(copies + sum(p[0] is not None and p not in _LEGAL for p in pairs))
                costs = backward(codes, more, end or list(END))
                audit, out, spent, _ = trace(codes, more, costs, state or 0, nxt is None)
                audits.append(audit)
                turns.append([{"at": at, "role": role} for at, role in out])
                cost.append(spent)
            new = [pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(audits, pa.string()), pa.array(turns, turn)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *new], [*b.schema.names[:6], "illegal", "cost", "audit", "turns"])

    conv = chunks.schema["conv_id"].dataType.simpleString()
    kind = f"conv_id {conv}, head long, rows array<struct<k:binary,role:string>>, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<at:int,role:string>>"
    return cut_lineage(rows.mapInArrow(run, kind))


def repair(rows: DataFrame, times: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits and the repaired turns of rows ``conv_id, turn, role, text``.

    Edits, one row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit``. Turns: ``conv_id, head, pos, role, text``, in the order of ``head, pos``.
    """
    keyed = _keyed(rows, times)
    sorted_rows = _sorted_rows(keyed)
    chunks = _chunks(sorted_rows)
    several = chunks.filter("next is not null or kind_before is not null")
    traced = _traced(chunks, _entered(several, _stitched(several)))

    turns = sorted_rows.filter("n > 0 and turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    counts = [c for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    parts = traced.select("conv_id", *counts, F.struct("head", "audit").alias("part"))
    parts = parts.unionByName(gaps, allowMissingColumns=True).unionByName(sorted_rows.filter("n = 0").select("conv_id"), allowMissingColumns=True)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["audit"]), "")
    edits = parts.groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts)], audit.alias("audit"))

    items = traced.select("conv_id", "head", "rows", F.posexplode("turns").alias("pos", "turn"))
    row = F.get("rows", F.col("turn.at"))
    items = items.select("conv_id", "head", "pos", F.coalesce("turn.role", row["role"]).alias("role"), row["k"].alias("k"))
    texts = keyed.filter("n > 0").groupBy("k").agg(F.first("text").alias("text"))
    kept = items.filter("k is not null").join(texts, "k").drop("k")
    return edits, kept.unionByName(items.filter("k is null").drop("k").withColumn("text", F.lit("")))


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the lines ``role:text``; the turns of a conversation are read in order, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            done = []
            for own, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or own != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield batch_of(done)
        yield batch_of([(conv, digest.hexdigest())] if digest is not None else [])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], arrow), pa.array([d for _, d in rows], pa.string())], ["conv_id", "repaired_sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(turns.schema["conv_id"].dataType)
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "head", "pos").select("conv_id", "role", "text").mapInArrow(run, kind)


def digests(edits: DataFrame, turns: DataFrame) -> DataFrame:
    """The edits with ``repaired_sha256``; no turns have the hash of the empty text."""
    both = edits.unionByName(turn_digests(turns), allowMissingColumns=True)
    whole = [F.max(c).alias(c) for c in edits.columns if c != "conv_id"]
    return both.groupBy("conv_id").agg(*whole, F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
