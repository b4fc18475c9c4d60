"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record is JSON text of any layout. Its fingerprint is a hash of its nested field paths,
whatever the values. ``MAPPINGS`` says for each known fingerprint where the turns are, so
prompt, instruction and message layouts all become rows of ``(role, text)``. A table that
has one row a turn is not written as JSON: the fingerprint of its field names selects one of
``ROW_MAPPINGS``. Turns are then written into one text per conversation::

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside a role or text are broken by an escape sign after their first
character, and escape signs are doubled; ``unescape`` undoes both exactly. The loss mask
lists the spans of assistant texts.

Defined results: NULL roles and texts are empty. Rows of one conversation go by turn, then
role and text; a NULL turn comes first. Rows with a NULL ``conv_id`` are one conversation.
Records of an unknown layout, or that are no JSON object, are in ``unmapped`` with a status
and nowhere else. A record repeated with its ``conv_id`` is one. Empty tables give empty
tables; extra columns are ignored.

Limits: Spark reads no JSON text with a string of more than 20 million characters or of more
than about 128 MB in all; such a record is ``unreadable`` in ``unmapped``. Turns kept as rows
have no such limit: a conversation is limited by what one row of its formatted text can hold.

All of it is built-in SQL functions. One exchange by conversation puts turns together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK, ESCAPE = "<|im_start|>", "<|im_end|>", "<|br|>", "\\"

# Strings with a meaning to this template or to others in use: fixed values, as patterns that
# follow their first character.
AFTER_ANGLE = [r"\|im_start\|>", r"\|im_end\|>", r"\|br\|>", r"\|endoftext\|>", r"\|startoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>"]
AFTER_BRACKET = [r"INST\]", r"/INST\]"]

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(text: Column) -> Column:
    """Double escape signs, then put one after the first character of every control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    pattern = rf"<(?=(?:{'|'.join(AFTER_ANGLE)}))|\[(?=(?:{'|'.join(AFTER_BRACKET)}))"
    return F.regexp_replace(doubled, pattern, r"$0\\")


def unescape(text: Column) -> Column:
    """A pair of escape signs is one, a single one is none: runs of them are even or of length one."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


# Layouts


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: single fields in order, then a list of objects."""

    name: str
    example: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"


# Each example stands for its layout; its field paths are what records are compared with.
MAPPINGS = [
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', items="messages"),
    Mapping("system_conversations", '{"system": "", "conversations": [{"from": "", "value": ""}]}', (("system", "system"),), "conversations", "from", "value"),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', items="conversations", role="from", text="value"),
    Mapping("prompt_completion", '{"prompt": "", "completion": ""}', (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", '{"prompt": "", "response": ""}', (("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", '{"question": "", "answer": ""}', (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", '{"instruction": "", "output": ""}', (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", '{"instruction": "", "input": "", "output": ""}', (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
]

# Layouts of tables with one row a turn, by the names of their fields; ``turn`` gives the order.
ROW_MAPPINGS = [
    Mapping("turn_text", '{"turn": 0, "role": "", "text": ""}', text="text"),
    Mapping("turn_content", '{"turn": 0, "role": "", "content": ""}'),
    Mapping("turn_value", '{"turn": 0, "from": "", "value": ""}', role="from", text="value"),
]


def field_paths(record: Column) -> Column:
    """The nested field names of JSON text as one string, sorted, without values or their types; NULL if it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, ": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\\([0-9,]*\\))", "")


def fingerprint(record: Column) -> Column:
    return F.md5(field_paths(record))


def names_fingerprint(names: Iterable[str]) -> str:
    """The fingerprint of a record with these fields and nothing nested in them."""
    return hashlib.md5(f"OBJECT<{', '.join(sorted(names))}>".encode()).hexdigest()


def _known(docs: DataFrame) -> dict[str, str]:
    """Fingerprint of each mapping, by the same expression that records go through."""
    row = docs.sparkSession.range(1).select(*[fingerprint(F.lit(m.example)).alias(m.name) for m in MAPPINGS]).first()
    return row.asDict()


def _role(mapping: Mapping, role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    if mapping.role != "from":
        return role
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[role], role)


def _turns(mapping: Mapping, record: Column) -> Column:
    value = F.try_parse_json(record)

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))

    fixed = F.array(*[F.struct(F.lit(role).alias("role"), text(path).alias("text")) for role, path in mapping.fields])
    if mapping.items is None:
        return fixed
    kind = f"array<struct<{mapping.role}: string, {mapping.text}: string>>"
    listed = F.try_variant_get(value, f"$.{mapping.items}", kind)

    def turn(item: Column) -> Column:
        return F.struct(_role(mapping, item[mapping.role]).alias("role"), F.coalesce(item[mapping.text], F.lit("")).alias("text"))

    turns = F.transform(listed, turn)
    return F.concat(fixed, turns) if mapping.fields else turns


def to_turns(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """``conv_id, version, pos, role, text``: the turns of all records of a known layout."""
    rows = records.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record")).dropDuplicates()
    found = fingerprint(F.col("record"))
    turns = F.coalesce(*[F.when(found == mark, _turns(m, F.col("record"))) for m in MAPPINGS if (mark := _known(records)[m.name])])
    exploded = rows.select("conv_id", F.md5("record").alias("version"), F.posexplode(turns).alias("pos", "turn"))
    return exploded.select("conv_id", "version", "pos", "turn.role", "turn.text")


def unmapped(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """``conv_id, record, paths, status``: records without turns, as ``missing`` (NULL), ``unreadable`` or of an ``unknown layout``."""
    known = list(_known(records).values())
    paths = field_paths(F.col(record))
    status = F.when(F.col(record).isNull(), "missing").when(paths.isNull(), "unreadable").otherwise("unknown layout")
    lost = records.filter(F.coalesce(~F.md5(paths).isin(known), F.lit(True)))
    return lost.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"), paths.alias("paths"), status.alias("status"))


def row_mapping(names: Iterable[str]) -> Mapping:
    """The first of ``ROW_MAPPINGS`` that the fields of a table fit, other fields aside."""
    names = set(names)
    for mapping in ROW_MAPPINGS:
        fields = set(json.loads(mapping.example))
        if names_fingerprint(names & fields) == names_fingerprint(fields):
            return mapping
    raise ValueError(f"no layout with one row a turn has the fields {sorted(names)}")


def rows_to_turns(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, version, pos, role, text`` of conversations kept one row a turn. They have one version."""
    mapping = row_mapping(rows.columns)
    text = F.coalesce(F.col(mapping.text), F.lit(""))
    one = F.struct(F.col("turn"), _role(mapping, F.col(mapping.role)).alias("role"), text.alias("text"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    exploded = grouped.select("conv_id", F.lit("").alias("version"), F.posexplode("turns").alias("pos", "one"))
    return exploded.select("conv_id", "version", "pos", "one.role", "one.text")


def rows_to_records(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, record``: conversations kept one row a turn, as JSON of the layout that suits their roles.

    ``rows_to_turns`` needs no JSON and has no limit of its size.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    texts = F.transform("turns", lambda t: t["text"])
    pair = F.struct(texts[0].alias("prompt"), F.get(texts, F.lit(1)).alias("completion"))
    messages = F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    rest = F.slice("turns", F.lit(2), F.greatest(F.size("turns") - 1, F.lit(0)))
    named = F.transform(rest, lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    led = F.struct(texts[0].alias("system"), named.alias("conversations"))
    only_two = F.forall(rest, lambda t: t["role"].isin("user", "assistant"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair))
        .when((F.size("turns") > 1) & (roles[0] == "system") & only_two, F.to_json(led))
        .otherwise(F.to_json(messages))
    )
    return grouped.select("conv_id", record.alias("record"))


# Formatting and reading back


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: the text of each conversation and its loss mask.

    A span of the mask has ``start`` and ``length`` in code points of ``formatted``, and the
    number of its turn with the ``place`` of the span in what that turn wrote.
    """
    role = F.replace(escape("role"), F.lit("\n"), F.lit(BREAK))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape("text")
    rows = turns.select("conv_id", "version", "pos", "role", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.struct(
        F.col("pos").alias("turn"), F.length("head").alias("place"), (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length")
    )
    made = F.struct("pos", "piece", F.when(F.col("role") == "assistant", span).alias("span"))
    grouped = rows.groupBy("conv_id", "version").agg(F.array_sort(F.collect_list(made), lambda a, b: a["pos"] - b["pos"]).alias("made"))
    formatted = F.array_join(F.transform("made", lambda m: m["piece"]), "")
    loss = F.filter(F.transform("made", lambda m: m["span"]), lambda s: s.isNotNull())
    return grouped.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def _pieces(formatted: Column) -> Column:
    """What each turn wrote, without its end: no control string is left inside, so ends are ends of turns."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted text."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2)
        plain = unescape(F.replace(F.substr(role, F.lit(len(START) + 1)), F.lit(BREAK), F.lit("\n")))
        return F.struct(plain.alias("role"), unescape(text).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    pieces = _pieces(formatted)
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.get(pieces, s["turn"]), s["place"] + 1, s["length"]))), "")


def digests(made: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the formatted texts."""
    rows = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("under"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
