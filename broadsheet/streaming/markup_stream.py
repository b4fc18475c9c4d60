"""Tokens of documents that arrive in pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from broadsheet.functions import markup as M
from broadsheet.operators.markup import describe_tokens

_STATE = "tail string, next_seq long, pos int, last_tag string, waiting string"


def _python_pattern(java: str) -> str:
    return java.replace(r"\z", r"\Z")


def _complete(token: str, literal: re.Pattern | None) -> bool:
    """True when no further text can change a token at the end of what has arrived."""
    if not token.startswith("<") or not token.endswith(">"):
        return False
    if literal and (whole := literal.match(token)):
        return whole.group(3) is not None
    if token.startswith("<!--"):
        return re.search(r"(?s)^<!--.*--\s*>\Z", token) is not None
    if token.startswith("<!["):
        return re.search(r"\]\s*\]?\s*>\Z", token) is not None
    return True


def _cutter(literal_tags: tuple[str, ...]):
    """``cut(text, at_end) -> (tokens, tail)`` by the same grammar as the batch form."""
    grammar = re.compile(_python_pattern(M.token_pattern(literal_tags)))
    literal = re.compile(_python_pattern(M.literal_pattern(literal_tags))) if literal_tags else None

    def cut(text: str, at_end: bool) -> tuple[list[str], str]:
        found = [m.group() for m in grammar.finditer(text)]
        tail = ""
        if found and not at_end and not _complete(found[-1], literal):
            tail = found.pop()
        tokens = []
        for token in found:
            whole = literal.match(token) if literal else None
            tokens.extend([g for g in whole.groups() if g] if whole else [token])
        return tokens, tail

    return cut


def markup_stream(
    chunks: DataFrame,
    key: str = "doc_id",
    literal_tags: Iterable[str] = M.DEFAULT_LITERAL_TAGS,
    idle: str | None = None,
    entities: dict[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Token rows, as ``tokenize_markup`` gives them, from a stream of pieces.

    ``chunks`` is ``(key, seq, chunk, is_last)`` with ``seq`` from 0. Markup is emitted
    as soon as it is complete; the open rest, the next number and the last tag are
    kept per document. A piece that comes early waits for the ones before it. The
    rest is flushed by ``is_last`` or, with ``idle`` (as ``"10 minutes"``), when
    nothing has come for that long; pieces that still wait then follow in order.
    """
    cut = _cutter(tuple(literal_tags))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, next_seq, pos, last_tag, held = state.get if state.exists else ("", 0, 0, "???", "[]")
        waiting = {seq: (chunk, is_last) for seq, chunk, is_last in json.loads(held)}
        for batch in batches:
            for seq, chunk, is_last in zip(batch["seq"], batch["chunk"], batch["is_last"]):
                # A piece that was read before is a repeat.
                if int(seq) >= next_seq:
                    waiting[int(seq)] = (chunk, bool(is_last))
        ended, text = False, tail
        while next_seq in waiting and not ended:
            chunk, ended = waiting.pop(next_seq)
            text += chunk
            next_seq += 1
        if state.hasTimedOut:
            # Pieces beyond a gap that nothing filled are text all the same.
            text += "".join(waiting[seq][0] for seq in sorted(waiting))
            ended = True
        tokens, tail = cut(text, ended)
        rows = []
        for i, token in enumerate(tokens):
            again = last_tag if token == "<>" else None
            name = re.match(f"<({M.TAG_NAME})", token)
            last = ended and i == len(tokens) - 1
            if name and (token.endswith(">") or not last):
                last_tag = name.group(1).lower()
            rows.append((*group, pos, token, last, again))
            pos += 1
        if ended:
            state.remove()
        else:
            early = [(seq, chunk, is_last) for seq, (chunk, is_last) in waiting.items()]
            state.update((tail, next_seq, pos, last_tag, json.dumps(early)))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "pos", "raw", "last", "again"])

    shape = f"{key} {dict(chunks.dtypes)[key]}, pos int, raw string, last boolean, again string"
    cut_rows = chunks.select(key, "seq", "chunk", "is_last").groupBy(key).applyInPandasWithState(
        advance, shape, _STATE, "append", timeout
    )
    rows = cut_rows.withColumn("part", F.lit(0)).withColumn("kind", M.token_kind(F.col("raw"), F.col("last")))
    return describe_tokens(rows, key, entities)
