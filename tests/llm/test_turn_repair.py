"""Conversation repair against a plain search over all edits, whole and in chunks of a few rows."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from broadsheet.llm import turn_repair as tr

ROWS = "conv_id long, turn long, role string, text string, times int, k string, seq long"
SPACE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """``(cost, audit, turns)`` of rows ``(role, text, must_go, cut)``: the least of all edits, by cost and then audit."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for r in after[last]:
                if r in names:
                    cost, audit, turns = best(i, r, inserted + 1)
                    found.append((cost + 2, "I" + audit, ((names[r], ""),) + turns))
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            cost, audit, turns = best(i + 1, last, 0)
            found.append((cost + 3, "D" + audit, turns))
            if not must_go:
                if role[:1] in after[last]:
                    cost, audit, turns = best(i + 1, after[last][role[:1]], 0)
                    found.append((cost + cut, "K" + audit, ((role, text),) + turns))
                for r in after[last]:
                    if r in names:
                        cost, audit, turns = best(i + 1, r, 0)
                        found.append((cost + 2 + cut, "R" + audit, ((names[r], text),) + turns))
        return min(found, default=(10**9, "", ()))

    # From the end, so that the recursion stays shallow.
    for i in range(len(rows), -1, -1):
        for last in after:
            best(i, last, 0)
    return best(0, "", 0)


def plain(rows):
    """Result rows of table rows ``(conv_id, turn, role, text, times)``; turns must not tie, but for copies."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            shown = text.strip(SPACE)
            blank, again, cut = not shown, (role, text) in seen, not shown.endswith((".", "!", "?"))
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                counts[fault] += 1
            judged.append((role, text, blank or again, int(cut)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, made = plain_edits(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)
    got = tr.digests(*tr.repair(table, "times")).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def random_rows(seed, n_convs, longest):
    rng = random.Random(seed)
    roles, rows = ["user", "assistant", "user", "assistant", "system", "tool", "", "sys"], []
    for conv in range(n_convs):
        for turn in range(rng.randrange(longest)):
            text = rng.choice(["", " ", "Yes.", "No", f"t{turn}.", f"t{turn}", f"t{turn}! ", f"é{turn}?\n"])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + 1000 * turn, rng.choice(roles), text, rng.choice([1, 1, 1, 1, 0, 2, 3])))
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_against_all_edits(spark, monkeypatch, chunk):
    monkeypatch.setattr(tr, "CHUNK", chunk)
    rows = random_rows(chunk, 30, 14)
    assert run(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, "user", "A.", 1),
        (1, 3, None, None, 1),
        (1, 5, "assistant", "B." * 50_000, 1),
        (2, 1, "user", "", 1),
        (3, 1, "user", "gone.", 0),
        (None, 1, "system", "Be kind.", 1),
        (None, 2, "user", "Hi", 1),
        (4, None, "assistant", "x.", 1),
        (5, 1, "user", "same.", 1),
        (5, 1, "user", "same.", 1),
        (5, 1, "user", "same.", 40),
        (6, 2, "user", "a\nassistant:b.", 1),
        (7, 1, "system", "only.", 1),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    empty = [r for r in run(spark, rows) if r[0] == 3][0]
    assert empty == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_holds_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tr, "CHUNK", 16)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"t{t}.", f"t{t}", "again."]), 1) for t in range(300)]
    rows += [(2, 0, "user", "q.", 1), (2, 1, "assistant", "a.", 1)]
    assert run(spark, rows) == plain(rows)


def test_vectors_converge_to_a_constant_difference():
    rng = random.Random(9)
    for _ in range(50):
        codes = [rng.randrange(4) + 4 * rng.randrange(2) + 8 * rng.randrange(2) for _ in range(60)]
        more = [rng.choice([0, 0, 0, 2]) for _ in codes]
        old, new = [0, 0, 0, 0], [rng.randrange(5) for _ in range(4)]
        start = tr.level(tr.backward(codes, more, old)[0])
        found, walked = tr.fix_up(codes, more, old, new, start)
        assert found == tr.level(tr.backward(codes, more, new)[0])
        # A run of rows that may stay makes the vectors alike long before the start.
        if sum(1 for c in codes if c & 4) > 20:
            assert walked < len(codes)


def test_damage_draws_one_fault_a_row(spark):
    rows = [(i, t, "assistant", "Well. Yes! No?") for i in range(40) for t in range(5)] + [(None, None, None, None), (1, None, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in tr.damage(table).collect()), key=repr)

    def one(conv, turn, role, text):
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        return (conv, turn, "user" if fault == 4 else role, text, {0: 0, 3: 2}.get(fault, 1))

    assert got == sorted((one(*r) for r in rows), key=repr)
