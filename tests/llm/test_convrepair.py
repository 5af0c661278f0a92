"""Repair of conversations against a search over all edit strings, whole and in chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chronolake.llm import convrepair

from .conftest import TURNS


def cheapest(rows):
    """(cost, labels, turns) by a search from the start that holds whole label strings."""
    pattern = re.compile("(s?(ua)+)?")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, labels, at, made, turns = heapq.heappop(heap)
        if at == len(rows) and pattern.fullmatch(made):
            same = [x for x in heap if x[0] == cost and x[2] == len(rows) and pattern.fullmatch(x[3])]
            return min([(cost, labels, turns), *((x[0], x[1], x[4]) for x in same)])
        if (labels, at, made) in seen:
            continue
        seen.add((labels, at, made))
        step = []
        if at < len(rows):
            role, text, fault = rows[at]
            step.append((3, "D", 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                step.append((more, "K", 1, role[:1], (f"{role}:{text}",)))
                step += [(2 + more, "R", 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        step += [(2, "I", 0, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        for c, label, on, out, turn in step:
            now = made + out
            if label == "D" or len(out) == 1 and re.fullmatch("s|s?(ua)*u?", now):
                if cost + c <= 30:
                    heapq.heappush(heap, (cost + c, labels + label, at + on, now, turns + turn))


def by_force(rows):
    """The result row of one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, made = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults, strict=True)])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def results(spark, rows):
    got = convrepair.Repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in got.hashes().collect()}
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), hashes[r["conv_id"]]) for r in got.conversations.collect()}


@pytest.mark.parametrize("rows_of_a_chunk", [1, 2, 1024])
def test_against_search(spark, monkeypatch, rows_of_a_chunk):
    """Random conversations, with ties of turns, null turns, foreign roles and faults; chunks of any size."""
    monkeypatch.setattr(convrepair, "ROWS", rows_of_a_chunk)
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for _ in range(rng.randint(1, 5)):
            turn = rng.choice([None, 0, 1, 2, 3, 7])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sage"]), rng.choice(["One.", "Two!", "open", " \n", "", "Drei?"])))
    want = {c: by_force([r[1:] for r in rows if r[0] == c]) for c in range(60)}
    assert results(spark, rows) == want


def test_a_long_conversation_is_cut_and_joined(spark):
    """One conversation with nearly all rows, over many chunks and ranges, equals the same machine on one string."""
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), f"Text {k}{rng.choice('.. ')}") for k in range(5000)] + [(2, 0, "user", "One."), (0, 0, "user", "x")]
    got = results(spark, rows)
    machine = convrepair.Composition()
    symbols = "".join(r[2][0] if r[3][-1] == "." else r[2][0].upper() for r in rows[:5000])
    cost, audit = machine.best(symbols)
    turns = machine.repaired([r[2:] for r in rows[:5000]], symbols, audit)
    assert got[1][5:] == (cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest())
    assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in turns))
    assert got[2][6] == "KI"
    assert convrepair.Repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).turns().where("conv_id = 1").count() == len(turns)


def test_odd_rows(spark, odd):
    """The query on nulls, ties, equal rows, foreign and empty roles, a long text; damage by hand."""
    kept = {}
    for conv, turn, role, text in TURNS:
        kept.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {c: by_force(rows) if rows else nothing for c, rows in kept.items()}
    got = convrepair.op11_conversation_repair(spark, odd)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_further_columns_and_other_types(spark):
    """Clashing columns are not read; ids may be text; turns that are no numbers count as null."""
    rows = spark.createDataFrame([("a", "1", "user", "One.", 9, "z", 4), ("a", "x", "assistant", "Two.", 9, "z", 4)], "conv_id string, turn string, role string, text string, part int, label string, low int")
    got = convrepair.Repaired(rows)
    assert [tuple(r) for r in got.conversations.collect()] == [("a", 0, 0, 0, 0, 0, 4, "IKKI")]
    assert [(r["role"], r["text"]) for r in got.turns().orderBy("part", "no", "place").collect()] == [("user", ""), ("assistant", "Two."), ("user", "One."), ("assistant", "")]
