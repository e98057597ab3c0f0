"""Conversation repair against full tables and plain enumeration."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from neartag.llm import conversations as cv
from neartag.plans.staging import Staging

TURNS = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"


def enumerate_edits(rows, inserts):
    """Every sequence of edits with at most so many insertions: cost, audit, roles."""
    def ways(symbol):
        yield 4, "D", ""
        if symbol != "-":
            extra = 3 * symbol.isupper()
            yield extra, "K", symbol.lower()
            for initial in "ua":
                yield 3 + extra, "R", initial

    for n in range(inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            for inserted in itertools.product("ua", repeat=n):
                for chosen in itertools.product(*map(ways, rows)):
                    cost, audit, roles = 0, "", ""
                    for i in range(len(rows) + 1):
                        for place, initial in zip(places, inserted):
                            if place == i:
                                cost, audit, roles = cost + 3, audit + "I", roles + initial
                        if i < len(rows):
                            cost, audit, roles = cost + chosen[i][0], audit + chosen[i][1], roles + chosen[i][2]
                    if PATTERN.match(roles):
                        yield cost, audit


def by_table(rows, start=0, goals=(0, 3)):
    """Cost and least audit by relaxing the whole lattice until nothing changes."""
    best = {(0, start): (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for s in range(4):
                if (i, s) in best:
                    cost, audit = best[i, s]
                    t = cv.STEP[s][cv.NEXT[s]]
                    best[i, t] = min(best.get((i, t), (1 << 60, "")), (cost + 3, audit + "I"))
        if i < len(rows):
            for s in range(4):
                for more, t, edit in cv.row_edits(rows[i], s) if (i, s) in best else ():
                    cost, audit = best[i, s]
                    best[i + 1, t] = min(best.get((i + 1, t), (1 << 60, "")), (cost + more, audit + edit))
    found = [best[len(rows), g] for g in goals if (len(rows), g) in best]
    return min(found, default=None)


def test_cheapest_edits_by_enumeration():
    for n in range(4):
        for rows in itertools.product("suaxUA-", repeat=n):
            assert cv.cheapest("".join(rows), 0, (0, 3)) == min(enumerate_edits(rows, 2)), rows


def test_cheapest_edits_by_table():
    rng = random.Random(1)
    for n in [5, 9, 30, 64]:
        for _ in range(60):
            rows = "".join(rng.choice("suuaaxSUAX--") for _ in range(n))
            assert cv.cheapest(rows, 0, (0, 3)) == by_table(rows)
            for start, goal in itertools.product(range(4), range(4)):
                assert cv.cheapest(rows, start, (goal,)) == by_table(rows, start, (goal,))


def test_chunks_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        parts = ["".join(rng.choice("suuaaxSUAX--") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))]
        matrices = [{(p, q): f for p in range(4) for q in range(4) if (f := cv.cheapest(rows, p, (q,))) is not None} for rows in parts]
        whole = "".join(parts)
        cost, audit = cv.joined(matrices)
        assert (cost, audit) == by_table(whole)
        pieces = cv.split_audit(audit, [len(p) for p in parts])
        assert "".join(pieces) == audit and [len(p) - p.count("I") for p in pieces] == [len(p) for p in parts]


def brute_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        known = ["" if x is None else str(x) for x in (conv_id, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(":".join(k or " " for k in known).encode()) % 20
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def brute_repair(ids, rows):
    """Report and repaired lines of every conversation; rows of one turn have to be equal."""
    out = {}
    for conv_id in ids:
        own = [r for r in rows if r[0] == conv_id]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in own if r[1] is not None]
        counts, seen, letters = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), ""
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if bare == "" else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = by_table(letters)
        n_out = len(audit) - audit.count("D")
        roles = ("s" if n_out % 2 else "") + "ua" * (n_out // 2)
        lines, rest = [], iter(own)
        for edit in audit:
            row = None if edit == "I" else next(rest)
            if edit != "D":
                name = {"s": "system", "u": "user", "a": "assistant"}[roles[len(lines)]]
                lines.append(f"{row[2] if edit == 'K' else name}:{row[3] if row else ''}")
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n, longest):
    rows = []
    for conv_id in range(n):
        turn = rng.randrange(3)
        for _ in range(rng.choice([1, 2, 5, longest])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Well? ", "", " \n", None, "a long answer.", f"number {rng.randrange(50)}!", "ümlaut:.\nline"])
            rows.append((conv_id, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 5])
    rows += [(None, 0, "user", "Hello."), (None, None, "user", "First."), (None, 1, "assistant", "Yes."), (-7, None, "user", "x")]
    return rows


def compare(spark, rows):
    got = cv.damage_and_repair(spark.createDataFrame(rows, TURNS), Staging(spark))
    expected = brute_repair({r[0] for r in rows}, brute_damage(rows))
    found = got.collect()
    assert len(found) == len(expected)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r[c] for c in names) for r in found} == expected


def test_conversations_equal_brute_force(spark):
    compare(spark, conversations(random.Random(5), 120, 12))


def test_small_chunks_and_one_hot_conversation(spark, monkeypatch):
    rng = random.Random(6)
    rows = conversations(rng, 20, 40)
    rows += [(3, 1000 + i, rng.choice(["user", "assistant"]), f"turn {rng.randrange(300)}" + rng.choice([".", ""])) for i in range(700)]
    compare(spark, rows)
    monkeypatch.setattr(cv, "CHUNK_ROWS", 3)
    rng.shuffle(rows)
    compare(spark, rows)


def test_damage(spark):
    rows = conversations(random.Random(8), 60, 8)
    got = [tuple(r) for r in cv.damage(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_damage(rows)))


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 5, "assistant", "No"), (2, 0, "assistant", "Only."), (3, 0, "user", " ")]
    pieces = cv.repair(spark.createDataFrame(rows, TURNS), Staging(spark))
    got = {r.conv_id: r for r in cv.digests(pieces).collect()}
    assert {i: (r.gaps, r.cost, r.audit) for i, r in got.items()} == {1: (3, 6, "KIKK"), 2: (0, 3, "IK"), 3: (0, 4, "D")}
    lines = [(r.conv_id, r.number, r.role, r.text, r.edit) for r in cv.repaired_rows(pieces).orderBy("conv_id", "number").collect()]
    assert lines == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "There.", "K"), (1, 3, "assistant", "No", "K"),
                     (2, 0, "user", "", "I"), (2, 1, "assistant", "Only.", "K")]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, None, None), (2, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000)]
    frame = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in ("part", "seq", "case", "copy", "h", "m", "report", "lines")})
    got = {r.conv_id: r for r in cv.damage_and_repair(frame, Staging(spark)).collect()}
    assert set(got) == {1, 2, None}
    expected = brute_repair({1, 2, None}, brute_damage(rows))
    assert {i: (r.blank, r.duplicate, r.audit, r.repaired_sha256) for i, r in got.items()} == {i: (e[1], e[2], e[6], e[7]) for i, e in expected.items()}
    nothing = spark.createDataFrame([], TURNS)
    assert cv.damage_and_repair(nothing, Staging(spark)).count() == 0
