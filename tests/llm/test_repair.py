"""Conversation repair against exhaustive search, and over awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import pyarrow as pa
import pytest

from finweave.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, n long, task int, state string"


def cheapest(initials, faults):
    """All orders of edits, by least cost and then least audit."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def rest(i, q, inserted):
        found = [(0, "")] if i == len(initials) and q in (0, 3) else []
        if inserted < 3:
            found += [(3 + c, "I" + x) for r in "ua" if r in step[q] for c, x in [rest(i, step[q][r], inserted + 1)]]
        if i < len(initials):
            found += [(4 + c, "D" + x) for c, x in [rest(i + 1, q, 0)]]
            if faults[i] not in (repair.BLANK, repair.DUPLICATE):
                more = 3 * (faults[i] == repair.TRUNCATED)
                found += [(more + c, "K" + x) for c, x in [rest(i + 1, step[q][initials[i]], 0)]] if initials[i] in step[q] else []
                found += [(3 + more + c, "R" + x) for r in "ua" if r in step[q] for c, x in [rest(i + 1, step[q][r], 0)]]
        return min(found, default=(10**9, ""))

    for i in range(len(initials), 0, -1):  # so that no call goes deep
        for q in range(4):
            rest(i, q, 0)
    return rest(0, 0, 0)


def cases(count, longest, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(0, longest)
        yield "".join(rng.choice("suax\0") if rng.random() < 0.5 else "ua"[i % 2] for i in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)), rng


def test_layers_find_the_least_of_the_cheapest():
    for initials, faults, _ in cases(1500, 11, 1):
        audit, _ = repair.trace(initials, faults, repair.END, 0, True)
        assert (repair.cost(audit, faults), audit) == cheapest(initials, faults)


def test_blocks_meet():
    for initials, faults, rng in cases(500, 60, 2):
        cuts = [0, *sorted(rng.randint(0, len(initials)) for _ in range(3)), len(initials)]
        parts = [(initials[a:b], faults[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        rows = pa.Table.from_pylist([{"conv_id": 1, "task": k // 2, "block": k % 2, "matrix": repair.to_each(*p)} for k, p in enumerate(parts)])
        ends = {(r["task"], r["block"]): r for r in repair._ends(rows).to_pylist()}
        state, audit = 0, ""
        for k, p in enumerate(parts):
            r = ends[k // 2, k % 2]
            more, state = repair.trace(*p, repair.vector(r["ahead"]), state, r["last"])
            audit += more
        assert audit == repair.trace(initials, faults, repair.END, 0, True)[0]


def plain(rows):
    """The whole contract, row by row."""
    word = lambda x: " " if x is None else str(x)
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, seen in convs.items():
        seen.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, before = [], set()
        for _, role, text in seen:
            core = text.strip(repair.SPACE)
            faults.append(repair.BLANK if not core else repair.DUPLICATE if (role, text) in before else repair.TRUNCATED if core[-1] not in ".!?" else repair.FINE)
            before.add((role, text))
        turns = {t for t, _, _ in seen if t is not None}
        initials = [r[:1] for _, r, _ in seen]
        cost, audit = cheapest(tuple(initials), tuple(faults)) if seen else (0, "")
        lines, i, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else seen[i][1:]
            i += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(k) for k in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def digests(spark, rows, most=1024):
    given = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digest(repair.repaired(given, most)).collect()}


def awkward():
    rng = random.Random(5)
    texts = ["Fine.", "Cut off", "", " \t\n", None, "Why?", "é .", "..", "A.\x1c"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(1, 9))]
    rows += [(100, 3, "user", "Same.")] * 9 + [(101, None, "user", "x" * 300_000)] + [(102, 5, "u", "End. "), (102, 7, "a", "End.")]
    return rows


@pytest.mark.parametrize("size", [1024, 3])
def test_awkward_tables(spark, size):
    rows = awkward()
    assert digests(spark, rows, size) == plain(rows)


def test_one_conversation_in_many_blocks_and_tasks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Text {t % 50}{rng.choice(['.', ''])}") for t in range(700)] + [(2, 1, "user", "Same.")] * 400 + [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(3, 60) for t in range(4)]
    assert digests(spark, rows, 64) == plain(rows)
    given = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    fixed = repair.repaired(given, 64)
    assert fixed.filter("conv_id = 1 and not complete").count() >= 2
    said = repair.turns(fixed).filter("conv_id = 1").orderBy("task", "block", "place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in said).encode()).hexdigest() == plain(rows)[1][-1]


def test_empty_table(spark):
    assert repair.digest(repair.repaired(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_against_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, sf).collect()} == plain(rows)
