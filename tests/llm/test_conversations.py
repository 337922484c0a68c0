"""Conversation repair: against all edits of small conversations, in blocks, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from release_guard.llm import queries
from release_guard.llm.conversations import COUNTS, Program, damaged, repair, settle

COLUMNS = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "" if shown and shown[-1] in ".!?" else "truncated"
        fault = "duplicate" if (role, text) in seen else fault
        found.append("blank" if not shown else fault)
        seen.add((role, text))
    return found


def all_edits(rows, found, most):
    """Every sequence of edits with its cost up to `most`, as (cost, audit, lines)."""
    def go(i, cost, audit, lines):
        if cost > most:
            return
        initials = "".join(line[0][:1] or "-" for line in lines)
        if not re.fullmatch(r"s?(ua)*u?|", initials):
            return
        if i == len(rows) and FORM.fullmatch(initials):
            yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
        for role in ("user", "assistant"):
            yield from go(i, cost + 3, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            yield from go(i + 1, cost + 4, audit + "D", lines)
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                yield from go(i + 1, cost + more, audit + "K", [*lines, (role, text)])
                for other in ("user", "assistant"):
                    yield from go(i + 1, cost + more + 3, audit + "R", [*lines, (other, text)])

    return list(go(0, 0, "", []))


def expected(rows, cost):
    """The result of one conversation whose cheapest edits cost `cost`, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    best = min(all_edits(rows, found, cost))
    turns = {r[0] for r in rows} - {None}
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: found.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": best[0],
        "audit": best[1],
        "repaired_sha256": hashlib.sha256(best[2].encode()).hexdigest(),
    }


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "user"])
            text = rng.choice(["One.", "Two!", "Three? ", "cut", " ", "", "Four.\n", f"Own {turn}.", "x "])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def test_cheapest_edits_against_all_edits(spark):
    rows = conversations(1, 80, 5)
    found = {r["conv_id"]: r.asDict() for r in repair(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert len(found) == 80
    for conv, got in found.items():
        del got["conv_id"]
        assert got == expected([r[1:] for r in rows if r[0] == conv], got["cost"]), conv


def test_no_edits_are_cheaper():
    rng = random.Random(2)
    for _ in range(60):
        kinds = [(rng.choice("suax"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(0, 4))]
        program, pointers = Program(), b""
        for kind in kinds:
            pointers += program.row(*kind)
        cost, state, inserted = program.end()
        rows = [(0, initial, "") for initial, _ in kinds]
        found = all_edits(rows, [fault for _, fault in kinds], cost)
        edits, start = settle(pointers, state)
        audit = "".join("I" * n + e for n, e in edits) + "I" * inserted
        assert (cost, audit) == min(found)[:2] and start == 0


@pytest.mark.parametrize(("rows", "chars"), [(1, 1 << 20), (2, 1 << 20), (7, 1 << 20), (1000, 3)])
def test_blocks_change_nothing(spark, rows, chars):
    given = spark.createDataFrame(conversations(3, 60, 12), COLUMNS).repartition(4)
    whole = sorted(map(str, repair(given).collect()))
    assert whole == sorted(map(str, repair(given, block_rows=rows, block_chars=chars).collect()))


def test_long_conversation_in_blocks(spark):
    rows = spark.range(30_000).selectExpr(
        "7 as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('Row ', id, if(id % 5 = 0, '', '.')) as text"
    )
    (small,) = repair(rows, block_rows=1000).collect()
    (large,) = repair(rows, block_rows=100_000).collect()
    assert small == large and len(small["audit"]) >= 30_000 and small["truncated"] == 6_000


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (2, 5, "user", "A."), (2, 5, "assistant", "B."),
        (2, 5, "user", "A."), (3, 0, "user", "x" * 100_000 + "."), (3, 9, "assistant", "漢字.　"), (4, -5, "u", "Hi."), (4, 2**40, "a", "Ho."),
    ]
    columns = COLUMNS + ", gaps long, cost long, audit string, block long, fault string, edits string"
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z") for r in rows], columns)
    found = {r["conv_id"]: r.asDict() for r in repair(df).collect()}
    for conv in (None, 1, 2, 3, 4):
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        got = found[conv]
        assert {k: got[k] for k in got if k != "conv_id"} == expected(own, got["cost"]), conv
    assert found[4]["gaps"] == 2**40 + 5 + 1 - 2 and found[3]["truncated"] == 1
    assert repair(spark.createDataFrame([], COLUMNS)).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x", True), (1, 2, "user", "y", None), (2, 1, "user", "x", True)], COLUMNS + ", gone boolean")
    found = {r["conv_id"]: r for r in repair(gone).collect()}
    assert [found[2][c] for c in COUNTS] == [0] * 6 and (found[2]["audit"], found[2]["repaired_sha256"]) == ("", EMPTY)
    assert found[1]["truncated"] == 1 and found[1]["illegal"] == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b? C!") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    found = [tuple(r) for r in damaged(spark.createDataFrame(rows, COLUMNS)).collect()]
    wanted = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {0: "", 1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        wanted += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_query_returns_every_conversation(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, sf_dir).count() == given.select("conv_id").distinct().count()
