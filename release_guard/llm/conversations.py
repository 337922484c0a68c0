"""Repair of conversations by the cheapest edits.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Rows are kept, given another role,
deleted, or preceded by inserted rows; a dynamic program over four states (nothing yet, after system, after
user, complete) finds the cheapest edits, and among those the string of edits that comes first in ASCII.

Rows are partitioned by conversation and sorted by turn; one pass streams over them and carries the state of
the program across Arrow batches. Strings of edits are never compared: after each row the four states keep
the rank of theirs, which decides with the next edit. A conversation of bounded size is finished in
memory. Of a longer one, blocks of rows with their backpointers (four bytes a row) are written to the shared
scratch folder; a second pass reads the blocks from the last to the first and settles the edits, a third one
reads them forward and makes the digest. So a task holds one block, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BLANKS = " \t\n\x0b\x0c\r"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
ENDS = ".!?"
# Rows and characters of a block; a conversation that fits in one block stays in memory.
BLOCK_ROWS = 10_000
BLOCK_CHARS = 4 << 20
RESULT_ROWS = 2_000

# Cost of each edit, and what a truncated row adds unless it is deleted.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
START, SYSTEM, USER, COMPLETE = range(4)
NEVER = 1 << 60
# The state after a row of each role; rows that are inserted or get another role go the way of user and assistant.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (COMPLETE, "u"): USER, (USER, "a"): COMPLETE}
NEEDED = {START: "u", SYSTEM: "u", COMPLETE: "u", USER: "a"}
ROLES = {"u": "user", "a": "assistant"}


def steps(initial: str, fault: str) -> list[list[tuple[int, int, str, int]]]:
    """For each state after a row: (state before, inserted rows, edit, cost) of all ways to reach it."""
    ways: list[list[tuple[int, int, str, int]]] = [[] for _ in range(4)]
    for source in range(4):
        state = source
        for inserted in range(3):
            paid = inserted * COSTS["I"]
            ways[state].append((source, inserted, "D", paid + COSTS["D"]))
            if fault not in ("blank", "duplicate"):
                paid += TRUNCATED if fault == "truncated" else 0
                if (state, initial) in AFTER:
                    ways[AFTER[state, initial]].append((source, inserted, "K", paid + COSTS["K"]))
                ways[AFTER[state, NEEDED[state]]].append((source, inserted, "R", paid + COSTS["R"]))
            state = AFTER[state, NEEDED[state]]
    return ways


STEPS = {(i, f): steps(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}
EDITS = "KRD"


def pointer(source: int, inserted: int, edit: str) -> int:
    """A way to reach a state as one byte."""
    return source | inserted << 2 | EDITS.index(edit) << 4


class Program:
    """The dynamic program over the rows of one conversation."""

    def __init__(self) -> None:
        self.cost = [0, NEVER, NEVER, NEVER]
        self.rank = [0, 0, 0, 0]

    def row(self, initial: str, fault: str) -> bytes:
        """Go over one row; the backpointers of the four states after it."""
        reached = []
        for ways in STEPS[initial if initial in ("s", "u", "a") else "", fault]:
            least = min(
                (self.cost[source] + cost, self.rank[source], "I" * inserted + edit, source, inserted, edit)
                for source, inserted, edit, cost in ways
            ) if ways else (NEVER, 0, "", 0, 0, "D")
            reached.append(least)
        order = sorted({r[1:3] for r in reached if r[0] < NEVER})
        self.cost = [min(r[0], NEVER) for r in reached]
        self.rank = [order.index(r[1:3]) if r[0] < NEVER else 0 for r in reached]
        return bytes(pointer(*r[3:]) for r in reached)

    def end(self) -> tuple[int, int, int]:
        """Cost, last state and rows inserted after the last row of the cheapest edits."""
        ways = []
        for state in range(4):
            last = state
            for inserted in range(3):
                if last in (START, COMPLETE) and self.cost[state] < NEVER:
                    ways.append((self.cost[state] + inserted * COSTS["I"], self.rank[state], "I" * inserted, state, inserted))
                last = AFTER[last, NEEDED[last]]
        cost, _, _, state, inserted = min(ways)
        return cost, state, inserted


def settle(pointers: bytes, state: int) -> tuple[list[tuple[int, str]], int]:
    """Follow the backpointers of a block from the state after it: per row (inserted rows, edit), and the state before."""
    edits: list[tuple[int, str]] = []
    for at in range(len(pointers) - 4, -1, -4):
        byte = pointers[at + state]
        edits.append((byte >> 2 & 3, EDITS[byte >> 4]))
        state = byte & 3
    return edits[::-1], state


class Writer:
    """Carries out the edits in order: the audit and the digest of the repaired conversation."""

    def __init__(self) -> None:
        self.state, self.lines, self.audit, self.digest = START, 0, [], hashlib.sha256()

    def _line(self, role: str, text: str, initial: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = AFTER[self.state, initial]

    def insert(self, rows: int) -> None:
        for _ in range(rows):
            initial = NEEDED[self.state]
            self._line(ROLES[initial], "", initial)
        self.audit.append("I" * rows)

    def rows(self, roles: list[str], texts: list[str], edits: list[tuple[int, str]]) -> None:
        for role, text, (inserted, edit) in zip(roles, texts, edits, strict=True):
            if inserted:
                self.insert(inserted)
            if edit == "K":
                self._line(role, text, role[:1])
            elif edit == "R":
                self._line(ROLES[NEEDED[self.state]], text, NEEDED[self.state])
            self.audit.append(edit)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join([*[f"{name} long" for name in COUNTS], "audit string", "repaired_sha256 string"])
BLOCK = "block long, roles array<string>, texts array<string>, pointers binary, last_state int, last_inserted int"


class Conversation:
    """What the pass over one conversation carries along: counts, the program, and the rows of the current block."""

    def __init__(self, limits: tuple[int, int]) -> None:
        self.limits = limits
        self.count = dict.fromkeys(COUNTS, 0)
        self.program = Program()
        self.before: str | None = None
        self.first_turn: int | None = None
        self.turn: int | None = None
        self.turns = self.blocks = 0
        self.clear()

    def clear(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.pointers = bytearray()
        self.chars = 0

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.before = initial
        self.pointers += self.program.row(initial, fault)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.roles) >= self.limits[0] or self.chars >= self.limits[1]

    def block(self) -> dict[str, Any]:
        made = {"block": self.blocks, "roles": self.roles, "texts": self.texts, "pointers": bytes(self.pointers)}
        self.blocks += 1
        self.clear()
        return made

    def finish(self) -> dict[str, Any]:
        """The result, or with blocks written before the last block and the counts."""
        cost, state, inserted = self.program.end()
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        found = {**self.count, "cost": cost, "gaps": gaps}
        if self.blocks:
            return {**found, **self.block(), "last_state": state, "last_inserted": inserted}
        edits, _ = settle(bytes(self.pointers), state)
        writer = Writer()
        writer.rows(self.roles, self.texts, edits)
        writer.insert(inserted)
        return {**found, "audit": "".join(writer.audit), "repaired_sha256": writer.digest.hexdigest()}


def with_faults(rows: DataFrame) -> DataFrame:
    """Add the first fault of each row: '', blank, duplicate or truncated.

    The rows must be partitioned by conversation; a row is a duplicate if role and text were seen earlier.
    """
    copies = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(~F.col("text").rlike(NOT_BLANK), "blank")
        .when(F.row_number().over(copies) > 1, "duplicate")
        .when(~F.substring(shown, -1, 1).isin(*ENDS), "truncated")
        .otherwise("")
    )
    return rows.withColumn("fault", F.when(F.col("gone"), "").otherwise(fault))


def _schema(key: str) -> str:
    return f"conv_id {key}, {RESULT}, {BLOCK}"


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn, role and text; null role and text count as one space. A boolean column `gone` marks
    rows that only say that their conversation exists. Rows of one turn are ordered by role and text. Rows
    without conv_id are one conversation, rows without turn come first. Without rows the counts are 0, the
    audit is empty and the digest is that of the empty text. Other columns are ignored.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    gone: Column = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, gone.alias("gone"))
    key = read.schema["conv_id"].dataType.simpleString()
    limits = (block_rows, block_chars)
    schema = _schema(key)
    empty = read.sparkSession.createDataFrame([], schema).schema

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(empty)
        made: list[dict] = []
        current: Conversation | None = None
        of: Any = None
        chars = 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "fault")]
            for conv, turn, role, said, left_out, fault in zip(*columns, strict=True):
                if current is None or conv != of:
                    if current is not None:
                        made.append({"conv_id": of, **current.finish()})
                    current, of = Conversation(limits), conv
                if left_out:
                    continue
                if current.full():
                    made.append({"conv_id": of, **current.block()})
                    chars += block_chars
                current.row(turn, role, said, fault)
                if len(made) >= RESULT_ROWS or chars >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, chars = [], 0
        if current is not None:
            made.append({"conv_id": of, **current.finish()})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    # Of equal rows of a turn the first one seen comes first.
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == "duplicate"]
    placed = with_faults(read.repartition("conv_id")).sortWithinPartitions(*order)
    passed = stored(placed.mapInArrow(first_pass, schema), "conversations")
    result = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    short = passed.where("block is null").select(*result)
    return short.unionByName(_long(passed.where("block is not null"), key).select(*result))


def _long(blocks: DataFrame, key: str) -> DataFrame:
    """The results of conversations that were written in blocks."""
    edited = f"conv_id {key}, {RESULT}, {BLOCK}, edits string"
    settled_type = blocks.sparkSession.createDataFrame([], edited).schema

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(settled_type)
        state = 0
        for batch in batches:
            for row in batch.to_pylist():
                # The last block comes first and says where the cheapest edits end.
                state = state if row["last_state"] is None else row["last_state"]
                edits, state = settle(row["pointers"], state)
                written = "".join(f"{inserted}{edit}" for inserted, edit in edits)
                yield pa.RecordBatch.from_pylist([{**row, "pointers": None, "edits": written}], schema=arrow)

    def third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(settled_type)
        writer = Writer()
        for batch in batches:
            for row in batch.to_pylist():
                edits = [(int(row["edits"][i]), row["edits"][i + 1]) for i in range(0, len(row["edits"]), 2)]
                writer.rows(row["roles"], row["texts"], edits)
                if row["last_state"] is None:
                    continue
                writer.insert(row["last_inserted"])
                found = {"audit": "".join(writer.audit), "repaired_sha256": writer.digest.hexdigest()}
                kept = {name: row[name] for name in ("conv_id", *COUNTS)}
                yield pa.RecordBatch.from_pylist([{**kept, **found}], schema=arrow)
                writer = Writer()

    backward = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    settled = backward.mapInArrow(second_pass, edited)
    return settled.sortWithinPartitions("conv_id", "block").mapInArrow(third_pass, edited)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, decided by a checksum of `conv_id:turn`; nulls count as one space.

    0 drops a row (it stays, marked gone), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(name.cast("binary")) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    changed = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")
