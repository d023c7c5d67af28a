"""Repair of a conversation's structure by the cheapest edits, in one pass over its sorted rows.

Rows are repartitioned by conversation and sorted by turn; a task reads them as Arrow batches and
carries the state of a dynamic program from batch to batch. A conversation's roles must read
``(s?(ua)+)?``, an automaton with the states *empty*, *s*, *u* and *a*. For each state the program
keeps the least cost of bringing the rows so far there, the rank of the state's edits among those of
the other states in the order of their letters, and a running hash of the repaired text. So texts are
read once and never kept. What is kept per row is one number, the step taken; beyond ``KEPT_STEPS``
these go to an unnamed file of the task (as Spark's own spills do, gone with the task) and are read
backwards in the end. Digests of the rows seen are kept in the same way.

Costs relative to the cheapest state, and the ranks, take few values, so each step is looked up in a
table that fills while it is used. Two edit texts of different states that reach the same row differ
at some letter, since either ends with an edit of that row: comparing ranks and the step's own
letters therefore orders the longer texts, and keeping the least for each state keeps the least.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Steps, and digests, that one conversation keeps in memory.
KEPT_STEPS = 1 << 20
# Costs of the edits and the added cost of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 2, 3, 2, 1
EMPTY, S, U, A = range(4)
_INF = 1 << 60
#: Where a kept initial leads from a state, and where the one role that may be put in leads.
_KEPT = {(EMPTY, "s"): S, (EMPTY, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
_PUT = {EMPTY: U, S: U, U: A, A: U}
_ROLE = {U: "user", A: "assistant"}
_START = ((0, _INF, _INF, _INF), (0, 1, 2, 3))
#: Faults, the first that applies; the last is none.
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows after damage: ``conv, turn, role, text`` and ``lost`` for a row that is dropped.

    The CRC-32 of ``conv:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes
    ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes it the user's. A null conversation,
    turn, role or text reads as one space there and in role and text; nulls of the conversation and
    the turn remain nulls. A dropped row stays as a mark of its conversation.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    body = F.when(kind < 2, F.lit("")).when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space(role)).alias("role"), body.alias("text"), (kind == 0).alias("lost"),
        F.explode(times).alias("__copy"),
    ).drop("__copy")


def step(costs: tuple, ranks: tuple, initial: str, fault: int) -> tuple[tuple, tuple, int, tuple]:
    """One row: new costs relative to the least, new ranks, that least, and each state's move.

    A move is (state before, letters of the edits, number of inserts), or None.
    """
    best: list[tuple | None] = [None] * 4
    for before in range(4):
        if costs[before] >= _INF:
            continue
        state, put = before, 0
        while put <= 2:  # a third insert returns to a state that one insert reaches
            spent = costs[before] + INSERT * put
            ways = [(DELETE, "D", state)]
            if fault in (TRUNCATED, SOUND):
                stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
                ways.append((REROLE + stays, "R", _PUT[state]))
                if (state, initial) in _KEPT:
                    ways.append((stays, "K", _KEPT[state, initial]))
            for cost, letter, to in ways:
                found = (spent + cost, ranks[before], "I" * put + letter, before, put)
                if best[to] is None or found < best[to]:
                    best[to] = found
            state, put = _PUT[state], put + 1
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
    place = {s: i for i, (_, _, s) in enumerate(order)}
    return (
        tuple(b[0] - least if b else _INF for b in best), tuple(place.get(s, 4) for s in range(4)), least,
        tuple((b[3], b[2], b[4]) if b else None for b in best),
    )


def close(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """The end: (cost, state, inserts) of the cheapest way to an accepting state."""
    ends = []
    for before in range(4):
        state = before
        for put in range(3):
            if costs[before] < _INF and state in (EMPTY, A):
                ends.append((costs[before] + INSERT * put, ranks[before], put, before))
                break
            state = _PUT[state]
    cost, _, put, state = min(ends)
    return cost, state, put


class Steps:
    """Numbers added one by one and read backwards; only the last of them are kept in memory."""

    def __init__(self, kept: int = KEPT_STEPS) -> None:
        self.kept, self.part, self.file, self.parts = kept, array("I"), None, 0

    def add(self, number: int) -> None:
        self.part.append(number)
        if len(self.part) >= self.kept:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.part.tofile(self.file)
            self.part, self.parts = array("I"), self.parts + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.part)
        for i in range(self.parts - 1, -1, -1):
            self.file.seek(i * self.kept * self.part.itemsize)
            part = array("I")
            part.fromfile(self.file, self.kept)
            yield from reversed(part)


class Seen:
    """The rows of a conversation by 128-bit digest; beyond ``kept`` they lie sorted in a file."""

    def __init__(self, kept: int = KEPT_STEPS) -> None:
        self.kept, self.now, self.runs = kept, set(), []

    def add(self, digest: bytes) -> bool:
        """Whether the digest was there before."""
        if digest in self.now:
            return True
        for run in self.runs:
            at = bisect_left(run, digest, key=bytes)
            if at < len(run) and bytes(run[at]) == digest:
                return True
        self.now.add(digest)
        if len(self.now) >= self.kept:
            self._write()
        return False

    def _write(self) -> None:
        file = tempfile.TemporaryFile()
        for digest in sorted(self.now):
            file.write(digest)
        file.flush()
        self.runs.append(np.memmap(file, "V16", "r"))
        self.now = set()


@dataclass
class Conversation:
    """What is known of a conversation after some of its rows."""

    kept: int = KEPT_STEPS
    costs: tuple = _START[0]
    ranks: tuple = _START[1]
    spent: int = 0
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    hashes: list = field(default_factory=lambda: [hashlib.sha256()] * 4)

    def __post_init__(self) -> None:
        self.steps, self.seen = Steps(self.kept), Seen(self.kept)

    def row(self, table: Table, turn: int | None, role: str, text: str, blank: bool, ended: bool) -> None:
        """The next row in order: its text, whether that is blank and whether it ends a sentence."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        body = text.encode("utf-8", "surrogatepass")
        name = role.encode("utf-8", "surrogatepass")
        again = self.seen.add(hashlib.blake2b(b"%d:" % len(name) + name + body, digest_size=16).digest())
        fault = BLANK if blank else DUPLICATE if again else SOUND if ended else TRUNCATED
        self.faults[fault] += 1
        number, self.costs, self.ranks, least, moves = table.look(self.costs, self.ranks, initial, fault)
        self.spent += least
        self.steps.add(number)
        before, after = self.hashes, [None] * 4
        for to, move in enumerate(moves):
            if move is None:
                continue
            came, letters, put = move
            if letters == "D":
                after[to] = before[came]
                continue
            h, state = before[came].copy(), came
            for _ in range(put):
                state = _inserted(h, state)
            if letters[-1] != "D":
                h.update(b"\n" if state != EMPTY else b"")
                h.update((name if letters[-1] == "K" else _ROLE[to].encode()) + b":" + body)
            after[to] = h
        self.hashes = after

    def result(self, table: Table) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of the whole conversation."""
        cost, state, put = close(self.costs, self.ranks)
        h, at = self.hashes[state].copy(), state
        for _ in range(put):
            at = _inserted(h, at)
        audit = bytearray(b"I" * put)
        for number in self.steps.backwards():
            state, letters, _ = table.moves[number][state]
            audit += letters[::-1].encode()
        audit.reverse()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = gaps if gaps < 1 << 63 else None
        return gaps, *self.faults[:3], self.illegal, self.spent + cost, audit.decode(), h.hexdigest()


def _inserted(h, state: int) -> int:
    to = _PUT[state]
    h.update((b"\n" if state != EMPTY else b"") + _ROLE[to].encode() + b":")
    return to


class Table:
    """The steps met so far, each worked out once and then looked up; ``moves`` by their number."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.moves: list[tuple] = []

    def look(self, costs: tuple, ranks: tuple, initial: str, fault: int) -> tuple:
        key = costs, ranks, initial if initial in ("s", "u", "a") else "", fault if fault > DUPLICATE else BLANK
        found = self.known.get(key)
        if found is None:
            costs, ranks, least, moves = step(*key)
            found = self.known[key] = (len(self.moves), costs, ranks, least, moves)
            self.moves.append(moves)
        return found


_RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(kept: int):
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, key, now = Table(), None, None
        for batch in batches:
            done = []
            columns = [batch[c].tolist() for c in ("conv", "turn", "no_turn", "role", "text", "lost", "blank", "ended")]
            for conv, turn, no_turn, role, text, lost, blank, ended in zip(*columns):
                if now is None or conv != key:
                    if now is not None:
                        done.append((key, *now.result(table)))
                    key, now = conv, Conversation(kept)
                if not lost:
                    now.row(table, None if no_turn else turn, role, text, blank, ended)
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([(key, *now.result(table))], columns=names)

    return run


def repair(
    rows: DataFrame, conv: str, turn: str, role: str, text: str, lost: Column | None = None, kept_steps: int = KEPT_STEPS
) -> DataFrame:
    """The faults, the cheapest edits and the repaired text's hash of every conversation.

    Rows of a conversation are taken by turn, nulls first; rows of one turn by role and text. Returns
    ``conv`` under its own name, ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. ``lost`` marks rows that are no longer there but whose conversation is to appear.

    * A row's first fault counts: blank, duplicate (role and text as in an earlier row), truncated
      (the last character that is no white space is none of ``.!?``).
    * ``audit`` has the letters of the edits in order: Keep, Rerole, Delete, Insert. Of equally cheap
      edits the one whose letters come first is taken. Letters tell roles, since only one role can
      be put in at any place, so the repaired text follows from them.
    * A null role or text reads as one space, a null conversation is one of its own, and a null turn
      counts for no gap. ``gaps`` is null if turns span more than 63 bits.
    * A conversation all of whose rows are lost has zeros, an empty audit and the hash of nothing.
    * Repeated rows are duplicates; an empty table gives no rows; other columns have no effect.

    A conversation is one task's stream, since its hash runs over its text in order; what the task
    holds is bounded whatever the conversation's length, but for the audit, which is a cell of the result.
    """
    kind = rows.schema[conv].dataType
    of = lambda c: F.col(f"`{c}`")
    own = rows.select(
        of(conv).cast("string").alias("conv"), F.coalesce(of(turn).cast("long"), F.lit(0)).alias("turn"), of(turn).isNull().alias("no_turn"),
        F.coalesce(of(role), F.lit(" ")).alias("role"), F.coalesce(of(text), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(False) if lost is None else lost, F.lit(False)).alias("lost"),
    )
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    told = own.select("*", (F.length(visible) == 0).alias("blank"), F.substring(visible, -1, 1).isin(".", "!", "?").alias("ended"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = (
        told.repartition(tasks, "conv")
        .sortWithinPartitions("conv", F.desc("no_turn"), "turn", "role", "text")
        .mapInPandas(_stream(kept_steps), _RESULT)
    )
    return streamed.select(F.col("conv").cast(kind).alias(conv), *streamed.columns[1:])
