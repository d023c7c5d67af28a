"""Alerts for steps whose computed due time has passed.

Due times are never stored: a send moves the time of the step after it. The processor keeps
one state value per sequence, with its steps and the timer for the next pending one; every
change of the sequence replaces the timer. A visit to a sequence reads and writes that value
once, because each call to the state store is a message between Python and the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import vocab

#: Times are microseconds here; ``due_alerts`` gives timestamps.
ALERT = "seq string, sequence_step int, due_us long"
_STATE = "timer long, steps string"
_DAY_US = 86_400_000_000

#: Of a step: offset in days, when it was created and sent, its status, whether it has alerted.
Steps = dict[int, list]


def next_due(steps: Steps) -> tuple[int, int] | None:
    """The lowest pending step and when it is due, or none; also none if no time of creation is known."""
    cursor = min((created for _, created, _, _, _ in steps.values() if created is not None), default=None)
    if cursor is None:
        return None
    for number in sorted(steps):
        offset, _, sent, status, _ = steps[number]
        cursor += offset * _DAY_US
        if status in vocab.PENDING_STATUSES:
            return number, cursor
        cursor = cursor if sent is None else sent
    return None


class DueAlerts(StatefulProcessor):
    """Input rows carry the step's new facts: ``seq, sequence_step, day_offset, created_us, sent_us, status``."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sequence", _STATE)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        timer, steps = self._load()
        for row in rows:
            facts = [row.day_offset, row.created_us, row.sent_us, row.status]
            known = steps.get(row.sequence_step)
            # new facts may alert anew, a repeated row may not
            steps[row.sequence_step] = [*facts, known is not None and known[:4] == facts and known[4]]
        due = next_due(steps)
        wanted = due[1] // 1000 if due and not steps[due[0]][4] else None
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self._store(wanted, steps)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, steps = self._load()
        due = next_due(steps)
        if due is None or steps[due[0]][4]:
            return
        number, at = due
        steps[number][4] = True
        self._store(None, steps)
        yield Row(seq=key[0], sequence_step=number, due_us=at)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int | None, Steps]:
        value = self.state.get()
        if value is None:
            return None, {}
        return value[0], {int(number): step for number, step in json.loads(value[1]).items()}

    def _store(self, timer: int | None, steps: Steps) -> None:
        self.state.update((timer, json.dumps(steps)))


def due_alerts(changes: DataFrame, late: str) -> DataFrame:
    """``seq, sequence_step, due_at`` as event time passes each sequence's next due time.

    ``changes`` has ``seq, sequence_step, day_offset, created_at, sent_at, status,
    changed_at``. Needs the RocksDB state store.
    """
    facts = changes.withWatermark("changed_at", late).select(
        "seq", "sequence_step", "day_offset", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("sent_at").alias("sent_us"), "status", "changed_at",
    )
    found = facts.groupBy("seq").transformWithState(DueAlerts(), ALERT, "Append", "EventTime")
    return found.select("seq", "sequence_step", F.timestamp_micros("due_us").alias("due_at"))
