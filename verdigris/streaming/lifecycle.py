"""Runs as keyed state of a stream: changes of status that are allowed, retries after a timer, pauses.

Each run has a row of state: its status, how often it was tried, and which
attempt a timer belongs to.  Commands come in order of their number; one that the
status doesn't allow changes nothing and is handed on as refused.  A failure with
attempts left sets a timer with a doubling delay, and the run starts again when
it is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Command to the statuses in which it is allowed, and the status that it leads to.
COMMANDS = {
    "start": ({"pending"}, "running"),
    "complete": ({"running"}, "completed"),
    "fail": ({"pending", "running", "paused", "waiting"}, "failed"),
    "error": ({"running"}, "waiting"),
    "pause": ({"running", "waiting"}, "paused"),
    "resume": ({"paused"}, "running"),
}
FIRST = "pending"
OUTPUT = "run_id string, n long, command string, before string, after string, accepted boolean, attempt int, retry_at long"


def step(status: str, attempt: int, command: str, attempts: int) -> tuple[str, int, bool]:
    """Status and attempt after a command, and whether it was allowed."""
    allowed, after = COMMANDS.get(command, (frozenset(), status))
    if status not in allowed:
        return status, attempt, False
    if command == "start":
        return after, 1, True
    if command == "error" and attempt >= attempts:
        return "failed", attempt, True
    return after, attempt, True


class Lifecycle(StatefulProcessor):
    def __init__(self, attempts: int, delay_ms: int) -> None:
        self.attempts, self.delay_ms = attempts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, attempt int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempt, due = self.state.get() if self.state.exists() else (FIRST, 0, 0)
        out = []
        commands = sorted((r for batch in rows for r in zip(batch["n"].tolist(), batch["command"].tolist(), strict=True)), key=lambda r: (r[0], str(r[1])))
        for n, command in commands:
            before = status
            status, attempt, accepted = step(status, attempt, command, self.attempts)
            if accepted and due:  # whatever happens to a waiting run takes its timer away
                self.handle.deleteTimer(due)
                due = 0
            if accepted and status == "waiting":
                due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms * 2 ** (attempt - 1)
                self.handle.registerTimer(due)
            out.append((key[0], n, command, before, status, accepted, attempt, due or None))
        self.state.update((status, attempt, due))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempt, due = self.state.get()
        if status != "waiting" or due != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.state.update(("running", attempt + 1, 0))
        yield _frame([(key[0], None, "retry", status, "running", True, attempt + 1, None)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])
    return out.astype({"n": "Int64", "attempt": "Int32", "retry_at": "Int64"})


def lifecycle(commands: DataFrame, *, attempts: int = 3, delay_ms: int = 800) -> DataFrame:
    """Changes of status of runs from a stream of commands (run_id, n, command).

    Every command is a row, accepted or not; so is each retry that a timer starts.
    A null run_id is a run of its own.  The session needs the RocksDB state store.
    """
    return commands.groupBy("run_id").transformWithStateInPandas(Lifecycle(attempts, delay_ms), OUTPUT, "append", "processingTime")
