"""Ordered command logs as a stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SCHEMA = "case_id long, sequence long, command_id long, outcome string, drain long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARKED = struct.Struct("<qqq???")
_OUTCOME = Row("case_id", "sequence", "command_id", "outcome", "drain")


class CommandLog(StatefulProcessor):
    """The commands of one case: those whose turn has not come are parked under their sequence.

    The first ``AT_HAND`` of them lie in the value that says how far the case is, so a case is read once and written once a batch, whatever has
    come for it; each call of the state goes to the engine and back. What is beyond lies in a map, so this value stays small.
    """

    AT_HAND = 64

    def __init__(self, per_drain: int, patience_ms: int | None):
        self.per_drain, self.patience_ms = per_drain, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "settled long, last long, stuck boolean, beyond long, near binary")
        self.parked = handle.getMapState("parked", "sequence long", "command_id long, predecessor long, refuse boolean, again boolean")

    @staticmethod
    def _packed(near: dict[int, tuple]) -> bytes:
        return b"".join(_PARKED.pack(sequence, command, predecessor or 0, predecessor is None, refuse, again) for sequence, (command, predecessor, refuse, again) in near.items())

    def _read(self) -> tuple[int, int | None, bool, int, dict[int, tuple]]:
        settled, last, stuck, beyond, near = self.at.get() or (0, None, False, 0, b"")
        return settled, last, stuck, beyond, {s: (command, None if first else predecessor, refuse, again) for s, command, predecessor, first, refuse, again in _PARKED.iter_unpack(bytes(near))}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        settled, last, stuck, beyond, near = self._read()

        def held(sequence: int) -> tuple | None:
            return near.get(sequence) or (self.parked.getValue((sequence,)) if beyond else None)

        for _, sequence, command, predecessor, refuse in rows:
            if sequence <= settled:
                # The last sequence claimed by another command breaks the log; an earlier one is taken for a repeat.
                stuck = stuck or (sequence == settled and command != last)
                continue
            before, now = held(sequence), (command, predecessor, refuse, False)
            if before is not None:
                if before[0] == command:
                    continue
                now = (*min(before[:3], now[:3], key=lambda c: c[0]), True)
            if sequence in near or (before is None and len(near) < self.AT_HAND):
                near[sequence] = now
            else:
                self.parked.updateValue((sequence,), now)
                beyond += before is None
        done = []
        while not stuck and (turn := held(settled + 1)):
            command, predecessor, refuse, again = turn
            if predecessor != last:
                break
            settled, last, stuck = settled + 1, command, again
            if near.pop(settled, None) is None:
                self.parked.removeKey((settled,))
                beyond -= 1
            done.append(_OUTCOME(key[0], settled, command, "refused" if refuse else "applied", (settled - 1) // self.per_drain + 1))
        self.at.update((settled, last, stuck, beyond, self._packed(near)))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if near or beyond:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from done

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        *_, beyond, near = self._read()
        waiting = [(sequence, command[0]) for sequence, command in near.items()]
        if beyond:
            waiting += [(place[0], command[0]) for place, command in self.parked.iterator()]
        for sequence, command in sorted(waiting):
            yield _OUTCOME(key[0], sequence, command, "pending", None)

    def close(self) -> None:
        pass


def apply_as_they_come(commands: DataFrame, per_drain: int = 32, patience: str | None = None) -> DataFrame:
    """Stream: ``case_id, sequence, command_id, predecessor, refuse`` in any order -> outcomes as in ``cases.apply_in_order``, each once.

    A command is settled when it has the next sequence of its case and names the command settled before it; a refusal takes its sequence. What comes
    early is parked in the state of its case, and a late predecessor releases all that waits for it, in one batch, counted in drains of
    ``per_drain``. A wrong predecessor, or a sequence that two commands claim, stops the case behind it. Parked commands are reported as
    ``pending`` when nothing has come for the case for ``patience``; they stay parked, and are settled if their turn still comes. (A stream with
    such timers never ends by itself, so give none to one that is to stop at the end of its input.) A command that is
    delivered twice counts once. The session needs ``keyed_state`` while the query starts.
    """
    milliseconds = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)
    whole = commands.select("case_id", "sequence", "command_id", "predecessor", "refuse")
    return whole.groupBy("case_id").transformWithState(CommandLog(per_drain, milliseconds), SCHEMA, "append", "None" if patience is None else "ProcessingTime")


class keyed_state:
    """State stores that hold values, lists and maps by key, for queries that start within."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.before)


def with_pending(commands: DataFrame, settled: DataFrame) -> DataFrame:
    """Every command with its outcome so far: those that the stream has not settled are pending."""
    known = settled.filter("outcome <> 'pending'").select("case_id", "sequence", "command_id", "outcome", "drain")
    return commands.select("case_id", "sequence", "command_id").join(known, ["case_id", "sequence", "command_id"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
