"""The command log as a stream: status machine and apply-once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contactmill import vocab

STEP = "command_id long, event_id long, ts timestamp, previous string, status string, legal boolean"


class CommandStates(StatefulProcessor):
    """Keeps the last status per command, the final one too; emits every step with its verdict."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        steps = sorted(step for part in rows for step in zip(part["ts"], part["event_id"], part["status"]))
        out = []
        for ts, event_id, status in steps:
            out.append((key[0], event_id, ts, before, status, status in _allowed(before)))
            before = status
        if before is not None:
            self.last.update((before,))
        yield pd.DataFrame(out, columns=["command_id", "event_id", "ts", "previous", "status", "legal"])

    def close(self) -> None:
        pass


class OrderedCommandStates(StatefulProcessor):
    """Holds the steps of a command until the watermark has passed them, and judges them in order of event time.

    A timer stands at the earliest step that waits. When it fires, every step up to the watermark is released: no
    earlier one can come any more. A finished command is forgotten ``keep_ms`` of event time after its last step.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, status string")
        self.last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        come = [
            (at, event_id, status)
            for part in rows
            for at, event_id, status in zip(part["ts"].astype("datetime64[us]").astype("int64").tolist(), part["event_id"].tolist(), part["status"])
        ]
        if come:
            self.waiting.appendList(come)
            self._wake(min(at for at, _, _ in come))
        # Nothing is released here; a table without rows for every command would cost more than its steps.
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(at), int(event_id), status) for at, event_id, status in self.waiting.get()) if self.waiting.exists() else []
        ready = [step for step in held if _up(step[0]) <= passed]
        before, seen = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for at, event_id, status in ready:
            out.append((key[0], event_id, pd.Timestamp(at, unit="us"), before, status, status in _allowed(before)))
            before, seen = status, at
        if ready:
            self.last.update((before, seen))
            self.waiting.clear()
            if len(held) > len(ready):
                self.waiting.put(held[len(ready):])
        if len(held) > len(ready):
            self._wake(held[len(ready)][0])
        elif before is not None and not vocab.ALLOWED_TRANSITIONS.get(before):
            gone = _up(int(seen)) + self.keep_ms
            if gone <= passed:
                self.last.clear()
            else:
                self.handle.registerTimer(gone)
        if out:
            yield _steps(out)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(_up(at))

    def close(self) -> None:
        pass


def _up(micros: int) -> int:
    """Microseconds as whole milliseconds, rounded up: what a watermark is counted in."""
    return -(-micros // 1000)


def _allowed(before: str | None) -> tuple:
    return ("received",) if before is None else vocab.ALLOWED_TRANSITIONS.get(before, ())


def _steps(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["command_id", "event_id", "ts", "previous", "status", "legal"])
    return made.astype({"command_id": "int64", "event_id": "int64", "ts": "datetime64[ns]", "legal": "bool"})


def stream_ordered_command_state(events: DataFrame, lateness: str = "1 day", keep_days: float = 7) -> DataFrame:
    """Steps of each command in order of event time, however they arrive, judged as in the batch ``illegal_transitions``.

    A step is given out once the watermark (latest ``ts`` seen, less ``lateness``) has passed it; ties follow
    ``event_id``. Within ``lateness`` steps may come in any order, in any files and micro-batches. Spark drops a step that
    comes later than that and counts it in the query's progress (``numRowsDroppedByWatermark``). A finished command is
    forgotten ``keep_days`` of event time after its last step: a step within that time is judged as one after the end, a
    later one as the first of a new command. Unfinished commands are kept. The last steps of a source that has ended
    come out when a later event, of any command, moves the watermark.

    Needs the RocksDB state store provider. ``ts`` must be a timestamp with the session zone.
    """
    return events.withWatermark("ts", lateness).groupBy("command_id").transformWithStateInPandas(
        statefulProcessor=OrderedCommandStates(round(keep_days * 86_400_000)), outputStructType=STEP, outputMode="Append", timeMode="EventTime",
    )


def stream_command_state(events: DataFrame, ttl_days: float | None = None) -> DataFrame:
    """Steps of each command as they arrive, judged by the same rule as the batch ``illegal_transitions``.

    For steps that arrive out of order see ``stream_ordered_command_state``.

    Steps of one micro-batch are put in order of time; one that arrives in a
    later micro-batch is judged after those before it; none is dropped. Nothing is
    legal after a final status, so the last status of every command is kept: for
    ever, or for ``ttl_days`` after its last step by the clock of the job. With a
    ``ttl_days`` the query needs a trigger that runs on (not ``availableNow``), and a step
    after that time is judged as the first of a new command.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB
    provider. ``ts`` must be a timestamp with the session zone.
    """
    return (
        events.groupBy("command_id")
        .transformWithStateInPandas(
            statefulProcessor=CommandStates(None if ttl_days is None else round(ttl_days * 86_400_000)),
            outputStructType=STEP,
            outputMode="Append",
            timeMode="None" if ttl_days is None else "ProcessingTime",
        )
    )


def stream_dedupe_apply(commands: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each command id once within the lateness window."""
    return commands.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["command_id"])


def read_event_stream(
    spark, folder: str, schema, glob: str = "*.parquet", max_bytes: int = 1 << 30
) -> DataFrame:
    """Event files as a stream with ``ts`` as a zoned timestamp.

    ``max_bytes`` bounds a micro-batch, and with it what one command can bring
    to its task at a time.
    """
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxBytesPerTrigger", max_bytes)
        .parquet(folder)
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))
