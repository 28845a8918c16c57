"""Answers and traces reduced by request on a stream of events, with state, a timeout and late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REDUCED = "request_id {kind}, answer string, steps array<string>, done boolean, timed_out boolean, late int"
_COLUMNS = ["request_id", "answer", "steps", "done", "timed_out", "late"]


def out_schema(kind: str) -> str:
    return REDUCED.format(kind=kind)


class RequestReducer(StatefulProcessor):
    """The state of one request: its events by number until it is closed, then only that it is.

    A request closes when its done event and all numbers before that one are there, in whatever order they came, or
    when the watermark has passed its last event by `timeout_ms`. Events after that are counted as late. What is kept of
    a closed request goes after another `timeout_ms`.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "type string, payload string")
        # Number of the done event (-1: not seen), of the events held, time of the last one, and whether the request is closed.
        self.about = handle.getValueState("about", "done_at long, held long, last_ms long, closed boolean")

    def _wait(self, until: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def _close(self, key: object, done_at: int, last: int, timed_out: bool) -> pd.DataFrame:
        found = sorted((int(k[0]), v[0], v[1]) for k, v in self.events.iterator())
        answer = "".join(p or "" for _, t, p in found if t == "answer_delta")
        steps = [p for _, t, p in found if t == "tool_call"]
        self.events.clear()
        self.about.update((done_at, 0, last, True))
        return pd.DataFrame([(key, answer, steps, done_at >= 0, timed_out, 0)], columns=_COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        done_at, held, last, closed = self.about.get() if self.about.exists() else (-1, 0, 0, False)
        late = 0
        for pdf in rows:
            for seq, kind, payload, ts in zip(pdf["seq"], pdf["type"], pdf["payload"], pdf["ts"], strict=True):
                if closed:
                    late += 1
                    continue
                at = (int(seq),)
                # A repeated event counts once.
                held += not self.events.containsKey(at)
                self.events.updateValue(at, (kind, payload))
                last = max(last, int(ts.timestamp() * 1000))
                done_at = int(seq) if kind == "done" else done_at
        if closed:
            yield pd.DataFrame([(key[0], None, None, None, None, late)], columns=_COLUMNS)
        elif done_at >= 0 and held == done_at + 1:
            self._wait(last + 2 * self.timeout_ms)
            yield self._close(key[0], done_at, last, False)
        else:
            self._wait(last + self.timeout_ms)
            self.about.update((done_at, held, last, False))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        done_at, _, last, closed = self.about.get()
        if closed:
            self.about.clear()
        else:
            self.handle.registerTimer(last + 2 * self.timeout_ms + 1)
            yield self._close(key[0], done_at, last, True)

    def close(self) -> None:
        pass


def reduce_stream(events: DataFrame, late: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """(request_id, answer, steps, done, timed_out, late) of a stream of events (request_id, seq from 0 on, type, payload, ts).

    A row when a request closes: the deltas joined and the tool calls listed in order, as `reduce_events` gives them of a
    table. A request whose done event does not come closes after `timeout_ms` of event time, timed_out. Events of a
    closed request give a row that counts them. Rows without request_id or seq are left out. The state needs the RocksDB
    provider (`PROVIDER`), a checkpoint in a shared folder and a bounded number of shuffle partitions.
    """
    rows = events.where(F.col("request_id").isNotNull() & F.col("seq").isNotNull())
    rows = rows.select("request_id", F.col("seq").cast("long").alias("seq"), "type", "payload", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    kind = events.schema["request_id"].dataType.simpleString()
    return rows.groupBy("request_id").transformWithStateInPandas(RequestReducer(timeout_ms), out_schema(kind), "Append", "EventTime")
