"""The stateful reduction of a stream equals that of a table, whatever the order and the cut into batches."""

import datetime as dt
import random

import pytest

from tessera.streaming.ingest import reduce_events
from tessera.streaming.stateful import PROVIDER, reduce_stream

SCHEMA = "request_id long, seq long, type string, payload string, ts timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def streaming(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, path, batches, late):
    """Rows that come out of batches of events, each a file."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/b={i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")
    q = reduce_stream(stream, late, 60_000).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def event(r, seq, kind, payload, second):
    return (r, seq, kind, payload, START + dt.timedelta(seconds=second))


def test_stream_equals_table(streaming, tmp_path):
    rng = random.Random(2)
    events = []
    for r in range(12):
        n = rng.randrange(1, 9)
        kinds = [rng.choice(["answer_delta", "tool_call"]) for _ in range(n)] + ["done"]
        events += [event(r, i, k, f"{r}.{i}" if k != "done" else None, i) for i, k in enumerate(kinds)]
    rng.shuffle(events)
    events += rng.sample(events, 5)  # some twice
    got = {r.request_id: (r.answer, r.steps, r.done) for r in run(streaming, str(tmp_path), [events[i::4] for i in range(4)], "1 hour") if not r.late}
    table = streaming.createDataFrame(list(dict.fromkeys(events)), SCHEMA)
    assert got == {r.request_id: (r.answer, r.steps, r.done) for r in reduce_events(table).collect()} and len(got) == 12


def test_timeouts_and_late_events(streaming, tmp_path):
    batches = [
        [event(1, 0, "answer_delta", "a", 0), event(1, 1, "done", None, 1), event(2, 0, "tool_call", "t", 1), event(3, 1, "answer_delta", "y", 1), event(3, 2, "done", None, 2)],
        [event(1, 2, "answer_delta", "after", 2)],
        [event(9, 0, "done", None, 500)],
        [event(9, 1, "tool_call", "x", 1000)],
    ]
    rows = run(streaming, str(tmp_path), batches, "10 seconds")
    got = {r.request_id: (r.answer, r.steps, r.done, r.timed_out) for r in rows if not r.late}
    assert got[1] == ("a", [], True, False)
    # No done event, and a done event with a gap before it: closed by the watermark.
    assert got[2] == ("", ["t"], False, True) and got[3] == ("y", [], True, True)
    assert {(r.request_id, r.late) for r in rows if r.late} == {(1, 1), (9, 1)}
