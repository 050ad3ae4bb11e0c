"""Rows merged on a stream equal the batch form, for parameters nobody named."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pulseframe.operators import latest
from pulseframe.streaming import presence, rows as stream_rows

SCHEMA = "device_id string, ts_ms bigint, param_id string, value double"
T0 = 1704067200000


def run(spark, tmp_path, frames, gap_ms, lateness):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.conf.set(presence.STATE_STORE_CONF, presence.ROCKSDB)
    late = 0
    for frame in frames:
        spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        merged = stream_rows.merged_rows_stream(spark.readStream.schema(SCHEMA).parquet(source), gap_ms, lateness)
        query = merged.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        late += stream_rows.late_rows(query)
    got = spark.read.schema(merged.schema).parquet(out).where("device_id <> 'closing'").collect()
    return sorted((r["device_id"], r["label_ts"], r["ts_ms"], tuple(zip(r["param_ids"], r["values"]))) for r in got), late


def batch(spark, updates, gap_ms):
    found = latest.merged_rows(spark.createDataFrame(updates, SCHEMA), gap_ms).withColumn("v", F.array_sort(F.map_entries("values")))
    return sorted((r["device_id"], r["label_ts"], r["ts_ms"], tuple((e["key"], e["value"]) for e in r["v"])) for r in found.collect())


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    updates = list(
        {
            (d, t, p): (d, t, p, float(rng.randrange(50)))
            for d, t, p in ((rng.choice("abc"), T0 + rng.randrange(0, 120_000), f"X{rng.randrange(30)}") for _ in range(900))
        }.values()
    )
    updates.sort(key=lambda r: r[1])
    # Batches overlap by less than the lateness, and each is out of order.
    shuffled = sorted(updates, key=lambda r: r[1] + rng.randrange(8_000))
    frames = [shuffled[k : k + 220] for k in range(0, len(shuffled), 220)]
    closing = [[("closing", T0 + 10_000_000 * k, "none", 0.0)] for k in (1, 2)]
    got, late = run(spark, tmp_path, [*frames, *closing], 300, "20 seconds")
    assert got == batch(spark, updates, 300) and late == 0


def test_late_updates_are_counted(spark, tmp_path):
    frames = [
        [("a", T0, "P1", 1.0), ("a", T0 + 100, "P2", 2.0)],
        [("b", T0 + 60_000, "P1", 3.0)],
        [("b", T0 + 60_100, "P9", 4.0)],
        [("a", T0 + 50, "P3", 9.0)],
        [("closing", T0 + 10_000_000, "none", 0.0)],
        [("closing", T0 + 20_000_000, "none", 0.0)],
    ]
    got, late = run(spark, tmp_path, frames, 300, "1 second")
    assert got == [
        ("a", T0, T0 + 100, (("P1", 1.0), ("P2", 2.0))),
        ("b", T0 + 60_000, T0 + 60_100, (("P1", 3.0), ("P9", 4.0))),
    ]
    assert late == 1


class Handle:
    """State and timers of one device, counting calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema):
        return State(self, "value")

    def getMapState(self, name, key, value):
        return State(self, "map")

    def listTimers(self):
        self.calls += 1
        return iter(set(self.timers))

    def deleteTimer(self, timer):
        self.calls += 1
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.calls += 1
        self.timers.add(timer)


class State:
    def __init__(self, handle, kind):
        self.handle, self.kind = handle, kind

    def get(self):
        self.handle.calls += 1
        return self.handle.value

    def update(self, value):
        self.handle.calls += 1
        self.handle.value = value

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.handle.map[key] = value

    def iterator(self):
        self.handle.calls += 1
        return iter(list(self.handle.map.items()))

    def clear(self):
        self.handle.calls += 1
        setattr(self.handle, self.kind, None if self.kind == "value" else {})


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_calls_on_the_state():
    handle, processor = Handle(), stream_rows._OpenRows(10)
    processor.init(handle)

    def take(watermark, *cells):
        rows = [dict(zip(("first_ts", "last_ts", "param_id", "value"), c)) for c in cells]
        found = processor.handleInputRows(("a",), iter(rows), At(watermark))
        return [(r["label_ts"], r["ts_ms"], dict(zip(r["param_ids"], r["values"]))) for r in found]

    # Rows that close at once: one call, whatever their number.
    assert take(100, (31, 31, "P", 3.0), (1, 5, "P", 1.0), (12, 12, "Q", None)) == [(1, 12, {"P": 1.0, "Q": None}), (31, 31, {"P": 3.0})]
    assert handle.calls == 1 and not handle.timers
    # 119 + 10 may still be joined by what comes at 120, the first open bucket.
    assert take(125, (111, 119, "P", 1.0)) == [] and handle.timers == {130}
    assert take(138, (120, 128, "Q", 2.0)) == [] and handle.timers == {140} and handle.value == (111, 128)
    assert take(160, (139, 139, "P", 4.0)) == [(111, 128, {"P": 1.0, "Q": 2.0}), (139, 139, {"P": 4.0})]
    assert handle.value is None and not handle.map and not handle.timers


def test_stretches():
    assert stream_rows.stretches([(9, 9, "P", 1.0)], (1, 5), 4) == [(1, 9, {"P": 1.0})]
    assert stream_rows.stretches([(10, 10, "P", 1.0)], (1, 5), 4) == [(1, 5, {}), (10, 10, {"P": 1.0})]


def test_stream_without_a_gap(spark, tmp_path):
    updates = [("a", T0, "P1", 1.0), ("a", T0, "P2", None), ("a", T0 + 1, "P1", 2.0)]
    closing = [[("closing", T0 + 10_000_000 * k, "none", 0.0)] for k in (1, 2)]
    got, late = run(spark, tmp_path, [updates, *closing], 0, "1 second")
    assert got == batch(spark, updates, 0) and late == 0
