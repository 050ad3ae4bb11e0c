"""Row merging on a stream for parameters nobody named beforehand.

Updates are first reduced to one per device, parameter and time bucket as long as the gap,
which Spark's own windowed aggregate holds until the watermark has passed the bucket.  They
leave it complete and in order of buckets, so the rows are those of the batch form, whatever
order the updates arrive in.  Per device, state holds only the row that is still open: its
first and last time, and a map from parameter to its newest value.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pulseframe.functions.timeparts import event_time
from pulseframe.operators.latest import MERGE_GAP_MS
from pulseframe.streaming.presence import ROCKSDB, STATE_STORE_CONF

MERGED = "device_id string, label_ts bigint, ts_ms bigint, param_ids array<string>, values array<double>"


def bucket_ms(gap_ms: int) -> int:
    """Width of a bucket: two updates of one are never more than the gap apart."""
    return max(gap_ms, 1)


def newest_cells(updates: DataFrame, gap_ms: int) -> DataFrame:
    """Updates with ``event_time`` reduced to one row per device, bucket and parameter.

    All updates of a device in a bucket belong to one merged row, so its times and the
    newest value of each parameter are all that counts.
    """
    return (
        updates.groupBy("device_id", F.window("event_time", f"{bucket_ms(gap_ms)} milliseconds"), "param_id")
        .agg(
            F.min("ts_ms").alias("first_ts"),
            F.max("ts_ms").alias("last_ts"),
            F.max_by("value", F.struct("ts_ms", "value")).alias("value"),
        )
        .select("device_id", F.window_time("window").alias("event_time"), "param_id", "first_ts", "last_ts", "value")
    )


def stretches(cells: list[tuple], before: tuple | None, gap_ms: int) -> list[tuple]:
    """Rows ``first, last, values`` that the cells ``first_ts, last_ts, param_id, value`` form.

    The first one goes on with the row ``first, last`` open before, where there is one, and
    names only the parameters that are new in it.
    """
    found = [] if before is None else [(*before, {})]
    for first_ts, last_ts, param, value in sorted(cells, key=lambda c: c[:3]):
        if not found or first_ts - found[-1][1] > gap_ms:
            found.append((first_ts, last_ts, {}))
        first, last, values = found[-1]
        values[param] = value
        found[-1] = (first, max(last, last_ts), values)
    return found


class _OpenRows(StatefulProcessor):
    """The open row of a device.

    A device has a timer just when it has such a row.  Each call on the handle is a round
    trip to the JVM, so a device whose rows all close at once makes none but the first.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms
        self.width = bucket_ms(gap_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bounds = handle.getValueState("bounds", "first_ts bigint, last_ts bigint")
        self.cells = handle.getMapState("cells", "param_id string", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.bounds.get()
        before = None if state is None else (state[0], state[1])
        cells = [(r["first_ts"], r["last_ts"], r["param_id"], r["value"]) for r in rows]
        closed = stretches(cells, before, self.gap_ms)
        # What is still to come starts at the first bucket the watermark has not passed.
        watermark = timerValues.getCurrentWatermarkInMs()
        left_open = closed.pop() if closed[-1][1] + self.gap_ms >= watermark - watermark % self.width else None
        if before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if closed:
                first, last, values = closed[0]
                closed[0] = (first, last, self._taken() | values)
            if left_open is None:
                self.bounds.clear()
        if left_open is not None:
            first, last, values = left_open
            self.bounds.update((first, last))
            for param, value in values.items():
                self.cells.updateValue((param,), (value,))
            end = last + self.gap_ms
            self.handle.registerTimer(end - end % self.width + self.width)
        yield from self._lines(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.bounds.get()
        if state is not None:
            values = self._taken()
            self.bounds.clear()
            yield from self._lines(key, [(state[0], state[1], values)])

    def _taken(self) -> dict:
        """Stored values, which are given up."""
        values = {k[0]: v[0] for k, v in self.cells.iterator()}
        self.cells.clear()
        return values

    def _lines(self, key, closed: list[tuple]) -> Iterator[Row]:
        for first, last, values in closed:
            names = sorted(values)
            yield Row(
                device_id=key[0], label_ts=first, ts_ms=last, param_ids=names, values=[values[p] for p in names]
            )

    def close(self) -> None:
        pass


def merged_rows_stream(updates: DataFrame, gap_ms: int = MERGE_GAP_MS, lateness: str = "10 seconds") -> DataFrame:
    """Streaming form of ``latest.merged_rows`` for any parameters: one line per merged row.

    ``updates``: ``device_id, ts_ms, param_id, value``.  State per device is one map of
    parameters, and one cell per parameter and bucket the watermark has not passed.  Updates
    whose bucket it has passed are left out and counted (``late_rows``).  A row is reported
    when nothing can join it any more, at most one bucket later than its gap.  The session must
    keep streaming state in RocksDB.
    """
    if updates.sparkSession.conf.get(STATE_STORE_CONF, None) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE_CONF} to {ROCKSDB}")
    timed = updates.select("device_id", "ts_ms", "param_id", "value").where(F.col("param_id").isNotNull())
    timed = timed.withColumn("event_time", event_time(F.col("ts_ms"))).withWatermark("event_time", lateness)
    return newest_cells(timed, gap_ms).groupBy("device_id").transformWithState(
        statefulProcessor=_OpenRows(gap_ms), outputStructType=MERGED, outputMode="Append", timeMode="EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """Cells a query has left out because they came after the watermark, as far as its progress is kept.

    Late updates of one device, parameter and bucket that one task reads together are one cell.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
