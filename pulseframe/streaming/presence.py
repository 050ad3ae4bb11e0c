"""Presence with a grace period.

A client that goes offline loses its session and subscriptions unless it comes
back, or sends any command, within the grace period.  A new offline message
restarts the timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseframe.functions.timeparts import event_time
from pulseframe.operators.latest import DELETE
from pulseframe.operators.sequence import following

# Fixed value: grace period.
GRACE_MS = 30_000

EXPIRY = "client_id string, offline_ts bigint, expired_ts bigint"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def activity(events: DataFrame, grace_ms: int = GRACE_MS) -> DataFrame:
    """Events of a client reduced to one row per grace-long time bucket.

    Two events of one bucket are never more than the grace period apart, so only
    the first time of a bucket can end a silence and only its last event can start
    one.  Nothing is lost, and a busy client shrinks in the map-side partial
    aggregate; at equal times an offline message counts as the later one.
    """
    offline = F.coalesce(~F.col("online"), F.lit(False))
    return (
        events.groupBy("client_id", F.window("event_time", f"{grace_ms} milliseconds"))
        .agg(
            F.min("ts_ms").alias("first_ts"),
            F.max("ts_ms").alias("last_ts"),
            F.max_by(offline, F.struct(F.col("ts_ms"), offline)).alias("offline"),
        )
        .select("client_id", "window", "first_ts", "last_ts", "offline")
    )


def expired_clients(events: DataFrame, until_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """Batch form over ``client_id, ts_ms, online`` (``online`` NULL for a command).

    An offline message expires when the client's next event comes more than the
    grace period later, or not at all before ``until_ms``.  Messages whose status
    cannot be read are not events: leave them out.
    """
    buckets = activity(events.withColumn("event_time", event_time(F.col("ts_ms"))), grace_ms).drop("window")
    ordered = following(buckets, ["client_id"], ["first_ts"], "first_ts", "_next")
    quiet_until = F.coalesce("_next", F.lit(until_ms))
    expiry = F.col("last_ts") + F.lit(grace_ms)
    return (
        ordered.where(F.col("offline") & (quiet_until > expiry))
        .select("client_id", F.col("last_ts").alias("offline_ts"), expiry.alias("expired_ts"))
    )


def lost_subscriptions(expired: DataFrame, held: DataFrame) -> DataFrame:
    """Deletions that expired clients cause, as rows of the subscription change log.

    ``expired`` may be a stream; ``held`` are the subscriptions in force.  Appended to
    the change log, the rows end the subscriptions wherever its state is computed.
    """
    return expired.join(held.select("client_id", "device_id"), "client_id").select(
        "client_id",
        "device_id",
        F.lit(DELETE).alias("op"),
        F.array().cast("array<string>").alias("param_ids"),
        F.col("expired_ts").alias("seq"),
    )


def silences(buckets: list[tuple], before: int | None, grace_ms: int) -> tuple[list[int], int | None]:
    """Offline messages that the buckets ``first_ts, last_ts, offline`` leave unanswered for too long, and the one left open."""
    found, open_ts = [], before
    for first_ts, last_ts, offline in sorted(buckets):
        # The offline message a bucket finds open is the one the bucket before left.
        if open_ts is not None and first_ts > open_ts + grace_ms:
            found.append(open_ts)
        open_ts = last_ts if offline else None
    return found, open_ts


class _Presence(StatefulProcessor):
    """Holds the time of the offline message a client has not answered yet.

    A client has a timer just when it has such a message.  Each call on the handle is a
    round trip to the JVM, so clients without one make none but the first.
    """

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "offline_ts bigint")

    def _expired(self, key, offline_ts: list[int]) -> pd.DataFrame:
        times = pd.Series(offline_ts, dtype="int64")
        return pd.DataFrame({"client_id": key[0], "offline_ts": times, "expired_ts": times + self.grace_ms})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buckets = [
            bucket for frame in rows for bucket in zip(frame["first_ts"].tolist(), frame["last_ts"].tolist(), frame["offline"].tolist())
        ]
        state = self.pending.get()
        before = None if state is None else state[0]
        silent, left_open = silences(buckets, before, self.grace_ms)
        if before is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if left_open is not None:
            self.pending.update((left_open,))
            # An answer may sit in the bucket that holds the expiry, and that bucket
            # arrives when it ends: only then is the silence certain.
            expiry = left_open + self.grace_ms
            self.handle.registerTimer(expiry - expiry % self.grace_ms + self.grace_ms)
        elif before is not None:
            self.pending.clear()
        if silent:
            yield self._expired(key, silent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.pending.get()
        if state is not None:
            self.pending.clear()
            yield self._expired(key, [state[0]])

    def close(self) -> None:
        pass


def expired_client_stream(events: DataFrame, grace_ms: int = GRACE_MS, lateness: str = "10 seconds") -> DataFrame:
    """Streaming form: one output row per expired client session.

    State is one time per client that is offline.  Events later than
    ``lateness`` are not seen.  An expiry is reported when the watermark passes
    the end of the bucket it falls into, at most one grace period after it.  The
    session must keep streaming state in RocksDB (``STATE_STORE_CONF``).
    """
    if events.sparkSession.conf.get(STATE_STORE_CONF, None) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE_CONF} to {ROCKSDB}")
    timed = events.withColumn("event_time", event_time(F.col("ts_ms"))).withWatermark("event_time", lateness)
    return (
        activity(timed, grace_ms)
        .groupBy("client_id")
        .transformWithStateInPandas(
            statefulProcessor=_Presence(grace_ms), outputStructType=EXPIRY, outputMode="Append", timeMode="EventTime"
        )
    )
