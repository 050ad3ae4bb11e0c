"""STR, and the streaming form of the operators that also run on streams.

Each query drains a stream of the events table into files in the shared folder
and returns what is stored there; its SQL twin is the batch answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import (
    BOUNDARY_MS,
    NOW_MS,
    PACKETS,
    PRESENCE,
    PTS,
    SUBSCRIPTIONS,
    as_points,
    joined,
    point_packets,
    points,
    presence,
    subscriptions,
    table,
)
from checks.joins import LIVE_SUBSCRIPTIONS, SHOWN_VALUE, _live_subscriptions
from checks.latest import CHANGES, _changes, _merge_sql
from checks.packing import _client_sql
from checks.registry import check
from pulseframe.functions import topics
from pulseframe.functions.timeparts import DAY_MS
from pulseframe.operators import aggregates, joins, latest, packing
from pulseframe.session import scratch_path
from pulseframe.sinks import exports
from pulseframe.sources import packets, segments
from pulseframe.streaming import ingest, live, presence as presence_stream, rows as row_stream


def point_stream(spark, sf_dir):
    """Events as a stream of points."""
    schema = table(spark, sf_dir, "events").schema
    return as_points(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))


def written_stream(spark, df, name):
    """A DataFrame written to files and read back as a stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(spark, stream, name):
    """A stateless stream run to its end, then read as a table."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def view_of(spark, view, keys, name):
    """A keyed view kept in update mode, read back as its newest versions."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    live.upsert_view(view, path, checkpoint, None).awaitTermination()
    return live.latest_version(spark.read.parquet(path), keys)


STORED = f"""WITH {PTS}
    SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
           strftime(make_timestamp(ts_ms * 1000), '%H') AS hour
    FROM pts"""


def _stored(spark, path):
    rows = segments.read_table(spark, path)
    return rows.select("device_id", "ts_ms", "param_id", F.col("value").cast("double").alias("value"), "day", "hour")


@check("str_01_ingest", STORED)
def ingest_points(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-state")
    ingest.ingest_points(point_stream(spark, sf_dir), path, checkpoint, None, partition_by=("day",)).awaitTermination()
    return _stored(spark, path)


@check("str_01_packet_lines", f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cells")
def packet_lines(spark, sf_dir):
    source, path, checkpoint = (scratch_path(spark, n) for n in ("lines", "lines-table", "lines-state"))
    members = F.map_from_entries(F.transform("points", lambda p: F.struct(p["param_id"], p["value"])))
    record = F.struct(F.col("device_id").alias("id"), F.col("ts_ms").alias("t"), F.lit(1).alias("s"), members.alias("p"))
    whole = F.to_json(record)
    lines = point_packets(spark, sf_dir).select(F.explode(F.array(whole, F.substring(whole, 1, 20))).alias("value"))
    lines.write.text(source)
    stream = ingest.packet_line_stream(spark, source, max_files=2)
    ingest.ingest_packets(stream, path, checkpoint, interval=None, partition_by=("day",)).awaitTermination()
    return _stored(spark, path).drop("day", "hour")


@check(
    "str_01_raw_archive",
    f"WITH {PTS} SELECT device_id, ts_ms AS timestamp_ms, props AS payload_text, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day FROM pts",
)
def raw_archive(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "archive"), scratch_path(spark, "archive-state")
    events = point_stream(spark, sf_dir).select(
        "device_id", F.col("ts_ms").alias("timestamp_ms"), F.col("props").cast("binary").alias("payload")
    )
    ingest.archive_events(events, path, checkpoint, None, partition_by=("day",)).awaitTermination()
    rows = segments.read_table(spark, path)
    return rows.select("device_id", "timestamp_ms", F.col("payload").cast("string").alias("payload_text"), "day")


@check(
    "str_02_hour_buckets",
    f"""WITH {PTS} SELECT device_id, ts_ms - ts_ms % 3600000 AS hour_ms, count(*) AS points, min(value) AS min_value, max(value) AS max_value
    FROM pts GROUP BY ALL""",
)
def hour_buckets(spark, sf_dir):
    return view_of(spark, live.hour_buckets(point_stream(spark, sf_dir)), ["device_id", "hour_ms"], "hours")


@check("str_03_late_data", STORED)
def late_data(spark, sf_dir):
    # The newer half arrives first; the older half, weeks late, in a second run on the same checkpoint.
    source, path, checkpoint = (scratch_path(spark, n) for n in ("late", "late-table", "late-state"))
    pts = points(spark, sf_dir)
    for half in (pts.where(F.col("ts_ms") >= BOUNDARY_MS), pts.where(F.col("ts_ms") < BOUNDARY_MS)):
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema(pts.schema).parquet(source)
        ingest.ingest_points(stream, path, checkpoint, None, partition_by=("day",)).awaitTermination()
    return _stored(spark, path)


def _expired_sql(grace_ms):
    return f"""WITH {PRESENCE}
    SELECT client_id, ts_ms AS offline_ts, ts_ms + {grace_ms} AS expired_ts
    FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY client_id ORDER BY ts_ms, coalesce(NOT online, false)) AS next_ts FROM presence)
    WHERE online = false AND coalesce(next_ts, {NOW_MS}) > ts_ms + {grace_ms}"""


SIX_HOURS = 6 * 3600000


@check("str_04_presence", _expired_sql(presence_stream.GRACE_MS))
def expired_clients(spark, sf_dir):
    return presence_stream.expired_clients(presence(spark, sf_dir), NOW_MS)


@check("str_04_presence_long_grace", _expired_sql(SIX_HOURS))
def expired_clients_long_grace(spark, sf_dir):
    return presence_stream.expired_clients(presence(spark, sf_dir), NOW_MS, SIX_HOURS)


def closed(events, closing_ms):
    """Events plus one far in the future, which lets the watermark pass all others."""
    last = F.struct(
        F.lit("closing").alias("client_id"), F.lit(closing_ms).alias("ts_ms"), F.lit(True).alias("online"), F.lit("x").alias("cmd")
    )
    one = events.sparkSession.range(1).select(last.alias("e")).select("e.*")
    return events.unionByName(one)


@check("str_04_presence_stream", _expired_sql(SIX_HOURS).replace(str(NOW_MS), str(NOW_MS + DAY_MS)))
def expired_client_stream(spark, sf_dir):
    spark.conf.set(presence_stream.STATE_STORE_CONF, presence_stream.ROCKSDB)
    stream = written_stream(spark, closed(presence(spark, sf_dir), NOW_MS + 10 * DAY_MS), "presence")
    return drained(spark, presence_stream.expired_client_stream(stream, SIX_HOURS), "expired")


# Streaming forms of batch operators.


@check(
    "win_01_current_values_stream",
    f"""WITH {PTS} SELECT device_id, param_id, arg_max(value, (ts_ms, value)) AS value, max(ts_ms) AS ts_ms
    FROM pts GROUP BY device_id, param_id""",
)
def current_values(spark, sf_dir):
    view = latest.current_values(point_stream(spark, sf_dir))
    return view_of(spark, view, ["device_id", "param_id"], "current")


@check(
    "win_04_session_view_stream",
    f"""WITH {PRESENCE} SELECT client_id, max(ts_ms) AS last_seen_ts, upper(arg_max(cmd, (ts_ms, cmd))) AS last_cmd
    FROM presence GROUP BY client_id""",
)
def session_view(spark, sf_dir):
    stream = written_stream(spark, presence(spark, sf_dir), "sessions")
    return view_of(spark, latest.session_view(stream), ["client_id"], "session-view")


@check(
    "win_12_merged_rows_stream",
    f"""WITH merged AS ({_merge_sql(SIX_HOURS)})
    SELECT device_id, label_ts, ts_ms, texts FROM merged""",
)
def merged_rows(spark, sf_dir):
    pts = points(spark, sf_dir).select("device_id", "ts_ms", "param_id", "value")
    one = spark.range(1).select(
        F.lit("closing").alias("device_id"), F.lit(NOW_MS + 10 * DAY_MS).alias("ts_ms"), F.lit("none").alias("param_id"),
        F.lit(0.0).alias("value"),
    )
    params = sorted(["P00001", "P00002", "P00003", "A00001", "Z00001"])
    stream = written_stream(spark, pts.unionByName(one), "updates")
    rows = drained(spark, live.merged_row_stream(stream, params, SIX_HOURS), "merged")
    texts = F.concat_ws(",", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in params])
    return rows.select("device_id", "label_ts", "ts_ms", texts.alias("texts"))


# The same without naming a parameter.
@check(
    "win_12_merged_any_stream",
    f"""WITH merged AS ({_merge_sql(SIX_HOURS)})
    SELECT device_id, label_ts, ts_ms, texts FROM merged""",
)
def merged_any(spark, sf_dir):
    spark.conf.set(presence_stream.STATE_STORE_CONF, presence_stream.ROCKSDB)
    pts = points(spark, sf_dir).select("device_id", "ts_ms", "param_id", "value")
    last = F.struct(
        F.lit("closing").alias("device_id"), F.lit(NOW_MS + 10 * DAY_MS).alias("ts_ms"), F.lit("none").alias("param_id"),
        F.lit(0.0).alias("value"),
    )
    one = spark.range(1).select(last.alias("e")).select("e.*")
    stream = written_stream(spark, pts.unionByName(one), "updates")
    rows = drained(spark, row_stream.merged_rows_stream(stream, SIX_HOURS), "merged-any").where("device_id <> 'closing'")
    texts = F.zip_with("param_ids", "values", lambda p, v: F.concat(p, F.lit("="), v.cast("string")))
    return rows.select("device_id", "label_ts", "ts_ms", F.array_join(texts, ",").alias("texts"))


@check(
    "agg_11_topic_counts_stream",
    f"WITH {PTS} SELECT 'gw/' || device_id || '/' || param_id AS topic, count(*) AS messages FROM pts GROUP BY 1",
)
def topic_counts(spark, sf_dir):
    messages = point_stream(spark, sf_dir).select(topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"))
    return view_of(spark, aggregates.topic_counts(messages), ["topic"], "topics")


@check(
    "jon_01_fan_out_stream",
    f"""WITH {PACKETS}, {SUBSCRIPTIONS}
    SELECT client_id, c.device_id, ts_ms, string_agg(param_id || '=' || CAST(value AS VARCHAR), ',' ORDER BY param_id) AS points
    FROM cells c JOIN subs s ON c.device_id = s.device_id AND list_contains(s.param_ids, c.param_id)
    GROUP BY client_id, c.device_id, ts_ms""",
)
def fan_out(spark, sf_dir):
    stream = written_stream(spark, point_packets(spark, sf_dir), "packets")
    selected = joins.fan_out(stream, subscriptions(spark, sf_dir))
    text = F.transform("points", lambda p: F.concat(p["param_id"], F.lit("="), p["value"].cast("string")))
    return drained(spark, selected.select("client_id", "device_id", "ts_ms", joined(text).alias("points")), "fan-out")


@check(
    "jon_08_live_messages_stream",
    f"""WITH {PTS}, {LIVE_SUBSCRIPTIONS}
    SELECT p.device_id, ts_ms, param_id, {SHOWN_VALUE} AS text
    FROM pts p JOIN live l ON p.device_id = l.device_id AND list_contains(wanted, param_id)""",
)
def live_messages(spark, sf_dir):
    messages = packing.param_messages(point_stream(spark, sf_dir)).select(
        topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"), "payload", "ts_ms"
    )
    shown = joins.select_live(messages, _live_subscriptions(spark, sf_dir))
    return drained(spark, shown.select("device_id", "ts_ms", F.explode("values").alias("param_id", "text")), "live")


@check(
    "pck_01_messages_stream",
    f"""WITH {PACKETS}
    SELECT 'gw/' || device_id || '/telemetry' AS topic, device_id AS key,
           '{{"device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"points":['
           || string_agg('{{"id":"' || param_id || '","value":' || CAST(value AS VARCHAR) || '}}', ',' ORDER BY param_id) || ']}}' AS value
    FROM cells GROUP BY device_id, ts_ms""",
)
def messages(spark, sf_dir):
    stream = written_stream(spark, point_packets(spark, sf_dir), "to-pack")
    path, checkpoint = scratch_path(spark, "published"), scratch_path(spark, "published-state")
    ingest.publish(exports.messages(packing.device_messages(stream)), path, checkpoint, None).awaitTermination()
    return spark.read.schema("topic string, key string, value string").json(path)


@check("src_05_flat_payload_stream", f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, value FROM cells")
def flat_payload(spark, sf_dir):
    members = F.map_from_entries(F.transform("points", lambda p: F.struct(p["param_id"], p["value"])))
    raw = point_packets(spark, sf_dir).select("device_id", "ts_ms", F.to_json(members).alias("payload"))
    stream = packets.flat_packets(written_stream(spark, raw, "flat"))
    return drained(spark, packets.packet_points(stream), "flat-points")


@check("src_04_published_stream", f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, value FROM cells")
def published(spark, sf_dir):
    source = scratch_path(spark, "published-lines")
    packing.device_messages(point_packets(spark, sf_dir)).select(F.col("payload").alias("value")).write.text(source)
    return drained(spark, packets.packet_points(ingest.published_stream(spark, source)), "published-points")


@check(
    "src_03_ingest_batches_stream",
    f"WITH {PACKETS} SELECT device_id, ts_ms AS recv_ts, ts_ms, param_id, value FROM cells",
)
def ingest_batches(spark, sf_dir):
    point = F.transform(
        "points",
        lambda p: F.struct(F.col("ts_ms").alias("ts"), p["param_id"].alias("param_id"), p["value"].alias("value")),
    )
    whole = F.to_json(F.struct("device_id", F.col("ts_ms").alias("recv_ts"), point.alias("points")))
    source = scratch_path(spark, "batches")
    lines = point_packets(spark, sf_dir).select(F.explode(F.array(whole, F.substring(whole, 1, 30))).alias("value"))
    lines.write.text(source)
    return drained(spark, packets.parse_ingest_batches(spark.readStream.text(source)), "batch-points")


@check(
    "snk_02_packet_wide_stream",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms, array_to_string(param_ids, ',') AS params, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
           list_min(list_transform(vals, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))) AS lowest
    FROM packets""",
)
def packet_wide(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "wide"), scratch_path(spark, "wide-state")
    stream = written_stream(spark, point_packets(spark, sf_dir), "wide-in")
    ingest.ingest_packet_wide(stream, path, checkpoint, None, partition_by=("day",)).awaitTermination()
    return segments.read_table(spark, path).select(
        "device_id", "ts_ms", joined(F.col("param_ids")).alias("params"), "day", F.array_min("values").cast("double").alias("lowest")
    )


@check(
    "agg_03_source_stats_stream",
    f"""WITH {PACKETS}, loud AS (SELECT len(list_filter(vals, lambda v: v > 50)) AS n FROM packets)
    SELECT count(*) AS input_lines, count(*) FILTER (WHERE n > 0) AS accepted_packets,
           CAST(sum(n) AS BIGINT) AS accepted_points, count(*) FILTER (WHERE n = 0) AS skipped_packets
    FROM loud""",
)
def source_stats(spark, sf_dir):
    loud = point_packets(spark, sf_dir).withColumn("points", F.filter("points", lambda p: p["value"] > 50))
    return view_of(spark, aggregates.source_stats(written_stream(spark, loud, "loud")), [], "source-stats")


@check(
    "agg_10_window_stats_stream",
    f"""WITH {PTS} SELECT CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source, count(*) AS points,
           true AS hours_close, true AS devices_close
    FROM pts GROUP BY 1""",
)
def window_stats(spark, sf_dir):
    def tagged(df):
        return df.withColumn("source", F.when(F.col("ts_ms") < BOUNDARY_MS, "cold").otherwise("hot"))

    view = aggregates.window_stats(tagged(point_stream(spark, sf_dir)), approximate=True)
    streamed = view_of(spark, view, ["source"], "window-stats")
    exact = aggregates.window_stats(tagged(points(spark, sf_dir))).select(
        "source", F.col("hours").alias("exact_hours"), F.col("devices").alias("exact_devices")
    )
    batch = aggregates.window_stats(tagged(points(spark, sf_dir)), approximate=True).select(
        "source", F.col("hours").alias("batch_hours"), F.col("devices").alias("batch_devices")
    )
    # A sketch does not depend on the order of its input, so the stream must give the batch's
    # numbers; its relative error is 5 % (one standard deviation).
    close = lambda c: (F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.2 * F.col(f"exact_{c}")) & (
        F.col(c) == F.col(f"batch_{c}")
    )
    return streamed.join(exact, "source").join(batch, "source").select(
        "source", "points", close("hours").alias("hours_close"), close("devices").alias("devices_close")
    )


@check(
    "win_05_subscriptions_stream",
    f"WITH {CHANGES} SELECT client_id, device_id, array_to_string(param_ids, ',') AS params FROM state",
)
def subscriptions_view(spark, sf_dir):
    # Old changes first, then the rest: a later delete must reach the view.
    changes = _changes(spark, sf_dir)
    source, path, checkpoint = (scratch_path(spark, n) for n in ("changes", "subscriptions", "subscriptions-state"))
    middle = changes.agg(F.max("seq")).first()[0] // 2
    for half in (changes.where(F.col("seq") <= middle), changes.where(F.col("seq") > middle)):
        half.write.mode("append").parquet(source)
        states = latest.subscription_states(spark.readStream.schema(changes.schema).parquet(source))
        live.upsert_view(states, path, checkpoint, None).awaitTermination()
    state = latest.live_subscriptions(live.latest_version(spark.read.parquet(path), ["client_id", "device_id"]))
    return state.select("client_id", "device_id", F.array_join("param_ids", ",").alias("params"))


@check("pck_02_client_messages_stream", _client_sql(125))
def client_messages(spark, sf_dir):
    stream = written_stream(spark, point_packets(spark, sf_dir), "client-packets")
    selected = joins.fan_out(stream, subscriptions(spark, sf_dir))
    return drained(spark, packing.client_messages(selected, 125), "client-messages")


@check(
    "pck_03_param_messages_stream",
    f"""WITH {PTS}
    SELECT device_id, ts_ms, param_id, '{{"device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"param_id":"' || param_id
           || '","value":' || CAST(value AS VARCHAR) || '}}' AS payload
    FROM pts""",
)
def param_messages(spark, sf_dir):
    return drained(spark, packing.param_messages(point_stream(spark, sf_dir)), "param-messages")


@check(
    "src_09_raw_archive_stream",
    f"WITH {PTS} SELECT device_id, ts_ms AS timestamp_ms, strlen(props) AS payload_len FROM pts",
)
def raw_archive_scan(spark, sf_dir):
    from pulseframe import schema
    from pulseframe.sinks.segments import write_raw_archive
    from checks.adapter import raw_events

    source = scratch_path(spark, "archived")
    write_raw_archive(raw_events(spark, sf_dir), source, partition_by=("day",))
    stream = spark.readStream.schema(schema.RAW_ARCHIVE).option("recursiveFileLookup", "true").parquet(source)
    lengths = stream.select("device_id", "timestamp_ms", F.octet_length("payload").cast("bigint").alias("payload_len"))
    return drained(spark, lengths, "archive-lengths")


@check(
    "str_01_sparse",
    f"""WITH {PTS} SELECT device_id, ts_ms AS timestamp, max(CASE WHEN param_id = 'P00001' THEN value END) AS p1,
           max(CASE WHEN param_id = 'P00003' THEN value END) AS p3
    FROM pts GROUP BY device_id, ts_ms""",
)
def sparse(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "sparse"), scratch_path(spark, "sparse-state")
    dates = ("year", "month", "day")
    ingest.ingest_sparse(point_stream(spark, sf_dir), path, checkpoint, [1, 3], None, dates).awaitTermination()
    rows = segments.read_table(spark, path)
    return rows.groupBy("device_id", "timestamp").agg(F.max("point_0001").alias("p1"), F.max("point_0003").alias("p3"))


@check(
    "str_04_lost_subscriptions",
    f"""WITH expired AS ({_expired_sql(SIX_HOURS)}),
    ids AS (SELECT DISTINCT user_id FROM events)
    SELECT e.client_id, 'dev' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS device_id, expired_ts AS seq
    FROM expired e JOIN ids ON e.client_id = 'cli-' || user_id""",
)
def lost_subscriptions(spark, sf_dir):
    # Every client holds a subscription of the device of its own number.
    expired = presence_stream.expired_clients(presence(spark, sf_dir), NOW_MS, SIX_HOURS)
    held = points(spark, sf_dir).select(
        F.concat(F.lit("cli-"), F.col("user_id").cast("string")).alias("client_id"), "device_id"
    )
    return presence_stream.lost_subscriptions(expired, held.distinct()).select("client_id", "device_id", "seq")
