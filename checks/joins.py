"""JON: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import (
    CATALOG,
    PACKETS,
    PTS,
    SUBSCRIPTIONS,
    catalog,
    device_name,
    joined,
    point_packets,
    points,
    subscriptions,
    table,
)
from checks.registry import check
from pulseframe.functions import topics
from pulseframe.operators import joins, latest, packing

LATEST = """
latest AS (
  SELECT device_id, param_id, arg_max(value, (ts_ms, value)) AS value, max(ts_ms) AS ts_ms
  FROM pts GROUP BY device_id, param_id
)"""


@check(
    "jon_01_fan_out",
    f"""WITH {PACKETS}, {SUBSCRIPTIONS}
    SELECT client_id, c.device_id, ts_ms, string_agg(param_id || '=' || CAST(value AS VARCHAR), ',' ORDER BY param_id) AS points
    FROM cells c JOIN subs s ON c.device_id = s.device_id AND list_contains(s.param_ids, c.param_id)
    GROUP BY client_id, c.device_id, ts_ms""",
)
def fan_out(spark, sf_dir):
    selected = joins.fan_out(point_packets(spark, sf_dir), subscriptions(spark, sf_dir))
    text = F.transform("points", lambda p: F.concat(p["param_id"], F.lit("="), p["value"].cast("string")))
    return selected.select("client_id", "device_id", "ts_ms", joined(text).alias("points"))


@check(
    "jon_01_fan_out_points",
    f"""WITH {PTS}, {SUBSCRIPTIONS}
    SELECT client_id, p.device_id, ts_ms, param_id, value
    FROM pts p JOIN subs s ON p.device_id = s.device_id AND list_contains(s.param_ids, p.param_id)""",
)
def fan_out_points(spark, sf_dir):
    return joins.fan_out_points(points(spark, sf_dir), subscriptions(spark, sf_dir))


@check(
    "jon_02_key_lookup",
    f"""WITH {PTS}, {LATEST},
    asked AS (
      SELECT 'dev' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS device_id, v.position, v.param_id
      FROM customer, (VALUES (0, 'Z00001'), (1, 'P00002'), (2, 'P00007')) AS v(position, param_id)
    )
    SELECT a.device_id, position, a.param_id, value, ts_ms
    FROM asked a LEFT JOIN latest l ON a.device_id = l.device_id AND a.param_id = l.param_id""",
)
def key_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").select(
        device_name(F.col("c_custkey")).alias("device_id"),
        F.array(F.lit(" z00001"), F.lit("P00002"), F.lit("p00007")).alias("param_ids"),
    )
    return joins.key_lookup(requests, latest.current_values(points(spark, sf_dir)))


@check(
    "jon_02_device_values",
    f"WITH {PTS}, {LATEST} SELECT device_id, param_id, value, ts_ms FROM latest WHERE device_id = 'dev000005'",
)
def device_values(spark, sf_dir):
    return joins.device_values(latest.current_values(points(spark, sf_dir)), "dev000005")


# Segments of hour 03 are gone; hours of day 2024-01-09 have no manifest.
@check("jon_03_missing_segments", f"WITH {CATALOG} SELECT segment_file, rows FROM catalog WHERE hour = '03'")
def missing_segments(spark, sf_dir):
    manifest = catalog(spark, sf_dir).withColumn("file_path", F.col("segment_file"))
    inventory = manifest.where(F.col("hour") != "03").select("file_path")
    return joins.missing_segments(manifest, inventory).select("segment_file", "rows")


@check(
    "jon_04_hours_without_manifest",
    f"""WITH {CATALOG}
    SELECT DISTINCT device_id || '/' || day || '/' || hour AS directory FROM catalog WHERE day = '2024-01-09'""",
)
def hours_without_manifest(spark, sf_dir):
    hours = catalog(spark, sf_dir).select(F.concat_ws("/", "device_id", "day", "hour").alias("directory"), "day")
    manifests = hours.where(F.col("day") != "2024-01-09")
    return joins.hours_without_manifest(hours, manifests).select("directory")


# Every event asks for its own value in minutes, starting at its time.
INTERVALS = """
asked AS (
  SELECT event_id, device_id, param_id AS asked_param, ts_ms AS from_ms, ts_ms + CAST(floor(value * 60) AS BIGINT) * 1000 AS to_ms
  FROM pts
)"""


def _intervals(spark, sf_dir):
    return points(spark, sf_dir).select(
        "event_id",
        "device_id",
        F.col("param_id").alias("asked_param"),
        F.col("ts_ms").alias("from_ms"),
        (F.col("ts_ms") + F.floor(F.col("value") * 60).cast("bigint") * 1000).alias("to_ms"),
    )


def _segments(spark, sf_dir):
    return catalog(spark, sf_dir).select("device_id", "min_ts", "max_ts", "segment_file", "param_ids")


@check(
    "jon_05_overlap_join",
    f"""WITH {CATALOG}, {INTERVALS}
    SELECT event_id, segment_file FROM asked a JOIN catalog c
      ON a.device_id = c.device_id AND max_ts >= from_ms AND min_ts <= to_ms""",
)
def overlap_join(spark, sf_dir):
    return joins.overlap_join(_intervals(spark, sf_dir), _segments(spark, sf_dir)).select("event_id", "segment_file")


@check(
    "jon_05_overlap_join_param",
    f"""WITH {CATALOG}, {INTERVALS}
    SELECT event_id, segment_file FROM asked a JOIN catalog c
      ON a.device_id = c.device_id AND max_ts >= from_ms AND min_ts <= to_ms AND list_contains(param_ids, asked_param)""",
)
def overlap_join_param(spark, sf_dir):
    pairs = joins.overlap_join(_intervals(spark, sf_dir), _segments(spark, sf_dir), param="asked_param")
    return pairs.select("event_id", "segment_file")


@check(
    "jon_05_overlap_join_days",
    f"""WITH {CATALOG},
    days AS (SELECT device_id, day, min(min_ts) AS min_ts, max(max_ts) AS max_ts FROM catalog GROUP BY ALL),
    asked AS (SELECT device_id, min(ts_ms) AS from_ms, max(ts_ms) - 86400000 AS to_ms FROM pts GROUP BY device_id)
    SELECT a.device_id, day FROM asked a JOIN days d
      ON a.device_id = d.device_id AND max_ts >= from_ms AND min_ts <= to_ms""",
)
def overlap_join_days(spark, sf_dir):
    # Long intervals against segments that span many hours.
    pts = points(spark, sf_dir)
    days = catalog(spark, sf_dir).groupBy("device_id", "day").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    asked = pts.groupBy("device_id").agg(F.min("ts_ms").alias("from_ms"), (F.max("ts_ms") - 86400000).alias("to_ms"))
    return joins.overlap_join(asked, days).select("device_id", "day")


@check(
    "jon_06_device_status",
    f"""WITH {PTS}, seen AS (SELECT device_id, max(ts_ms) AS last_seen FROM pts GROUP BY device_id),
    devices AS (SELECT 'dev' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS device_id, '10.0.0.' || c_nationkey || ':9000' AS addr FROM customer)
    SELECT d.device_id, coalesce(last_seen, 0) AS last_seen_ts, addr FROM devices d LEFT JOIN seen s ON d.device_id = s.device_id""",
)
def device_status(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(
        device_name(F.col("c_custkey")).alias("device_id"),
        F.concat(F.lit("10.0.0."), F.col("c_nationkey").cast("string")).alias("ip"),
        F.lit(9000).alias("port"),
    )
    return joins.device_status(devices, points(spark, sf_dir))


@check(
    "jon_07_compare_totals",
    f"""WITH {PACKETS},
    a AS (SELECT device_id, count(DISTINCT ts_ms) AS packets, count(*) AS points FROM pts GROUP BY device_id),
    b AS (SELECT device_id, count(DISTINCT ts_ms) AS packets, count(*) AS points FROM cells GROUP BY device_id)
    SELECT a.device_id, a.packets AS source_packets, a.points AS source_points, b.packets AS stored_packets, b.points AS stored_points,
           a.packets = b.packets AS packets_match, a.points = b.points AS points_match
    FROM a JOIN b ON a.device_id = b.device_id""",
)
def compare_totals(spark, sf_dir):
    def totals(df):
        return df.groupBy("device_id").agg(F.count_distinct("ts_ms").alias("packets"), F.count("*").alias("points"))

    stored = point_packets(spark, sf_dir).select("device_id", "ts_ms", F.inline("points"))
    return joins.compare_totals(totals(points(spark, sf_dir)), totals(stored))


# A number is shown as a browser shows it: whole ones without decimals.
SHOWN_VALUE = "regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')"

LIVE_SUBSCRIPTIONS = """
live AS (
  SELECT device_id, CASE user_id % 3 WHEN 0 THEN ['P00001', 'Z00001'] WHEN 1 THEN ['A00001', 'P00002', 'P00003'] ELSE ['P00009', 'Z00001'] END AS wanted
  FROM (SELECT DISTINCT device_id, user_id FROM pts) WHERE user_id % 10 <> 9
)"""


def _live_subscriptions(spark, sf_dir):
    def codes(*names):
        return F.array(*[F.lit(n) for n in names])

    users = points(spark, sf_dir).select("device_id", "user_id").distinct()
    kind = F.col("user_id") % 3
    wanted = F.when(kind == 0, codes("P00001", "Z00001")).when(kind == 1, codes("A00001", "P00002", "P00003"))
    return users.where(F.col("user_id") % 10 != 9).select(
        "device_id", wanted.otherwise(codes("P00009", "Z00001")).alias("param_ids")
    )


@check(
    "jon_08_live_param_messages",
    f"""WITH {PTS}, {LIVE_SUBSCRIPTIONS}
    SELECT p.device_id, ts_ms, param_id, {SHOWN_VALUE} AS text
    FROM pts p JOIN live l ON p.device_id = l.device_id AND list_contains(wanted, param_id)""",
)
def live_param_messages(spark, sf_dir):
    messages = packing.param_messages(points(spark, sf_dir)).select(
        topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"), "payload", "ts_ms"
    )
    shown = joins.select_live(messages, _live_subscriptions(spark, sf_dir))
    return shown.select("device_id", "ts_ms", F.explode("values").alias("param_id", "text"))


@check(
    "jon_08_live_device_messages",
    f"""WITH {PACKETS}, {LIVE_SUBSCRIPTIONS},
    asked AS (SELECT p.device_id, p.ts_ms, unnest(wanted) AS param_id FROM packets p JOIN live l ON p.device_id = l.device_id)
    SELECT a.device_id, a.ts_ms, a.param_id, coalesce({SHOWN_VALUE}, '-') AS text
    FROM asked a LEFT JOIN cells c ON a.device_id = c.device_id AND a.ts_ms = c.ts_ms AND a.param_id = c.param_id""",
)
def live_device_messages(spark, sf_dir):
    messages = packing.device_messages(point_packets(spark, sf_dir)).select(
        topics.telemetry_topic(F.col("device_id")).alias("topic"), "payload", "ts_ms"
    )
    shown = joins.select_live(messages, _live_subscriptions(spark, sf_dir))
    return shown.select("device_id", "ts_ms", F.explode("values").alias("param_id", "text"))


@check(
    "jon_01_wide_packets",
    """WITH cells AS (
      SELECT 'wide' || user_id % 10 AS device_id, 'P' || lpad(CAST(event_id % 5000 AS VARCHAR), 5, '0') AS param_id, max(value) AS value
      FROM events GROUP BY ALL
    ),
    kept AS (SELECT * FROM cells WHERE CAST(substr(param_id, 2) AS INTEGER) % 2 = 0 AND CAST(substr(param_id, 2) AS INTEGER) < 4000)
    SELECT device_id, count(*) AS n, min(param_id) AS first_param, max(param_id) AS last_param,
           list_last(list(value ORDER BY param_id)) AS last_value
    FROM kept GROUP BY device_id""",
)
def wide_packets(spark, sf_dir):
    """Packets and subscriptions of up to thousands of parameters."""

    def code(number):
        return F.concat(F.lit("P"), F.lpad(number.cast("string"), 5, "0"))

    device = F.concat(F.lit("wide"), (F.col("user_id") % 10).cast("string"))
    cells = (
        table(spark, sf_dir, "events")
        .groupBy(device.alias("device_id"), code(F.col("event_id") % 5000).alias("param_id"))
        .agg(F.max("value").alias("value"))
    )
    wide = cells.groupBy("device_id").agg(F.collect_list(F.struct("param_id", "value")).alias("points"))
    asked = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda n: code(n * 2))
    subs = wide.select(F.lit("all").alias("client_id"), "device_id", asked.alias("param_ids"))
    sent = joins.fan_out(wide.withColumn("ts_ms", F.lit(0).cast("bigint")), subs)
    return sent.select(
        "device_id",
        F.size("points").cast("bigint").alias("n"),
        F.get("points", F.lit(0))["param_id"].alias("first_param"),
        F.get("points", F.size("points") - 1)["param_id"].alias("last_param"),
        F.get("points", F.size("points") - 1)["value"].alias("last_value"),
    )


@check(
    "jon_08_repeated_subscriptions",
    f"""WITH {PTS}
    SELECT device_id, ts_ms, param_id, {SHOWN_VALUE.replace("c.", "")} AS text FROM pts WHERE param_id IN ('P00001', 'Z00001')""",
)
def repeated_subscriptions(spark, sf_dir):
    """Two subscriptions of a device, of which the first counts, with repeated and lower-case parameters."""
    messages = packing.param_messages(points(spark, sf_dir)).select(
        topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"), "payload", "ts_ms"
    )
    first, second = F.array(F.lit("p00001"), F.lit("P00001"), F.lit(" z00001")), F.array(F.lit("P00002"))
    devices = points(spark, sf_dir).select("device_id").distinct()
    both = devices.select(F.lit("cli-1").alias("client_id"), "device_id", first.alias("param_ids")).unionByName(
        devices.select(F.lit("cli-2").alias("client_id"), "device_id", second.alias("param_ids"))
    )
    shown = joins.select_live(messages, both)
    return shown.select("device_id", "ts_ms", F.explode("values").alias("param_id", "text"))


# The last click at or before each event, within two hours: devices of any size are spread over blocks.
@check(
    "sql_05_as_of_join",
    f"""WITH {PTS}
    SELECT p.event_id, CASE WHEN p.ts_ms - c.ts_ms <= 7200000 THEN c.value END AS click_value,
           CASE WHEN p.ts_ms - c.ts_ms <= 7200000 THEN c.ts_ms END AS click_value_ts
    FROM pts p ASOF LEFT JOIN (SELECT * FROM pts WHERE param_id = 'P00001') c
      ON p.device_id = c.device_id AND p.ts_ms >= c.ts_ms""",
)
def as_of_join(spark, sf_dir):
    rows = points(spark, sf_dir)
    clicks = rows.where(F.col("param_id") == "P00001")
    found = joins.as_of(rows.select("device_id", "ts_ms", "event_id"), clicks, name="click_value", within_ms=7_200_000)
    return found.select("event_id", "click_value", "click_value_ts")
