"""The given tables as telemetry inputs, in Spark and as SQL text.

Every Spark function here has a CTE of the same content next to it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import DAY_MS, HOUR_MS, ntz_millis
from pulseframe.operators.aggregates import segment_catalog
from pulseframe.operators.reshape import points_to_packets
from pulseframe.session import scratch_path
from pulseframe.sinks.segments import with_day_hour, write_long_rows, write_raw_archive, write_sparse
from pulseframe.sources.segments import read_table
from pulseframe.sources.skipping import file_catalog

# Event types as parameter codes.
PARAM_OF_EVENT = {
    "click": "P00001",
    "error": "P00002",
    "purchase": "P00003",
    "signup": "A00001",
    "view": "Z00001",
}
PARAMS = sorted(PARAM_OF_EVENT.values())

# 2024-01-08T00:00Z: between stored and recent rows.
BOUNDARY_MS = 1704672000000
# 2024-01-31T00:00Z: after the last event.
NOW_MS = 1706659200000


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, opened once per session: the footer need not be read again for its schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _stored(spark: SparkSession, sf_dir: str, tz: str) -> str:
    path = scratch_path(spark, "stored")
    write_long_rows(points(spark, sf_dir), path, tz=tz, partition_by=("day", "hour"))
    return path


@cache
def stored_points(spark: SparkSession, sf_dir: str, tz: str = "UTC") -> DataFrame:
    """The points as a table of long rows by day and hour, written once per session."""
    return read_table(spark, _stored(spark, sf_dir, tz))


@cache
def stored_catalog(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The folder of that table and the catalog of its files, written once per session."""
    path = scratch_path(spark, "stored-catalog")
    file_catalog(stored_points(spark, sf_dir)).write.parquet(path)
    return _stored(spark, sf_dir, "UTC"), spark.read.parquet(path)


@cache
def stored_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events as an archive by day and hour."""
    path = scratch_path(spark, "stored-raw")
    write_raw_archive(raw_events(spark, sf_dir), path, partition_by=("day", "hour"))
    return read_table(spark, path)


@cache
def stored_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a sparse table by date."""
    path = scratch_path(spark, "stored-sparse")
    write_sparse(points(spark, sf_dir), path, [1, 2, 3], partition_by=("year", "month", "day"))
    return read_table(spark, path)


def device_name(number: Column) -> Column:
    return F.concat(F.lit("dev"), F.lpad(number.cast("string"), 6, "0"))


def _param() -> Column:
    return F.coalesce(*[F.when(F.col("event_type") == e, F.lit(p)) for e, p in PARAM_OF_EVENT.items()])


def as_points(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "user_id",
        device_name(F.col("user_id")).alias("device_id"),
        ntz_millis(F.col("ts")).alias("ts_ms"),
        _param().alias("param_id"),
        "value",
        "props",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as points; whatever a query leaves out, its operator must leave out."""
    return as_points(table(spark, sf_dir, "events"))


PTS = """
pts AS (
  SELECT event_id, user_id, 'dev' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS device_id,
         epoch_us(ts) // 1000 AS ts_ms,
         CASE event_type WHEN 'click' THEN 'P00001' WHEN 'error' THEN 'P00002' WHEN 'purchase' THEN 'P00003'
                         WHEN 'signup' THEN 'A00001' WHEN 'view' THEN 'Z00001' END AS param_id,
         value, props
  FROM events
)"""


def day_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved to the start of their day, so that packets hold several."""
    pts = points(spark, sf_dir)
    return pts.withColumn("ts_ms", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(DAY_MS)))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a device and day as parallel lists."""
    return points_to_packets(day_points(spark, sf_dir))


def point_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets with a list of points."""
    return packets(spark, sf_dir).select(
        "device_id",
        "ts_ms",
        F.transform(
            F.arrays_zip("param_ids", "values"),
            lambda z: F.struct(z["param_ids"].alias("param_id"), z["values"].alias("value")),
        ).alias("points"),
    )


PACKETS = f"""
{PTS.strip()},
cells AS (
  SELECT device_id, ts_ms - ts_ms % {DAY_MS} AS ts_ms, param_id, max(value) AS value
  FROM pts GROUP BY ALL
),
packets AS (
  SELECT device_id, ts_ms, list(param_id ORDER BY param_id) AS param_ids, list(value ORDER BY param_id) AS vals
  FROM cells GROUP BY ALL
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per device, day and hour."""
    keyed = with_day_hour(points(spark, sf_dir))
    found = segment_catalog(keyed, ["device_id", "day", "hour"])
    return found.withColumn("segment_file", segment_file())


def segment_file() -> Column:
    return F.concat_ws("_", F.lit("seg"), "device_id", F.regexp_replace("day", "-", ""), "hour")


CATALOG = f"""
{PTS.strip()},
keyed AS (
  SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
         strftime(make_timestamp(ts_ms * 1000), '%H') AS hour
  FROM pts
),
catalog AS (
  SELECT device_id, day, hour, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS rows, count(*) AS points,
         list_sort(list(DISTINCT param_id)) AS param_ids,
         'seg_' || device_id || '_' || replace(day, '-', '') || '_' || hour AS segment_file
  FROM keyed GROUP BY device_id, day, hour
)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per nation: two parameters of every device with its number modulo 25."""
    nations = table(spark, sf_dir, "nation")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    codes = F.array(*[F.lit(p) for p in SUBSCRIBED])
    region = F.col("n_regionkey")
    return users.join(nations, F.pmod("user_id", F.lit(25)) == F.col("n_nationkey")).select(
        F.concat(F.lit("cli-"), F.col("n_nationkey").cast("string")).alias("client_id"),
        device_name(F.col("user_id")).alias("device_id"),
        F.array(F.get(codes, region), F.get(codes, F.pmod(region + 1, F.lit(5)))).alias("param_ids"),
    )


SUBSCRIBED = ["P00001", "P00002", "P00003", "A00001", "Z00001"]

SUBSCRIPTIONS = """
subs AS (
  SELECT 'cli-' || n_nationkey AS client_id, 'dev' || lpad(CAST(u.user_id AS VARCHAR), 6, '0') AS device_id,
         [c.codes[n_regionkey + 1], c.codes[(n_regionkey + 1) % 5 + 1]] AS param_ids
  FROM (SELECT DISTINCT user_id FROM events) u
  JOIN nation ON u.user_id % 25 = n_nationkey,
  (SELECT ['P00001', 'P00002', 'P00003', 'A00001', 'Z00001'] AS codes) c
)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property text of every event as an opaque payload."""
    return points(spark, sf_dir).select(
        "device_id", F.col("ts_ms").alias("timestamp_ms"), F.col("props").cast("binary").alias("payload")
    )


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as online, errors as offline messages, everything else as commands."""
    return points(spark, sf_dir).select(
        F.concat(F.lit("cli-"), F.col("user_id").cast("string")).alias("client_id"),
        "ts_ms",
        F.when(F.col("param_id") == "A00001", True).when(F.col("param_id") == "P00002", False).alias("online"),
        F.coalesce(*[F.when(F.col("param_id") == p, F.lit(e)) for e, p in PARAM_OF_EVENT.items()]).alias("cmd"),
    )


PRESENCE = f"""
{PTS.strip()},
presence AS (
  SELECT 'cli-' || user_id AS client_id, ts_ms,
         CASE param_id WHEN 'A00001' THEN true WHEN 'P00002' THEN false END AS online,
         CASE param_id WHEN 'P00001' THEN 'click' WHEN 'P00002' THEN 'error' WHEN 'P00003' THEN 'purchase'
                       WHEN 'A00001' THEN 'signup' WHEN 'Z00001' THEN 'view' END AS cmd
  FROM pts
)"""


def hour_of(ts_ms: Column) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(HOUR_MS))


def joined(values: Column) -> Column:
    """A list of any type as one text."""
    return F.array_join(values.cast("array<string>"), ",")
