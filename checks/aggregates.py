"""AGG: statistics, catalogs and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import (
    BOUNDARY_MS,
    CATALOG,
    PACKETS,
    PTS,
    SUBSCRIPTIONS,
    catalog,
    packets,
    point_packets,
    points,
    raw_events,
    segment_file,
    subscriptions,
)
from checks.registry import check
from pulseframe.functions import naming, topics
from pulseframe.operators import aggregates, sketches
from pulseframe.session import scratch_path
from pulseframe.sinks.segments import with_day_hour, write_long_rows
from pulseframe.sources import catalogs


def _stored(spark, sf_dir):
    """Points with the name of the segment they would be stored in."""
    return with_day_hour(points(spark, sf_dir)).withColumn("file_path", segment_file())


@check(
    "agg_01_point_stats",
    f"""WITH {CATALOG} SELECT count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, min(min_ts) AS min_ts, max(max_ts) AS max_ts FROM catalog""",
)
def point_stats(spark, sf_dir):
    return aggregates.point_stats(_stored(spark, sf_dir))


@check(
    "agg_02_storage_stats",
    f"""WITH {CATALOG}
    SELECT count(DISTINCT device_id) AS devices, count(*) AS manifests, count(*) AS segments, CAST(sum(rows) AS BIGINT) AS rows,
           CAST(sum(points) AS BIGINT) AS points, min(min_ts) AS min_ts, max(max_ts) AS max_ts
    FROM catalog""",
)
def storage_stats(spark, sf_dir):
    known = catalog(spark, sf_dir).withColumn("manifest_path", F.concat_ws("/", "device_id", "day", "hour"))
    return aggregates.storage_stats(known.withColumn("mode", F.lit("long_row")))


# Hour 00 segments are empty, hour 01 segments have no recorded points, hour 02 segments are packet wide.
@check(
    "agg_02_storage_stats_recount",
    f"""WITH {CATALOG}
    SELECT count(DISTINCT device_id) AS devices, count(DISTINCT device_id || day || hour) AS manifests, count(*) AS segments,
           CAST(sum(CASE WHEN hour = '00' THEN 0 ELSE rows END) AS BIGINT) AS rows,
           CAST(sum(CASE WHEN hour = '00' THEN 0 ELSE rows END) AS BIGINT) AS points,
           min(CASE WHEN hour <> '00' THEN min_ts END) AS min_ts, max(CASE WHEN hour <> '00' THEN max_ts END) AS max_ts
    FROM catalog""",
)
def storage_stats_recount(spark, sf_dir):
    hour = F.col("hour")
    known = catalog(spark, sf_dir).withColumn("manifest_path", F.concat_ws("/", "device_id", "day", "hour"))
    recounts = known.where(hour == "02").select("manifest_path", "segment_file", F.col("rows").alias("recount"))
    entries = known.withColumns(
        {
            "rows": F.when(hour == "00", 0).otherwise(F.col("rows")).cast("bigint"),
            "points": F.when(hour.isin("00", "01", "02"), 0).otherwise(F.col("points")).cast("bigint"),
            "mode": F.when(hour == "02", "packet_wide").otherwise("long_row"),
        }
    )
    return aggregates.storage_stats(entries, recounts)


@check(
    "agg_03_source_stats",
    f"""WITH {PACKETS}, loud AS (SELECT len(list_filter(vals, lambda v: v > 50)) AS n FROM packets)
    SELECT count(*) AS input_lines, count(*) FILTER (WHERE n > 0) AS accepted_packets,
           CAST(sum(n) AS BIGINT) AS accepted_points, count(*) FILTER (WHERE n = 0) AS skipped_packets
    FROM loud""",
)
def source_stats(spark, sf_dir):
    loud = point_packets(spark, sf_dir).withColumn("points", F.filter("points", lambda p: p["value"] > 50))
    return aggregates.source_stats(loud)


@check(
    "agg_04_segment_catalog",
    f"""WITH {CATALOG}
    SELECT device_id, day, hour, min_ts, max_ts, rows, points, array_to_string(param_ids, ',') AS params FROM catalog""",
)
def segment_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).select(
        "device_id", "day", "hour", "min_ts", "max_ts", "rows", "points", F.array_join("param_ids", ",").alias("params")
    )


@check(
    "agg_04_packet_catalog",
    f"""WITH {PACKETS}
    SELECT device_id, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT ts_ms) AS rows, count(*) AS points,
           array_to_string(list_sort(list(DISTINCT param_id)), ',') AS params
    FROM cells GROUP BY device_id""",
)
def packet_catalog(spark, sf_dir):
    found = aggregates.packet_catalog(packets(spark, sf_dir), ["device_id"])
    return found.withColumn("params", F.array_join("param_ids", ",")).drop("param_ids")


@check(
    "agg_05_archive_catalog",
    f"""WITH {PTS},
    files AS (
      SELECT device_id, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day_key,
             strftime(make_timestamp(ts_ms * 1000), '%H') AS hh, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms,
             count(*) AS rows, CAST(sum(octet_length(encode(props))) AS BIGINT) AS payload_bytes
      FROM pts GROUP BY ALL
    )
    SELECT CAST(1 AS SMALLINT) AS schema_version, device_id, 'h' || hh || '_p001.parquet' AS file_name, day_key,
           CAST(hh AS INTEGER) AS hour, 1 AS part, min_ts_ms, max_ts_ms, rows,
           payload_bytes, CAST(100 AS BIGINT) AS file_size_bytes, true AS sealed, CAST(7 AS BIGINT) AS created_at_ms
    FROM files""",
)
def archive_catalog(spark, sf_dir):
    name = naming.archive_name(F.col("hour").cast("int"), F.lit(1))
    hourly = with_day_hour(raw_events(spark, sf_dir), "timestamp_ms", compact_day=True).withColumn(
        "file_path", F.concat_ws("/", F.lit("root"), "device_id", "day", name)
    )
    names = hourly.select("file_path").distinct()
    other = names.select(F.regexp_replace("file_path", "h([0-9]*)_p", "x$1_p").alias("file_path"))
    inventory = names.unionByName(other).withColumn("bytes", F.lit(100).cast("bigint"))
    rebuilt = aggregates.archive_catalog(hourly, inventory, created_at_ms=7)
    path = scratch_path(spark, "manifests")
    catalogs.write_archive_manifests(rebuilt, path, partition_by=("day",))
    return catalogs.read_archive_manifests(spark, path, glob="*.json")


@check(
    "agg_04_segment_sizes",
    f"WITH {PTS} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS rows, true AS sized FROM pts GROUP BY 1",
)
def segment_sizes(spark, sf_dir):
    path = scratch_path(spark, "sized")
    write_long_rows(points(spark, sf_dir), path, partition_by=("day",))
    rows = spark.read.parquet(path).withColumns(
        {"file_path": F.col("_metadata.file_path"), "size_on_disk": F.col("_metadata.file_size")}
    )
    inventory = catalogs.file_inventory(spark, path, "*.parquet")
    sized = aggregates.with_file_sizes(aggregates.segment_catalog(rows, ["file_path", "size_on_disk"]), inventory)
    return sized.groupBy(naming.path_day_of_device(F.col("file_path")).alias("day")).agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("size") == F.col("size_on_disk")).alias("sized")
    )


@check(
    "agg_06_hourly_index",
    f"""WITH {PTS},
    segs AS (
      SELECT device_id || '|' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d|%H') AS index_key, param_id || '.parquet' AS f, count(*) AS n
      FROM pts GROUP BY ALL
    )
    SELECT index_key, string_agg(f || ':' || n, ',' ORDER BY f) AS segments FROM segs GROUP BY index_key""",
)
def hourly_index(spark, sf_dir):
    per_param = (
        with_day_hour(points(spark, sf_dir))
        .groupBy("device_id", "day", "hour", "param_id")
        .agg(F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count("*").alias("rows"))
        .withColumn("segment_file", F.concat("param_id", F.lit(".parquet")))
    )
    empty = per_param.withColumns({"segment_file": F.lit("empty.parquet"), "rows": F.lit(0).cast("bigint")})
    index = aggregates.hourly_index(per_param.unionByName(per_param).unionByName(empty))
    entry = F.transform("segments", lambda s: F.concat(s["segment_file"], F.lit(":"), s["rows"].cast("string")))
    return index.select("index_key", F.array_join(entry, ",").alias("segments"))


@check(
    "agg_07_raw_stats",
    f"""WITH {PTS}
    SELECT count(DISTINCT device_id) AS files, count(*) AS records, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms,
           CAST(sum(octet_length(encode(props))) AS BIGINT) AS payload_bytes
    FROM pts""",
)
def raw_stats(spark, sf_dir):
    return aggregates.raw_stats(raw_events(spark, sf_dir), "device_id")


@check(
    "agg_07_raw_stats_pages",
    """SELECT count(DISTINCT split_part(url, '/', 3)) AS files, count(*) AS records, min(page_id) AS min_ts_ms,
              max(page_id) AS max_ts_ms, CAST(sum(octet_length(encode(html))) AS BIGINT) AS payload_bytes
       FROM pages""",
)
def raw_stats_pages(spark, sf_dir):
    from checks.adapter import table

    raw = table(spark, sf_dir, "pages").select(
        F.get(F.split("url", "/"), F.lit(2)).alias("host"),
        F.col("page_id").alias("timestamp_ms"),
        F.encode("html", "UTF-8").alias("payload"),
    )
    return aggregates.raw_stats(raw, "host")


@check(
    "agg_08_recount_points",
    f"""WITH {PACKETS} SELECT device_id, CAST(sum(CASE WHEN len(vals) = 1 THEN 0 ELSE len(vals) END) AS BIGINT) AS recount
    FROM packets GROUP BY device_id""",
)
def recount_points(spark, sf_dir):
    holed = packets(spark, sf_dir).withColumn("values", F.when(F.size("values") > 1, F.col("values")))
    return aggregates.recount_points(holed, ["device_id"])


def _tagged(spark, sf_dir):
    source = F.when(F.col("ts_ms") < BOUNDARY_MS, "cold").otherwise("hot")
    return points(spark, sf_dir).withColumn("source", source)


@check("agg_09_distinct_devices", f"WITH {PTS} SELECT count(DISTINCT device_id) AS devices FROM pts")
def distinct_devices(spark, sf_dir):
    both = _tagged(spark, sf_dir)
    return aggregates.distinct_devices(both.where("source = 'cold'"), both.where("source = 'hot'"))


@check(
    "agg_10_window_stats",
    f"""WITH {PTS}
    SELECT CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source, count(DISTINCT ts_ms // 3600000) AS hours,
           count(DISTINCT device_id) AS devices, count(*) AS points
    FROM pts GROUP BY 1""",
)
def window_stats(spark, sf_dir):
    return aggregates.window_stats(_tagged(spark, sf_dir))


@check(
    "agg_11_topic_counts",
    f"WITH {PTS} SELECT 'gw/' || device_id || '/' || param_id AS topic, count(*) AS messages FROM pts GROUP BY 1",
)
def topic_counts(spark, sf_dir):
    messages = points(spark, sf_dir).select(topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"))
    return aggregates.topic_counts(messages).orderBy("topic")


SUMMARY = """min(value) AS min_value, round(avg(value), 9) AS avg_value,
    list_sort(list(value))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS quantile_value, max(value) AS max_value"""


@check("agg_12_value_summary", f"WITH {PTS} SELECT {SUMMARY} FROM pts")
def value_summary(spark, sf_dir):
    return aggregates.value_summary(points(spark, sf_dir), "value").withColumn("avg_value", F.round("avg_value", 9))


@check("agg_12_value_summary_by_param", f"WITH {PTS} SELECT param_id, {SUMMARY} FROM pts GROUP BY param_id")
def value_summary_by_param(spark, sf_dir):
    summary = aggregates.value_summary(points(spark, sf_dir), "value", ["param_id"])
    return summary.withColumn("avg_value", F.round("avg_value", 9))


@check(
    "agg_13_source_counts",
    f"WITH {PTS} SELECT CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source, count(*) AS rows FROM pts GROUP BY 1",
)
def source_counts(spark, sf_dir):
    return aggregates.source_counts(_tagged(spark, sf_dir))


@check("agg_14_file_ranges", f"WITH {CATALOG} SELECT segment_file AS file_path, rows, min_ts, max_ts FROM catalog")
def file_ranges(spark, sf_dir):
    return aggregates.file_ranges(_stored(spark, sf_dir))


@check(
    "agg_15_subscription_sizes",
    f"WITH {SUBSCRIPTIONS} SELECT client_id, device_id, CAST(len(list_distinct(param_ids)) AS INTEGER) AS param_count FROM subs",
)
def subscription_sizes(spark, sf_dir):
    messy = F.concat("param_ids", F.transform("param_ids", lambda p: F.concat(F.lit(" "), F.lower(p))), F.array(F.lit(" ")))
    return aggregates.subscription_sizes(subscriptions(spark, sf_dir).withColumn("param_ids", messy))


# Sketches kept per hour and united: no point is read again.
@check(
    "agg_10_united_sketches",
    f"""WITH {PTS} SELECT CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source, count(*) AS points,
           count(DISTINCT ts_ms // 3600000) AS hours, count(DISTINCT param_id) AS params, true AS devices_close
    FROM pts GROUP BY 1""",
)
def united_sketches(spark, sf_dir):
    tagged = _tagged(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    sketches.hourly_sketches(tagged).write.parquet(path)
    united = sketches.distinct_over(spark.read.parquet(path))
    exact = tagged.groupBy("source").agg(F.count_distinct("device_id").alias("exact"))
    close = F.abs(F.col("devices") - F.col("exact")) <= 0.1 * F.col("exact")
    return united.join(exact, "source").select("source", "points", "hours", "params", close.alias("devices_close"))
