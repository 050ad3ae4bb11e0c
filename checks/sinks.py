"""SNK: writers.  Every query writes, then reads back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import PACKETS, PTS, day_points, joined, packets, point_packets, points, raw_events
from checks.registry import check
from pulseframe.operators import packing
from pulseframe.plans import freesql, history
from pulseframe.session import scratch_path
from pulseframe.sinks import exports, segments
from pulseframe.sources.segments import read_table

# Fixed text: a number as the exports write it.
EXPORT_NUMBER = "CASE WHEN v = trunc(v) THEN printf('%.0f', v) ELSE printf('%.3f', v) END"


@check(
    "snk_01_long_rows",
    f"""WITH {PTS}
    SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
           strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%H') AS hour
    FROM pts""",
)
def long_rows(spark, sf_dir):
    path = scratch_path(spark, "long")
    segments.write_long_rows(points(spark, sf_dir), path, partition_by=("day", "hour"), compression="snappy")
    rows = read_table(spark, path)
    return rows.select("device_id", "ts_ms", "param_id", F.col("value").cast("double").alias("value"), "day", "hour")


@check(
    "snk_01_compaction",
    f"WITH {PTS} SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM pts",
)
def compaction(spark, sf_dir):
    small, large = scratch_path(spark, "small"), scratch_path(spark, "large")
    segments.write_long_rows(points(spark, sf_dir), small, partition_by=("day",), rows_per_file=100)
    segments.compact_long_rows(spark, small, large, partition_by=("day",))
    return read_table(spark, large).select("device_id", "ts_ms", "param_id", F.col("value").cast("double").alias("value"))


@check(
    "snk_02_packet_wide",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms, array_to_string(param_ids, ',') AS params, len(vals) AS n,
           list_min(list_transform(vals, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))) AS lowest
    FROM packets""",
)
def packet_wide(spark, sf_dir):
    path = scratch_path(spark, "wide")
    segments.write_points_as_packets(day_points(spark, sf_dir), path, partition_by=("day",), compression="gzip")
    return read_table(spark, path).select(
        "device_id",
        "ts_ms",
        joined(F.col("param_ids")).alias("params"),
        F.size("values").cast("bigint").alias("n"),
        F.array_min("values").cast("double").alias("lowest"),
    )


@check(
    "snk_03_sparse_wide",
    f"""WITH {PTS}
    SELECT device_id, ts_ms AS timestamp,
           max(CASE WHEN param_id = 'P00001' THEN value END) AS point_0001,
           max(CASE WHEN param_id = 'P00002' THEN value END) AS point_0002,
           max(CASE WHEN param_id = 'P00003' THEN value END) AS point_0003,
           strftime(make_timestamp(ts_ms * 1000), '%Y') AS year, strftime(make_timestamp(ts_ms * 1000), '%m') AS month,
           strftime(make_timestamp(ts_ms * 1000), '%d') AS day
    FROM pts GROUP BY device_id, ts_ms""",
)
def sparse_wide(spark, sf_dir):
    path = scratch_path(spark, "sparse")
    segments.write_sparse(points(spark, sf_dir), path, [1, 2, 3], partition_by=("year", "month", "day"))
    return read_table(spark, path).select(
        "device_id", "timestamp", "point_0001", "point_0002", "point_0003", "year", "month", "day"
    )


@check(
    "snk_04_raw_archive",
    f"""WITH {PTS}
    SELECT device_id, ts_ms AS timestamp_ms, octet_length(encode(props)) AS payload_len,
           strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%H') AS hour
    FROM pts""",
)
def raw_archive(spark, sf_dir):
    path = scratch_path(spark, "raw")
    segments.write_raw_archive(raw_events(spark, sf_dir), path, partition_by=("day",))
    return read_table(spark, path).select(
        "device_id", "timestamp_ms", F.octet_length("payload").cast("bigint").alias("payload_len"), "day", "hour"
    )


@check(
    "snk_05_packet_lines",
    f"""WITH {PACKETS},
    members AS (
      SELECT device_id, ts_ms, string_agg('"' || param_id || '":' || {EXPORT_NUMBER}, ',' ORDER BY param_id) AS body
      FROM (SELECT *, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM cells) GROUP BY ALL
    ),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms) AS s FROM members)
    SELECT '{{"id":"' || device_id || '","t":' || ts_ms || ',"s":' || s || ',"p":{{' || body || '}}}}' AS value FROM numbered""",
)
def packet_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    narrow = packets(spark, sf_dir).withColumn("values", F.col("values").cast("array<float>"))
    exports.write_lines(exports.packet_lines(narrow), path)
    return spark.read.text(path)


@check(
    "snk_05_long_row_lines",
    f"""WITH {PTS},
    numbered AS (
      SELECT *, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v,
             row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, param_id) AS s
      FROM pts
    )
    SELECT '{{"id":"' || device_id || '","t":' || ts_ms || ',"s":' || s || ',"p":{{"' || param_id || '":'
           || {EXPORT_NUMBER} || '}}}}' AS value
    FROM numbered""",
)
def long_row_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    narrow = points(spark, sf_dir).withColumn("value", F.col("value").cast("float"))
    exports.write_lines(exports.long_row_lines(narrow), path)
    return spark.read.text(path)


EXPORT_ORDER = ("ts_ms", "param_id", "device_id")


@check(
    "snk_06_point_csv",
    f"""WITH {PTS}
    SELECT CAST(ts_ms AS VARCHAR) AS ts, param_id, printf('%.6f', CAST(CAST(value AS FLOAT) AS DOUBLE)) AS value
    FROM pts ORDER BY ts_ms, param_id, device_id LIMIT 1000""",
)
def point_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    narrow = points(spark, sf_dir).withColumn("value", F.col("value").cast("float"))
    exports.write_points_csv(narrow, path, order=EXPORT_ORDER)
    return spark.read.csv(path, header=True)


@check(
    "snk_07_point_json",
    f"WITH {PTS} SELECT ts_ms AS ts, param_id, value FROM pts ORDER BY ts_ms, param_id, device_id LIMIT 1000",
)
def point_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    exports.write_points_json(points(spark, sf_dir), path, order=EXPORT_ORDER)
    return spark.read.schema("ts bigint, param_id string, value double").json(path)


RAW_EXPORT = f"""WITH {PTS},
    raw AS (SELECT ts_ms, device_id, octet_length(encode(props)) AS payload_len, lower(hex(encode(props))) AS payload_hex FROM pts)
    SELECT * FROM raw ORDER BY ts_ms, device_id, payload_hex LIMIT 200"""


@check("snk_08_raw_csv", RAW_EXPORT)
def raw_csv(spark, sf_dir):
    path = scratch_path(spark, "rawcsv")
    exports.write_raw_csv(history.raw_rows(raw_events(spark, sf_dir), history.HEX), path)
    return spark.read.csv(path, header=True, schema="ts_ms bigint, device_id string, payload_len bigint, payload_hex string")


@check("snk_08_raw_json", RAW_EXPORT)
def raw_json(spark, sf_dir):
    path = scratch_path(spark, "rawjson")
    exports.write_raw_json(history.raw_rows(raw_events(spark, sf_dir), history.HEX), path)
    return spark.read.schema("ts_ms bigint, device_id string, payload_len bigint, payload_hex string").json(path)


@check(
    "snk_09_messages",
    f"""WITH {PTS}
    SELECT 'gw/' || device_id || '/' || param_id AS topic, device_id AS key,
           '{{"device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"param_id":"' || param_id || '","value":'
           || CAST(value AS VARCHAR) || '}}' AS value
    FROM pts""",
)
def messages(spark, sf_dir):
    path = scratch_path(spark, "messages")
    exports.write_messages(exports.messages(packing.param_messages(points(spark, sf_dir))), path)
    return spark.read.schema("topic string, key string, value string").json(path)


@check(
    "snk_09_device_topics",
    f"WITH {PACKETS} SELECT 'gw/' || device_id || '/telemetry' AS topic, count(*) AS messages FROM packets GROUP BY device_id",
)
def device_topics(spark, sf_dir):
    from pulseframe.operators.aggregates import topic_counts

    return topic_counts(exports.messages(packing.device_messages(point_packets(spark, sf_dir))))


@check(
    "snk_10_result_csv",
    f"""WITH {PTS}
    SELECT device_id, count(*) AS n, max(value) AS top, max(CASE WHEN value > 400 THEN param_id END) AS rare
    FROM pts GROUP BY device_id""",
)
def result_csv(spark, sf_dir):
    path = scratch_path(spark, "result")
    text = """SELECT device_id, count(*) AS n, max(value) AS top, max(CASE WHEN value > 400 THEN param_id END) AS rare
              FROM pts GROUP BY device_id"""
    exports.write_result_csv(freesql.run_sql(spark, text, {"pts": points(spark, sf_dir)}), path)
    return spark.read.csv(path, header=True, schema="device_id string, n bigint, top double, rare string")
