"""DQ: data-quality jobs on faults derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import CATALOG, PACKETS, PTS, catalog, packets, points, raw_events
from checks.registry import check
from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators import quality
from pulseframe.session import scratch_path
from pulseframe.sinks.segments import with_day_hour
from pulseframe.sources import catalogs, footers

ALL = TimeRange(0, 4102444800000)

# Hour 05 has no manifest, hour 06 lists a bad line per segment, hour 07 swaps min and max, hour 08 lost its segments.


def _tree(spark, sf_dir):
    """Inventory and manifest lines of a faulty tree with one segment per hour directory."""
    known = catalog(spark, sf_dir).withColumn("directory", F.concat_ws("/", F.lit("root"), "device_id", "day", "hour"))
    segment = F.when(F.col("hour") != "08", F.col("segment_file"))
    manifest = F.when(F.col("hour") != "05", F.lit(quality.MANIFEST_NAME))
    files = known.select("directory", F.explode(F.array_compact(F.array(segment, manifest))).alias("file_name"))
    inventory = files.withColumn("file_path", F.concat_ws("/", "directory", "file_name"))
    swapped = F.col("hour") == "07"
    entry = F.to_json(
        F.struct(
            "segment_file",
            F.when(swapped, F.col("max_ts") + 1).otherwise(F.col("min_ts")).alias("min_ts"),
            F.when(swapped, F.col("min_ts")).otherwise(F.col("max_ts")).alias("max_ts"),
            "rows",
        )
    )
    bad = F.when(F.col("hour") == "06", F.lit("{broken"))
    lines = known.where(F.col("hour") != "05").select(
        F.concat_ws("/", "directory", F.lit(quality.MANIFEST_NAME)).alias("manifest_path"),
        F.explode(F.array_compact(F.array(entry, F.lit(" "), bad))).alias("value"),
    )
    return inventory, lines


@check(
    "dq_01_issues",
    f"""WITH {CATALOG}, tree AS (SELECT *, 'root/' || device_id || '/' || day || '/' || hour AS directory FROM catalog)
    SELECT 'missing manifest' AS issue, directory || '/manifest.jsonl' AS location, NULL AS detail FROM tree WHERE hour = '05'
    UNION ALL SELECT 'bad manifest line', directory || '/manifest.jsonl', '{{broken' FROM tree WHERE hour = '06'
    UNION ALL SELECT 'invalid ts range', directory || '/manifest.jsonl', 'min_ts=' || (max_ts + 1) || ' max_ts=' || min_ts FROM tree WHERE hour = '07'
    UNION ALL SELECT 'missing segment file', directory || '/' || segment_file, NULL FROM tree WHERE hour = '08'""",
)
def issues(spark, sf_dir):
    return quality.consistency_issues(*_tree(spark, sf_dir), ALL)


@check(
    "dq_01_report",
    f"""WITH {CATALOG}, hours AS (SELECT hour FROM catalog WHERE day BETWEEN '2024-01-05' AND '2024-01-20')
    SELECT count(*) AS hour_dirs, count(*) FILTER (WHERE hour <> '05') AS manifest_files,
           count(*) FILTER (WHERE hour <> '05') AS manifest_entries, count(*) FILTER (WHERE hour = '05') AS missing_manifest,
           count(*) FILTER (WHERE hour = '06') AS bad_manifest_lines, count(*) FILTER (WHERE hour = '07') AS invalid_entries,
           count(*) FILTER (WHERE hour = '08') AS missing_segment_files, count(*) FILTER (WHERE hour IN ('05', '06', '07', '08')) AS issues
    FROM hours""",
)
def report(spark, sf_dir):
    return quality.consistency_report(*_tree(spark, sf_dir), TimeRange(1704412800000, 1705795199999))


@check(
    "dq_01_shown_issues",
    f"""WITH {CATALOG}
    SELECT 'bad manifest line' AS issue, 'root/' || device_id || '/' || day || '/06/manifest.jsonl' AS location FROM catalog WHERE hour = '06'
    ORDER BY 2 LIMIT 30""",
)
def shown_issues(spark, sf_dir):
    return quality.shown_issues(quality.consistency_issues(*_tree(spark, sf_dir), ALL)).select("issue", "location")


def _archive(spark, sf_dir):
    """One file per device and day; hour-23 rows claim another device, files of day 20240110 cannot be read."""
    rows = with_day_hour(raw_events(spark, sf_dir), "timestamp_ms", compact_day=True)
    placed = rows.withColumn("file_path", F.concat_ws("/", F.lit("root"), "device_id", "day", F.lit("h00_p001.parquet")))
    inventory = placed.select("file_path").distinct()
    stranger = F.when(F.col("hour") == "23", F.lit("other")).otherwise(F.col("device_id"))
    return placed.where(F.col("day") != "20240110").withColumn("device_id", stranger), inventory


ARCHIVE = f"""
{PTS.strip()},
files AS (
  SELECT 'root/' || device_id || '/' || day || '/h00_p001.parquet' AS file_path, day <> '20240110' AS readable,
         CASE WHEN day <> '20240110' THEN count(*) ELSE 0 END AS records,
         CASE WHEN day <> '20240110' THEN count(*) FILTER (WHERE hour = '23') ELSE 0 END AS foreign_rows
  FROM (SELECT device_id, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%H') AS hour FROM pts)
  GROUP BY device_id, day
)"""


@check("dq_02_archive_check", f"WITH {ARCHIVE} SELECT *, readable AND foreign_rows = 0 AS ok FROM files")
def archive_check(spark, sf_dir):
    return quality.archive_check(*_archive(spark, sf_dir))


@check(
    "dq_02_archive_summary",
    f"""WITH {ARCHIVE}
    SELECT count(*) FILTER (WHERE readable AND foreign_rows = 0) AS readable_files,
           CAST(sum(records) FILTER (WHERE readable AND foreign_rows = 0) AS BIGINT) AS records,
           count(*) FILTER (WHERE NOT (readable AND foreign_rows = 0)) AS failed_files
    FROM files""",
)
def archive_summary(spark, sf_dir):
    return quality.archive_summary(quality.archive_check(*_archive(spark, sf_dir)))


@check(
    "dq_03_import_check",
    f"""WITH {PACKETS}
    SELECT (SELECT count(*) FROM packets) AS source_packets, (SELECT count(*) FROM cells) AS source_points,
           (SELECT count(*) FROM cells) AS stored_rows, (SELECT count(*) FROM pts) AS stored_points,
           true AS rows_match, (SELECT count(*) FROM cells) = (SELECT count(*) FROM pts) AS points_match""",
)
def import_check(spark, sf_dir):
    wide = packets(spark, sf_dir)
    source = wide.agg(F.count("*").alias("packets"), F.sum(F.size("values").cast("bigint")).alias("points"))
    # Stored: one row per cell, and more points than the source because repeats were stored too.
    rows = wide.select(F.explode("values").alias("v")).select(F.lit(1).alias("rows"), F.lit(0).alias("points"))
    repeats = points(spark, sf_dir).select(F.lit(0).alias("rows"), F.lit(1).alias("points"))
    stored = rows.unionByName(repeats).agg(F.sum("rows").alias("rows"), F.sum("points").alias("points"))
    return quality.import_check(source, stored, "long-row")


@check(
    "dq_02_manifest_rows",
    f"""WITH {ARCHIVE}
    SELECT file_path, CASE WHEN file_path LIKE '%/20240111/%' THEN false WHEN file_path LIKE '%/20240110/%' THEN true ELSE readable END AS readable
    FROM files""",
)
def manifest_rows(spark, sf_dir):
    """Day 10 holds empty files, and of day 11 the manifest knows one row more than can be read."""
    raw, inventory = _archive(spark, sf_dir)
    counted = raw.groupBy("file_path").agg(F.count("*").alias("rows"))
    lost = F.col("file_path").contains("/20240111/").cast("bigint")
    known = inventory.join(counted, "file_path", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("bigint")) + lost
    )
    return quality.archive_check(raw, known).select("file_path", "readable")


# What the footers of the files name, without a manifest, against what a scan of them gives.
@check(
    "dq_02_footer_rows",
    f"""WITH {PTS}
    SELECT strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day, count(*) AS footer_rows, count(*) AS records, true AS readable
    FROM pts GROUP BY 1""",
)
def footer_rows(spark, sf_dir):
    path = scratch_path(spark, "footers")
    rows = with_day_hour(raw_events(spark, sf_dir), "timestamp_ms", compact_day=True)
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    inventory = footers.with_footer_rows(spark, catalogs.file_inventory(spark, path, "*.parquet"), path)
    stored = spark.read.parquet(path).withColumn("file_path", F.col("_metadata.file_path"))
    checked = quality.archive_check(stored, inventory).join(inventory.select("file_path", "rows"), "file_path")
    return checked.groupBy(F.regexp_extract("file_path", "/day=([0-9]+)/", 1).alias("day")).agg(
        F.sum("rows").alias("footer_rows"), F.sum("records").alias("records"), F.bool_and("readable").alias("readable")
    )
