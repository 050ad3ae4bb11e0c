"""SRC: readers.  Inputs are written by Spark from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import CATALOG, PACKETS, PTS, catalog, device_name, point_packets, points, raw_events, table
from checks.registry import check
from pulseframe.functions.timeparts import TimeRange
from pulseframe.session import scratch_path
from pulseframe.sinks import segments as sinks
from pulseframe.sources import catalogs, packets, segments, skipping

BY_DAY = ("day",)
POINT_COLUMNS = ["device_id", "ts_ms", "param_id", "value"]


def _written_lines(spark, lines, name):
    path = scratch_path(spark, name)
    lines.select("value").write.text(path)
    return path


def _packet_line(code):
    """A packet line with one usable member and four that must be dropped."""
    return F.concat(
        F.lit('{"id":"'),
        F.col("device_id"),
        F.lit('","t":'),
        F.col("ts_ms").cast("string"),
        F.lit(',"s":'),
        F.col("event_id").cast("string"),
        F.lit(',"p":{" '),
        code,
        F.lit('":'),
        F.col("value").cast("string"),
        F.lit(',"X00001":1,"Z00009":"7","Z00008":true,"note":null}}'),
    )


@check("src_01_packet_jsonl", f"WITH {PTS} SELECT device_id, ts_ms, event_id AS seq, param_id, value FROM pts")
def packet_jsonl(spark, sf_dir):
    lines = points(spark, sf_dir).select(_packet_line(F.lower("param_id")).alias("value"))
    read = packets.read_packets(spark, _written_lines(spark, lines, "packets"))
    return read.select("device_id", "ts_ms", "seq", F.inline("points"))


@check(
    "src_01_packet_jsonl_skip",
    f"WITH {PTS} SELECT device_id, ts_ms, param_id, value FROM pts WHERE param_id <> 'P00002'",
)
def packet_jsonl_skip(spark, sf_dir):
    line = _packet_line(F.col("param_id"))
    broken = F.when(F.col("param_id") == "P00002", F.substring(line, 1, 40)).otherwise(line)
    lines = points(spark, sf_dir).select(broken.alias("value"))
    read = packets.read_packets(spark, _written_lines(spark, lines, "packets"), mode="skip")
    return packets.packet_points(read)


@check(
    "src_02_packet_jsonl_lenient",
    f"""WITH {PTS}
    SELECT CASE WHEN param_id = 'A00001' THEN 'unknown' ELSE device_id END AS device_id,
           CASE WHEN param_id = 'Z00001' THEN 0 ELSE ts_ms END AS ts_ms, param_id, value
    FROM pts""",
)
def packet_jsonl_lenient(spark, sf_dir):
    record = F.struct(
        F.when(F.col("param_id") != "A00001", F.col("device_id")).alias("id"),
        F.when(F.col("param_id") != "Z00001", F.col("ts_ms")).alias("t"),
        F.create_map("param_id", "value").alias("p"),
    )
    lines = points(spark, sf_dir).select(F.to_json(record).alias("value"))
    return packets.packet_points(packets.read_packets(spark, _written_lines(spark, lines, "lenient"), mode="lenient"))


@check(
    "src_03_ingest_batches",
    f"WITH {PACKETS} SELECT device_id, ts_ms AS recv_ts, ts_ms, param_id, value FROM cells",
)
def ingest_batches(spark, sf_dir):
    whole = F.to_json(
        F.struct(
            "device_id",
            F.col("ts_ms").alias("recv_ts"),
            F.transform(
                "points",
                lambda p: F.struct(F.col("ts_ms").alias("ts"), p["param_id"].alias("param_id"), p["value"].alias("value")),
            ).alias("points"),
        )
    )
    # Every whole line is followed by a cut-off copy, as after a crash.
    lines = point_packets(spark, sf_dir).select(
        F.explode(F.array(whole, F.substring_index(whole, ",", 2))).alias("value")
    )
    return packets.read_ingest_batches(spark, _written_lines(spark, lines, "batches"))


@check("src_04_published_packets", f"WITH {PACKETS} SELECT device_id, ts_ms, ts_ms AS recv_ts, param_id, value FROM cells")
def published_packets(spark, sf_dir):
    members = F.transform("points", lambda p: F.struct(p["param_id"].alias("id"), p["value"].alias("value")))
    message = F.to_json(F.struct("device_id", "ts_ms", members.alias("points")))
    empty = F.to_json(F.struct("device_id", "ts_ms", F.array().alias("points")))
    lines = point_packets(spark, sf_dir).select(F.explode(F.array(message, empty)).alias("value"))
    read = packets.parse_published(spark.read.text(_written_lines(spark, lines, "published")))
    return read.select("device_id", "ts_ms", "recv_ts", F.inline("points"))


@check("src_05_flat_payload", f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, value FROM cells")
def flat_payload(spark, sf_dir):
    members = F.map_from_entries(F.transform("points", lambda p: F.struct(F.lower(p["param_id"]), p["value"])))
    with_noise = F.map_concat(members, F.create_map(F.lit("k"), F.lit(1.0)))
    messages = point_packets(spark, sf_dir).select("device_id", "ts_ms", F.to_json(with_noise).alias("payload"))
    return packets.packet_points(packets.flat_packets(messages))


@check(
    "src_06_long_row_scan",
    f"WITH {PTS} SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM pts",
)
def long_row_scan(spark, sf_dir):
    path = scratch_path(spark, "long")
    sinks.write_long_rows(points(spark, sf_dir), path, partition_by=BY_DAY)
    rows = segments.read_table(spark, path)
    return rows.select("device_id", "ts_ms", "param_id", F.col("value").cast("double").alias("value"))


@check(
    "src_07_packet_wide_scan",
    f"WITH {PACKETS} SELECT device_id, ts_ms, param_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cells",
)
def packet_wide_scan(spark, sf_dir):
    from pulseframe.operators.reshape import packets_to_points

    path = scratch_path(spark, "wide")
    day_points = points(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") - F.pmod("ts_ms", F.lit(86_400_000)))
    sinks.write_points_as_packets(day_points, path, partition_by=("day",))
    rows = packets_to_points(segments.read_table(spark, path))
    return rows.withColumn("value", F.col("value").cast("double"))


@check(
    "src_08_sparse_point",
    f"""WITH {PTS}
    SELECT device_id, ts_ms AS timestamp, max(CASE WHEN param_id = 'P00002' THEN value END) AS value
    FROM pts GROUP BY device_id, ts_ms""",
)
def sparse_point(spark, sf_dir):
    path = scratch_path(spark, "sparse")
    sinks.write_sparse(points(spark, sf_dir), path, [1, 2, 3], partition_by=("year", "month", "day"))
    return segments.sparse_point(segments.read_table(spark, path), 2)


@check(
    "src_09_raw_archive",
    f"""WITH {PTS}
    SELECT CAST(1 AS SMALLINT) AS schema_version, device_id, ts_ms AS timestamp_ms, props AS payload_text FROM pts""",
)
def raw_archive(spark, sf_dir):
    path = scratch_path(spark, "raw")
    sinks.write_raw_archive(raw_events(spark, sf_dir), path, partition_by=BY_DAY)
    rows = segments.read_raw_archive(spark, path)
    return rows.select("schema_version", "device_id", "timestamp_ms", F.col("payload").cast("string").alias("payload_text"))


MANIFEST_FIELDS = ["segment_file", "min_ts", "max_ts", "rows", "points", "created_at_ms", "mode", "param_ids"]


@check(
    "src_10_manifest_strict",
    f"""WITH {CATALOG}
    SELECT segment_file, min_ts, max_ts, rows, points, max_ts AS created_at_ms, 'long_row' AS mode,
           array_to_string(param_ids, ',') AS params
    FROM catalog""",
)
def manifest_strict(spark, sf_dir):
    entries = catalog(spark, sf_dir).withColumns({"created_at_ms": F.col("max_ts"), "mode": F.lit("long-row")})
    path = _written_lines(spark, entries.select(F.to_json(F.struct(*MANIFEST_FIELDS)).alias("value")), "manifest")
    read = catalogs.read_manifests(spark, path, glob="*.txt")
    return read.select(*MANIFEST_FIELDS[:-1], F.array_join("param_ids", ",").alias("params"))


@check(
    "src_11_manifest_lenient",
    f"""WITH {CATALOG}
    SELECT segment_file, rows, CAST(0 AS BIGINT) AS points, 'packet_wide' AS mode, false AS bad_line FROM catalog
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, true FROM catalog WHERE rows > 1""",
)
def manifest_lenient(spark, sf_dir):
    old = F.to_json(F.struct("segment_file", "min_ts", "max_ts", "rows"))
    broken = F.when(F.col("rows") > 1, F.substring(old, 1, 30))
    entries = catalog(spark, sf_dir).select(F.explode(F.array(old, F.lit(""), broken)).alias("value"))
    path = _written_lines(spark, entries.where(F.col("value").isNotNull()), "manifest")
    read = catalogs.read_manifests(spark, path, strict=False, glob="*.txt")
    return read.select("segment_file", "rows", "points", "mode", "bad_line")


@check(
    "src_12_file_inventory",
    f"WITH {CATALOG} SELECT day, true AS has_files, true AS has_bytes, CAST(sum(rows) AS BIGINT) AS rows, true AS bytes_match FROM catalog GROUP BY day",
)
def file_inventory(spark, sf_dir):
    path = scratch_path(spark, "inventory")
    sinks.write_long_rows(points(spark, sf_dir), path, partition_by=BY_DAY)
    inventory = catalogs.file_inventory(spark, path, "*.parquet")
    # What the inventory lists must be the files that a scan of the table reads.
    scanned = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count("*").alias("rows"))
    )
    listed = inventory.join(scanned, "file_path", "left").groupBy("directory").agg(
        F.sum("rows").alias("rows"), F.sum("size").alias("scanned_bytes")
    )
    return catalogs.directory_totals(inventory).join(listed, "directory").select(
        F.regexp_extract("directory", "day=([^/]*)", 1).alias("day"),
        (F.col("files") >= 1).alias("has_files"),
        (F.col("bytes") > 0).alias("has_bytes"),
        "rows",
        (F.col("bytes") == F.col("scanned_bytes")).alias("bytes_match"),
    )


@check(
    "src_13_device_inventory",
    """SELECT 'dev' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS device_id,
              '10.0.0.' || c_nationkey AS ip, 9000 + c_nationkey AS port
       FROM customer""",
)
def device_inventory(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(
        device_name(F.col("c_custkey")).alias("device_id"),
        F.concat(F.lit("10.0.0."), F.col("c_nationkey").cast("string")).alias("ip"),
        (F.col("c_nationkey") + 9000).alias("port"),
    )
    path = scratch_path(spark, "devices")
    devices.write.json(path)
    return catalogs.read_device_inventory(spark, path)


FOREIGN_SPAN = (1704405600000, 1704506399999)


HALF_DAY = 43_200_000


def _site_points(spark, sf_dir):
    """All points under three sites, moved to the start of their half day."""
    site = F.concat(F.lit("site"), (F.col("user_id") % 3).cast("string"))
    start = F.col("ts_ms") - F.pmod("ts_ms", F.lit(HALF_DAY))
    return points(spark, sf_dir).select(site.alias("device_id"), start.alias("ts_ms"), "param_id", "value")


SITES = f"""
{PTS.strip()},
sites AS (SELECT 'site' || user_id % 3 AS device_id, ts_ms - ts_ms % {HALF_DAY} AS ts_ms, param_id, value FROM pts)"""


def _foreign_tree(spark, df, name):
    """A ``device/day/hour`` tree with unsigned 64-bit times, which Spark reads as DECIMAL(20,0)."""
    path = scratch_path(spark, name)
    keyed = sinks.with_day_hour(df.withColumn("device", F.col("device_id"))).drop("device_id")
    unsigned = keyed.withColumn("ts", F.col("ts_ms").cast("decimal(20,0)")).drop("ts_ms")
    unsigned.repartition("day").write.partitionBy("device", "day", "hour").parquet(path)
    return path


@check(
    "src_06_foreign_tree",
    f"""WITH {SITES} SELECT device_id, ts_ms, param_id, value FROM sites
    WHERE device_id = 'site1' AND ts_ms BETWEEN {FOREIGN_SPAN[0]} AND {FOREIGN_SPAN[1]}""",
)
def foreign_tree(spark, sf_dir):
    path = _foreign_tree(spark, _site_points(spark, sf_dir), "foreign")
    rows = segments.foreign_long_rows(spark, path, "ms", *FOREIGN_SPAN, device_id="site1")
    return rows.select(POINT_COLUMNS)


# The files to open come from a catalog of the tree.
@check(
    "src_06_catalog_files",
    f"""WITH {SITES} SELECT device_id, ts_ms, param_id, value FROM sites
    WHERE device_id = 'site1' AND ts_ms BETWEEN {FOREIGN_SPAN[0]} AND {FOREIGN_SPAN[1]} AND param_id = 'P00002'""",
)
def catalog_files(spark, sf_dir):
    path = _foreign_tree(spark, _site_points(spark, sf_dir), "foreign")
    catalog_of_tree = skipping.file_catalog(segments.foreign_long_rows(spark, path))
    files = skipping.candidate_files(catalog_of_tree, "site1", TimeRange(*FOREIGN_SPAN), "P00002")
    rows = segments.foreign_long_rows(spark, path, "ms", *FOREIGN_SPAN, device_id="site1", files=files)
    return rows.where(F.col("param_id") == "P00002").select(POINT_COLUMNS)


@check(
    "src_07_foreign_packets",
    f"""WITH {SITES} SELECT device_id, ts_ms, param_id, value FROM sites
    WHERE device_id = 'site2' AND ts_ms >= {FOREIGN_SPAN[0]}""",
)
def foreign_packets(spark, sf_dir):
    from pulseframe.operators.reshape import packets_to_points

    single = _site_points(spark, sf_dir).select(
        "device_id", "ts_ms", F.array("param_id").alias("param_ids"), F.array("value").alias("values")
    )
    path = _foreign_tree(spark, single, "foreign-wide")
    rows = segments.foreign_packets(spark, path, from_ms=FOREIGN_SPAN[0], device_id="site2")
    return packets_to_points(rows).select(POINT_COLUMNS)
