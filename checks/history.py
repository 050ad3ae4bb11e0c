"""QRY: end-user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import (
    BOUNDARY_MS,
    CATALOG,
    PTS,
    catalog,
    points,
    raw_events,
    segment_file,
    stored_catalog,
    stored_points,
    stored_raw,
    stored_sparse,
)
from checks.registry import check
from pulseframe.functions.timeparts import HOUR_MS, TimeRange
from pulseframe.operators import reshape
from pulseframe.operators.filters import partitioned_range
from pulseframe.plans import freesql, history
from pulseframe.session import scratch_path
from pulseframe.sinks.segments import with_day_hour, write_long_rows
from pulseframe.sources.segments import read_table

FORTNIGHT = TimeRange(1704067200000, 1705276799999)
DEVICE = "dev000003"
IN_RANGE = f"device_id = '{DEVICE}' AND ts_ms BETWEEN {FORTNIGHT.from_ms} AND {FORTNIGHT.to_ms}"


@check("qry_01_point_history", f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts WHERE {IN_RANGE} AND param_id = 'P00001'")
def point_history(spark, sf_dir):
    return history.point_history(points(spark, sf_dir), DEVICE, "P00001", FORTNIGHT)


@check(
    "qry_02_params_history",
    f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts WHERE {IN_RANGE} AND param_id IN ('P00001', 'Z00001')",
)
def params_history(spark, sf_dir):
    return history.params_history(points(spark, sf_dir), DEVICE, FORTNIGHT, ["p00001", "z00001"])


@check("qry_02_all_params_history", f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts WHERE {IN_RANGE}")
def all_params_history(spark, sf_dir):
    return history.params_history(points(spark, sf_dir), DEVICE, FORTNIGHT)


@check(
    "qry_03_cold_history",
    f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts WHERE {IN_RANGE} ORDER BY ts_ms, param_id LIMIT 10",
)
def cold_history(spark, sf_dir):
    return history.cold_history(points(spark, sf_dir), DEVICE, FORTNIGHT, limit=10)


def _unified(spark, sf_dir):
    rows = points(spark, sf_dir)
    return history.unified_history(rows, rows, DEVICE, FORTNIGHT, BOUNDARY_MS + HOUR_MS)


SOURCE = f"CASE WHEN ts_ms < {BOUNDARY_MS} THEN 'cold' ELSE 'hot' END AS source"


@check("qry_04_unified_history", f"WITH {PTS} SELECT ts_ms, param_id, value, {SOURCE} FROM pts WHERE {IN_RANGE}")
def unified_history(spark, sf_dir):
    return _unified(spark, sf_dir).rows


@check("qry_04_unified_counts", f"WITH {PTS} SELECT {SOURCE}, count(*) AS rows FROM pts WHERE {IN_RANGE} GROUP BY 1")
def unified_counts(spark, sf_dir):
    return _unified(spark, sf_dir).counts


def _paged(spark, sf_dir):
    rows = with_day_hour(points(spark, sf_dir)).withColumn("segment_file", segment_file())
    packets = rows.select(
        "device_id",
        "ts_ms",
        "segment_file",
        F.array("param_id").alias("param_ids"),
        F.array("value").alias("values"),
    )
    return history.paged_history(catalog(spark, sf_dir), packets, DEVICE, " p00001", FORTNIGHT, offset=2, limit=5)


@check(
    "qry_05_paged_history",
    f"WITH {PTS} SELECT ts_ms, value FROM pts WHERE {IN_RANGE} AND param_id = 'P00001' ORDER BY ts_ms LIMIT 5 OFFSET 2",
)
def paged_history(spark, sf_dir):
    return _paged(spark, sf_dir).rows


@check("qry_05_paged_total", f"WITH {PTS} SELECT count(*) AS total FROM pts WHERE {IN_RANGE} AND param_id = 'P00001'")
def paged_total(spark, sf_dir):
    return _paged(spark, sf_dir).total


def _raw(spark, sf_dir):
    return raw_events(spark, sf_dir).where(F.col("device_id") == DEVICE)


@check(
    "qry_06_raw_history_hex",
    f"""WITH {PTS} SELECT ts_ms, device_id, CAST(strlen(props) AS INTEGER) AS payload_len, lower(hex(encode(props))) AS payload_text
    FROM pts WHERE {IN_RANGE} ORDER BY ts_ms LIMIT 20""",
)
def raw_history_hex(spark, sf_dir):
    return history.raw_history(_raw(spark, sf_dir), DEVICE, FORTNIGHT, history.HEX, 20)


@check(
    "qry_06_raw_history_ascii",
    f"""WITH {PTS} SELECT ts_ms, device_id, CAST(strlen(props) AS INTEGER) AS payload_len, props AS payload_text FROM pts WHERE {IN_RANGE}""",
)
def raw_history_ascii(spark, sf_dir):
    return history.raw_history(_raw(spark, sf_dir), DEVICE, FORTNIGHT, history.ASCII, None)


@check(
    "qry_07_sparse_history",
    f"""WITH {PTS} SELECT ts_ms AS timestamp, max(CASE WHEN param_id = 'P00002' THEN value END) AS value
    FROM pts WHERE {IN_RANGE} GROUP BY ts_ms""",
)
def sparse_history(spark, sf_dir):
    wide = reshape.sparse_wide(points(spark, sf_dir), [1, 2])
    old = F.col("timestamp") < BOUNDARY_MS
    return history.sparse_history(wide.where(old), wide.where(~old), DEVICE, 2, FORTNIGHT)


@check(
    "qry_08_template",
    f"""WITH {PTS} SELECT param_id, count(*) AS n, max(value) AS top FROM pts
    WHERE ts_ms BETWEEN {FORTNIGHT.from_ms} AND {FORTNIGHT.to_ms} GROUP BY param_id""",
)
def template(spark, sf_dir):
    text = "SELECT param_id, count(*) AS n, max(value) AS top FROM {{table}} WHERE ts_ms BETWEEN {{from}} AND {{to}} GROUP BY param_id"
    return freesql.run_template(spark, text, points(spark, sf_dir), FORTNIGHT)


FREE = "SELECT device_id, count(DISTINCT param_id) AS params, min(value) AS low FROM pts GROUP BY device_id HAVING count(*) > 60"


@check("qry_09_free_sql", f"WITH {PTS} {FREE}")
def free_sql(spark, sf_dir):
    return freesql.run_sql(spark, FREE, {"pts": points(spark, sf_dir)})


@check("qry_10_typed_sql", f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts WHERE value > 100")
def typed_sql(spark, sf_dir):
    text = "SELECT ts_ms AS ts, param_id, value FROM pts WHERE value > :least"
    return freesql.run_typed(spark, text, {"pts": points(spark, sf_dir)}, {"least": 100})


@check(
    "qry_11_profiled",
    f"""WITH {PTS} SELECT device_id, ts_ms, param_id FROM pts
    WHERE ts_ms BETWEEN {FORTNIGHT.from_ms} AND {FORTNIGHT.to_ms} ORDER BY ts_ms, param_id, device_id LIMIT 100""",
)
def profiled(spark, sf_dir):
    rows, _ = freesql.profiled(points(spark, sf_dir), FORTNIGHT, 100)
    return rows.select("device_id", "ts_ms", "param_id")


@check(
    "qry_12_cross_hour",
    f"""WITH {CATALOG} SELECT day, hour, CAST(sum(rows) AS BIGINT) AS rows FROM catalog
    WHERE day || hour BETWEEN '2024-01-0422' AND '2024-01-0601' GROUP BY day, hour""",
)
def cross_hour(spark, sf_dir):
    span = TimeRange(1704405600000, 1704506399999)
    return partitioned_range(with_day_hour(points(spark, sf_dir)), span).groupBy("day", "hour").agg(F.count("*").alias("rows"))


@check(
    "qry_wide_history",
    f"""WITH {PTS}
    SELECT ts_ms, coalesce(max(CASE WHEN param_id = 'P00001' THEN value END), 'NaN'::DOUBLE) AS "P00001",
           coalesce(max(CASE WHEN param_id = 'P00002' THEN value END), 'NaN'::DOUBLE) AS "P00002"
    FROM pts WHERE {IN_RANGE} AND param_id IN ('P00001', 'P00002') GROUP BY ts_ms""",
)
def wide_history(spark, sf_dir):
    return history.wide_history(points(spark, sf_dir), DEVICE, ["P00001", "P00002"], FORTNIGHT)


# The same over tables as the writers store them: by day and hour, values as FLOAT.

NARROW = "CAST(CAST(value AS FLOAT) AS DOUBLE) AS value"


def _wide_values(df):
    return df.withColumn("value", F.col("value").cast("double"))


@check("qry_01_stored_point", f"WITH {PTS} SELECT ts_ms, param_id, {NARROW} FROM pts WHERE {IN_RANGE} AND param_id = 'P00001'")
def stored_point(spark, sf_dir):
    return _wide_values(history.point_history(stored_points(spark, sf_dir), DEVICE, "P00001", FORTNIGHT))


@check("qry_02_stored_zone", f"WITH {PTS} SELECT ts_ms, param_id, {NARROW} FROM pts WHERE {IN_RANGE}")
def stored_zone(spark, sf_dir):
    zone = "Asia/Shanghai"
    return _wide_values(history.params_history(stored_points(spark, sf_dir, zone), DEVICE, FORTNIGHT, tz=zone))


@check(
    "qry_02_before_epoch",
    f"""WITH {PTS} SELECT ts_ms - {BOUNDARY_MS} AS ts_ms, param_id, {NARROW} FROM pts
    WHERE device_id = '{DEVICE}' AND ts_ms BETWEEN {BOUNDARY_MS - 86400000} AND {BOUNDARY_MS + 86400000}""",
)
def before_epoch(spark, sf_dir):
    path = scratch_path(spark, "early")
    early = points(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms") - BOUNDARY_MS)
    write_long_rows(early, path, partition_by=("day", "hour"))
    span = TimeRange(-86400000, 86400000)
    return _wide_values(history.params_history(read_table(spark, path), DEVICE, span))


@check(
    "qry_05_stored_page",
    f"WITH {PTS} SELECT ts_ms, {NARROW} FROM pts WHERE {IN_RANGE} AND param_id = 'P00001' ORDER BY ts_ms LIMIT 5 OFFSET 2",
)
def stored_page(spark, sf_dir):
    single = stored_points(spark, sf_dir).withColumns(
        {"segment_file": segment_file(), "param_ids": F.array("param_id"), "values": F.array("value")}
    )
    page = history.paged_history(catalog(spark, sf_dir), single, DEVICE, "P00001", FORTNIGHT, offset=2, limit=5)
    return _wide_values(page.rows)


# Only the files that the catalog of the stored table names are opened.
@check(
    "qry_05_catalog_page",
    f"WITH {PTS} SELECT ts_ms, {NARROW} FROM pts WHERE {IN_RANGE} AND param_id = 'P00001' ORDER BY ts_ms LIMIT 6 OFFSET 1",
)
def catalog_page(spark, sf_dir):
    table = stored_points(spark, sf_dir)
    root, kept = stored_catalog(spark, sf_dir)
    page = history.catalog_history(spark, kept, root, table.schema, DEVICE, "P00001", FORTNIGHT, offset=1, limit=6)
    return _wide_values(page.rows)


# Tables keyed in another zone.
ZONE = "Asia/Shanghai"


@check("qry_04_stored_zone", f"WITH {PTS} SELECT ts_ms, param_id, {NARROW}, {SOURCE} FROM pts WHERE {IN_RANGE}")
def unified_zone(spark, sf_dir):
    rows = stored_points(spark, sf_dir, ZONE)
    return _wide_values(history.unified_history(rows, rows, DEVICE, FORTNIGHT, BOUNDARY_MS + HOUR_MS, tz=ZONE).rows)


@check(
    "qry_wide_zone",
    f"""WITH {PTS}
    SELECT ts_ms, coalesce(max(CASE WHEN param_id = 'P00001' THEN v END), 'NaN'::DOUBLE) AS "P00001",
           coalesce(max(CASE WHEN param_id = 'P00002' THEN v END), 'NaN'::DOUBLE) AS "P00002"
    FROM (SELECT *, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM pts)
    WHERE {IN_RANGE} AND param_id IN ('P00001', 'P00002') GROUP BY ts_ms""",
)
def wide_zone(spark, sf_dir):
    params = ["P00001", "P00002"]
    wide = history.wide_history(stored_points(spark, sf_dir, ZONE), DEVICE, params, FORTNIGHT, tz=ZONE)
    return wide.select("ts_ms", *[F.col(p).cast("double").alias(p) for p in params])


@check(
    "qry_06_stored_raw",
    f"""WITH {PTS} SELECT ts_ms, device_id, CAST(strlen(props) AS INTEGER) AS payload_len, props AS payload_text FROM pts WHERE {IN_RANGE}""",
)
def stored_raw_history(spark, sf_dir):
    own = stored_raw(spark, sf_dir).where(F.col("device_id") == DEVICE)
    return history.raw_history(own, DEVICE, FORTNIGHT, history.ASCII, None)


@check(
    "qry_07_stored_sparse",
    f"""WITH {PTS} SELECT ts_ms AS timestamp, max(CASE WHEN param_id = 'P00002' THEN value END) AS value
    FROM pts WHERE {IN_RANGE} GROUP BY ts_ms""",
)
def stored_sparse_history(spark, sf_dir):
    table = stored_sparse(spark, sf_dir)
    return history.sparse_history(table, table.where("false"), DEVICE, 2, FORTNIGHT)
