"""FLT: predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.adapter import BOUNDARY_MS, CATALOG, NOW_MS, PACKETS, PTS, catalog, packets, point_packets, points, table
from checks.registry import check
from pulseframe.functions import topics
from pulseframe.functions.codes import normalise_param
from pulseframe.functions.timeparts import TimeRange, resolve_range
from pulseframe.operators import filters
from pulseframe.sinks.segments import with_day_hour

POINT = "device_id, ts_ms, param_id, value"
COLUMNS = ["device_id", "ts_ms", "param_id", "value"]
WEEK = TimeRange(1704499200000, BOUNDARY_MS)


@check("flt_01_device", f"WITH {PTS} SELECT {POINT} FROM pts WHERE device_id = 'dev000007'")
def device(spark, sf_dir):
    return filters.of_device(points(spark, sf_dir), "dev000007").select(COLUMNS)


@check("flt_02_closed_interval", f"WITH {PTS} SELECT {POINT} FROM pts WHERE ts_ms BETWEEN {WEEK.from_ms} AND {WEEK.to_ms}")
def closed_interval(spark, sf_dir):
    return filters.in_range(points(spark, sf_dir), WEEK).select(COLUMNS)


@check(
    "flt_03_range_modes",
    f"""WITH {PTS},
    modes AS (
      SELECT * FROM (VALUES ('from_to', 1704153600000, 1704672000000), ('day', 1704844800000, 1704931199999),
        ('today', 1706659200000, 1706745599999), ('last', 1706486400000, 1706659200000), ('all', 0, 1706659200000)
      ) AS m(mode, lo, hi)
    )
    SELECT mode, count(ts_ms) AS n, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts
    FROM modes JOIN pts ON ts_ms BETWEEN lo AND hi GROUP BY mode""",
)
def range_modes(spark, sf_dir):
    modes = {
        "from_to": resolve_range(from_ms=1704153600000, to_ms=BOUNDARY_MS),
        "day": resolve_range(day="2024-01-10"),
        "today": resolve_range(today=True, now_ms=NOW_MS),
        "last": resolve_range(last="2d", now_ms=NOW_MS),
        "all": resolve_range(everything=True, now_ms=NOW_MS),
    }
    pts = points(spark, sf_dir)
    hit = F.array_compact(F.array(*[F.when(span.contains(F.col("ts_ms")), F.lit(m)) for m, span in modes.items()]))
    return (
        pts.select("ts_ms", F.explode(hit).alias("mode"))
        .groupBy("mode")
        .agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))
    )


@check("flt_04_param_list", f"WITH {PTS} SELECT {POINT} FROM pts WHERE param_id IN ('P00001', 'Z00001')")
def param_list(spark, sf_dir):
    return filters.of_params(points(spark, sf_dir), ["p00001", " Z00001 "]).select(COLUMNS)


@check("flt_04_long_param_list", f"WITH {PTS} SELECT {POINT} FROM pts WHERE param_id LIKE 'P%'")
def long_param_list(spark, sf_dir):
    return filters.of_params(points(spark, sf_dir), [f"P{n:05d}" for n in range(1, 1001)]).select(COLUMNS)


NAMES = """
names AS (
  SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'P' || lpad(CAST(p_partkey AS VARCHAR), 5, '0')
    WHEN 1 THEN 'Z' || p_partkey WHEN 2 THEN 'a' || lpad(CAST(p_partkey AS VARCHAR), 5, '0')
    WHEN 3 THEN 'B' || lpad(CAST(p_partkey AS VARCHAR), 5, '0')
    ELSE 'A' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || ' ' END AS param_id
  FROM part
)"""


def _names(spark, sf_dir):
    """Codes of every kind, from the part table."""
    number = F.col("p_partkey").cast("string")
    wide = F.lpad(number, 5, "0")
    kind = F.col("p_size") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("P"), wide))
        .when(kind == 1, F.concat(F.lit("Z"), number))
        .when(kind == 2, F.concat(F.lit("a"), wide))
        .when(kind == 3, F.concat(F.lit("B"), wide))
        .otherwise(F.concat(F.lit("A"), wide, F.lit(" ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("param_id"))


@check("flt_05_valid_codes", f"WITH {NAMES} SELECT * FROM names WHERE regexp_full_match(param_id, '[AZP][0-9]{{5}}')")
def valid_codes(spark, sf_dir):
    return filters.valid_codes(_names(spark, sf_dir))


@check(
    "flt_05_valid_codes_lenient",
    f"WITH {NAMES} SELECT p_partkey, upper(trim(param_id)) AS param_id FROM names "
    "WHERE regexp_full_match(upper(trim(param_id)), '[AZP][0-9]{5}')",
)
def valid_codes_lenient(spark, sf_dir):
    names = _names(spark, sf_dir)
    return filters.valid_codes(names.withColumn("param_id", normalise_param(F.col("param_id"))))


@check("flt_06_json_numbers", f"WITH {PTS} SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS value FROM pts")
def json_numbers(spark, sf_dir):
    # Every event offers its number, and the same number as text, in a list and as a truth value.
    k = F.get_json_object("props", "$.k")
    shapes = F.array(
        F.col("props"),
        F.concat(F.lit('{"k": "'), k, F.lit('"}')),
        F.concat(F.lit('{"k": ['), k, F.lit("]}")),
        F.lit('{"k": true}'),
        F.lit('{"k": null}'),
    )
    offered = points(spark, sf_dir).select("event_id", F.explode(shapes).alias("text"))
    member = F.try_variant_get(F.try_parse_json("text"), "$.k", "variant")
    kept = offered.where(filters.is_json_number(member))
    return kept.select("event_id", member.cast("double").alias("value"))


@check("flt_07_finite", f"WITH {PTS} SELECT event_id, value FROM pts WHERE param_id IN ('P00001', 'A00001', 'Z00001')")
def finite(spark, sf_dir):
    value = (
        F.when(F.col("param_id") == "P00002", F.lit(float("nan")))
        .when(F.col("param_id") == "P00003", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return filters.finite_values(points(spark, sf_dir).select("event_id", value.alias("value")))


@check("flt_08_non_negative", f"WITH {PTS} SELECT event_id, ts_ms - {BOUNDARY_MS} AS ts_ms FROM pts WHERE ts_ms >= {BOUNDARY_MS}")
def non_negative(spark, sf_dir):
    return filters.non_negative_times(points(spark, sf_dir).select("event_id", (F.col("ts_ms") - BOUNDARY_MS).alias("ts_ms")))


@check("flt_09_matched_lists", f"WITH {PACKETS} SELECT device_id, ts_ms, len(vals) AS n FROM packets WHERE len(vals) > 1")
def matched_lists(spark, sf_dir):
    # The only value of a single-point packet goes missing.
    cut = packets(spark, sf_dir).withColumn(
        "values", F.when(F.size("values") == 1, F.slice("values", 1, 0)).otherwise(F.col("values"))
    )
    return filters.matched_lists(cut).select("device_id", "ts_ms", F.size("values").cast("bigint").alias("n"))


@check(
    "flt_10_empty_packets",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms, len(list_filter(vals, lambda v: v > 50)) AS n FROM packets
    WHERE len(list_filter(vals, lambda v: v > 50)) > 0""",
)
def empty_packets(spark, sf_dir):
    loud = point_packets(spark, sf_dir).withColumn("points", F.filter("points", lambda p: p["value"] > 50))
    return filters.with_points(loud).select("device_id", "ts_ms", F.size("points").cast("bigint").alias("n"))


@check("flt_11_usable_segments", f"WITH {CATALOG} SELECT segment_file, rows FROM catalog WHERE rows > 1 AND hour <> '00'")
def usable_segments(spark, sf_dir):
    marked = catalog(spark, sf_dir).withColumns(
        {"rows": F.when(F.col("rows") > 1, F.col("rows")).otherwise(0), "sealed": F.col("hour") != "00"}
    )
    return filters.usable_segments(marked).select("segment_file", "rows")


@check(
    "flt_12_hour_overlap",
    f"""WITH {CATALOG} SELECT DISTINCT day, hour FROM catalog
    WHERE day || ' ' || hour BETWEEN '2024-01-06 05' AND '2024-01-08 17'""",
)
def hour_overlap(spark, sf_dir):
    hours = catalog(spark, sf_dir).select("day", "hour").distinct()
    # Bad names next to every good one.
    with_bad = hours.select(F.explode(F.array(F.struct("day", "hour"), F.struct("day", F.lit("24").alias("hour")),
                                              F.struct(F.lit("2024-13-01").alias("day"), "hour"))).alias("h")).select("h.*")
    span = TimeRange(1704499200000 + 5 * 3600000 + 1234, 1704672000000 + 17 * 3600000 + 1)
    return with_bad.where(filters.hour_overlaps(F.col("day"), F.col("hour"), span))


@check("flt_12_partition_pruning", f"WITH {PTS} SELECT {POINT} FROM pts WHERE ts_ms BETWEEN 1704512345678 AND 1704700000000")
def partition_pruning(spark, sf_dir):
    span = TimeRange(1704512345678, 1704700000000)
    return filters.partitioned_range(with_day_hour(points(spark, sf_dir)), span).select(COLUMNS)


FILTERS = ["gw/+/telemetry", "gw/#", "gw/dev000003/+", "+/+/P00001", "gw/dev000003/P00001", "#", "other/#"]


@check(
    "flt_13_topic_filter",
    f"""WITH {PTS},
    messages AS (
      SELECT 'gw/' || device_id || '/' || param_id AS topic FROM pts
      UNION ALL SELECT 'gw/' || device_id || '/telemetry' FROM pts WHERE param_id = 'P00001'
    ),
    tests AS (
      SELECT topic, 'gw/+/telemetry' AS topic_filter FROM messages WHERE regexp_full_match(topic, 'gw/[^/]*/telemetry')
      UNION ALL SELECT topic, 'gw/#' FROM messages
      UNION ALL SELECT topic, 'gw/dev000003/+' FROM messages WHERE regexp_full_match(topic, 'gw/dev000003/[^/]*')
      UNION ALL SELECT topic, '+/+/P00001' FROM messages WHERE regexp_full_match(topic, '[^/]*/[^/]*/P00001')
      UNION ALL SELECT topic, 'gw/dev000003/P00001' FROM messages WHERE topic = 'gw/dev000003/P00001'
      UNION ALL SELECT topic, '#' FROM messages
    )
    SELECT topic_filter, topic, count(*) AS n FROM tests GROUP BY ALL""",
)
def topic_filter(spark, sf_dir):
    pts = points(spark, sf_dir)
    own = pts.select(topics.param_topic(F.col("device_id"), F.col("param_id")).alias("topic"))
    shared = pts.where(F.col("param_id") == "P00001").select(topics.telemetry_topic(F.col("device_id")).alias("topic"))
    counts = own.unionByName(shared).groupBy("topic").agg(F.count("*").alias("n"))
    hits = [filters.on_topics(counts, f).withColumn("topic_filter", F.lit(f)) for f in FILTERS]
    return reduce(lambda a, b: a.unionByName(b), hits)


@check(
    "flt_14_may_contain",
    f"WITH {CATALOG} SELECT segment_file FROM catalog WHERE rows > 1 OR list_contains(param_ids, 'Z00001')",
)
def may_contain(spark, sf_dir):
    none = F.array().cast("array<string>")
    known = catalog(spark, sf_dir).withColumn("param_ids", F.when(F.col("rows") > 1, none).otherwise(F.col("param_ids")))
    return known.where(filters.may_contain(F.col("param_ids"), "Z00001")).select("segment_file")


@check("flt_15_projection", f"WITH {PTS} SELECT ts_ms, param_id, value FROM pts")
def projection(spark, sf_dir):
    return filters.points_only(points(spark, sf_dir))
