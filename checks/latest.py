"""WIN: current values, change logs, runs and row merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import (
    CATALOG,
    PACKETS,
    PRESENCE,
    PTS,
    SUBSCRIPTIONS,
    catalog,
    day_points,
    joined,
    packets,
    points,
    presence,
    subscriptions,
)
from checks.registry import check
from pulseframe.operators import latest
from pulseframe.session import scratch_path
from pulseframe.sinks import catalogstore
from pulseframe.sinks.segments import with_day_hour


@check(
    "win_01_current_values",
    f"""WITH {PTS} SELECT device_id, param_id, arg_max(value, (ts_ms, value)) AS value, max(ts_ms) AS ts_ms
    FROM pts GROUP BY device_id, param_id""",
)
def current_values(spark, sf_dir):
    return latest.current_values(points(spark, sf_dir).withColumn("param_id", F.lower("param_id")))


@check(
    "win_02_recent_packets",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms, array_to_string(param_ids, ',') AS params FROM packets
    QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts_ms DESC) <= 5""",
)
def recent_packets(spark, sf_dir):
    recent = latest.recent_packets(packets(spark, sf_dir), 5)
    return recent.select("device_id", "ts_ms", joined(F.col("param_ids")).alias("params"))


@check("win_03_last_rows", f"WITH {PTS} SELECT event_id, ts_ms FROM pts ORDER BY ts_ms DESC, event_id DESC LIMIT 500")
def last_rows(spark, sf_dir):
    return latest.last_rows(points(spark, sf_dir).select("event_id", "ts_ms"), ["ts_ms", "event_id"])


@check(
    "win_04_session_view",
    f"""WITH {PRESENCE} SELECT client_id, max(ts_ms) AS last_seen_ts, upper(arg_max(cmd, (ts_ms, cmd))) AS last_cmd
    FROM presence GROUP BY client_id""",
)
def session_view(spark, sf_dir):
    return latest.session_view(presence(spark, sf_dir)).orderBy("client_id")


def _changes(spark, sf_dir):
    """Each event sets its client's subscription of the device to one parameter; errors delete it."""
    pts = points(spark, sf_dir)
    error = F.col("param_id") == "P00002"
    return pts.select(
        F.concat(F.lit("cli-"), (F.col("user_id") % 25).cast("string")).alias("client_id"),
        "device_id",
        F.when(error, latest.DELETE).otherwise(latest.SET).alias("op"),
        F.when(~error, F.array(F.lower("param_id"), F.lit(" p00001"))).alias("param_ids"),
        F.col("event_id").alias("seq"),
    )


CHANGES = f"""
{PTS.strip()},
changes AS (
  SELECT 'cli-' || user_id % 25 AS client_id, device_id, event_id AS seq,
         CASE WHEN param_id = 'P00002' THEN 'del' ELSE 'set' END AS op, list_sort(list_distinct([param_id, 'P00001'])) AS param_ids
  FROM pts
),
state AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, device_id ORDER BY seq DESC) AS rn FROM changes)
  WHERE rn = 1 AND op = 'set'
)"""


@check(
    "win_05_current_subscriptions",
    f"WITH {CHANGES} SELECT client_id, device_id, array_to_string(param_ids, ',') AS params FROM state",
)
def current_subscriptions(spark, sf_dir):
    state = latest.current_subscriptions(_changes(spark, sf_dir))
    return state.select("client_id", "device_id", F.array_join("param_ids", ",").alias("params"))


def _removed(spark, sf_dir):
    """Clients named like an odd nation key, one of them twice."""
    from checks.adapter import table

    odd = table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 2 == 1)
    names = odd.select(F.concat(F.lit("cli-"), F.col("n_nationkey").cast("string")).alias("client_id"))
    return names.unionByName(names)


@check(
    "win_06_cascade",
    f"""WITH {SUBSCRIPTIONS} SELECT client_id, device_id FROM subs
    WHERE client_id NOT IN (SELECT 'cli-' || n_nationkey FROM nation WHERE n_nationkey % 2 = 1)""",
)
def cascade(spark, sf_dir):
    left = latest.without_clients(subscriptions(spark, sf_dir), _removed(spark, sf_dir))
    return left.select("client_id", "device_id")


@check(
    "win_06_removed_counts",
    f"""WITH {SUBSCRIPTIONS}
    SELECT 'cli-' || n_nationkey AS client_id, count(s.client_id) AS removed
    FROM nation LEFT JOIN subs s ON s.client_id = 'cli-' || n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY 1""",
)
def removed_counts(spark, sf_dir):
    return latest.removed_counts(subscriptions(spark, sf_dir), _removed(spark, sf_dir))


RUNS = """
  SELECT {key}, param_id, min(event_id) AS start_row, max(event_id) + 1 AS end_row, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts
  FROM (
    SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY event_id) AS run
    FROM (
      SELECT *, CASE WHEN param_id = lag(param_id) OVER (PARTITION BY {key} ORDER BY event_id) THEN 0 ELSE 1 END AS opens
      FROM named
    )
  )
  GROUP BY {key}, run, param_id"""


def _named(spark, sf_dir):
    """Events in stored order; every error is a row without a parameter."""
    rows = with_day_hour(points(spark, sf_dir))
    return rows.select(
        "day",
        F.lit("all").alias("whole"),
        F.col("event_id").alias("row_index"),
        F.when(F.col("param_id") != "P00002", F.col("param_id")).alias("param_id"),
        "ts_ms",
    )


NAMED = f"""
{PTS.strip()},
named AS (
  SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, 'all' AS whole FROM pts WHERE param_id <> 'P00002'
)"""


@check("win_07_parameter_runs", f"WITH {NAMED} {RUNS.format(key='day')}")
def parameter_runs(spark, sf_dir):
    return latest.parameter_runs(_named(spark, sf_dir), "day")


# One file that holds every row.
@check("win_07_parameter_runs_one_file", f"WITH {NAMED} {RUNS.format(key='whole')}")
def parameter_runs_one_file(spark, sf_dir):
    return latest.parameter_runs(_named(spark, sf_dir), "whole")


@check(
    "win_08_numbered_packets",
    f"""WITH {PACKETS}
    SELECT device_id, ts_ms, len(vals) AS n, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms) AS s FROM packets""",
)
def numbered_packets(spark, sf_dir):
    numbered = latest.numbered_packets(packets(spark, sf_dir))
    return numbered.select("device_id", "ts_ms", F.size("values").cast("bigint").alias("n"), "s")


@check(
    "win_09_unique_points",
    f"""WITH {PTS},
    spelled AS (
      SELECT device_id, ts_ms - ts_ms % 86400000 AS ts_ms, CASE WHEN value > 50 THEN lower(param_id) ELSE param_id END AS raw_id,
             param_id, max(value) AS value
      FROM pts GROUP BY ALL
    )
    SELECT device_id, ts_ms, param_id, arg_min(value, raw_id) AS value FROM spelled GROUP BY ALL""",
)
def unique_points(spark, sf_dir):
    # Loud values arrive under a lower-case name.
    spelled = day_points(spark, sf_dir).withColumn(
        "param_id", F.when(F.col("value") > 50, F.lower("param_id")).otherwise(F.col("param_id"))
    )
    loudest = spelled.groupBy("device_id", "ts_ms", "param_id").agg(F.max("value").alias("value"))
    return latest.unique_points(loudest)


@check("win_10_unique_segments", f"WITH {CATALOG} SELECT device_id, day, hour, segment_file FROM catalog")
def unique_segments(spark, sf_dir):
    known = catalog(spark, sf_dir).select("device_id", "day", "hour", "segment_file")
    return latest.unique_segments(known.unionByName(known))


@check(
    "win_11_upsert_segments",
    f"""WITH {CATALOG}
    SELECT device_id, day, hour, segment_file, CASE WHEN rows > 1 THEN rows * 10 ELSE rows END AS rows,
           CASE WHEN rows > 1 THEN max_ts + 1 ELSE max_ts END AS created_at_ms
    FROM catalog
    UNION ALL SELECT device_id, day, hour, segment_file || '_new', rows * 10, max_ts + 1 FROM catalog WHERE rows > 1""",
)
def upsert_segments(spark, sf_dir):
    known = catalog(spark, sf_dir).select(
        "device_id", "day", "hour", "segment_file", "rows", F.col("max_ts").alias("created_at_ms")
    )
    newer = known.where(F.col("rows") > 1).withColumns({"rows": F.col("rows") * 10, "created_at_ms": F.col("created_at_ms") + 1})
    added = newer.withColumn("segment_file", F.concat("segment_file", F.lit("_new")))
    return latest.upsert_segments(known, newer.unionByName(added))


def _merge_sql(gap_ms):
    return f"""WITH {PTS},
    marked AS (
      SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY device_id ORDER BY ts_ms, param_id) <= {gap_ms} THEN 0 ELSE 1 END AS opens
      FROM pts
    ),
    rows AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY ts_ms, param_id) AS row_number FROM marked),
    cells AS (
      SELECT device_id, row_number, param_id, arg_max(value, (ts_ms, value)) AS value, min(ts_ms) AS lo, max(ts_ms) AS hi
      FROM rows GROUP BY ALL
    )
    SELECT device_id, CAST(row_number AS BIGINT) AS row_number, min(lo) AS label_ts, max(hi) AS ts_ms,
           string_agg(param_id || '=' || CAST(value AS VARCHAR), ',' ORDER BY param_id) AS texts
    FROM cells GROUP BY device_id, row_number"""


def _merged(spark, sf_dir, gap_ms):
    rows = latest.merged_rows(points(spark, sf_dir), gap_ms)
    text = F.transform(
        F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select("device_id", "row_number", "label_ts", "ts_ms", F.array_join(text, ",").alias("texts"))


@check("win_12_merged_rows", _merge_sql(latest.MERGE_GAP_MS))
def merged_rows(spark, sf_dir):
    return _merged(spark, sf_dir, latest.MERGE_GAP_MS)


@check("win_12_merged_rows_hours", _merge_sql(6 * 3600000))
def merged_rows_hours(spark, sf_dir):
    return _merged(spark, sf_dir, 6 * 3600000)


@check(
    "win_05_deletion_results",
    f"""WITH {CHANGES}
    SELECT client_id, device_id, seq, coalesce(before = 'set', false) AS removed
    FROM (SELECT *, lag(op) OVER (PARTITION BY client_id, device_id ORDER BY seq) AS before FROM changes) WHERE op = 'del'""",
)
def deletion_results(spark, sf_dir):
    return latest.deletion_results(_changes(spark, sf_dir))


@check(
    "win_05_lookup",
    f"""WITH {CHANGES},
    asked AS (SELECT 'cli-' || n_nationkey AS client_id, 'dev' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS device_id FROM nation)
    SELECT a.client_id, a.device_id, array_to_string(s.param_ids, ',') AS params, s.client_id IS NOT NULL AS found
    FROM asked a LEFT JOIN state s ON a.client_id = s.client_id AND a.device_id = s.device_id""",
)
def lookup(spark, sf_dir):
    from checks.adapter import device_name, table

    number = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("cli-"), number.cast("string")).alias("client_id"), device_name(number).alias("device_id")
    )
    found = latest.looked_up(asked, latest.current_subscriptions(_changes(spark, sf_dir)))
    return found.select("client_id", "device_id", F.array_join("param_ids", ",").alias("params"), "found")


# The same upsert on storage: every half is a commit, and the newest entry of a segment stays.
@check(
    "win_11_stored_upserts",
    f"""WITH {CATALOG}
    SELECT device_id, day, hour, segment_file, CASE WHEN rows > 1 THEN rows * 10 ELSE rows END AS rows FROM catalog""",
)
def stored_upserts(spark, sf_dir):
    store = catalogstore.CatalogStore(spark, scratch_path(spark, "catalog-store"), catalogstore.segment_schema())
    known = catalogstore.with_times(catalog(spark, sf_dir))
    newer = known.where(F.col("rows") > 1).withColumns({"rows": F.col("rows") * 10, "created_at_ms": F.col("created_at_ms") + 1})
    store.upsert(newer)
    store.upsert(known)
    return store.read().select("device_id", "day", "hour", "segment_file", "rows")
