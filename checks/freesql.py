"""SQL: one query per category, run as text over the points.

The SQL twin is the same text wherever both dialects agree; where Spark needs another
form to scale, the twin says the same without it.  A window orders a whole device, as
its text asks; the operators in ``latest`` and ``presence`` order devices of any size.
"""

from __future__ import annotations

from checks.adapter import PACKETS, PTS, packets, points
from checks.registry import check
from pulseframe.plans.freesql import run_sql


def _same(name: str, text: str) -> None:
    """Register a query whose text both engines understand."""
    _both(name, text, text)


def _both(name: str, spark_text: str, sql_text: str) -> None:
    @check(name, f"WITH {PTS}, q AS ({sql_text}) SELECT * FROM q")
    def run(spark, sf_dir):
        return run_sql(spark, spark_text, {"pts": points(spark, sf_dir)})


_same(
    "sql_01_projection",
    """SELECT event_id, value * 2 + 1 AS scaled, CASE WHEN value > 50 THEN 'loud' WHEN value BETWEEN 10 AND 50 THEN 'mid' ELSE 'low' END AS band,
              CAST(ts_ms / 1000 AS DOUBLE) AS sec
       FROM pts WHERE param_id IN ('P00001', 'Z00001') AND device_id LIKE 'dev00000%'""",
)
_same(
    "sql_02_equi_joins",
    """SELECT a.device_id, a.param_id, a.n AS clicks, b.n AS errors
       FROM (SELECT device_id, param_id, count(*) AS n FROM pts WHERE value < 5 GROUP BY device_id, param_id) a
       FULL OUTER JOIN (SELECT device_id, param_id, count(*) AS n FROM pts WHERE value > 100 GROUP BY device_id, param_id) b
         ON a.device_id = b.device_id AND a.param_id = b.param_id""",
)
_same(
    "sql_02_left_join",
    """SELECT p.event_id, q.top FROM pts p
       LEFT JOIN (SELECT device_id, param_id, max(value) AS top FROM pts WHERE value > 100 GROUP BY device_id, param_id) q
         ON p.device_id = q.device_id AND p.param_id = q.param_id""",
)
_same(
    "sql_03_semi_anti",
    """SELECT event_id FROM pts p
       WHERE EXISTS (SELECT 1 FROM pts q WHERE q.device_id = p.device_id AND q.value > 300)
         AND NOT EXISTS (SELECT 1 FROM pts r WHERE r.device_id = p.device_id AND r.param_id = p.param_id AND r.value > 200)
         AND p.param_id IN (SELECT param_id FROM pts WHERE value > 400)""",
)
# A range self join needs an equality to stay off a nested loop: the hour, next to the device.
# A pair reaches into the next hour at most, so the earlier row is given both.
_both(
    "sql_04_range_join",
    """SELECT a.event_id AS first_event, b.event_id AS second_event
       FROM (SELECT event_id, device_id, ts_ms, explode(array(ts_ms div 3600000, ts_ms div 3600000 + 1)) AS hour FROM pts WHERE param_id = 'P00001') a
       JOIN (SELECT event_id, device_id, ts_ms, ts_ms div 3600000 AS hour FROM pts WHERE param_id = 'P00002') b
         ON a.device_id = b.device_id AND a.hour = b.hour AND b.ts_ms > a.ts_ms AND b.ts_ms <= a.ts_ms + 1800000""",
    """SELECT a.event_id AS first_event, b.event_id AS second_event
       FROM pts a JOIN pts b ON a.device_id = b.device_id AND b.ts_ms > a.ts_ms AND b.ts_ms <= a.ts_ms + 1800000
       WHERE a.param_id = 'P00001' AND b.param_id = 'P00002'""",
)
# The latest value of the day, else the last one of the days before: no device is ordered as a whole.
_both(
    "sql_05_as_of",
    """WITH days AS (SELECT device_id, ts_ms div 86400000 AS day, max_by(value, struct(ts_ms, event_id)) AS last FROM pts
                     WHERE param_id = 'P00001' GROUP BY ALL),
            known AS (SELECT device_id, ts_ms div 86400000 AS day FROM pts GROUP BY ALL),
            earlier AS (SELECT k.device_id, k.day, last_value(last, true)
                          OVER (PARTITION BY k.device_id ORDER BY k.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                        FROM known k LEFT JOIN days d ON k.device_id = d.device_id AND k.day = d.day)
       SELECT p.event_id, coalesce(p.today, e.before) AS click_value
       FROM (SELECT event_id, device_id, ts_ms div 86400000 AS day, last_value(CASE WHEN param_id = 'P00001' THEN value END, true)
               OVER (PARTITION BY device_id, ts_ms div 86400000 ORDER BY ts_ms, event_id) AS today FROM pts) p
       JOIN earlier e ON p.device_id = e.device_id AND p.day = e.day""",
    """SELECT event_id, last_value(CASE WHEN param_id = 'P00001' THEN value END IGNORE NULLS)
                OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS click_value
       FROM pts""",
)
_same(
    "sql_06_group_by",
    """SELECT device_id, param_id, count(*) AS n, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
              round(avg(value), 6) AS mean, round(stddev(value), 6) AS spread, count(DISTINCT ts_ms % 24) AS kinds
       FROM pts GROUP BY device_id, param_id HAVING count(*) > 5""",
)
_same(
    "sql_07_grouping_sets",
    """SELECT device_id, param_id, count(*) AS n, max(value) AS top FROM pts GROUP BY GROUPING SETS ((device_id, param_id), (device_id), ())""",
)
_same("sql_07_cube", "SELECT param_id, value > 50 AS loud, count(*) AS n FROM pts GROUP BY CUBE (param_id, value > 50)")
_same("sql_07_rollup", "SELECT device_id, param_id, max(value) AS top FROM pts GROUP BY ROLLUP (device_id, param_id)")
_both(
    "sql_08_approximate",
    """SELECT a.param_id, close_count, devices, count_if(value <= middle) BETWEEN 0.49 * n AND 0.51 * n + 1 AS plausible
       FROM (SELECT param_id, abs(approx_count_distinct(device_id) - count(DISTINCT device_id)) <= 0.1 * count(DISTINCT device_id) AS close_count,
                    count(DISTINCT device_id) AS devices, count(*) AS n, approx_percentile(value, 0.5, 1000) AS middle
             FROM pts GROUP BY param_id) a
       JOIN pts p ON p.param_id = a.param_id GROUP BY a.param_id, close_count, devices, n""",
    "SELECT param_id, true AS close_count, count(DISTINCT device_id) AS devices, true AS plausible FROM pts GROUP BY param_id",
)
_same(
    "sql_09_ranking",
    """SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk,
              CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter
       FROM pts WINDOW w AS (PARTITION BY device_id ORDER BY value, event_id)""",
)
_same(
    "sql_10_analytic",
    """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS later, first_value(value) OVER w AS opening,
              max(value) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top3,
              count(*) OVER (PARTITION BY device_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS in_hour
       FROM pts WINDOW w AS (PARTITION BY device_id ORDER BY ts_ms, event_id)""",
)
_same(
    "sql_11_set_operations",
    """(SELECT device_id FROM pts WHERE value > 200 UNION SELECT device_id FROM pts WHERE param_id = 'A00001')
       INTERSECT SELECT device_id FROM pts WHERE value > 100
       EXCEPT SELECT device_id FROM pts WHERE value > 300""",
)
_same("sql_11_union_all", "SELECT param_id, value FROM pts WHERE value > 300 UNION ALL SELECT param_id, value FROM pts WHERE value > 250")
_same(
    "sql_12_subqueries",
    """WITH tops AS (SELECT device_id, max(value) AS top FROM pts GROUP BY device_id)
       SELECT p.event_id, p.value FROM pts p JOIN tops t ON p.device_id = t.device_id AND p.value = t.top
       WHERE p.value > (SELECT avg(value) FROM pts)
         AND p.value >= (SELECT max(q.value) FROM pts q WHERE q.device_id = p.device_id AND q.param_id = p.param_id)""",
)
_same("sql_13_top_k", "SELECT event_id, value FROM pts ORDER BY value DESC, event_id LIMIT 50 OFFSET 10")
_both(
    "sql_14_time_buckets",
    """SELECT CAST(CAST(at AS DATE) AS STRING) AS day, hour(at) AS hour, dayofweek(at) AS weekday, count(*) AS n
       FROM (SELECT timestampadd(MILLISECOND, ts_ms, timestamp_ntz'1970-01-01 00:00:00') AS at FROM pts) GROUP BY 1, 2, 3""",
    """SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, CAST(extract(hour FROM make_timestamp(ts_ms * 1000)) AS INTEGER) AS hour,
              CAST(dayofweek(make_timestamp(ts_ms * 1000)) + 1 AS INTEGER) AS weekday, count(*) AS n
       FROM pts GROUP BY 1, 2, 3""",
)
_same(
    "sql_15_functions",
    """SELECT event_id, upper(substring(device_id, 1, 3)) AS prefix, CAST(length(param_id) AS BIGINT) AS width, replace(param_id, '0', '') AS short,
              concat(device_id, '/', param_id) AS path, CAST(floor(value) AS BIGINT) AS whole, abs(value - 50) AS distance, sqrt(value) AS root,
              coalesce(nullif(param_id, 'A00001'), 'none') AS named, greatest(value, 10.0) AS at_least
       FROM pts""",
)


@check(
    "sql_16_arrays_and_json",
    f"""WITH {PACKETS}
    SELECT p.device_id, p.ts_ms, len(vals) AS n, list_max(vals) AS top, array_to_string(list_filter(param_ids, lambda x: x LIKE 'P%'), ',') AS p_codes,
           list_contains(param_ids, 'Z00001') AS has_z
    FROM packets p""",
)
def arrays_and_json(spark, sf_dir):
    text = """SELECT device_id, ts_ms, CAST(size(values) AS BIGINT) AS n, aggregate(values, CAST(0 AS DOUBLE), (a, v) -> greatest(a, v)) AS top,
                     array_join(filter(param_ids, x -> x LIKE 'P%'), ',') AS p_codes, array_contains(param_ids, 'Z00001') AS has_z
              FROM packets"""
    return run_sql(spark, text, {"packets": packets(spark, sf_dir)})


@check("sql_16_json", f"WITH {PTS} SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM pts WHERE CAST(props->>'$.k' AS INTEGER) > 50")
def json_functions(spark, sf_dir):
    text = "SELECT event_id, from_json(props, 'k int').k AS k FROM pts WHERE from_json(props, 'k int').k > 50"
    return run_sql(spark, text, {"pts": points(spark, sf_dir)})
