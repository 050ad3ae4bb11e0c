"""PCK: messages of limited size."""

from __future__ import annotations

from checks.adapter import PACKETS, PTS, SUBSCRIPTIONS, point_packets, points, subscriptions
from checks.registry import check
from pulseframe.operators import joins, packing


def _greedy(head: str, keys: str, limit: int) -> str:
    """Next-fit packing, point by point.

    ``source`` has the key columns, ``param_id`` and ``value``; ``head`` is the
    text before the points.
    """
    same = " AND ".join(f"w.{k.strip()} = z.{k.strip()}" for k in keys.split(","))
    walked = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    return f"""
    sized AS (
      SELECT *, {head} AS head, strlen({head}) + 2 AS header,
             '{{"id":"' || param_id || '","value":' || CAST(value AS VARCHAR) || '}}' AS body,
             row_number() OVER (PARTITION BY {keys} ORDER BY param_id) AS pos
      FROM source
    ),
    walk AS (
      SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS bytes, false AS kept FROM sized
      UNION ALL
      SELECT {walked}, z.pos,
             CASE WHEN w.bytes > 0 AND w.bytes + 1 + strlen(body) <= {limit} THEN w.batch
                  WHEN header + strlen(body) <= {limit} THEN w.batch + 1 ELSE w.batch END,
             CASE WHEN w.bytes > 0 AND w.bytes + 1 + strlen(body) <= {limit} THEN w.bytes + 1 + strlen(body)
                  WHEN header + strlen(body) <= {limit} THEN header + strlen(body) ELSE 0 END,
             header + strlen(body) <= {limit}
      FROM walk w JOIN sized z ON {same} AND z.pos = w.pos + 1
    )
    SELECT {walked}, CAST(batch - 1 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS point_count,
           min(head) || string_agg(body, ',' ORDER BY w.pos) || ']}}' AS payload
    FROM walk w JOIN sized z ON {same} AND z.pos = w.pos
    WHERE kept GROUP BY {walked}, batch"""


DEVICE_HEAD = """'{"device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"points":['"""
CLIENT_HEAD = """'{"client_id":"' || client_id || '","device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"points":['"""


def _device_sql(limit):
    return f"WITH RECURSIVE {PACKETS}, source AS (SELECT * FROM cells), {_greedy(DEVICE_HEAD, 'device_id, ts_ms', limit)}"


@check("pck_01_device_messages", _device_sql(packing.MAX_DEVICE_BYTES))
def device_messages(spark, sf_dir):
    return packing.device_messages(point_packets(spark, sf_dir))


# Two points fit into a message.
@check("pck_01_small_limit", _device_sql(122))
def small_limit(spark, sf_dir):
    return packing.device_messages(point_packets(spark, sf_dir), 122)


# Points with a long value do not fit at all.
@check("pck_01_dropped_points", _device_sql(88))
def dropped_points(spark, sf_dir):
    return packing.device_messages(point_packets(spark, sf_dir), 88)


def _client_sql(limit):
    return f"""WITH RECURSIVE {PACKETS}, {SUBSCRIPTIONS},
    source AS (
      SELECT client_id, c.device_id, ts_ms, param_id, value
      FROM cells c JOIN subs s ON c.device_id = s.device_id AND list_contains(s.param_ids, c.param_id)
    ),
    {_greedy(CLIENT_HEAD, 'client_id, device_id, ts_ms', limit)}"""


@check("pck_02_client_messages", _client_sql(packing.MAX_CLIENT_BYTES))
def client_messages(spark, sf_dir):
    return packing.client_messages(joins.fan_out(point_packets(spark, sf_dir), subscriptions(spark, sf_dir)))


@check("pck_02_small_limit", _client_sql(125))
def client_small_limit(spark, sf_dir):
    return packing.client_messages(joins.fan_out(point_packets(spark, sf_dir), subscriptions(spark, sf_dir)), 125)


@check(
    "pck_03_param_messages",
    f"""WITH {PTS}
    SELECT device_id, ts_ms, param_id, '{{"device_id":"' || device_id || '","ts_ms":' || ts_ms || ',"param_id":"' || param_id
           || '","value":' || CAST(value AS VARCHAR) || '}}' AS payload
    FROM pts""",
)
def param_messages(spark, sf_dir):
    return packing.param_messages(points(spark, sf_dir))
