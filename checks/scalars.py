"""SCL: column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import PTS, points, table
from checks.registry import check
from pulseframe.functions import codes, naming, text, timeparts, topics


@check("scl_01_normalise_param", f"WITH {PTS} SELECT event_id, param_id FROM pts")
def normalise_param(spark, sf_dir):
    messy = F.concat(F.lit(" \t"), F.lower("param_id"), F.lit("\n "))
    return points(spark, sf_dir).select("event_id", codes.normalise_param(messy).alias("param_id"))


# A part of size n asks for n codes from its key on.
SPECS = """
specs AS (
  SELECT p_partkey, p_partkey % 90000 AS lo, p_partkey % 90000 + p_size AS hi FROM part
)"""


def _specs(spark, sf_dir):
    lo = F.col("p_partkey") % 90000
    # Listing the codes costs far more than reading the parts, whose file may be one or two tasks.
    parts = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", lo.alias("lo"), (lo + F.col("p_size")).alias("hi"))


def _code(prefix, number):
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 5, "0"))


@check(
    "scl_02_expand_specs",
    f"""WITH {SPECS}
    SELECT p_partkey, 'Z00009' || ',' || string_agg('A' || lpad(CAST(n AS VARCHAR), 5, '0'), ',' ORDER BY n) AS codes
    FROM (SELECT p_partkey, unnest(range(lo, hi + 1)) AS n FROM specs) GROUP BY p_partkey""",
)
def expand_specs(spark, sf_dir):
    token = F.concat(F.lower(_code("A", F.col("lo"))), F.lit(" ~ "), _code("A", F.col("hi")))
    tokens = F.array(F.lit(" z00009"), F.lit("  "), token)
    return _specs(spark, sf_dir).select("p_partkey", F.array_join(codes.expand_specs(tokens), ",").alias("codes"))


@check(
    "scl_03_expand_specs_lenient",
    f"""WITH {SPECS},
    names AS (SELECT p_partkey, lo, n FROM (SELECT p_partkey, lo, unnest(range(lo, hi + 1)) AS n FROM specs))
    SELECT p_partkey, string_agg('X_' || lpad(CAST(n AS VARCHAR), 7, '0'), ',' ORDER BY n) || ',FREE' AS names
    FROM names GROUP BY p_partkey""",
)
def expand_specs_lenient(spark, sf_dir):
    spec = F.concat(
        F.lit("x_"), F.lpad(F.col("lo").cast("string"), 7, "0"), F.lit("~X_"), F.col("hi").cast("string"),
        F.lit(", free ,P9~P1,~P1,FREE"),
    )
    return _specs(spark, sf_dir).select("p_partkey", F.array_join(codes.expand_specs_lenient(spec), ",").alias("names"))


@check(
    "scl_04_specs_are_valid",
    f"""WITH {SPECS} SELECT p_partkey, lo % 3 <> 1 AS ok FROM specs""",
)
def specs_are_valid(spark, sf_dir):
    lo, hi = F.col("lo"), F.col("hi")
    forward = F.concat(_code("B", lo), F.lit("~"), _code("B", hi))
    reversed_or_mixed = F.concat(_code("B", hi), F.lit("~"), _code("C", lo))
    token = F.when(lo % 3 == 0, forward).when(lo % 3 == 1, reversed_or_mixed).otherwise(_code("q", lo))
    tokens = F.array(token, F.lit(" "))
    return _specs(spark, sf_dir).select("p_partkey", codes.specs_are_valid(tokens).alias("ok"))


@check(
    "scl_05_point_index",
    """SELECT c_custkey, CAST(c_custkey AS INTEGER) AS code_index,
              CASE WHEN c_custkey BETWEEN 1 AND 10000 THEN CAST(c_custkey AS INTEGER) END AS column_index,
              CASE WHEN c_custkey BETWEEN 1 AND 10000 THEN 'point_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') END AS column_name
       FROM customer""",
)
def point_index(spark, sf_dir):
    number = F.col("c_custkey").cast("string")
    code, name = F.concat(F.lit("P"), number), F.concat(F.lit("point_"), number)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        codes.point_index(code).alias("code_index"),
        codes.point_column_index(name).alias("column_index"),
        codes.point_column_name(codes.point_index(code)).alias("column_name"),
    )


@check(
    "scl_06_floor_seconds",
    f"WITH {PTS} SELECT event_id, ts_ms // 1000 AS sec, CAST(floor((ts_ms - 1704672000000) / 1000.0) AS BIGINT) AS shifted FROM pts",
)
def floor_seconds(spark, sf_dir):
    ts = F.col("ts_ms")
    return points(spark, sf_dir).select(
        "event_id",
        timeparts.floor_seconds(ts).alias("sec"),
        timeparts.floor_seconds(ts - 1704672000000).alias("shifted"),
    )


LOCAL = "make_timestamp(ts_ms * 1000)"


@check(
    "scl_07_day_and_hour",
    f"""WITH {PTS}
    SELECT event_id, strftime({LOCAL}, '%Y-%m-%d') AS day, strftime({LOCAL}, '%Y%m%d') AS compact,
           CAST(extract(hour FROM {LOCAL}) AS INTEGER) AS hour,
           strftime({LOCAL} + INTERVAL 8 HOUR, '%Y-%m-%d') AS east_day,
           strftime({LOCAL} - INTERVAL 5 HOUR, '%H') AS west_hour
    FROM pts""",
)
def day_and_hour(spark, sf_dir):
    ts = F.col("ts_ms")
    return points(spark, sf_dir).select(
        "event_id",
        timeparts.day_key(ts).alias("day"),
        timeparts.day_key(ts, compact=True).alias("compact"),
        timeparts.hour_of_day(ts).alias("hour"),
        timeparts.day_key(ts, "Asia/Shanghai").alias("east_day"),
        timeparts.hour_text(ts, "America/New_York").alias("west_hour"),
    )


@check(
    "scl_08_hour_bounds",
    f"""WITH {PTS}
    SELECT event_id, ts_ms - ts_ms % 3600000 AS hour_ms, ts_ms - ts_ms % 3600000 + 3600000 AS next_ms,
           ts_ms - (ts_ms + 19800000) % 3600000 AS half_hour_zone_ms
    FROM pts""",
)
def hour_bounds(spark, sf_dir):
    ts = F.col("ts_ms")
    return points(spark, sf_dir).select(
        "event_id",
        timeparts.hour_start(ts).alias("hour_ms"),
        timeparts.next_hour(ts).alias("next_ms"),
        timeparts.hour_start(ts, "Asia/Kolkata").alias("half_hour_zone_ms"),
    )


@check(
    "scl_09_day_bounds",
    """SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) // 1000 AS start_ms,
              epoch_us(date_trunc('day', o_orderdate) + INTERVAL 1 DAY) // 1000 - 1 AS end_ms,
              epoch_us(date_trunc('day', o_orderdate)) // 1000 - 28800000 AS east_ms, CAST(NULL AS BIGINT) AS bad_ms
       FROM orders""",
)
def day_bounds(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").cast("string")
    compact = F.regexp_replace(day, "-", "")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        timeparts.day_start_ms(compact).alias("start_ms"),
        timeparts.day_end_ms(day).alias("end_ms"),
        timeparts.day_start_ms(compact, "Asia/Singapore").alias("east_ms"),
        timeparts.day_start_ms(F.concat(compact, F.lit("x"))).alias("bad_ms"),
    )


@check(
    "scl_10_hex",
    """SELECT doc_id, lower(hex(encode(text))) AS hex_text, md5(text) AS round_trip, true AS odd_rejected FROM documents""",
)
def hex_text(spark, sf_dir):
    encoded = text.hex_lower(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        encoded.alias("hex_text"),
        F.md5(text.hex_decode(F.upper(encoded))).alias("round_trip"),
        text.hex_decode(F.concat(encoded, F.lit("0"))).isNull().alias("odd_rejected"),
    )


@check(
    "scl_11_printable_ascii",
    """WITH bytes AS (SELECT page_id, lower(hex(encode(html))) AS h FROM pages),
       marked AS (SELECT page_id, regexp_replace(regexp_replace(h, '(..)', '\\1 ', 'g'), '([01][0-9a-f]|7f|[89a-f][0-9a-f]) ', '2e ', 'g') AS h FROM bytes)
       SELECT page_id, decode(unhex(replace(h, ' ', ''))) AS shown FROM marked""",
)
def printable_ascii(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.printable_ascii(F.encode("html", "UTF-8")).alias("shown")
    )


@check(
    "scl_12_payload_preview",
    """SELECT conv_id, turn, replace(replace(text, chr(10), '\\n'), chr(13), '\\r') AS whole,
              replace(replace(left(text, n), chr(10), '\\n'), chr(13), '\\r')
              || CASE WHEN strlen(text) > 40 AND strlen(left(text, n)) < 40 THEN chr(65533) ELSE '' END
              || CASE WHEN strlen(text) > 40 THEN '...(truncated)' ELSE '' END AS preview
       FROM (SELECT *, len(list_filter(range(1, 41), lambda k: k <= length(text) AND strlen(left(text, k)) <= 40)) AS n FROM conversations)""",
)
def payload_preview(spark, sf_dir):
    payload = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.payload_preview(payload, 1_000_000_000).alias("whole"),
        text.payload_preview(payload, 40).alias("preview"),
    )


@check("scl_13_payload_length", "SELECT doc_id, strlen(text) AS payload_len FROM documents")
def payload_length(spark, sf_dir):
    payload = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(payload).cast("bigint").alias("payload_len"))


@check(
    "scl_14_value_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, printf('%.6f', v) AS six,
              CASE WHEN v = trunc(v) THEN printf('%.0f', v) ELSE printf('%.3f', v) END AS short,
              printf('%.3f', n) AS negative
       FROM (SELECT *, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS v, CAST(CAST(l_discount - 0.0625 - l_tax AS FLOAT) AS DOUBLE) AS n FROM lineitem)""",
)
def value_text(spark, sf_dir):
    price = F.col("l_extendedprice").cast("float")
    below = (F.col("l_discount") - F.lit(0.0625) - F.col("l_tax")).cast("float")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.fixed_decimals(price, 6).alias("six"),
        text.export_number(price).alias("short"),
        text.fixed_decimals(below, 3).alias("negative"),
    )


@check("scl_15_narrowing", f"WITH {PTS} SELECT event_id, CAST(CAST(value * 1.1::DOUBLE AS FLOAT) AS DOUBLE) AS value FROM pts")
def narrowing(spark, sf_dir):
    narrow = (F.col("value") * F.lit(1.1)).cast("float")
    return points(spark, sf_dir).select("event_id", narrow.cast("double").alias("value"))


@check(
    "scl_16_archive_names",
    """SELECT c_custkey, 'h' || lpad(CAST(c_nationkey % 24 AS VARCHAR), 2, '0') || '_p' ||
              lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '.parquet' AS name,
              c_nationkey % 24 AS hour, CAST(c_custkey AS INTEGER) AS part, c_nationkey % 24 AS old_hour,
              CAST(c_custkey AS INTEGER) AS old_part, CAST(NULL AS INTEGER) AS other_hour
       FROM customer""",
)
def archive_names(spark, sf_dir):
    hour, part = (F.col("c_nationkey") % 24), F.col("c_custkey").cast("int")
    name = naming.archive_name(hour, part)
    old = F.format_string("hour_%02d_part_%03d.parquet", hour, part)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        name.alias("name"),
        naming.archive_hour(name).alias("hour"),
        naming.archive_part(name).alias("part"),
        naming.archive_hour(old).alias("old_hour"),
        naming.archive_part(old).alias("old_part"),
        naming.archive_hour(F.concat(old, F.lit(".tmp"))).alias("other_hour"),
    )


@check(
    "scl_17_next_sequence",
    """SELECT c_nationkey, CAST(max(c_custkey) AS INTEGER) + 1 AS next_number FROM customer GROUP BY c_nationkey""",
)
def next_sequence(spark, sf_dir):
    name = F.format_string("seg_%d_%06d.parquet", F.col("c_nationkey"), F.col("c_custkey"))
    names = table(spark, sf_dir, "customer").select("c_nationkey", name.alias("name"))
    with_others = names.unionByName(names.withColumn("name", F.concat("name", F.lit(".tmp"))))
    number = F.coalesce(naming.segment_sequence(F.col("name")), F.lit(0))
    return with_others.groupBy("c_nationkey").agg((F.max(number) + 1).alias("next_number"))


@check(
    "scl_18_path_parts",
    f"""WITH {PTS} SELECT event_id, device_id, strftime({LOCAL}, '%Y-%m-%d') AS day, strftime({LOCAL}, '%H') AS hour FROM pts""",
)
def path_parts(spark, sf_dir):
    ts = F.col("ts_ms")
    plain = F.concat_ws("/", F.lit("file:/root"), "device_id", timeparts.day_key(ts), timeparts.hour_text(ts), F.lit("seg.parquet"))
    hive = F.concat(
        F.lit("file:/root/device_id="), "device_id", F.lit("/day="), timeparts.day_key(ts), F.lit("/hour="), timeparts.hour_text(ts),
        F.lit("/part-0.parquet"),
    )
    path = F.when(F.col("param_id") == "P00001", plain).otherwise(hive)
    return points(spark, sf_dir).select(
        "event_id",
        naming.path_device(path).alias("device_id"),
        naming.path_day(path).alias("day"),
        naming.path_hour(path).alias("hour"),
    )


@check(
    "scl_19_hourly_key",
    f"WITH {PTS} SELECT event_id, device_id || '|' || strftime({LOCAL}, '%Y-%m-%d|%H') AS hourly_key FROM pts",
)
def hourly_key(spark, sf_dir):
    ts = F.col("ts_ms")
    key = naming.hourly_key(F.col("device_id"), timeparts.day_key(ts), timeparts.hour_of_day(ts))
    return points(spark, sf_dir).select("event_id", key.alias("hourly_key"))


@check(
    "scl_20_intervals_overlap",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              NOT (l_quantity < l_linenumber * 4 OR 10 > l_linenumber * 7) AS overlaps
       FROM lineitem""",
)
def intervals_overlap(spark, sf_dir):
    line = F.col("l_linenumber")
    overlaps = timeparts.intervals_overlap(F.lit(10), F.col("l_quantity"), line * 4, line * 7)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", overlaps.alias("overlaps")
    )


@check(
    "scl_21_hour_series",
    f"""WITH {PTS}
    SELECT event_id, unnest(range(ts_ms - ts_ms % 3600000, ts_ms + CAST(floor(value) AS BIGINT) * 60000 + 1, 3600000)) AS hour_ms FROM pts""",
)
def hour_series(spark, sf_dir):
    ts = F.col("ts_ms")
    series = timeparts.hour_series(ts, ts + F.floor("value").cast("bigint") * 60000)
    return points(spark, sf_dir).select("event_id", F.explode(series).alias("hour_ms"))


@check(
    "scl_22_topics",
    f"""WITH {PTS}
    SELECT event_id, 'gw/' || device_id || '/telemetry' AS device_topic, 'gw/' || device_id || '/' || param_id AS param_topic,
           'gw/cli-' || user_id || '/' || device_id || '/payload' AS client_topic
    FROM pts""",
)
def topic_build(spark, sf_dir):
    device = F.col("device_id")
    client = F.concat(F.lit("cli-"), F.col("user_id").cast("string"))
    return points(spark, sf_dir).select(
        "event_id",
        topics.telemetry_topic(device).alias("device_topic"),
        topics.param_topic(device, F.lower("param_id")).alias("param_topic"),
        topics.client_topic(client, device).alias("client_topic"),
    )


@check(
    "scl_23_topic_parse",
    f"""WITH {PTS}
    SELECT event_id, CASE WHEN param_id = 'A00001' THEN '' ELSE device_id END AS device,
           CASE WHEN param_id IN ('A00001', 'P00001', 'P00002') THEN '' ELSE param_id END AS param
    FROM pts""",
)
def topic_parse(spark, sf_dir):
    device, param = F.col("device_id"), F.col("param_id")
    topic = (
        F.when(param == "P00001", topics.telemetry_topic(device))
        .when(param == "P00002", F.concat_ws("/", F.lit("gw"), device, param, F.lit("extra")))
        .when(param == "A00001", F.concat_ws("/", F.lit("other"), device, param))
        .otherwise(F.concat_ws("/", F.lit("gw"), device, F.lower(param)))
    )
    return points(spark, sf_dir).select(
        "event_id", topics.topic_device(topic).alias("device"), topics.topic_param(topic).alias("param")
    )


@check(
    "scl_24_message_kind",
    f"""WITH {PTS}
    SELECT event_id, CASE param_id WHEN 'P00001' THEN 'json' WHEN 'P00002' THEN 'telemetry' WHEN 'P00003' THEN 'number'
                                   WHEN 'A00001' THEN 'string' ELSE 'text/binary' END AS kind
    FROM pts""",
)
def message_kind(spark, sf_dir):
    param, props = F.col("param_id"), F.col("props")
    payload = (
        F.when(param == "P00001", props)
        .when(param == "P00002", F.concat(F.lit('{"points":['), props, F.lit("]}")))
        .when(param == "P00003", F.col("value").cast("string"))
        .when(param == "A00001", F.concat(F.lit('"'), "device_id", F.lit('"')))
        .otherwise(F.col("device_id"))
    )
    return points(spark, sf_dir).select("event_id", topics.message_kind(payload).alias("kind"))


@check(
    "scl_25_pick_value",
    f"""WITH {PTS}
    SELECT event_id, CASE param_id WHEN 'A00001' THEN '-' WHEN 'P00003' THEN device_id ELSE props->>'$.k' END AS picked FROM pts""",
)
def pick_value(spark, sf_dir):
    param, k = F.col("param_id"), F.get_json_object("props", "$.k")
    payload = (
        F.when(param == "P00001", F.concat(F.lit('{"K00001":'), k, F.lit("}")))
        .when(param == "P00002", F.concat(F.lit('{"data":{"K00001":'), k, F.lit("}}")))
        .when(param == "P00003", F.concat(F.lit('{"points":[{"id":"x","value":1},{"code":" k00001","val":"'), "device_id", F.lit('"}]}')))
        .when(param == "Z00001", F.concat(F.lit('{"points":[7,{"point_id":"k00001","v":'), k, F.lit("}]}")))
        .otherwise(F.col("props"))
    )
    return points(spark, sf_dir).select("event_id", topics.pick_param_value(payload, F.lit("k00001")).alias("picked"))


@check(
    "scl_26_duration",
    """SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 60000 WHEN 2 THEN 3600000 ELSE 86400000 END AS ms,
              CAST(NULL AS BIGINT) AS bad
       FROM part""",
)
def duration(spark, sf_dir):
    size, unit = F.col("p_size").cast("string"), F.get(F.array(*[F.lit(u) for u in "smHd"]), F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        timeparts.duration_millis(F.concat(size, unit)).alias("ms"),
        timeparts.duration_millis(F.concat(size, F.lit("x"))).alias("bad"),
    )


@check(
    "scl_27_hour_text",
    f"""WITH {PTS} SELECT event_id, ts_ms - ts_ms % 3600000 AS utc_ms, ts_ms - ts_ms % 3600000 - 28800000 AS east_ms, CAST(NULL AS BIGINT) AS bad FROM pts""",
)
def hour_text(spark, sf_dir):
    ts = F.col("ts_ms")
    day = timeparts.day_key(ts, compact=True)
    stamp = F.concat(day, timeparts.hour_text(ts))
    return points(spark, sf_dir).select(
        "event_id",
        timeparts.hour_start_from_text(stamp).alias("utc_ms"),
        timeparts.hour_start_from_text(stamp, "Asia/Shanghai").alias("east_ms"),
        timeparts.hour_start_from_text(F.concat(day, F.lit("24"))).alias("bad"),
    )
