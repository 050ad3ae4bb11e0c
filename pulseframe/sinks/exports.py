"""Text exports and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import topics
from pulseframe.functions.text import export_number, fixed_decimals
from pulseframe.operators.latest import numbered_packets
from pulseframe.operators.ordering import EXPORT_LIMIT, RAW_LIMIT, first_rows


def _members(param_ids: Column, values: Column) -> Column:
    pairs = F.zip_with(
        param_ids, values, lambda p, v: F.concat(F.lit('"'), p, F.lit('":'), export_number(v))
    )
    return F.array_join(pairs, ",")


def packet_lines(packets: DataFrame, order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Packets as JSON lines ``{"id","t","s","p"}``; ``s`` counts per device."""
    numbered = numbered_packets(packets, order)
    line = F.concat(
        F.lit('{"id":"'),
        F.col("device_id"),
        F.lit('","t":'),
        F.col("ts_ms").cast("string"),
        F.lit(',"s":'),
        F.col("s").cast("string"),
        F.lit(',"p":{'),
        _members(F.col("param_ids"), F.col("values")),
        F.lit("}}"),
    )
    return numbered.select("device_id", "s", line.alias("value"))


def long_row_lines(points: DataFrame) -> DataFrame:
    """Every point as a packet line of its own."""
    single = points.select(
        "device_id", "ts_ms", F.array("param_id").alias("param_ids"), F.array("value").alias("values"), "param_id"
    )
    return packet_lines(single, ("ts_ms", "param_id"))


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON lines to text files."""
    lines.select("value").write.text(path)


def _first(df: DataFrame, limit: int | None, order: Sequence[str]) -> DataFrame:
    """First rows in order; all rows, each file in order, without a limit."""
    return df.sortWithinPartitions(*order) if limit is None else first_rows(df, limit, order)


def point_export(
    points: DataFrame, limit: int | None = EXPORT_LIMIT, order: Sequence[str] = ("ts_ms", "param_id")
) -> DataFrame:
    """First points in order (``limit=None``: all) with the value as text (six decimals)."""
    return _first(points, limit, order).select(
        F.col("ts_ms").alias("ts"), "param_id", fixed_decimals(F.col("value"), 6).alias("value")
    )


def write_points_csv(
    points: DataFrame, path: str, limit: int | None = EXPORT_LIMIT, order: Sequence[str] = ("ts_ms", "param_id")
) -> None:
    """``ts,param_id,value`` with a header."""
    point_export(points, limit, order).write.csv(path, header=True)


def write_points_json(
    points: DataFrame, path: str, limit: int | None = EXPORT_LIMIT, order: Sequence[str] = ("ts_ms", "param_id")
) -> None:
    """First points in order (``limit=None``: all) as JSON lines."""
    _first(points, limit, order).select(F.col("ts_ms").alias("ts"), "param_id", "value").write.json(path)


def write_raw_csv(rows: DataFrame, path: str, limit: int | None = RAW_LIMIT) -> None:
    """Raw query rows with a header."""
    _raw_export(rows, limit).write.csv(path, header=True)


def write_raw_json(rows: DataFrame, path: str, limit: int | None = RAW_LIMIT) -> None:
    """Raw query rows as JSON lines."""
    _raw_export(rows, limit).write.json(path)


def _raw_export(rows: DataFrame, limit: int | None) -> DataFrame:
    named = rows.withColumnRenamed("payload_text", "payload_hex")
    return _first(named, limit, ("ts_ms", "device_id", "payload_hex"))


def write_result_csv(result: DataFrame, path: str) -> None:
    """Any query result as CSV with a header; NULL stays empty."""
    result.write.csv(path, header=True)


def messages(payloads: DataFrame, prefix: str = topics.TOPIC_PREFIX) -> DataFrame:
    """Packed payloads as ``topic, key, value`` rows for a message sink.

    The topic follows from the columns present: per client, per parameter or per
    device.
    """
    device = F.col("device_id")
    if "client_id" in payloads.columns:
        topic = topics.client_topic(F.col("client_id"), device, prefix)
    elif "param_id" in payloads.columns:
        topic = topics.param_topic(device, F.col("param_id"), prefix)
    else:
        topic = topics.telemetry_topic(device, prefix)
    return payloads.select(topic.alias("topic"), device.alias("key"), F.col("payload").alias("value"))


def write_messages(rows: DataFrame, path: str) -> None:
    """Messages to files, for consumers that read a folder."""
    rows.write.mode("append").json(path)


def write_messages_kafka(rows: DataFrame, servers: str) -> None:
    """Messages to Kafka (needs the Kafka connector on the class path)."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
