"""JSON packets to points.

All parsers work row by row on built-in JSON and VARIANT functions, so the same
code serves batch and streaming DataFrames and never shuffles.  Numbers are told
apart from strings and booleans *before* any cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.functions import codes
from pulseframe.functions.columns import evaluated_once, has_items, rows_where

_BAD = "_bad_record"


def is_json_number(value: Column) -> Column:
    """True for a VARIANT that holds a JSON number."""
    return F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def is_finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False))


def object_points(members: Column, strict_case: bool = False) -> Column:
    """``map<string, variant>`` to a sorted ``array<struct<param_id, value>>``.

    Keeps valid codes with finite JSON numbers.  When several keys become the
    same code, the exact upper-case spelling wins, else the smallest key; this is
    decided before the number test, so a non-numeric winner hides the others.
    ``strict_case`` accepts only keys that are valid codes as written.
    """
    named = F.transform(
        F.map_entries(members),
        lambda e, i: F.struct(
            (e["key"] if strict_case else codes.normalise_param(e["key"])).alias("param_id"),
            e["key"].alias("key"),
            i.alias("position"),
            e["value"].alias("value"),
        ),
    )
    valid = F.filter(named, lambda e: codes.is_param_code(e["param_id"]))
    # VARIANT has no order, so the sort sees only what was read from it.  Of two
    # equal keys the later one counts, as in any JSON object.
    ranked = F.array_sort(
        F.transform(
            valid,
            lambda e: F.struct(
                e["param_id"].alias("param_id"),
                (e["key"] != e["param_id"]).alias("respelled"),
                e["key"].alias("key"),
                (-e["position"]).alias("from_end"),
                is_json_number(e["value"]).alias("number"),
                F.try_variant_get(e["value"], "$", "double").alias("value"),
            ),
        )
    )

    def accepted(entries: Column) -> Column:
        codes_before = F.concat(F.array(F.lit("")), F.transform(entries, lambda e: e["param_id"]))
        paired = F.zip_with(entries, codes_before, lambda e, before: F.struct(e.alias("e"), before.alias("before")))
        kept = F.filter(
            paired,
            lambda p: p["e"].isNotNull()
            & (p["e"]["param_id"] != p["before"])
            & p["e"]["number"]
            & is_finite(p["e"]["value"]),
        )
        return F.transform(
            kept, lambda p: F.struct(p["e"]["param_id"].alias("param_id"), p["e"]["value"].alias("value"))
        )

    return evaluated_once(ranked, accepted)


def parse_packet_lines(lines: DataFrame, mode: str = "strict", ts_unit: str = "ms") -> DataFrame:
    """``value`` lines ``{id,t,s,p{}}`` to packets.

    Result: ``device_id, ts_ms, seq, points, skipped``; ``skipped`` marks packets
    without any accepted point.  ``strict`` fails on the first bad line, ``skip``
    drops bad lines, ``lenient`` also fills a missing id or time.
    """
    if mode not in ("strict", "skip", "lenient"):
        raise ValueError(f"unknown mode: {mode!r}")
    scale = {"ms": 1, "s": 1_000}[ts_unit]

    def keep(r: Column) -> Column:
        whole = r[_BAD].isNull() & r["p"].isNotNull()
        complete = whole & r["t"].isNotNull() & r["id"].isNotNull() & (r["t"] >= 0)
        if mode == "lenient":
            return whole
        if mode == "skip":
            return F.coalesce(complete, F.lit(False))
        failed = F.raise_error(F.concat(F.lit("bad packet line: "), r["line"])).cast("boolean")
        return F.when(complete, F.lit(True)).otherwise(failed)

    def record(line: Column) -> Column:
        parsed = F.from_json(
            line, f"{schema.PACKET_LINE}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"}
        )
        return parsed.withField("line", line) if mode == "strict" else parsed

    parsed = lines.where(codes.trimmed(F.col("value")) != "").select(
        rows_where(record(F.col("value")), keep).alias("r")
    )
    return parsed.select(
        F.coalesce(F.col("r.id"), F.lit("unknown")).alias("device_id"),
        (F.coalesce(F.col("r.t"), F.lit(0)) * F.lit(scale)).cast("bigint").alias("ts_ms"),
        F.col("r.s").alias("seq"),
        object_points(F.col("r.p")).alias("points"),
    ).withColumn("skipped", F.size("points") == 0)


def read_packets(spark: SparkSession, path: str, mode: str = "strict", ts_unit: str = "ms") -> DataFrame:
    """Packet JSONL files."""
    return parse_packet_lines(spark.read.text(path), mode, ts_unit)


def packet_points(packets: DataFrame) -> DataFrame:
    """One row per point of accepted packets."""
    return packets.where(F.size("points") > 0).select("device_id", "ts_ms", F.inline("points"))


def parse_ingest_batches(lines: DataFrame) -> DataFrame:
    """``value`` lines ``{device_id,recv_ts,points[{ts,param_id,value}]}`` to points.

    Unreadable lines are skipped, so a log cut off in its last line is fine.
    """
    batch = F.from_json(
        "value",
        f"{schema.INGEST_BATCH}, {_BAD} string",
        {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"},
    )
    parsed = lines.select(rows_where(batch, lambda r: r[_BAD].isNull() & r["device_id"].isNotNull()).alias("r"))
    return parsed.select(
        F.col("r.device_id").alias("device_id"),
        F.col("r.recv_ts").alias("recv_ts"),
        F.inline("r.points").alias("ts_ms", "param_id", "value"),
    )


def read_ingest_batches(spark: SparkSession, path: str) -> DataFrame:
    """Files of nested ingest batches, one per line."""
    return parse_ingest_batches(spark.read.text(path))


def parse_published(messages: DataFrame, column: str = "value") -> DataFrame:
    """Published packets ``{device_id,ts_ms,points[{id,value}]}`` to packets.

    Non-finite values and packets left empty are dropped; the receive time is
    the packet time.
    """
    packet = F.from_json(F.col(column), schema.PUBLISHED_PACKET)
    parsed = messages.select(
        rows_where(packet, lambda r: r["device_id"].isNotNull() & r["ts_ms"].isNotNull()).alias("r")
    )
    kept = F.filter("r.points", lambda p: p["id"].isNotNull() & is_finite(p["value"]))
    named = F.transform(kept, lambda p: F.struct(p["id"].alias("param_id"), p["value"].alias("value")))
    return parsed.select(
        F.col("r.device_id").alias("device_id"),
        F.col("r.ts_ms").alias("ts_ms"),
        F.col("r.ts_ms").alias("recv_ts"),
        rows_where(named, has_items).alias("points"),
    )


def parse_flat_payload(payload: Column, strict_case: bool = False) -> Column:
    """Flat ``{"P00001": 1.5, …}`` payload to an array of points (empty when unusable)."""
    members = F.from_json(payload, "map<string,variant>")
    none = F.array().cast(schema.POINTS)
    return F.coalesce(object_points(members, strict_case), none)


def flat_packets(messages: DataFrame, strict_case: bool = False) -> DataFrame:
    """``device_id, ts_ms, payload`` messages to packets that have a point."""
    points = parse_flat_payload(F.col("payload").cast("string"), strict_case)
    return messages.select("device_id", "ts_ms", rows_where(points, has_items).alias("points"))
