"""Joins.

No side is forced to be broadcast here unless its size is bounded by
construction: Catalyst broadcasts from measured sizes, and adaptive execution
splits skewed partitions of the sort-merge joins it chooses otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import codes
from pulseframe.functions.columns import evaluated_once, has_items, rows_where
from pulseframe.functions.topics import MISSING_TEXT, message_fields, pick_from, topic_device, topic_param
from pulseframe.operators.overlap import overlap_join  # noqa: F401  (part of this module's surface)
from pulseframe.operators.sequence import TIME_WIDTH, latest_known


def fan_out(packets: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Packets to what each subscribed client gets; clients without a hit vanish.

    The join is on the device only and selects parameters inside the row, so
    points are neither exploded nor regrouped.  Points and wanted names are merged in
    name order: a parameter is selected when the name before it is its own, wanted one,
    so no point is compared with every name.  Works on streaming packets with a static
    subscription table.
    """
    no_points = F.array().cast(packets.schema["points"].dataType)
    names = F.transform(
        codes.subscription_params(F.col("param_ids")),
        lambda name: F.struct(name.alias("param_id"), F.lit(False).alias("held"), no_points.alias("points")),
    )
    wanted = subscriptions.select("client_id", "device_id", names.alias("_wanted"))
    held = packets.select("device_id", "ts_ms", F.sort_array("points").alias("points"))
    merged = held.select("device_id", "ts_ms", _by_param(F.col("points")).alias("_held")).join(wanted, "device_id").select(
        "client_id", "device_id", "ts_ms", F.sort_array(F.concat("_held", "_wanted")).alias("_merged")
    )
    selected = F.filter(
        "_merged", lambda m, i: m["held"] & (F.get("_merged", i - 1)["param_id"] == m["param_id"])
    )
    return merged.select(
        "client_id", "device_id", "ts_ms", rows_where(F.flatten(selected["points"]), has_items).alias("points")
    )


def _by_param(points: Column) -> Column:
    """Sorted points in one entry per parameter, which may hold it more than once."""
    starts = F.filter(
        F.transform(
            points,
            lambda p, i: F.when((i == 0) | (F.get(points, i - 1)["param_id"] != p["param_id"]), i),
        ),
        lambda start: start.isNotNull(),
    )

    def entry(start: Column, number: Column, of: Column) -> Column:
        end = F.coalesce(F.get(of, number + 1), F.size(points))
        return F.struct(
            F.get(points, start)["param_id"].alias("param_id"),
            F.lit(True).alias("held"),
            F.slice(points, start + 1, end - start).alias("points"),
        )

    return evaluated_once(starts, lambda of: F.transform(of, lambda start, number: entry(start, number, of)))


def fan_out_points(points: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The same for single points: an equi join on device and parameter."""
    wanted = subscriptions.select(
        "client_id", "device_id", F.explode(codes.subscription_params(F.col("param_ids"))).alias("param_id")
    )
    return points.join(wanted, ["device_id", "param_id"]).select(
        "client_id", "device_id", "ts_ms", "param_id", "value"
    )


def key_lookup(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requested parameters with their current value, NULL when there is none.

    ``requests``: ``device_id, param_ids`` in the order asked.  A bad code is an
    error; ``position`` keeps the order.
    """
    asked = requests.select("device_id", F.posexplode("param_ids").alias("position", "asked"))
    code = codes.normalise_param(F.col("asked"))
    bad = F.raise_error(F.concat(F.lit("invalid param_id: "), F.col("asked"))).cast("string")
    asked = asked.select(
        "device_id", "position", F.when(codes.is_param_code(code), code).otherwise(bad).alias("param_id")
    )
    return asked.join(latest, ["device_id", "param_id"], "left").select(
        "device_id", "position", "param_id", "value", "ts_ms"
    )


def device_values(latest: DataFrame, device_id: str) -> DataFrame:
    """All current values of one device, sorted by parameter."""
    return latest.where(F.col("device_id") == device_id).orderBy("param_id")


def missing_segments(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest entries whose file is not there (both sides carry ``file_path``)."""
    return manifest.join(inventory.select("file_path").distinct(), "file_path", "left_anti").select(manifest.columns)


def hours_without_manifest(hours: DataFrame, manifests: DataFrame) -> DataFrame:
    """Hour directories without a manifest (both sides carry ``directory``)."""
    return hours.join(manifests.select("directory").distinct(), "directory", "left_anti").select(hours.columns)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("device_id",),
    value: str = "value",
    time: str = "ts_ms",
    name: str = "as_of_value",
    within_ms: int | None = None,
    width: int = TIME_WIDTH,
) -> DataFrame:
    """Each left row with the last right ``value`` at or before its time, and that time (``name``_ts).

    NULL where there is none, or none in the last ``within_ms``.  Of right rows of one
    time the largest value counts.  Both sides are put into one order, cut into blocks of
    ``width``; the last value of the blocks before is carried into each, so a key of any
    size is spread over many tasks.
    """
    row = F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    asked = left.select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).alias("_value"), row)
    known = right.where(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("_time"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).alias("_row")
    )
    both = known.unionByName(asked)
    found = F.when(F.col("_side") == 0, F.struct(F.col("_value").alias("v"), F.col("_time").alias("t")))
    told = latest_known(both, keys, ["_time", "_side", "_value"], found, "_known", width).where("_side = 1")
    recent = F.col("_row")[time].isNotNull()
    if within_ms is not None:
        recent &= F.col("_row")[time] - F.col("_known.t") <= within_ms
    return told.select(
        "_row.*",
        F.when(recent, F.col("_known.v")).alias(name),
        F.when(recent, F.col("_known.t")).alias(f"{name}_ts"),
    )


def device_status(devices: DataFrame, points: DataFrame) -> DataFrame:
    """Inventory with last-seen time; 0 for a device that never reported."""
    seen = points.groupBy("device_id").agg(F.max("ts_ms").alias("last_seen_ts"))
    return (
        devices.join(seen, "device_id", "left")
        .select(
            "device_id",
            F.coalesce("last_seen_ts", F.lit(0).cast("bigint")).alias("last_seen_ts"),
            F.concat_ws(":", "ip", F.col("port").cast("string")).alias("addr"),
        )
        .orderBy("device_id")
    )


def select_live(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Live messages reduced to what one subscription per device asks for.

    Parameters are normalised and made unique, as everywhere.  Of several
    subscriptions of a device the first one counts: by client where there is one,
    else by its list.

    ``messages``: ``topic, payload, ts_ms``.  A parameter message passes when its
    parameter is subscribed; a device message yields every subscribed parameter,
    a dash where the message does not carry it.  ``values`` is a map from
    parameter to text.
    """
    # Taken apart once per message, before the join multiplies it.
    usable = rows_where(message_fields(F.col("payload")), lambda fields: fields["usable"])
    parsed = messages.select("topic", "ts_ms", usable.alias("_fields"))
    member = lambda name: F.element_at("_fields.top", name)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    heard = parsed.select(
        "ts_ms",
        "_fields",
        F.coalesce(F.nullif(topic_device(F.col("topic")), F.lit("")), text(member("device_id"))).alias("device_id"),
        topic_param(F.col("topic")).alias("topic_param"),
    )
    first = ["client_id"] if "client_id" in subscriptions.columns else []
    asked = F.struct(*first, codes.subscription_params(F.col("param_ids")).alias("wanted"))
    wanted = subscriptions.groupBy("device_id").agg(F.min(asked)["wanted"].alias("_wanted"))
    joined = heard.join(wanted, "device_id").where(
        (F.col("topic_param") == "") | F.array_contains("_wanted", F.col("topic_param"))
    )
    own = F.coalesce(text(member("value")), F.to_json(member("value")), F.lit(MISSING_TEXT))
    single = F.create_map(F.col("topic_param"), own)
    every = F.map_from_arrays("_wanted", F.transform("_wanted", lambda p: pick_from(F.col("_fields"), p)))
    return joined.select(
        "device_id", "ts_ms", "topic_param", F.when(F.col("topic_param") != "", single).otherwise(every).alias("values")
    )


def compare_totals(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Totals per device on both sides (``device_id, packets, points``), side by side."""
    a = source.select("device_id", F.col("packets").alias("source_packets"), F.col("points").alias("source_points"))
    b = stored.select("device_id", F.col("packets").alias("stored_packets"), F.col("points").alias("stored_points"))
    zero = F.lit(0).cast("bigint")
    both = a.join(b, "device_id", "full_outer")
    filled = {c: F.coalesce(c, zero) for c in ("source_packets", "source_points", "stored_packets", "stored_points")}
    return both.withColumns(filled).withColumns(
        {
            "packets_match": F.col("source_packets") == F.col("stored_packets"),
            "points_match": F.col("source_points") == F.col("stored_points"),
        }
    )
