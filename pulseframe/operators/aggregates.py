"""Statistics, catalogs and indexes.

Everything is a hash aggregate with a map-side partial step, so a hot device,
file or topic is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.functions import codes, naming
from pulseframe.functions.timeparts import HOUR_MS, floor_div

_ZERO = 0

#: Relative rank error of the sketch is one in this; the bracket is wider on either side.
SKETCH_ACCURACY = 2_000
BRACKET = 4 / SKETCH_ACCURACY


def point_stats(points: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Files, rows and time range of points."""
    return points.agg(
        F.count_distinct(file_column).alias("files"),
        F.count("*").alias("rows"),
        F.min("ts_ms").alias("min_ts"),
        F.max("ts_ms").alias("max_ts"),
    )


def point_count(catalog_points: Column, rows: Column, mode: Column, recount: Column) -> Column:
    """Points of a segment: the recorded number, else rows or a recount by mode."""
    return (
        F.when(catalog_points > 0, catalog_points)
        .when(mode == schema.MODE_LONG_ROW, rows)
        .otherwise(F.coalesce(recount, F.lit(_ZERO).cast("bigint")))
    )


def storage_stats(catalog: DataFrame, recounts: DataFrame | None = None) -> DataFrame:
    """Devices, manifests, segments, rows, points and time range of a catalog.

    ``catalog``: ``device_id, manifest_path, segment_file, rows, points, mode,
    min_ts, max_ts``.  Empty segments count but do not extend the range.
    ``recounts`` (``manifest_path, segment_file, recount``) fills in wide
    segments without a recorded number of points.
    """
    if recounts is None:
        known = catalog.withColumn("recount", F.lit(_ZERO).cast("bigint"))
    else:
        known = catalog.join(recounts, ["manifest_path", "segment_file"], "left")
    filled = F.col("rows") > 0
    points = point_count(F.col("points"), F.col("rows"), F.col("mode"), F.col("recount"))
    # A manifest belongs to one device, so counts of different ones add up over devices.
    per_device = known.groupBy("device_id").agg(
        F.count_distinct("manifest_path").alias("manifests"),
        F.count("*").alias("segments"),
        F.sum("rows").alias("rows"),
        F.sum(points).alias("points"),
        F.min(F.when(filled, F.col("min_ts"))).alias("min_ts"),
        F.max(F.when(filled, F.col("max_ts"))).alias("max_ts"),
    )
    return per_device.agg(
        F.count("device_id").alias("devices"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("manifests", "segments", "rows", "points")],
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
    )


def source_stats(packets: DataFrame) -> DataFrame:
    """Accepted packets and points, skipped packets, input lines."""
    accepted = F.size("points") > 0
    return packets.agg(
        F.count("*").alias("input_lines"),
        F.count_if(accepted).alias("accepted_packets"),
        F.coalesce(F.sum(F.size("points").cast("bigint")), F.lit(0)).alias("accepted_points"),
        F.count_if(~accepted).alias("skipped_packets"),
    )


def segment_catalog(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time range, rows, points and sorted parameter set per segment.

    The set is collected from names already made distinct per segment, so it is
    bounded by the number of parameters.
    """
    per_param = points.groupBy(*keys, "param_id").agg(
        F.min("ts_ms").alias("_min"), F.max("ts_ms").alias("_max"), F.count("*").alias("_rows")
    )
    return per_param.groupBy(*keys).agg(
        F.min("_min").alias("min_ts"),
        F.max("_max").alias("max_ts"),
        F.sum("_rows").alias("rows"),
        F.sum("_rows").alias("points"),
        F.array_sort(F.collect_set("param_id")).alias("param_ids"),
    )


def packet_catalog(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for packet-wide rows; ``rows`` are packets."""
    totals = packets.groupBy(*keys).agg(
        F.min("ts_ms").alias("min_ts"),
        F.max("ts_ms").alias("max_ts"),
        F.count("*").alias("rows"),
        F.sum(F.size("values").cast("bigint")).alias("points"),
    )
    names = (
        packets.select(*keys, F.explode("param_ids").alias("param_id"))
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("param_id")).alias("param_ids"))
    )
    none = F.array().cast("array<string>")
    return totals.join(names, list(keys), "left").withColumn("param_ids", F.coalesce("param_ids", none))


def with_file_sizes(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """A catalog per ``file_path`` with the bytes of each file (NULL when it is gone)."""
    sizes = inventory.select("file_path", F.col("bytes").alias("size"))
    return catalog.join(sizes, "file_path", "left")


def archive_catalog(raw: DataFrame, inventory: DataFrame, created_at_ms: int | None = None) -> DataFrame:
    """Rebuilt manifest of raw archive files in ``…/device/day/``.

    ``raw`` carries ``file_path``; device and day come from the path, hour and part
    from the file name, sizes from the inventory.  A row of another device is an
    error.  Files with another kind of name are left out; an empty file has times 0.
    ``created_at_ms`` is now unless given.
    """
    own = naming.path_device_of_day(F.col("file_path"))
    foreign = F.raise_error(F.concat(F.lit("row of another device in "), F.col("file_path"))).cast("boolean")
    checked = raw.where(F.when(F.col("device_id") == own, F.lit(True)).otherwise(foreign))
    per_file = checked.groupBy("file_path").agg(
        F.min("timestamp_ms").alias("min_ts_ms"),
        F.max("timestamp_ms").alias("max_ts_ms"),
        F.count("*").alias("rows"),
        F.sum(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
    )
    name = F.col("file_name")
    created = F.unix_millis(F.current_timestamp()) if created_at_ms is None else F.lit(created_at_ms)
    return (
        inventory.select("file_path", F.col("bytes").alias("file_size_bytes"))
        .join(per_file, "file_path", "left")
        .withColumn("file_name", naming.file_name(F.col("file_path")))
        .select(
            F.lit(schema.RAW_SCHEMA_VERSION).cast("smallint").alias("schema_version"),
            own.alias("device_id"),
            "file_name",
            naming.path_day_of_device(F.col("file_path")).alias("day_key"),
            naming.archive_hour(name).alias("hour"),
            naming.archive_part(name).alias("part"),
            *[
                F.coalesce(c, F.lit(_ZERO).cast("bigint")).alias(c)
                for c in ("min_ts_ms", "max_ts_ms", "rows", "payload_bytes")
            ],
            "file_size_bytes",
            F.lit(True).alias("sealed"),
            created.cast("bigint").alias("created_at_ms"),
        )
        .where(F.col("hour").isNotNull())
    )


def hourly_index(catalog: DataFrame) -> DataFrame:
    """``device|day|HH`` to its sorted, unique segments that hold rows.

    One list entry per *file* of an hour, never per row.
    """
    entry = F.struct("segment_file", "min_ts", "max_ts", "rows")
    return (
        catalog.where(F.col("rows") > 0)
        .dropDuplicates(["device_id", "day", "hour", "segment_file"])
        .groupBy(naming.hourly_key(F.col("device_id"), F.col("day"), F.col("hour")).alias("index_key"))
        .agg(F.array_sort(F.collect_list(entry)).alias("segments"))
    )


def raw_stats(raw: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Files, records, time range and payload bytes of a raw archive."""
    return raw.agg(
        F.count_distinct(file_column).alias("files"),
        F.count("*").alias("records"),
        F.min("timestamp_ms").alias("min_ts_ms"),
        F.max("timestamp_ms").alias("max_ts_ms"),
        F.sum(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
    )


def recount_points(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of packet-wide segments counted from their lists."""
    size = F.coalesce(F.when(F.col("values").isNotNull(), F.size("values")), F.lit(_ZERO))
    return packets.groupBy(*keys).agg(F.sum(size.cast("bigint")).alias("recount"))


def distinct_devices(*sources: DataFrame) -> DataFrame:
    """Exact number of different devices across sources."""
    names = sources[0].select("device_id")
    for source in sources[1:]:
        names = names.unionByName(source.select("device_id"))
    return names.agg(F.count_distinct("device_id").alias("devices"))


def window_stats(points: DataFrame, approximate: bool = False) -> DataFrame:
    """Hours, devices and points per source; the approximate form also streams."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return points.groupBy("source").agg(
        distinct(floor_div(F.col("ts_ms"), HOUR_MS)).alias("hours"),
        distinct("device_id").alias("devices"),
        F.count("*").alias("points"),
    )


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages per topic (sort by topic when the result is a batch)."""
    return messages.groupBy("topic").agg(F.count("*").alias("messages"))


def value_summary(df: DataFrame, value: str, keys: Sequence[str] = (), quantile: float = 0.95) -> DataFrame:
    """Minimum, mean, nearest-rank quantile and maximum of a column; NaN is the largest value.

    The built-in exact percentile keeps all values of a group in one buffer.  Here the
    first scan gives each group a mergeable quantile sketch, which brackets the value of
    the wanted rank between two values that lie close to it.  The second scan counts the
    rows below the bracket and, per value, the few inside; the first value whose running
    count reaches the rank is the exact quantile.
    """
    keys, v = list(keys), F.col(value)
    rows = df.where(v.isNotNull()).select(F.struct(F.lit(0).alias("_"), *keys).alias("_key"), v.alias("_v"))
    number = F.when(~F.isnan("_v"), F.col("_v")) if df.schema[value].dataType.typeName() in ("double", "float") else F.col("_v")
    ends = [max(quantile - BRACKET, 0.0), min(quantile + BRACKET, 1.0)]
    found = rows.groupBy("_key").agg(
        F.min("_v").alias("min_value"),
        F.avg("_v").alias("avg_value"),
        F.max("_v").alias("max_value"),
        F.count("*").alias("_total"),
        F.count(number).alias("_numbers"),
        F.percentile_approx(number, ends, SKETCH_ACCURACY).alias("_ends"),
    )
    # Values that are no numbers move the rank up, so with them the bracket is open above.
    low = F.coalesce(F.get("_ends", F.lit(0)), F.col("min_value"))
    high = F.when(F.col("_numbers") == F.col("_total"), F.get("_ends", F.lit(1))).otherwise(F.col("max_value"))
    found = found.withColumns({"_low": low, "_high": high, "_rank": F.greatest(F.ceil(F.col("_total") * quantile), F.lit(1))})
    ends = found.select(F.col("_key").alias("_of"), "_low", "_high")
    if keys:
        near = rows.join(ends, F.col("_key") == F.col("_of"))
    else:
        one = ends.select(F.struct("_low", "_high").alias("e")).scalar()
        near = rows.withColumns({"_low": one["_low"], "_high": one["_high"]})
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_inside")
    counts = near.where(F.col("_v") <= F.col("_high")).groupBy("_key", inside).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_inside"))
    counts = counts.withColumn("_upto", upto).join(found.select(F.col("_key").alias("_of"), "_rank"), F.col("_key") == F.col("_of"))
    reached = (F.col("_upto") >= F.col("_rank")) & F.col("_inside").isNotNull()
    exact = counts.groupBy("_of").agg(
        F.min(F.when(reached, F.col("_inside"))).alias("_found"),
        F.coalesce(F.max(F.when(F.col("_inside").isNull(), F.col("_upto"))), F.lit(0)).alias("_below"),
        F.first("_rank").alias("_wanted"),
    )
    # The bracket holds the rank, or the sketch is not what it promises.
    sound = F.col("_found").isNotNull() & (F.col("_below") < F.col("_wanted"))
    quantile_value = F.when(sound, F.col("_found")).otherwise(F.raise_error(F.lit("rank outside of its bracket")))
    both = found.join(exact, F.col("_key") == F.col("_of"))
    whole = both.select(
        *[F.col(f"_key.{k}") for k in keys], "min_value", "avg_value", quantile_value.alias("quantile_value"), "max_value"
    )
    if keys:
        return whole
    # One row, of NULLs, without values.
    return df.sparkSession.range(1).join(whole, F.lit(True), "left").drop("id")


def source_counts(points: DataFrame) -> DataFrame:
    """Rows per origin."""
    return points.groupBy("source").agg(F.count("*").alias("rows"))


def file_ranges(rows: DataFrame, file_column: str = "file_path", time_column: str = "ts_ms") -> DataFrame:
    """Row count and time range per file, from its data."""
    return rows.groupBy(file_column).agg(
        F.count("*").alias("rows"), F.min(time_column).alias("min_ts"), F.max(time_column).alias("max_ts")
    )


def subscription_sizes(subscriptions: DataFrame) -> DataFrame:
    """Parameters per subscription after normalising and removing repeats."""
    return subscriptions.select(
        "client_id", "device_id", F.size(codes.subscription_params(F.col("param_ids"))).alias("param_count")
    )
