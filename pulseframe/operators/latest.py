"""Current values, change logs, runs and row merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import codes
from pulseframe.operators.sequence import ROW_WIDTH, islands, numbered, preceding, total_order
from pulseframe.session import parallelism

# Operations of a subscription change log.
SET, DELETE = "set", "del"

# Fixed value: updates this close to the row before become one row.
MERGE_GAP_MS = 300


def current_values(points: DataFrame, sequence: str | None = None) -> DataFrame:
    """Newest value per device and parameter; also on streams (update mode).

    ``sequence`` breaks ties in time; without it the largest value wins.  One
    ``max_by`` with partial aggregation, so hot devices shrink before the shuffle.
    """
    tie = F.col(sequence) if sequence else F.col("value")
    newest = F.max_by(F.struct("value", "ts_ms"), F.struct("ts_ms", tie))
    return (
        points.withColumn("param_id", codes.normalise_param(F.col("param_id")))
        .where(F.col("param_id") != "")
        .groupBy("device_id", "param_id")
        .agg(newest.alias("newest"))
        .select("device_id", "param_id", "newest.value", "newest.ts_ms")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of each key in a given order, whatever a key's size.

    Rows are first ranked per (key, slice), where a slice is a share of the input
    partitions, so a hot key is spread over all tasks; only ``n`` rows per slice
    meet in the second ranking.  Spark also applies the limit before each shuffle.
    """
    slices = parallelism(df.sparkSession)
    sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    for partition in ([*keys, "_slice"], list(keys)):
        rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
        sliced = sliced.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return sliced.drop("_slice")


def recent_packets(packets: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` packets of each device; of equal times the larger row is the newer."""
    order = [c for c in total_order(packets, ["ts_ms"]) if c != "device_id"]
    return top_per_key(packets, ["device_id"], [F.col(c).desc() for c in order], n)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 500) -> DataFrame:
    """Last ``n`` rows overall, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def session_view(commands: DataFrame) -> DataFrame:
    """Last-seen time and last command (upper case) per client; also on streams."""
    return (
        commands.groupBy("client_id")
        .agg(F.max_by(F.struct("ts_ms", F.upper("cmd").alias("cmd")), F.struct("ts_ms", "cmd")).alias("last"))
        .select("client_id", F.col("last.ts_ms").alias("last_seen_ts"), F.col("last.cmd").alias("last_cmd"))
    )


def subscription_states(changes: DataFrame) -> DataFrame:
    """Change log ``client_id, device_id, op, param_ids, seq`` to the last state per key.

    Deleted keys stay, with ``op`` = delete and no parameters, so that a stream can
    tell a reader about them.  A set replaces the whole parameter set; setting an
    empty one is an error.
    """
    wanted = codes.subscription_params(F.col("param_ids"))
    empty = F.raise_error(F.concat(F.lit("empty subscription of "), F.col("client_id"))).cast("array<string>")
    state = changes.select(
        "client_id",
        "device_id",
        "seq",
        "op",
        F.when(F.col("op") == DELETE, F.array().cast("array<string>"))
        .when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, empty)
        .otherwise(wanted)
        .alias("param_ids"),
    )
    return (
        state.groupBy("client_id", "device_id")
        .agg(F.max_by(F.struct("op", "param_ids"), "seq").alias("last"))
        .select("client_id", "device_id", "last.op", "last.param_ids")
    )


def live_subscriptions(states: DataFrame) -> DataFrame:
    """States without the deleted keys."""
    return states.where(F.col("op") == SET).drop("op")


def current_subscriptions(changes: DataFrame) -> DataFrame:
    """Change log to the subscriptions that are in force."""
    return live_subscriptions(subscription_states(changes))


def deletion_results(changes: DataFrame) -> DataFrame:
    """Whether each delete of the change log removed something: ``client_id, device_id, seq, removed``."""
    told = preceding(
        changes.select("client_id", "device_id", "seq", "op"), ["client_id", "device_id"], ["seq"], "op", "_before", ROW_WIDTH
    )
    return told.where(F.col("op") == DELETE).select(
        "client_id", "device_id", "seq", F.coalesce(F.col("_before") == SET, F.lit(False)).alias("removed")
    )


def looked_up(requests: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions asked for by client and device; ``found`` is false for an unknown key."""
    known = subscriptions.select("client_id", "device_id", "param_ids", F.lit(True).alias("_known"))
    return requests.join(known, ["client_id", "device_id"], "left").select(
        "client_id", "device_id", "param_ids", F.coalesce("_known", F.lit(False)).alias("found")
    )


def without_clients(subscriptions: DataFrame, removed: DataFrame) -> DataFrame:
    """Subscriptions left after some clients are removed."""
    return subscriptions.join(removed.select("client_id").distinct(), "client_id", "left_anti").select(
        subscriptions.columns
    )


def removed_counts(subscriptions: DataFrame, removed: DataFrame) -> DataFrame:
    """Subscriptions each removed client loses (0 when it had none)."""
    held = subscriptions.groupBy("client_id").agg(F.count("*").alias("removed"))
    gone = removed.select("client_id").distinct()
    return gone.join(held, "client_id", "left").select(
        "client_id", F.coalesce("removed", F.lit(0).cast("bigint")).alias("removed")
    )


def parameter_runs(rows: DataFrame, file_column: str = "file_path", row_column: str = "row_index") -> DataFrame:
    """Runs of one parameter in file order: rows ``start…end`` (end excluded).

    Rows without a parameter are ignored but do not end a run.
    """
    named = rows.where(F.col("param_id").isNotNull()).select(file_column, row_column, "param_id", "ts_ms")
    runs = islands(named, [file_column], [row_column], "param_id", lambda before, here: before == here, "_run", ROW_WIDTH)
    return (
        runs.groupBy(file_column, "_run", "param_id")
        .agg(
            F.min(row_column).alias("start_row"),
            (F.max(row_column) + 1).alias("end_row"),
            F.min("ts_ms").alias("min_ts"),
            F.max("ts_ms").alias("max_ts"),
        )
        .drop("_run")
    )


def numbered_packets(packets: DataFrame, order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Running packet number per device, from 1, as ``s``.

    ``order`` starts with a time in milliseconds; the other columns break ties.
    """
    return numbered(packets, ["device_id"], total_order(packets, order), "s")


def unique_points(points: DataFrame) -> DataFrame:
    """One value per device, time and parameter after normalising the parameter.

    For rows that arrive already exploded; inside a packet the parser does the
    same without a shuffle.
    """
    return (
        points.select("device_id", "ts_ms", "param_id", "value", codes.normalise_param(F.col("param_id")).alias("_code"))
        .groupBy("device_id", "ts_ms", F.col("_code"))
        .agg(F.min_by("value", F.struct(F.col("param_id") != F.col("_code"), "param_id")).alias("value"))
        .select("device_id", "ts_ms", F.col("_code").alias("param_id"), "value")
    )


def unique_segments(catalog: DataFrame) -> DataFrame:
    """One entry per segment name."""
    return catalog.dropDuplicates(["device_id", "day", "hour", "segment_file"])


def upsert_segments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entries after an upsert: the newest one per segment name.

    An incoming entry replaces one of the same time; a missing time is the oldest.
    """
    keys = ["device_id", "day", "hour", "segment_file"]
    sides = [df.withColumn("_side", F.lit(side)) for side, df in enumerate((existing, incoming))]
    both = sides[0].unionByName(sides[1])
    others = [c for c in existing.columns if c not in keys]
    # A struct is never NULL and NULL sorts first in it.
    age = F.struct("created_at_ms", "_side")
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), age).alias("entry"))
        .select(*keys, "entry.*")
        .select(existing.columns)
    )


def merged_rows(updates: DataFrame, gap_ms: int = MERGE_GAP_MS, tie: str = "param_id") -> DataFrame:
    """Updates of a device at most ``gap_ms`` after the one before become one row.

    ``updates``: ``device_id, ts_ms, param_id, value``.  A row keeps its first
    time as label and moves its own time forward; a later value of a parameter
    replaces an earlier one.  Result: one line per merged row and parameter.
    """
    wanted = updates.select(*dict.fromkeys(["device_id", "ts_ms", "param_id", "value", tie]))
    rows = islands(
        wanted, ["device_id"], ["ts_ms", tie], "ts_ms", lambda before, here: here - before <= gap_ms, "row_number"
    )
    last = F.max_by("value", F.struct("ts_ms", tie, "value"))
    cells = rows.groupBy("device_id", "row_number", "param_id").agg(
        last.alias("value"), F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last")
    )
    bounds = cells.groupBy("device_id", "row_number").agg(
        F.min("_first").alias("label_ts"),
        F.max("_last").alias("ts_ms"),
        F.map_from_entries(F.collect_list(F.struct("param_id", "value"))).alias("values"),
    )
    return bounds.select("device_id", "row_number", "label_ts", "ts_ms", "values")
