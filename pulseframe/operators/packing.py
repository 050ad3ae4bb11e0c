"""Messages of limited size.

Packing is greedy and order-dependent, but only inside one packet, so it is a
fold over the packet's own points: no shuffle, and usable on streams.  The fold
carries positions and byte counts, not the batches themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest encoded packet in bytes.
MAX_DEVICE_BYTES = 8 * 1024
MAX_CLIENT_BYTES = 512 * 1024

_BATCHES = "array<struct<first:int,count:int>>"


def _message_points(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["param_id"].alias("id"), p["value"].alias("value")))


def _batches(sizes: Column, header: Column, max_bytes: int) -> Column:
    """Cut encoded point sizes into batches ``(first, count)``, first from 0.

    A batch of sizes s1…sk takes ``header + s1 + … + sk + (k - 1)`` bytes, the
    last term for the commas.  A point that alone exceeds the limit closes the
    open batch and is dropped.
    """
    limit = F.lit(max_bytes)
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("first"),
        F.lit(0).alias("count"),
        F.lit(0).alias("bytes"),
        F.array().cast(_BATCHES).alias("done"),
    )

    def step(state: Column, size: Column) -> Column:
        joins = (state["count"] > 0) & (header + state["bytes"] + 1 + size <= limit)
        closed = F.when(
            state["count"] > 0,
            F.array_append(
                state["done"], F.struct(state["first"].alias("first"), state["count"].alias("count"))
            ),
        ).otherwise(state["done"])
        fits_alone = header + size <= limit
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(joins, state["first"]).otherwise(state["at"]).alias("first"),
            F.when(joins, state["count"] + 1).when(fits_alone, 1).otherwise(0).alias("count"),
            F.when(joins, state["bytes"] + 1 + size).when(fits_alone, size).otherwise(0).alias("bytes"),
            F.when(joins, state["done"]).otherwise(closed).alias("done"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["count"] > 0,
            F.array_append(
                state["done"], F.struct(state["first"].alias("first"), state["count"].alias("count"))
            ),
        ).otherwise(state["done"])

    return F.aggregate(sizes, start, step, finish)


def _pack(packets: DataFrame, head: list[str], max_bytes: int) -> DataFrame:
    empty = F.array().cast("array<struct<id:string,value:double>>")
    header = F.octet_length(F.to_json(F.struct(*head, empty.alias("points"))))
    prepared = packets.select(*head, _message_points(F.col("points")).alias("_all"), header.alias("_header"))
    sizes = F.transform("_all", lambda p: F.octet_length(F.to_json(p)))
    cut = prepared.select(
        *head, "_all", F.posexplode(_batches(sizes, F.col("_header"), max_bytes)).alias("part", "_batch")
    )
    points = F.slice("_all", F.col("_batch.first") + 1, F.col("_batch.count"))
    return cut.select(*head, "part", points.alias("points")).select(
        *head,
        "part",
        F.size("points").alias("point_count"),
        F.to_json(F.struct(*head, "points")).alias("payload"),
    )


def device_messages(packets: DataFrame, max_bytes: int = MAX_DEVICE_BYTES) -> DataFrame:
    """Packets ``device_id, ts_ms, points`` as JSON messages of limited size."""
    return _pack(packets, ["device_id", "ts_ms"], max_bytes)


def client_messages(selected: DataFrame, max_bytes: int = MAX_CLIENT_BYTES) -> DataFrame:
    """Fanned-out packets as JSON messages of limited size, one client each."""
    return _pack(selected, ["client_id", "device_id", "ts_ms"], max_bytes)


def param_messages(points: DataFrame) -> DataFrame:
    """One JSON message per point."""
    row = F.struct("device_id", "ts_ms", "param_id", "value")
    return points.select("device_id", "ts_ms", "param_id", F.to_json(row).alias("payload"))
