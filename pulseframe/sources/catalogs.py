"""Manifests and inventories."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.functions import codes
from pulseframe.functions.columns import rows_where

_BAD = "_bad_record"


def _canonical_mode(mode: Column) -> Column:
    known = F.coalesce(
        *[F.when(F.lower(mode) == spelling, F.lit(name)) for spelling, name in schema.MODE_SPELLINGS.items()]
    )
    return F.coalesce(known, F.lit(schema.MODE_PACKET_WIDE))


def parse_manifest_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Segment manifest lines in ``value``; other columns are carried along.

    ``strict`` fails on a bad line.  Otherwise bad lines stay, flagged in
    ``bad_line``; ``line`` is the text as read.  Missing points become 0, a missing mode packet wide.
    """
    carried = [c for c in lines.columns if c != "value"]
    entry = F.from_json(
        "value",
        f"{schema.SEGMENT_MANIFEST}, {_BAD} string",
        {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"},
    )

    def is_good(m: Column) -> Column:
        present = [m["entry"][c].isNotNull() for c in ("segment_file", "min_ts", "max_ts", "rows")]
        return F.coalesce(reduce(and_, present, m["entry"][_BAD].isNull()), F.lit(False))

    def keep(m: Column) -> Column:
        failed = F.raise_error(F.concat(F.lit("bad manifest line: "), m["line"])).cast("boolean")
        return F.when(is_good(m), F.lit(True)).otherwise(failed if strict else F.lit(True))

    parsed = lines.where(codes.trimmed(F.col("value")) != "").select(
        *carried, rows_where(F.struct(entry.alias("entry"), F.col("value").alias("line")), keep).alias("m")
    )
    judged = parsed.select(*carried, "m", is_good(F.col("m")).alias("_good"))
    good = F.col("_good")
    return judged.select(
        *carried,
        F.when(good, F.col("m.entry.segment_file")).alias("segment_file"),
        F.when(good, F.col("m.entry.min_ts")).alias("min_ts"),
        F.when(good, F.col("m.entry.max_ts")).alias("max_ts"),
        F.when(good, F.col("m.entry.rows")).alias("rows"),
        F.when(good, F.coalesce("m.entry.points", F.lit(0).cast("bigint"))).alias("points"),
        F.when(good, F.col("m.entry.created_at_ms")).alias("created_at_ms"),
        F.when(good, _canonical_mode(F.col("m.entry.mode"))).alias("mode"),
        F.when(good, F.coalesce("m.entry.param_ids", F.array().cast("array<string>"))).alias("param_ids"),
        (~good).alias("bad_line"),
        F.col("m.line").alias("line"),
    )


def manifest_lines(spark: SparkSession, root: str, glob: str = "manifest.jsonl") -> DataFrame:
    """Raw manifest lines below a tree with the path of their manifest."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("manifest_path"))
    )


def read_manifests(spark: SparkSession, root: str, strict: bool = True, glob: str = "manifest.jsonl") -> DataFrame:
    """Segment manifests below a tree."""
    return parse_manifest_lines(manifest_lines(spark, root, glob), strict)


def read_archive_manifests(spark: SparkSession, root: str, glob: str = "manifest.jsonl") -> DataFrame:
    """Raw-archive manifests below a tree; a bad line fails the read."""
    return (
        spark.read.schema(schema.ARCHIVE_MANIFEST)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .json(root)
    )


def write_archive_manifests(
    catalog: DataFrame, path: str, partition_by: Sequence[str] = ("device", "day")
) -> None:
    """Manifest lines of ``archive_catalog`` as JSON, one file per device and day, in part order.

    ``partition_by=("day",)`` keeps the number of files small where devices are many.  Read back with ``read_archive_manifests(spark, path, glob="*.json")``.
    """
    keyed = catalog.withColumns({"device": F.col("device_id"), "day": F.col("day_key")})
    unused = [c for c in ("device", "day") if c not in partition_by]
    placed = keyed.repartition(*partition_by).sortWithinPartitions(*partition_by, "device_id", "hour", "part")
    placed.drop(*unused).write.partitionBy(*partition_by).json(path)


def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path and size of every file below a tree; contents are never read.

    Spark's scans leave out files of no bytes at all.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            # Spelled as in the scans this is joined with; ``path`` has another URI form.
            F.col("_metadata.file_path").alias("file_path"),
            F.substring_index("_metadata.file_path", "/", -1).alias("file_name"),
            F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("directory"),
            F.col("length").alias("bytes"),
        )
    )


def directory_totals(inventory: DataFrame) -> DataFrame:
    """File count and bytes per directory."""
    return inventory.groupBy("directory").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def device_inventory(spark: SparkSession, devices: Iterable[tuple[str, str, int]]) -> DataFrame:
    """Configured devices as a DataFrame."""
    return spark.createDataFrame(list(devices), schema.DEVICE_INVENTORY)


def read_device_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Device inventory kept as JSON lines."""
    return spark.read.schema(schema.DEVICE_INVENTORY).json(path)
