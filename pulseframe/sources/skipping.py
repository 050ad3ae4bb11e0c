"""Opening only the files that a catalog does not rule out.

A catalog has one row per device and file: its time range, number of rows and parameter
set.  One device and time range leave a short list of files; they are opened by path, so the
rest of the table is neither listed nor read.  The list is what the driver would hold for
those files anyway; the catalog itself is filtered by Spark and never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseframe.functions.timeparts import TimeRange, intervals_overlap
from pulseframe.operators import filters
from pulseframe.operators.aggregates import packet_catalog, segment_catalog
from pulseframe.sources.segments import plain_path, stored_file


def file_catalog(table: DataFrame) -> DataFrame:
    """Catalog of a stored table of long rows or packets, from its data: one row per device and file."""
    keyed = table if "file_path" in table.columns else table.withColumn("file_path", stored_file())
    build = packet_catalog if "param_ids" in table.columns else segment_catalog
    return build(keyed, ["device_id", "file_path"])


def manifest_catalog(manifests: DataFrame) -> DataFrame:
    """Segment manifests (``manifest_path, segment_file, …``) with the path of each segment."""
    folder = F.regexp_replace("manifest_path", "/[^/]*$", "/")
    return manifests.withColumn("file_path", F.concat(folder, "segment_file"))


def candidates(catalog: DataFrame, device_id: str, span: TimeRange, param: str | None = None) -> DataFrame:
    """Segments that may hold rows of a device, time range and parameter."""
    kept = filters.usable_segments(catalog).where(
        (F.col("device_id") == device_id)
        & intervals_overlap(F.col("min_ts"), F.col("max_ts"), F.lit(span.from_ms), F.lit(span.to_ms))
    )
    return kept if param is None else kept.where(filters.may_contain(F.col("param_ids"), param))


def candidate_files(catalog: DataFrame, device_id: str, span: TimeRange, param: str | None = None) -> list[str]:
    """Paths of those segments, in order."""
    found = candidates(catalog, device_id, span, param).select("file_path").distinct()
    return sorted(r["file_path"] for r in found.collect())


def open_files(spark: SparkSession, root: str, files: Sequence[str], schema: StructType) -> DataFrame:
    """Rows of the given files below ``root``, as named by ``_metadata.file_path`` or a manifest.

    ``schema`` holds the partition columns too; with it no file is opened before the scan.
    """
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*[plain_path(f) for f in files])
