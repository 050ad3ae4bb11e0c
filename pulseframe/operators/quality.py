"""Data-quality jobs: catalog against files, archive contents, import totals."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.functions import naming
from pulseframe.functions.columns import evaluated_once
from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators.filters import hour_overlaps
from pulseframe.sources.catalogs import parse_manifest_lines

# Kinds of issues, and how many are shown by default.
NO_MANIFEST = "missing manifest"
BAD_LINE = "bad manifest line"
BAD_RANGE = "invalid ts range"
NO_SEGMENT = "missing segment file"
SHOWN_ISSUES = 30

MANIFEST_NAME = "manifest.jsonl"


def _in_span(directory: Column, span: TimeRange, tz: str) -> Column:
    """True for a ``…/day/hour`` directory that shares time with the range.

    The condition is pushed below whatever the directory is made from, so directory,
    day and hour are computed once each.
    """

    def shares_time(inside: Column) -> Column:
        parts = F.struct(naming.path_day(inside).alias("day"), naming.path_hour(inside).alias("hour"))
        return evaluated_once(parts, lambda p: hour_overlaps(p["day"], p["hour"], span, tz))

    return evaluated_once(F.concat(directory, F.lit("/-")), shares_time)


def _hours(inventory: DataFrame, span: TimeRange, tz: str) -> DataFrame:
    """Hour directories in range and whether they hold a manifest."""
    return (
        inventory.where(_in_span(F.col("directory"), span, tz))
        .groupBy("directory")
        .agg(F.bool_or(F.col("file_name") == MANIFEST_NAME).alias("has_manifest"))
    )


def _entries(inventory: DataFrame, lines: DataFrame, span: TimeRange, tz: str) -> DataFrame:
    """Parsed manifest lines in range with the verdict on each, in one pass."""
    placed = lines.withColumn("directory", F.regexp_replace("manifest_path", "/[^/]*$", ""))
    parsed = parse_manifest_lines(placed.where(_in_span(F.col("directory"), span, tz)), strict=False)
    named = parsed.withColumn("file_path", F.concat(F.col("directory"), F.lit("/"), F.col("segment_file")))
    stored = inventory.select("file_path").distinct().withColumn("stored", F.lit(True))
    # Estimates from the files below the tree may call its inventory small; it grows with the tree.
    return named.join(stored.hint("merge"), "file_path", "left").withColumns(
        {
            "reversed": (~F.col("bad_line")) & (F.col("rows") > 0) & (F.col("min_ts") > F.col("max_ts")),
            "missing": (~F.col("bad_line")) & F.col("stored").isNull(),
        }
    )


def consistency_issues(
    inventory: DataFrame, lines: DataFrame, span: TimeRange, tz: str = "UTC"
) -> DataFrame:
    """Issues as rows ``issue, location, detail``.

    ``inventory``: ``file_path, file_name, directory`` of all files below the
    tree; ``lines``: ``value, manifest_path``.  An hour without a manifest is
    reported once and not looked at further.
    """

    def issue(kind: str, location: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue"), location.alias("location"), detail.alias("detail"))

    none = F.lit(None).cast("string")
    bounds = F.format_string("min_ts=%d max_ts=%d", F.col("min_ts"), F.col("max_ts"))
    found = F.array_compact(
        F.array(
            F.when(F.col("bad_line"), issue(BAD_LINE, F.col("manifest_path"), F.col("line"))),
            F.when(F.col("reversed"), issue(BAD_RANGE, F.col("manifest_path"), bounds)),
            F.when(F.col("missing"), issue(NO_SEGMENT, F.col("file_path"), none)),
        )
    )
    bare_hours = _hours(inventory, span, tz).where(~F.col("has_manifest"))
    manifest = F.concat_ws("/", "directory", F.lit(MANIFEST_NAME))
    return (
        bare_hours.select(issue(NO_MANIFEST, manifest, none).alias("found"))
        .unionByName(_entries(inventory, lines, span, tz).select(F.explode(found).alias("found")))
        .select("found.*")
    )


def shown_issues(issues: DataFrame, n: int = SHOWN_ISSUES) -> DataFrame:
    """The first issues in a fixed order."""
    return issues.orderBy("issue", "location", "detail").limit(n)


def _one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row results side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def consistency_report(inventory: DataFrame, lines: DataFrame, span: TimeRange, tz: str = "UTC") -> DataFrame:
    """One row of counts for the same checks."""
    hours = _hours(inventory, span, tz).agg(
        F.count("*").alias("hour_dirs"),
        F.count_if("has_manifest").alias("manifest_files"),
        F.count_if(~F.col("has_manifest")).alias("missing_manifest"),
    )
    entries = _entries(inventory, lines, span, tz).agg(
        F.count_if(~F.col("bad_line")).alias("manifest_entries"),
        F.count_if("bad_line").alias("bad_manifest_lines"),
        F.count_if("reversed").alias("invalid_entries"),
        F.count_if("missing").alias("missing_segment_files"),
    )
    counted = _one_row(hours, entries)
    kinds = ["missing_manifest", "bad_manifest_lines", "invalid_entries", "missing_segment_files"]
    return counted.withColumn("issues", reduce(add, [F.col(k) for k in kinds]))


def archive_check(raw: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per archive file: readable, records, rows of another device, verdict.

    ``raw`` is scanned with corrupt files ignored; ``device_id`` of a file is the
    one its path names.  Where ``inventory`` has a column ``rows`` (from the manifest)
    a file is readable when exactly so many rows were read: a file that breaks off
    half way is not, an empty one is.  Without it, a file is readable when any row was.
    """
    own = naming.path_device_of_day(F.col("file_path"))
    # Damage shows only in columns that are read, so the verdict depends on all of them.
    stored = [c for c in ("schema_version", "timestamp_ms", "payload") if c in raw.columns]
    missing = reduce(or_, [F.col(c).isNull() for c in stored], F.lit(False))
    per_file = raw.groupBy("file_path").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("device_id") != own).alias("foreign_rows"),
        F.count_if(missing).alias("_missing"),
    )
    zero = F.lit(0).cast("bigint")
    expected = F.col("rows") if "rows" in inventory.columns else F.lit(None).cast("bigint")
    read = F.col("records").isNotNull() & (F.col("_missing") <= F.col("records"))
    return (
        inventory.select("file_path", expected.alias("_expected"))
        .join(per_file, "file_path", "left")
        .select(
            "file_path",
            F.when(F.col("_expected") == 0, F.col("records").isNull())
            .otherwise(F.coalesce(read & (F.col("records") == F.coalesce("_expected", "records")), F.lit(False)))
            .alias("readable"),
            F.coalesce("records", zero).alias("records"),
            F.coalesce("foreign_rows", zero).alias("foreign_rows"),
        )
        .withColumn("ok", F.col("readable") & (F.col("foreign_rows") == 0))
    )


def archive_summary(checked: DataFrame) -> DataFrame:
    """Readable files, records of good files and failed files."""
    return checked.agg(
        F.count_if("ok").alias("readable_files"),
        F.sum(F.when(F.col("ok"), F.col("records")).otherwise(0)).cast("bigint").alias("records"),
        F.count_if(~F.col("ok")).alias("failed_files"),
    )


def import_check(source: DataFrame, stored: DataFrame, mode: str = schema.MODE_LONG_ROW) -> DataFrame:
    """One row: source totals against stored totals.

    ``source``: ``packets, points``; ``stored``: ``rows, points`` — one row each.
    Long rows hold one row per point, packet-wide rows one per packet.
    """
    long_rows = schema.storage_mode(mode) == schema.MODE_LONG_ROW
    a = source.select(F.col("packets").alias("source_packets"), F.col("points").alias("source_points"))
    b = stored.select(F.col("rows").alias("stored_rows"), F.col("points").alias("stored_points"))
    expected = F.col("source_points") if long_rows else F.col("source_packets")
    return _one_row(a, b).withColumns(
        {
            "rows_match": F.col("stored_rows") == expected,
            "points_match": F.col("stored_points") == F.col("source_points"),
        }
    )
