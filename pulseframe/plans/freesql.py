"""Free SQL over DataFrames: Spark parses, plans and runs it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators.filters import in_range

# Placeholders of a query template.
TABLE_MARK, FROM_MARK, TO_MARK = "{{table}}", "{{from}}", "{{to}}"

# Columns a typed query must return, with their accepted types.
TYPED_COLUMNS = {
    "ts": ("bigint", "int", "decimal(20,0)"),
    "param_id": ("string",),
    "value": ("float", "double"),
}


def run_sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Mapping[str, Any] | None = None
) -> DataFrame:
    """Any query over the named tables; values are bound as ``:name`` parameters."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=dict(args) if args else None)


def run_template(spark: SparkSession, text: str, table: DataFrame, span: TimeRange) -> DataFrame:
    """Template with ``{{table}}``, ``{{from}}`` and ``{{to}}``.

    The bounds become named parameters; no value is pasted into the text.
    """
    view = f"points_{uuid.uuid4().hex}"
    bound = text.replace(TABLE_MARK, view).replace(FROM_MARK, ":from_ms").replace(TO_MARK, ":to_ms")
    known = {"from_ms": span.from_ms, "to_ms": span.to_ms}
    used = {name: value for name, value in known.items() if re.search(f":{name}\\b", bound)}
    return run_sql(spark, bound, {view: table}, used)


def run_typed(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Mapping[str, Any] | None = None
) -> DataFrame:
    """A query that must return ``ts, param_id, value``; returned as points."""
    result = run_sql(spark, text, tables, args)
    types = {f.name: f.dataType.simpleString() for f in result.schema}
    for name, accepted in TYPED_COLUMNS.items():
        if types.get(name) not in accepted:
            raise ValueError(f"column {name} must be one of {accepted}, got {types.get(name)}")
    return result.select(F.col("ts").cast("bigint").alias("ts_ms"), "param_id", F.col("value").cast("double").alias("value"))


@dataclass(frozen=True)
class Profile:
    """Metrics filled in when the query has run once."""

    read: Observation
    returned: Observation

    @property
    def rows_read(self) -> int:
        return self.read.get["rows"]

    @property
    def rows_returned(self) -> int:
        return self.returned.get["rows"]


def profiled(points: DataFrame, span: TimeRange, limit: int) -> tuple[DataFrame, Profile]:
    """A limited range query that counts rows read and returned as it runs."""
    profile = Profile(Observation("rows_read"), Observation("rows_returned"))
    scanned = in_range(points, span).observe(profile.read, F.count(F.lit(1)).alias("rows"))
    limited = scanned.orderBy("ts_ms", "param_id", "device_id").limit(limit)
    return limited.observe(profile.returned, F.count(F.lit(1)).alias("rows")), profile
