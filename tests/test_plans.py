"""What a plan must not do however small the files below it look."""

from __future__ import annotations

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import codes
from pulseframe.functions.timeparts import TimeRange
from pulseframe.operators import ordering, quality
from pulseframe.sources.catalogs import parse_manifest_lines

QUERIES = __spark_entry__.queries()
SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("jon_05_")])
def test_overlap_join_does_not_broadcast_its_blocks(spark, name):
    plan = executed(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_manifest_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("{}", "root/a/2024-01-01/05/manifest.jsonl")], "value string, manifest_path string")
    optimized = parse_manifest_lines(lines, strict=False)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json(") == 1


def test_span_condition_mentions_its_directory_once(spark):
    tree = spark.createDataFrame([("root/dev/2024-01-01/05",), ("root/dev/2024-01-01/24",), ("x",)], "directory string")
    kept = tree.where(quality._in_span(F.col("directory"), TimeRange(0, 4102444800000), "UTC"))
    assert [r.directory for r in kept.collect()] == ["root/dev/2024-01-01/05"]
    condition = kept._jdf.queryExecution().analyzed().condition().toString()
    assert condition.count("directory#") == 1


def test_file_inventory_is_not_broadcast(spark):
    assert "BroadcastHashJoin" not in executed(QUERIES["dq_01_issues"](spark, SF))


def test_one_task_sorts_a_few_megabytes_at_most(spark, tmp_path):
    ids = spark.range(0, 1_500_000, 1, 4).select(F.xxhash64("id").alias("ts_ms"), F.lit("P00001").alias("param_id"))
    ids.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    assert 4 << 20 < ordering.expected_bytes(stored) < 64 << 20
    assert "SinglePartition" not in executed(ordering.by_time(stored))


def test_range_ends_are_parsed_once_per_range(spark):
    specs = spark.createDataFrame([("x_08~X_10, free ,P9~P1,~P1,A1~B2,Q9~Q99999999999999999999,FREE",)], "spec string")
    lenient = specs.select(codes.expand_specs_lenient(F.col("spec")).alias("names"))
    assert lenient.first().names == ["X_08", "X_09", "X_10", "FREE"]
    plan = lenient._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= 4
