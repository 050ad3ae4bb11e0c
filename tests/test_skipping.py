"""Only the files a catalog names are opened, and ordered joins hold for one device of any size."""

from __future__ import annotations

import os
import random
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import DAY_MS, HOUR_MS, TimeRange
from pulseframe.operators import joins
from pulseframe.plans import history
from pulseframe.sinks import segments as sinks
from pulseframe.sources import segments, skipping

START = 1_704_067_200_000
ZONE = "Asia/Shanghai"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [
        (device, START + hour * HOUR_MS + rng.randrange(HOUR_MS), param, float(k))
        for device in ("a b=1", "dev{2}")
        for hour in range(0, 72, 3)
        for k, param in enumerate(["P00001"] if hour % 2 else ["P00001", "P00002"])
    ]


@pytest.fixture(scope="module", params=["long", "packets"])
def stored(request, spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "with space")
    df = spark.createDataFrame(rows, "device_id string, ts_ms bigint, param_id string, value double")
    if request.param == "long":
        sinks.write_long_rows(df, path)
    else:
        sinks.write_points_as_packets(df, path)
    return path


def spoil(path, keep):
    """Every file that is not to be opened becomes rubbish."""
    kept = {unquote(urlparse(f).path) for f in keep}
    spoilt = 0
    for folder, _, names in os.walk(path):
        for name in names:
            file = os.path.join(folder, name)
            if name.endswith(".parquet") and file not in kept:
                with open(file, "wb") as out:
                    out.write(b"rubbish")
                spoilt += 1
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".crc"):
                os.remove(os.path.join(folder, name))
    return spoilt


def test_only_candidates_are_opened(spark, rows, stored):
    table = segments.read_table(spark, stored)
    catalog = spark.createDataFrame(skipping.file_catalog(table).collect())
    span = TimeRange(START + 10 * HOUR_MS, START + 40 * HOUR_MS)
    files = skipping.candidate_files(catalog, "a b=1", span, "P00002")
    want = sorted((t, v) for d, t, p, v in rows if d == "a b=1" and p == "P00002" and span.from_ms <= t <= span.to_ms)
    assert 0 < len(files) <= len(want)
    assert spoil(stored, files) > 30
    opened = skipping.open_files(spark, stored, files, table.schema)
    assert sorted(f.replace("///", "/") for f in opened.inputFiles()) == files
    page = history.catalog_history(spark, catalog, stored, table.schema, "a b=1", "p00002", span, 1, 3)
    assert [tuple(r) for r in page.rows.collect()] == want[1:4] and page.total.first()["total"] == len(want)
    none = history.catalog_history(spark, catalog, stored, table.schema, "dev{2}", "P00009", span)
    assert none.rows.collect() == [] and none.total.first()["total"] == 0


def test_unknown_parameters_keep_a_file(spark):
    catalog = spark.createDataFrame(
        [("d", "x", 0, 9, 5, []), ("d", "y", 0, 9, 5, ["P00002"]), ("d", "z", 0, 9, 0, []), ("e", "w", 0, 9, 5, [])],
        "device_id string, file_path string, min_ts bigint, max_ts bigint, rows bigint, param_ids array<string>",
    )
    assert skipping.candidate_files(catalog, "d", TimeRange(3, 4), "P00001") == ["x"]
    assert skipping.candidate_files(catalog, "d", TimeRange(10, 14), "P00002") == []
    manifests = spark.createDataFrame([("file:/t/d/manifest.jsonl", "s.parquet")], "manifest_path string, segment_file string")
    assert skipping.manifest_catalog(manifests).first()["file_path"] == "file:/t/d/s.parquet"


def test_foreign_files(spark, tmp_path):
    path = str(tmp_path / "tree")
    df = spark.range(200).select(
        F.concat(F.lit("d"), F.col("id") % 2).alias("device"), F.lit("2024-01-01").alias("day"), F.lpad((F.col("id") % 20).cast("string"), 2, "0").alias("hour"),
        (START + F.col("id") % 20 * HOUR_MS + F.col("id")).cast("decimal(20,0)").alias("ts"), F.lit("P00001").alias("param_id"), F.col("id").cast("float").alias("value"),
    )
    df.repartition(1).write.partitionBy("device", "day", "hour").parquet(path)
    catalog = spark.createDataFrame(skipping.file_catalog(segments.foreign_long_rows(spark, path)).collect())
    span = TimeRange(START + 4 * HOUR_MS, START + 7 * HOUR_MS - 1)
    files = skipping.candidate_files(catalog, "d0", span)
    assert len(files) == 2 and spoil(path, files) == 18
    got = segments.foreign_long_rows(spark, path, from_ms=span.from_ms, to_ms=span.to_ms, device_id="d0", files=files)
    assert got.count() == 20 and got.select("device_id").distinct().collect() == [("d0",)]


@pytest.mark.parametrize("zone", ["UTC", ZONE, "America/St_Johns"])
def test_histories_of_a_table_in_another_zone(spark, rows, tmp_path, zone):
    df = spark.createDataFrame(rows, "device_id string, ts_ms bigint, param_id string, value double")
    sinks.write_long_rows(df, str(tmp_path), tz=zone, partition_by=("day", "hour"))
    table = segments.read_table(spark, str(tmp_path))
    span = TimeRange(START + 5 * HOUR_MS, START + 2 * DAY_MS)
    want = sorted((t, p, v) for d, t, p, v in rows if d == "dev{2}" and span.from_ms <= t <= span.to_ms)
    both = history.unified_history(table, table, "dev{2}", span, START + DAY_MS, tz=zone)
    assert sorted(tuple(r)[:3] for r in both.rows.collect()) == want
    assert sum(r["rows"] for r in both.counts.collect()) == len(want)
    wide = history.wide_history(table, "dev{2}", ["P00001", "P00002"], span, tz=zone).collect()
    assert sorted(r["ts_ms"] for r in wide) == sorted({t for t, _, _ in want})


@pytest.mark.parametrize("width", [50, 1000, 10**9])
def test_as_of(spark, width):
    rng = random.Random(width)
    devices = ["hot"] * 20 + ["b", "c", None]
    left = [(rng.choice(devices), rng.choice([None, *range(5000)]), k) for k in range(2000)]
    right = [(rng.choice(devices), rng.randrange(5000), rng.choice([None, *range(9)])) for _ in range(300)]
    a = spark.createDataFrame(left, "device_id string, ts_ms bigint, id bigint").repartition(5)
    b = spark.createDataFrame(right, "device_id string, ts_ms bigint, value bigint").repartition(3)

    def brute(device, at, within=None):
        if at is None:
            return (None, None)
        earlier = [(t, v is not None, v) for d, t, v in right if d == device and t <= at]
        t, _, v = max(earlier, key=lambda r: (r[0], r[1], r[2] or 0), default=(None, None, None))
        return (None, None) if t is None or (within is not None and at - t > within) else (v, t)

    for within in (None, 40):
        got = joins.as_of(a, b, name="x", within_ms=within, width=width)
        assert got.columns == ["device_id", "ts_ms", "id", "x", "x_ts"]
        assert {r["id"]: (r["x"], r["x_ts"]) for r in got.collect()} == {k: brute(d, t, within) for d, t, k in left}
