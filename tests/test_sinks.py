from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulseframe import schema
from pulseframe.operators import packing, reshape
from pulseframe.plans import freesql
from pulseframe.sinks import exports, segments
from pulseframe.sources.segments import read_table, sparse_point

T0 = 1704067200000  # 2024-01-01T00:00Z


@pytest.fixture
def points(spark):
    rows = [
        ("d1", T0 + 1, "P00002", 2.5),
        ("d1", T0 + 1, "P00001", 1.0),
        ("d1", T0 + 3600000, "Z00001", 0.1),
        ("d2", T0 + 2, "P00001", 7.0),
    ]
    return spark.createDataFrame(rows, "device_id string, ts_ms bigint, param_id string, value double")


def test_long_rows_layout_and_order(spark, points, tmp_path, rows):
    path = str(tmp_path / "t")
    segments.write_long_rows(points, path)
    files = glob.glob(f"{path}/device_id=d1/day=2024-01-01/hour=00/*.parquet")
    assert len(files) == 1
    stored = pq.ParquetFile(files[0])
    assert stored.metadata.row_group(0).column(0).compression == "ZSTD"
    assert stored.read().column("param_id").to_pylist() == ["P00001", "P00002"]
    assert stored.schema_arrow.field("value").type == "float"
    back = read_table(spark, path)
    assert rows(back, "device_id", "ts_ms", "param_id", "day", "hour")[0] == ("d1", T0 + 1, "P00001", "2024-01-01", "00")
    assert back.count() == 4


def test_rows_per_file_and_codecs(spark, tmp_path):
    many = spark.range(1000).select(F.lit("d").alias("device_id"), (F.col("id") + T0).alias("ts_ms"), F.lit("P00001").alias("param_id"), F.lit(1.0).alias("value"))
    for codec in segments.CODECS:
        segments.write_long_rows(many, str(tmp_path / codec), compression=codec, rows_per_file=300)
        assert len(glob.glob(str(tmp_path / codec / "*/*/*/*.parquet"))) == 4
    with pytest.raises(ValueError):
        segments.write_long_rows(many, str(tmp_path / "x"), compression="lzma")


def test_small_files_of_one_day_have_several_writers(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        many = spark.range(4000).select(F.lit("d").alias("device_id"), (F.col("id") + T0).alias("ts_ms"), F.lit("P00001").alias("param_id"), F.rand(1).alias("value"))
        segments.write_long_rows(many, str(tmp_path / "t"), partition_by=("day",), rows_per_file=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spans, writers = [], {}
    for file in glob.glob(str(tmp_path / "t" / "*" / "*.parquet")):
        times = pq.ParquetFile(file).read().column("ts_ms").to_pylist()
        spans.append((times[0], times[-1], len(times)))
        writer = file.split("part-")[1][:5]
        writers[writer] = writers.get(writer, 0) + len(times)
    spans.sort()
    assert all(n <= 100 for *_, n in spans) and sum(n for *_, n in spans) == 4000
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # All rows of a day were one task before.
    assert len(writers) > 2 and max(writers.values()) < 2000


def test_zone_of_partitions(spark, points, tmp_path, rows):
    segments.write_long_rows(points, str(tmp_path / "t"), tz="America/New_York")
    assert rows(read_table(spark, str(tmp_path / "t")), "day", "hour")[0] == ("2023-12-31", "19")


def test_range_prunes_directories(spark, points, tmp_path):
    from pulseframe.functions.timeparts import TimeRange
    from pulseframe.plans.history import point_history

    segments.write_long_rows(points, str(tmp_path / "t"))
    result = point_history(read_table(spark, str(tmp_path / "t")), "d1", "p00001", TimeRange(T0, T0 + 1000))
    plan = result._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "device_id" in scan.split("PartitionFilters")[1] and "hour" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(param_id,P00001)" in scan and "GreaterThanOrEqual(ts_ms" in scan
    assert "ReadSchema: struct<ts_ms:bigint,param_id:string,value:float>" in scan
    assert [tuple(r) for r in result.collect()] == [(T0 + 1, "P00001", 1.0)]


def test_packet_round_trip(spark, points, tmp_path, rows):
    segments.write_points_as_packets(points, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"))
    assert rows(back.where("device_id = 'd1' AND hour = '00'"), "param_ids") == [(["P00001", "P00002"],)]
    narrow = points.withColumn("value", F.col("value").cast("float"))
    assert rows(reshape.packets_to_points(back)) == rows(narrow)


def test_sparse_round_trip(spark, points, tmp_path, rows):
    segments.write_sparse(points, str(tmp_path / "t"), [1, 2, 3])
    assert glob.glob(str(tmp_path / "t" / "device_id=d1/year=2024/month=01/day=01/*.parquet"))
    table = read_table(spark, str(tmp_path / "t"))
    assert rows(sparse_point(table, 2, "d1"), "timestamp", "value") == [(T0 + 1, 2.5), (T0 + 3600000, None)]
    with pytest.raises(ValueError):
        sparse_point(table, 0)
    with pytest.raises(ValueError):
        segments.write_sparse(points, str(tmp_path / "u"), [10001])


def test_raw_archive_layout(spark, tmp_path):
    events = spark.createDataFrame([("d1", T0, bytearray(b"\x00\xff"))], "device_id string, timestamp_ms bigint, payload binary")
    segments.write_raw_archive(events, str(tmp_path / "t"))
    row = read_table(spark, str(tmp_path / "t")).first()
    assert (row["schema_version"], row["day"], row["hour"], bytes(row["payload"])) == (1, "20240101", "00", b"\x00\xff")


def test_export_lines(spark, points, rows):
    lines = exports.packet_lines(reshape.points_to_packets(points, "float"))
    assert rows(lines, "value") == [
        (f'{{"id":"d1","t":{T0 + 1},"s":1,"p":{{"P00001":1,"P00002":2.500}}}}',),
        (f'{{"id":"d1","t":{T0 + 3600000},"s":2,"p":{{"Z00001":0.100}}}}',),
        (f'{{"id":"d2","t":{T0 + 2},"s":1,"p":{{"P00001":7}}}}',),
    ]
    assert exports.long_row_lines(points).count() == 4


def test_csv_exports(spark, points, tmp_path):
    exports.write_points_csv(points, str(tmp_path / "csv"), limit=2)
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "csv" / "*.csv")))
    assert text == f"ts,param_id,value\n{T0 + 1},P00001,1.000000\n{T0 + 1},P00002,2.500000\n"
    result = freesql.run_sql(spark, "SELECT 1 AS a, CAST(NULL AS STRING) AS b", {})
    exports.write_result_csv(result, str(tmp_path / "sql"))
    assert "".join(open(f).read() for f in glob.glob(str(tmp_path / "sql" / "*.csv"))) == "a,b\n1,\n"


def test_messages_by_kind(spark, points, rows):
    one = packing.param_messages(points.where("device_id = 'd2'"))
    assert rows(exports.messages(one)) == [("gw/d2/P00001", "d2", f'{{"device_id":"d2","ts_ms":{T0 + 2},"param_id":"P00001","value":7.0}}')]
    client = one.drop("param_id").withColumn("client_id", F.lit("c"))
    assert rows(exports.messages(client), "topic") == [("gw/c/d2/payload",)]
    assert rows(exports.messages(one.drop("param_id"), "site"), "topic") == [("site/d2/telemetry",)]


def test_mode_spellings():
    assert schema.storage_mode("Long-Row") == schema.storage_mode("long_row") == schema.MODE_LONG_ROW
    with pytest.raises(ValueError):
        schema.storage_mode("other")


def brute_force(head, points, limit):
    size = lambda batch: len(head + ",".join(batch) + "]}")
    out, current = [], []
    for p in points:
        if size([*current, p]) <= limit:
            current.append(p)
            continue
        if current:
            out.append(current)
        current = [p] if size([p]) <= limit else []
    return [head + ",".join(b) + "]}" for b in [*out, current] if b]


@pytest.mark.parametrize("limit", [60, 75, 100, 300, 8192])
def test_packing_is_greedy(spark, limit):
    values = [1.0, 1234567.125, 2.5, 0.1, 99999999.5, 3.0, 4.0, 5.25] * 4
    points = [(f"P{i:05d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame([("d1", 7, points), ("d2", 8, [])], f"device_id string, ts_ms bigint, points {schema.POINTS}")
    got = packing.device_messages(df, limit).orderBy("part").collect()
    encoded = [r[0] for r in spark.createDataFrame(points, "id string, value double").select(F.to_json(F.struct("id", "value"))).collect()]
    want = brute_force('{"device_id":"d1","ts_ms":7,"points":[', encoded, limit)
    assert [r["payload"] for r in got] == want
    assert [r["part"] for r in got] == list(range(len(want)))
    assert all(len(r["payload"].encode()) <= limit for r in got)


def test_packing_thousands_of_points(spark):
    df = spark.range(1).select(
        F.lit("d").alias("device_id"),
        F.lit(1).alias("ts_ms"),
        F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.struct(F.format_string("P%05d", i).alias("param_id"), i.cast("double").alias("value"))).alias("points"),
    )
    total = packing.device_messages(df).agg(F.sum("point_count"), F.max(F.octet_length("payload")), F.count("*")).first()
    assert total[0] == 5000 and total[1] <= packing.MAX_DEVICE_BYTES and total[2] > 10
