from __future__ import annotations

import json
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulseframe.operators import filters, reshape
from pulseframe.sources import catalogs, packets, segments


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def points_of(df, column="points"):
    return [[(p["param_id"], p["value"]) for p in r[column]] for r in df.collect()]


def test_packet_members_are_filtered_and_sorted(spark):
    line = (
        '{"id":"d1","t":1000,"s":1,"p":{"Z00001":1,"P00001":1.5," p00010":4,"P00003":true,"P00004":null,'
        '"P00005":"7","P00006":12345678901234567890,"P00007":[1],"P00008":{"a":1},"P00009":1.25e3,"X00001":2,"P1":3}}'
    )
    got = packets.parse_packet_lines(lines(spark, line))
    assert points_of(got) == [[("P00001", 1.5), ("P00006", 1.2345678901234567e19), ("P00009", 1250.0), ("P00010", 4.0), ("Z00001", 1.0)]]
    assert [tuple(r) for r in got.select("device_id", "ts_ms", "seq", "skipped").collect()] == [("d1", 1000, 1, False)]


def test_twins_of_a_code(spark):
    parse = lambda p: points_of(packets.parse_packet_lines(lines(spark, '{"id":"d","t":1,"s":1,"p":%s}' % p)))[0]
    assert parse('{"p00001":2,"P00001":1}') == [("P00001", 1.0)]  # exact spelling wins
    assert parse('{" p00001":2,"p00001":3}') == [("P00001", 2.0)]  # else the smallest key
    assert parse('{"P00001":"x","p00001":3}') == []  # a winner without a number hides the other
    assert parse('{"P00001":1,"P00001":5}') == [("P00001", 5.0)]  # equal keys: the later one


def test_line_modes(spark):
    good, other = '{"id":"d1","t":1,"s":1,"p":{"P00001":1}}', '{"id":"d2","t":2,"s":1,"p":{}}'
    bad = ["{", '{"id":"d","t":"x","s":1,"p":{}}', '{"id":"d","t":1,"s":1,"p":[1]}', '{"id":"d","t":1,"s":1}']
    assert packets.parse_packet_lines(lines(spark, good, "", "  ", other)).count() == 2
    for line in bad:
        with pytest.raises(PySparkException):
            packets.parse_packet_lines(lines(spark, good, line)).collect()
    skipped = packets.parse_packet_lines(lines(spark, good, other, *bad), mode="skip")
    assert sorted(r["device_id"] for r in skipped.collect()) == ["d1", "d2"]
    assert [r["skipped"] for r in skipped.orderBy("device_id").collect()] == [False, True]
    lenient = packets.parse_packet_lines(lines(spark, '{"s":1,"p":{"P00001":1}}', "{"), mode="lenient")
    assert [tuple(r) for r in lenient.select("device_id", "ts_ms").collect()] == [("unknown", 0)]
    with pytest.raises(ValueError):
        packets.parse_packet_lines(lines(spark, good), mode="other")


def test_seconds_become_milliseconds(spark):
    got = packets.parse_packet_lines(lines(spark, '{"id":"d","t":1777050000,"s":1,"p":{}}'), ts_unit="s")
    assert got.first()["ts_ms"] == 1777050000000


def test_infinite_numbers_are_dropped(spark):
    got = packets.parse_packet_lines(lines(spark, '{"id":"d","t":1,"s":1,"p":{"P00001":1e999,"P00002":1}}'), mode="skip")
    assert all(math.isfinite(v) for row in points_of(got) for _, v in row)


def test_ingest_batches_skip_a_cut_line(spark, tmp_path):
    whole = {"device_id": "d1", "recv_ts": 9, "points": [{"ts": 1, "param_id": "P00001", "value": 1.5}, {"ts": 2, "param_id": "P00002", "value": 2}]}
    (tmp_path / "a.log").write_text(json.dumps(whole) + "\n")
    (tmp_path / "b.log").write_text(json.dumps(whole) + "\n" + json.dumps(whole)[:50])
    got = packets.read_ingest_batches(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted([("d1", 9, 1, "P00001", 1.5), ("d1", 9, 2, "P00002", 2.0)] * 2)


def test_published_packets(spark):
    messages = lines(
        spark,
        '{"device_id":"d1","ts_ms":5,"points":[{"id":"P00001","value":1},{"id":"P00002"}]}',
        '{"device_id":"d1","ts_ms":6,"points":[]}',
        '{"device_id":"d1","points":[{"id":"P00001","value":1}]}',
        "not json",
    )
    got = packets.parse_published(messages)
    assert points_of(got) == [[("P00001", 1.0)]]
    assert got.first()["recv_ts"] == 5


def test_flat_payloads(spark):
    rows = [("d", 1, '{"P00001":1.5,"z00001":2,"note":"x"}'), ("d", 2, "[1]"), ("d", 3, "{}"), ("d", 4, "\x00"), ("d", 5, '{"k":1}')]
    messages = spark.createDataFrame(rows, "device_id string, ts_ms bigint, payload string")
    assert points_of(packets.flat_packets(messages)) == [[("P00001", 1.5), ("Z00001", 2.0)]]
    assert points_of(packets.flat_packets(messages, strict_case=True)) == [[("P00001", 1.5)]]


def write_long(path, ts, params, values):
    path.parent.mkdir(parents=True, exist_ok=True)
    table = pa.table({"ts": pa.array(ts, pa.uint64()), "param_id": pa.array(params, pa.string()), "value": pa.array(values, pa.float32())})
    pq.write_table(table, path)


def test_foreign_long_rows_with_unsigned_times(spark, tmp_path):
    write_long(tmp_path / "dev1" / "2024-01-01" / "00" / "seg_000001.parquet", [1704067200, 1704067201], ["P00001", "P00002"], [1.5, 2.5])
    write_long(tmp_path / "dev2" / "2024-01-01" / "01" / "seg_000001.parquet", [1704070800], ["P00001"], [3.5])
    write_long(tmp_path / "dev2" / "2024-01-01" / "01" / "seg_000002.parquet", [], [], [])
    (tmp_path / "dev1" / "2024-01-01" / "00" / "manifest.jsonl").write_text("{}\n")
    (tmp_path / "_meta").mkdir()
    (tmp_path / "_meta" / "storage.toml").write_text("mode = 'long_row'\n")
    rows = segments.foreign_long_rows(spark, str(tmp_path), ts_unit="s")
    assert sorted(tuple(r)[:4] for r in rows.collect()) == [
        ("dev1", 1704067200000, "P00001", 1.5),
        ("dev1", 1704067201000, "P00002", 2.5),
        ("dev2", 1704070800000, "P00001", 3.5),
    ]
    part = segments.foreign_long_rows(spark, str(tmp_path), "s", from_ms=1704067200001, to_ms=1704070800999)
    assert sorted(r["ts_ms"] for r in part.collect()) == [1704067201000, 1704070800000]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan


def test_foreign_packets_drop_unequal_lists(spark, tmp_path):
    path = tmp_path / "dev1" / "2024-01-01" / "00" / "seg_000001.parquet"
    path.parent.mkdir(parents=True)
    table = pa.table(
        {
            "ts": pa.array([1, 2, 3], pa.uint64()),
            "param_ids": pa.array([["P00001", "P00002"], ["P00001"], []], pa.list_(pa.string())),
            "values": pa.array([[1.0, None], [1.0, 2.0], []], pa.list_(pa.float32())),
        }
    )
    pq.write_table(table, path)
    points = reshape.packets_to_points(segments.foreign_packets(spark, str(tmp_path)))
    assert sorted(map(tuple, points.collect()), key=repr) == [("dev1", 1, "P00001", 1.0), ("dev1", 1, "P00002", None)]
    assert filters.matched_lists(segments.foreign_packets(spark, str(tmp_path))).count() == 2


def test_stored_row_positions(spark, tmp_path):
    write_long(tmp_path / "d" / "2024-01-01" / "00" / "s.parquet", [5, 6, 7], ["P00001"] * 3, [1, 2, 3])
    df = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = df.select(segments.stored_row().alias("row"), "ts", segments.stored_file().alias("file")).orderBy("ts").collect()
    assert [r["row"] for r in got] == [0, 1, 2]
    assert got[0]["file"].endswith("/s.parquet")


def test_raw_archive_rejects_other_types(spark, tmp_path):
    pq.write_table(pa.table({"schema_version": pa.array([1], pa.int16()), "device_id": ["d"], "timestamp_ms": pa.array(["x"]), "payload": pa.array([b"a"])}), tmp_path / "h00_p001.parquet")
    with pytest.raises(Exception):
        segments.read_raw_archive(spark, str(tmp_path)).select("timestamp_ms").collect()


def test_manifest_modes(spark, tmp_path):
    full = {"segment_file": "a.parquet", "min_ts": 1, "max_ts": 2, "rows": 3, "points": 4, "created_at_ms": 5, "mode": "long-row", "param_ids": ["P00001"]}
    old = {"segment_file": "b.parquet", "min_ts": 1, "max_ts": 2, "rows": 3, "created_at_ms": 5}
    hour = tmp_path / "d" / "2024-01-01" / "00"
    hour.mkdir(parents=True)
    (hour / "manifest.jsonl").write_text(json.dumps(full) + "\n\n" + json.dumps(old) + "\n")
    (hour / "other.jsonl").write_text("broken\n")
    got = catalogs.read_manifests(spark, str(tmp_path)).orderBy("segment_file").collect()
    assert [(r["segment_file"], r["points"], r["mode"], r["param_ids"]) for r in got] == [
        ("a.parquet", 4, "long_row", ["P00001"]),
        ("b.parquet", 0, "packet_wide", []),
    ]
    with (hour / "manifest.jsonl").open("a") as out:
        out.write('{"segment_file": "c"}\nbroken\n')
    with pytest.raises(PySparkException):
        catalogs.read_manifests(spark, str(tmp_path)).collect()
    lenient = catalogs.read_manifests(spark, str(tmp_path), strict=False)
    assert sorted(r["bad_line"] for r in lenient.collect()) == [False, False, True, True]


def test_archive_manifest(spark, tmp_path):
    entry = {"schema_version": 1, "device_id": "d", "file_name": "h00_p001.parquet", "day_key": "20240101", "hour": 0, "part": 1, "min_ts_ms": 1,
             "max_ts_ms": 2, "rows": 1, "payload_bytes": 1, "file_size_bytes": 1, "sealed": False, "created_at_ms": 1}
    (tmp_path / "manifest.jsonl").write_text(json.dumps(entry) + "\n" + json.dumps({**entry, "sealed": True, "rows": 0}) + "\n" + json.dumps({**entry, "sealed": True}) + "\n")
    read = catalogs.read_archive_manifests(spark, str(tmp_path))
    assert read.count() == 3
    assert filters.usable_segments(read).count() == 1


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("12345")
    (tmp_path / "a" / "y.log").write_text("123")
    inventory = catalogs.file_inventory(spark, str(tmp_path))
    assert sorted((r["file_name"], r["bytes"]) for r in inventory.collect()) == [("x.log", 5), ("y.log", 3)]
    totals = catalogs.directory_totals(inventory).first()
    assert (totals["files"], totals["bytes"]) == (2, 8)


def test_device_inventory(spark):
    devices = catalogs.device_inventory(spark, [("d1", "10.0.0.1", 9000)])
    assert tuple(devices.first()) == ("d1", "10.0.0.1", 9000)


def test_partition_keys_stay_text(spark, tmp_path):
    spark.range(1).selectExpr("1 AS v", "'05' AS hour", "'2024-01-01' AS day", "'007' AS device_id").write.partitionBy("device_id", "day", "hour").parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    try:
        inferred = segments.read_table(spark, str(tmp_path / "t")).first()
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    kept = segments.read_table(spark, str(tmp_path / "t")).first()
    assert (inferred["day"], inferred["hour"]) == (kept["day"], kept["hour"]) == ("2024-01-01", "05")
    assert kept["device_id"] == "007"


def test_repeated_keys_of_a_flat_payload(spark):
    rows = [("d", 1, '{"P00001":1,"P00001":2,"p00001":3}'), ("d", 2, "1"), ("d", 3, '"x"'), ("d", 4, "null"), ("d", 5, '{"P00001":1'), ("d", 6, None)]
    messages = spark.createDataFrame(rows, "device_id string, ts_ms bigint, payload string")
    assert points_of(packets.flat_packets(messages)) == [[("P00001", 2.0)]]


def opened(df):
    """Files a query opened, in a plan of its own, as metrics count one run."""
    df = df.select("*")
    df.collect()

    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        children = plan.children()
        kids = [children.apply(i) for i in range(children.size())]
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            kids = [plan.plan()]
        return [leaf for kid in kids for leaf in leaves(kid)] or [plan]

    scans = [n for n in leaves(df._jdf.queryExecution().executedPlan()) if n.metrics().contains("numFiles")]
    return sum(n.metrics().apply("numFiles").value() for n in scans)


def test_scans_open_only_files_of_the_range(spark, tmp_path):
    from pulseframe.functions.timeparts import TimeRange
    from pulseframe.plans import history
    from pulseframe.sinks import segments as sinks
    from pulseframe.sources import segments

    hour = 3_600_000
    points = spark.createDataFrame(
        [(d, t * hour, "P00001", float(t)) for d in ("d1", "d2") for t in range(0, 60, 10)],
        "device_id string, ts_ms long, param_id string, value double",
    )
    span = TimeRange(10 * hour, 10 * hour + 5)
    table, raw, sparse = (str(tmp_path / n) for n in ("points", "raw", "sparse"))
    sinks.write_long_rows(points, table)
    events = points.select("device_id", points["ts_ms"].alias("timestamp_ms"), points["param_id"].cast("binary").alias("payload"))
    sinks.write_raw_archive(events, raw)
    sinks.write_sparse(points, sparse, [1])

    # A tree with times of another type, and a file outside the day and hour directories.
    foreign = str(tmp_path / "foreign")
    unsigned = sinks.with_day_hour(points).selectExpr("device_id device", "day", "hour", "CAST(ts_ms AS DECIMAL(20,0)) ts", "param_id", "value")
    unsigned.write.partitionBy("device", "day", "hour").parquet(foreign)
    found = segments.foreign_long_rows(spark, foreign, "ms", span.from_ms, span.to_ms, "d1")
    assert [(r["device_id"], r["value"]) for r in found.collect()] == [("d1", 10.0)]
    assert opened(found) == 1
    unsigned.drop("device", "day", "hour").limit(2).coalesce(1).write.mode("append").parquet(foreign + "/loose")
    assert segments.foreign_long_rows(spark, foreign, "ms", span.from_ms, span.to_ms).count() >= 2

    assert opened(history.params_history(segments.read_table(spark, table), "d1", span)) == 1
    own = segments.read_table(spark, raw).where("device_id = 'd1'")
    assert opened(history.raw_history(own, "d1", span)) == 1
    wide = segments.read_table(spark, sparse)
    got = history.sparse_history(wide, wide.where("false"), "d1", 1, TimeRange(30 * hour, 30 * hour))
    assert [r["value"] for r in got.collect()] == [30.0] and opened(got) == 1
