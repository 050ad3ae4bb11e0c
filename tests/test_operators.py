from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import HOUR_MS, TimeRange
from pulseframe.operators import aggregates, filters, joins, latest, ordering, quality, reshape, unions
from pulseframe.plans import freesql, history
from pulseframe.sources import catalogs

POINT = "device_id string, ts_ms bigint, param_id string, value double"
SUBS = "client_id string, device_id string, param_ids array<string>"
PACKET = "device_id string, ts_ms bigint, points array<struct<param_id:string,value:double>>"


def test_filters(spark, rows):
    df = spark.createDataFrame([("d", -1, "P00001", 1.0), ("d", 0, "p00001", float("nan")), ("d", 1, "A00001", float("inf")), ("d", 2, "P00002", None)], POINT)
    assert rows(filters.non_negative_times(df), "ts_ms") == [(0,), (1,), (2,)]
    assert rows(filters.finite_values(df), "ts_ms") == [(-1,)]
    assert rows(filters.valid_codes(df), "param_id") == [("A00001",), ("P00001",), ("P00002",)]
    assert rows(filters.of_params(df, ["p00001"]), "param_id") == [("P00001",)]
    assert rows(filters.of_params(df, ["p00001"], exact=True), "param_id") == [("p00001",)]
    assert filters.of_params(df, []).count() == 4
    assert rows(filters.in_range(df, TimeRange(0, 1)), "ts_ms") == [(0,), (1,)]
    many = filters.of_params(df, [f"P{i:05d}" for i in range(2000)])
    assert rows(many, "param_id") == [("P00001",), ("P00002",)]


def test_wide_tables(spark, rows):
    df = spark.createDataFrame([("d", 1, "P00001", 1.0), ("d", 1, "P00001", 3.0), ("d", 2, "P00002", 2.0), ("d", 3, "Z00001", 9.0)], POINT)
    wide = reshape.wide_by_params(df, ["p00001", "P00002", "P00009"]).orderBy("ts_ms").collect()
    assert [repr(tuple(r)) for r in wide] == ["(1, 3.0, nan, nan)", "(2, nan, 2.0, nan)"]
    found = reshape.wide_discovered(df).orderBy("ts_ms")
    assert found.columns == ["ts_ms", "P00001", "P00002", "Z00001"]
    assert [tuple(r) for r in found.collect()] == [(1, 3.0, None, None), (2, None, 2.0, None), (3, None, None, 9.0)]
    assert [tuple(r) for r in reshape.wide_text(found).collect()][0] == (1, "3.000000", "", "")
    with pytest.raises(ValueError):
        reshape.wide_discovered(df, limit=2)
    assert reshape.wide_discovered(df.limit(0)).count() == 0


def test_many_columns_give_the_same_table(spark, rows, monkeypatch):
    df = spark.createDataFrame([("d", t, f"P{p:05d}", float(t * p)) for t in range(5) for p in range(30) if (t + p) % 3], POINT)
    params = [f"P{p:05d}" for p in range(32)]
    few = reshape.wide_by_params(df, params)
    monkeypatch.setattr(reshape, "MAX_CONDITIONAL_COLUMNS", 4)
    many = reshape.wide_by_params(df, params)
    assert few.columns == many.columns
    assert repr(rows(few)) == repr(rows(many))


def test_live_table(spark, rows):
    df = spark.createDataFrame([("d", 1, "P00001", 1.5)], POINT)
    assert rows(reshape.live_table(df, ["A00001", "P00001"])) == [("d", 1, "-", "1.5")]


def test_fan_out(spark, rows):
    packets = spark.createDataFrame([("d1", 1, [("Z00001", 3.0), ("P00001", 1.0)]), ("d2", 1, [("P00001", 2.0)])], PACKET)
    subs = spark.createDataFrame([("c1", "d1", [" p00001", "P00001", "Z00001"]), ("c2", "d1", ["P00009"]), ("c3", "d2", []), ("c4", "d9", ["P00001"])], SUBS)
    got = joins.fan_out(packets, subs)
    assert rows(got.select("client_id", "device_id", F.col("points.param_id"))) == [("c1", "d1", ["P00001", "Z00001"])]


def test_hot_device_fans_out_whole(spark):
    packets = spark.range(20000).select(F.lit("hot").alias("device_id"), F.col("id").alias("ts_ms"), F.array(F.struct(F.lit("P00001").alias("param_id"), F.lit(1.0).alias("value"))).alias("points"))
    subs = spark.range(7).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("client_id"), F.lit("hot").alias("device_id"), F.array(F.lit("P00001")).alias("param_ids"))
    assert joins.fan_out(packets, subs).count() == 140000


def test_key_lookup(spark):
    now = spark.createDataFrame([("d1", "P00001", 1.0, 5)], "device_id string, param_id string, value double, ts_ms bigint")
    ask = lambda *params: spark.createDataFrame([("d1", list(params))], "device_id string, param_ids array<string>")
    got = joins.key_lookup(ask("z00001", " p00001"), now).orderBy("position").collect()
    assert [tuple(r) for r in got] == [("d1", 0, "Z00001", None, None), ("d1", 1, "P00001", 1.0, 5)]
    with pytest.raises(PySparkException):
        joins.key_lookup(ask("bad"), now).collect()
    assert joins.device_values(now, "d2").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    longest = [1, 30 * HOUR_MS, 5000 * HOUR_MS]

    def interval(width):
        start = rng.randrange(0, 6000 * HOUR_MS)
        return start, start + rng.randrange(width)

    asked = [(rng.choice(["hot", "d"]), i, *interval(rng.choice(longest))) for i in range(60)]
    asked += [("hot", 100, 0, 2**62), ("hot", 101, -5, -1), ("hot", 102, 10, 9), ("hot", 103, 7 * HOUR_MS, 8 * HOUR_MS)]
    stored = [(rng.choice(["hot", "hot", "d"]), f"s{i}", *interval(rng.choice(longest[:2]))) for i in range(150)]
    stored += [("hot", "edge", 8 * HOUR_MS, 8 * HOUR_MS)]
    want = sorted((a[1], s[1]) for a in asked for s in stored if a[0] == s[0] and a[2] <= a[3] and s[3] >= a[2] and s[2] <= a[3])
    a = spark.createDataFrame(asked, "device_id string, q bigint, from_ms bigint, to_ms bigint")
    s = spark.createDataFrame(stored, "device_id string, f string, min_ts bigint, max_ts bigint")
    got = joins.overlap_join(a, s)
    assert got.columns == ["device_id", "q", "from_ms", "to_ms", "f", "min_ts", "max_ts"]
    assert sorted((r["q"], r["f"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_device_status(spark):
    devices = catalogs.device_inventory(spark, [("d2", "10.0.0.2", 2), ("d1", "10.0.0.1", 1)])
    points = spark.createDataFrame([("d1", 5, "P00001", 1.0), ("d1", 7, "P00001", 1.0)], POINT)
    assert [tuple(r) for r in joins.device_status(devices, points).collect()] == [("d1", 7, "10.0.0.1:1"), ("d2", 0, "10.0.0.2:2")]


def test_live_selection(spark, rows):
    subs = spark.createDataFrame([("d1", ["P00001", "Z00001"])], "device_id string, param_ids array<string>")
    messages = spark.createDataFrame(
        [
            ("gw/d1/p00001", '{"value":"on"}', 1),
            ("gw/d1/p00001", "{}", 2),
            ("gw/d1/P00009", '{"value":1}', 3),
            ("gw/d1/telemetry", '{"points":[{"id":"Z00001","value":2}]}', 4),
            ("any", '{"device_id":"d1","P00001":1}', 5),
            ("gw/d2/P00001", '{"value":1}', 6),
            ("gw/d1/P00001", "broken", 7),
            ("gw/d1/P00001", "null", 8),
            ("gw/d1/P00001", "5", 9),
        ],
        "topic string, payload string, ts_ms bigint",
    )
    got = joins.select_live(messages, subs).select("ts_ms", F.explode("values"))
    assert rows(got) == [(1, "P00001", "on"), (2, "P00001", "-"), (4, "P00001", "-"), (4, "Z00001", "2"), (5, "P00001", "1"), (5, "Z00001", "-"), (9, "P00001", "-")]


def test_totals(spark):
    side = "device_id string, packets bigint, points bigint"
    a = spark.createDataFrame([("d1", 1, 2), ("d2", 1, 1)], side)
    b = spark.createDataFrame([("d1", 1, 3), ("d3", 1, 1)], side)
    got = {r["device_id"]: (r["packets_match"], r["points_match"]) for r in joins.compare_totals(a, b).collect()}
    assert got == {"d1": (True, False), "d2": (False, False), "d3": (False, False)}
    one = lambda **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} bigint" for n in k))
    source = one(packets=3, points=7)
    check = lambda mode, rows: quality.import_check(source, one(rows=rows, points=7), mode).first()["rows_match"]
    assert check("long-row", 7) and check("packet_wide", 3) and not check("long_row", 3)


def test_storage_stats(spark):
    cat = spark.createDataFrame(
        [
            ("d1", "m1", "a", 10, 0, "long_row", 100, 200),
            ("d1", "m1", "b", 0, 0, "long_row", 1, 999),
            ("d2", "m2", "c", 5, 0, "packet_wide", 150, 250),
            ("d2", "m2", "d", 5, 40, "packet_wide", 160, 240),
        ],
        "device_id string, manifest_path string, segment_file string, rows bigint, points bigint, mode string, min_ts bigint, max_ts bigint",
    )
    recounts = spark.createDataFrame([("m2", "c", 17)], "manifest_path string, segment_file string, recount bigint")
    assert tuple(aggregates.storage_stats(cat, recounts).first()) == (2, 2, 4, 20, 67, 100, 250)
    assert aggregates.storage_stats(cat).first()["points"] == 50


def test_recount_ignores_missing_lists(spark, rows):
    df = spark.createDataFrame([("f", [1.0, 2.0]), ("f", None), ("g", None)], "segment_file string, values array<float>")
    assert rows(aggregates.recount_points(df, ["segment_file"])) == [("f", 2), ("g", 0)]


def test_current_values(spark, rows):
    df = spark.createDataFrame([("d", 1, "p00001", 5.0), ("d", 2, " P00001", 1.0), ("d", 2, "P00001", 3.0), ("d", 9, " ", 1.0)], POINT)
    assert rows(latest.current_values(df)) == [("d", "P00001", 3.0, 2)]


def test_subscription_log(spark, rows):
    log = "client_id string, device_id string, op string, param_ids array<string>, seq bigint"
    changes = spark.createDataFrame(
        [("c1", "d", "set", ["P00001"], 1), ("c1", "d", "set", [" z00001", "Z00001", "A00001"], 3), ("c2", "d", "set", ["P00001"], 2), ("c2", "d", "del", None, 4)], log
    )
    state = latest.current_subscriptions(changes)
    assert rows(state) == [("c1", "d", ["A00001", "Z00001"])]
    for empty in ([], [" "], None):
        with pytest.raises(PySparkException):
            latest.current_subscriptions(spark.createDataFrame([("c", "d", "set", empty, 1)], log)).collect()
    gone = spark.createDataFrame([("c1",), ("c9",)], "client_id string")
    assert latest.without_clients(state, gone).count() == 0
    assert rows(latest.removed_counts(state, gone)) == [("c1", 1), ("c9", 0)]


def test_merge_rows_boundary(spark, rows):
    updates = spark.createDataFrame(
        [("d", 0, "P00001", 1.0), ("d", 300, "P00001", 2.0), ("d", 601, "P00001", 3.0), ("d", 700, "Z00001", 4.0), ("e", 100, "P00001", 9.0)], POINT
    )
    got = latest.merged_rows(updates).select("device_id", "row_number", "label_ts", "ts_ms", F.array_sort(F.map_entries("values")))
    assert [r[:4] for r in rows(got)] == [("d", 1, 0, 300), ("d", 2, 601, 700), ("e", 1, 100, 100)]
    assert [tuple(e) for e in rows(got)[0][4]] == [("P00001", 2.0)]


def test_segments(spark, rows):
    cat = "device_id string, day string, hour string, segment_file string, rows bigint, created_at_ms bigint"
    old = spark.createDataFrame([("d", "x", "00", "a", 1, 1), ("d", "x", "00", "b", 1, 1)], cat)
    new = spark.createDataFrame([("d", "x", "00", "a", 5, 2), ("d", "x", "00", "c", 7, 2)], cat)
    assert rows(latest.upsert_segments(old, new), "segment_file", "rows") == [("a", 5), ("b", 1), ("c", 7)]
    assert latest.unique_segments(old.unionByName(old)).count() == 2


def test_pages(spark):
    df = spark.range(100).select(F.col("id").alias("ts_ms"), F.lit("p").alias("param_id"))
    ids = lambda page: [r["ts_ms"] for r in page.collect()]
    assert ids(ordering.page(df, 5, 3)) == [5, 6, 7]
    assert ids(ordering.page(df, 0, 0)) == [0]
    assert len(ids(ordering.page(df))) == 100
    assert ids(ordering.page(df, 200)) == []


def test_unified_sides(spark, rows):
    cold = spark.createDataFrame([("d", t, "P00001", 0.0) for t in range(0, 10)], POINT)
    hot = spark.createDataFrame([("d", t, "P00001", 1.0) for t in range(3, 13)], POINT)
    got = rows(unions.unified(cold, hot, TimeRange(2, 11), 6), "ts_ms", "value", "source")
    assert got == sorted([(t, 0.0, "cold") for t in range(2, 6)] + [(t, 1.0, "hot") for t in range(6, 12)], key=repr)
    assert unions.unified(cold, hot, TimeRange(2, 4), 6).where("source = 'hot'").count() == 0
    result = history.unified_history(cold, hot, "d", TimeRange(2, 11), 6 + HOUR_MS, limit=3)
    assert [r["ts_ms"] for r in result.rows.collect()] == [2, 3, 4]
    assert rows(result.counts) == [("cold", 4), ("hot", 6)]


def test_raw_history(spark, rows):
    raw = spark.createDataFrame([("d", -5, bytearray(b"a")), ("d", 1, bytearray(b"A\n")), ("x", 99, bytearray(b"b"))], "device_id string, timestamp_ms bigint, payload binary")
    assert rows(history.raw_history(raw, "d", TimeRange(0, 50), "ascii")) == [(1, "d", 2, "A.")]
    assert rows(history.raw_history(raw, "d", TimeRange(0, 50))) == [(1, "d", 2, "")]
    with pytest.raises(PySparkException):
        history.raw_history(raw, "d", TimeRange(0, 100)).collect()


def test_paged_history_arguments(spark):
    empty = spark.createDataFrame([], "device_id string, segment_file string, min_ts bigint, max_ts bigint, rows bigint, param_ids array<string>")
    packets = spark.createDataFrame([], "device_id string, ts_ms bigint, segment_file string, param_ids array<string>, values array<double>")
    for device, param, span in ((" ", "P00001", TimeRange(0, 1)), ("d", "X", TimeRange(0, 1)), ("d", "P00001", TimeRange(2, 1))):
        with pytest.raises(ValueError):
            history.paged_history(empty, packets, device, param, span)
    assert history.paged_history(empty, packets, "d", "p00001", TimeRange(0, 1)).total.first()["total"] == 0


def test_free_sql(spark):
    df = spark.createDataFrame([("d", 1, "P00001", 1.0), ("d", 5, "P00001", 2.0)], POINT)
    assert freesql.run_template(spark, "SELECT count(*) AS n FROM {{table}} WHERE ts_ms >= {{from}}", df, TimeRange(2, 9)).first()["n"] == 1
    typed = freesql.run_typed(spark, "SELECT ts_ms AS ts, param_id, value FROM t WHERE param_id = :p", {"t": df}, {"p": "x' OR '1'='1"})
    assert typed.columns == ["ts_ms", "param_id", "value"] and typed.count() == 0
    with pytest.raises(ValueError):
        freesql.run_typed(spark, "SELECT param_id, value FROM t", {"t": df})
    result, profile = freesql.profiled(df, TimeRange(0, 9), 1)
    assert len(result.collect()) == 1
    assert (profile.rows_read, profile.rows_returned) == (2, 1)


def test_consistency_report_on_files(spark, tmp_path):
    def hour(name, manifest, *files):
        path = tmp_path / "d1" / "2024-01-01" / name
        path.mkdir(parents=True)
        for f in files:
            (path / f).write_text("x")
        if manifest is not None:
            (path / "manifest.jsonl").write_text(manifest)

    entry = '{"segment_file":"%s","min_ts":%d,"max_ts":%d,"rows":%d}\n'
    hour("00", entry % ("a.parquet", 1, 2, 3) + "\nbroken\n", "a.parquet")
    hour("01", None, "b.parquet")
    hour("02", entry % ("gone.parquet", 9, 2, 3) + entry % ("c.parquet", 9, 2, 0), "c.parquet")
    hour("07", None, "late.parquet")
    hour("xx", None, "no-hour.parquet")
    span = TimeRange(1704067200000, 1704067200000 + 3 * HOUR_MS)
    inventory, lines = catalogs.file_inventory(spark, str(tmp_path)), catalogs.manifest_lines(spark, str(tmp_path))
    report = quality.consistency_report(inventory, lines, span).first().asDict()
    assert report == {
        "hour_dirs": 3, "manifest_files": 2, "missing_manifest": 1, "manifest_entries": 3, "bad_manifest_lines": 1,
        "invalid_entries": 1, "missing_segment_files": 1, "issues": 4,
    }
    issues = quality.shown_issues(quality.consistency_issues(inventory, lines, span)).collect()
    assert [r["issue"] for r in issues] == [quality.BAD_LINE, quality.BAD_RANGE, quality.NO_MANIFEST, quality.NO_SEGMENT]


def test_unreadable_archive_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pulseframe.sources.segments import read_raw_archive

    day = tmp_path / "d1" / "20240101"
    day.mkdir(parents=True)

    def put(name, devices):
        n = len(devices)
        pq.write_table(pa.table({"schema_version": pa.array([1] * n, pa.int16()), "device_id": devices, "timestamp_ms": pa.array(range(n), pa.int64()), "payload": pa.array([b"x"] * n)}), day / name)

    put("h00_p001.parquet", ["d1", "d1"])
    put("h01_p001.parquet", ["d1", "d2"])
    (day / "h02_p001.parquet").write_text("not parquet")
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        raw = read_raw_archive(spark, str(tmp_path))
        inventory = catalogs.file_inventory(spark, str(tmp_path), "*.parquet")
        checked = quality.archive_check(raw, inventory)
        got = {r["file_path"].rsplit("/", 1)[1]: (r["readable"], r["records"], r["foreign_rows"], r["ok"]) for r in checked.collect()}
        assert got == {
            "h00_p001.parquet": (True, 2, 0, True), "h01_p001.parquet": (True, 2, 1, False), "h02_p001.parquet": (False, 0, 0, False),
        }
        assert tuple(quality.archive_summary(checked).first()) == (1, 2, 2)
    finally:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")


def test_upsert_keeps_entries_without_time(spark):
    from pulseframe.operators.latest import upsert_segments

    names = "device_id string, day string, hour string, segment_file string, rows long, created_at_ms long"
    old = spark.createDataFrame([("d", "1", "0", "a", 1, None), ("d", "1", "0", "b", 1, 5), ("d", "1", "0", "c", 1, 9)], names)
    new = spark.createDataFrame([("d", "1", "0", "b", 2, 5), ("d", "1", "0", "c", 2, None)], names)
    got = {(r["segment_file"], r["rows"]) for r in upsert_segments(old, new).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 1)}


def test_totals_of_nothing_are_zero(spark):
    from pulseframe.operators.aggregates import storage_stats

    catalog = spark.createDataFrame(
        [],
        "device_id string, manifest_path string, segment_file string, rows long, points long, mode string, "
        "min_ts long, max_ts long",
    )
    row = storage_stats(catalog).first()
    assert (row["devices"], row["manifests"], row["segments"], row["rows"], row["points"]) == (0, 0, 0, 0, 0)


def test_range_in_the_zone_of_the_table_and_before_the_epoch(spark, tmp_path):
    from pulseframe.functions.timeparts import TimeRange
    from pulseframe.operators.filters import partition_predicate
    from pulseframe.plans.history import params_history
    from pulseframe.sinks.segments import compact_long_rows, write_long_rows, write_raw_archive
    from pulseframe.sources.segments import read_table

    times = [-5_000, 5_000, 3_600_000 * 20, 3_600_000 * 30]
    points = spark.createDataFrame([("d", t, "P00001", 1.0) for t in times], "device_id string, ts_ms long, param_id string, value double")
    span = TimeRange(-10_000, 3_600_000 * 40)
    for zone in ("UTC", "Asia/Shanghai"):
        path = str(tmp_path / zone.replace("/", "-"))
        write_long_rows(points, path, tz=zone)
        compact_long_rows(spark, path, path + "-compact")
        for table in (path, path + "-compact"):
            assert params_history(read_table(spark, table), "d", span, tz=zone).count() == len(times)
    raw = points.select("device_id", points["ts_ms"].alias("timestamp_ms"), points["param_id"].cast("binary").alias("payload"))
    write_raw_archive(raw, str(tmp_path / "raw"))
    assert read_table(spark, str(tmp_path / "raw")).where(partition_predicate(span)).count() == len(times)


def test_damaged_and_empty_archive_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pulseframe.operators import aggregates
    from pulseframe.sources.segments import read_raw_archive

    day = tmp_path / "d1" / "20240101"
    day.mkdir(parents=True)

    def put(name, n, **options):
        payload = pa.array([bytes([i % 251]) * 40 for i in range(n)], pa.binary())
        table = {"schema_version": pa.array([1] * n, pa.int16()), "device_id": pa.array(["d1"] * n, pa.string()), "timestamp_ms": pa.array(range(n), pa.int64()), "payload": payload}
        pq.write_table(pa.table(table), day / name, compression="zstd", use_dictionary=False, **options)

    put("h00_p001.parquet", 3)
    put("h01_p001.parquet", 0)
    put("h02_p001.parquet", 20_000)
    path = day / "h02_p001.parquet"
    column = pq.ParquetFile(path).metadata.row_group(0).column(3)
    data = bytearray(path.read_bytes())
    start = column.data_page_offset
    data[start + 40 : start + 400] = b"\xff" * 360
    path.write_bytes(bytes(data))
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        raw = read_raw_archive(spark, str(tmp_path))
        inventory = catalogs.file_inventory(spark, str(tmp_path), "*.parquet")
        manifest = spark.createDataFrame([("h00_p001.parquet", 3), ("h01_p001.parquet", 0), ("h02_p001.parquet", 20_000)], "file_name string, rows long")
        checked = quality.archive_check(raw, inventory.join(manifest, "file_name"))
        got = {r["file_path"].rsplit("/", 1)[1][:3]: r["ok"] for r in checked.collect()}
        assert got == {"h00": True, "h01": True, "h02": False}
        assert tuple(quality.archive_summary(checked).first()) == (2, 3, 1)
        whole = inventory.where("file_name <> 'h02_p001.parquet'")
        rebuilt = aggregates.archive_catalog(raw, whole, created_at_ms=5)
        entries = [(r["device_id"], r["day_key"], r["hour"], r["rows"], r["min_ts_ms"], r["created_at_ms"]) for r in rebuilt.orderBy("hour").collect()]
        assert entries == [("d1", "20240101", 0, 3, 0, 5), ("d1", "20240101", 1, 0, 0, 5)]
        stranger = raw.withColumn("device_id", F.lit("other"))
        with pytest.raises(Exception, match="row of another device"):
            aggregates.archive_catalog(stranger, whole).collect()
    finally:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")


def test_fan_out_of_repeated_and_missing_parameters(spark, rows):
    packets = spark.createDataFrame(
        [("d1", 1, [("P2", 2.0), ("P1", 1.0), ("P2", 3.0), (None, 9.0)]), ("d1", 2, []), ("d1", 3, None), ("d1", 4, [("P3", 1.0)])],
        "device_id string, ts_ms long, points array<struct<param_id:string,value:double>>",
    )
    subs = spark.createDataFrame([("c", "d1", ["p2 ", "P2", "P9", None]), ("e", "d1", []), ("n", "d1", None)], "client_id string, device_id string, param_ids array<string>")
    got = [(r["client_id"], r["ts_ms"], [tuple(p) for p in r["points"]]) for r in joins.fan_out(packets, subs).collect()]
    assert got == [("c", 1, [("P2", 2.0), ("P2", 3.0)])]


def test_exports_and_pages_without_the_default_limits(spark, tmp_path):
    from pulseframe.operators import ordering
    from pulseframe.sinks import exports

    points = spark.range(6000).selectExpr("id AS ts_ms", "'P00001' AS param_id", "CAST(id AS DOUBLE) AS value")
    exports.write_points_csv(points, str(tmp_path / "all"), limit=None)
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == 6000
    assert exports.point_export(points).count() == 1000
    assert ordering.page(points, 0, 5500, largest=10_000).count() == 5500


def test_view_compaction(spark, rows, tmp_path):
    from pulseframe.streaming.live import compact_view, latest_version

    stored = spark.createDataFrame([("a", 0, 1.0), ("a", 2, None), ("b", 1, 5.0)], "k string, version long, value double")
    compact_view(stored, ["k"], str(tmp_path / "view"))
    small = spark.read.parquet(str(tmp_path / "view"))
    assert small.count() == 2
    later = spark.createDataFrame([("b", 3, 6.0)], "k string, version long, value double")
    assert rows(latest_version(small.unionByName(later), ["k"]), "k", "value") == [("a", None), ("b", 6.0)]


def test_time_order_is_the_same_in_one_task_and_in_many(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.range(5000).select(
        (F.col("id") * 7919 % 700).alias("ts_ms"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("param_id")
    ).repartition(6).write.parquet(path)
    points = spark.read.parquet(path)
    small, large = ordering.by_time(points), ordering.by_time(points, one_task_bytes=0)
    assert "rangepartitioning" not in small._jdf.queryExecution().toString()
    assert "rangepartitioning" in large._jdf.queryExecution().toString()
    assert small.collect() == large.collect() == sorted(points.collect())
    # Nothing is known of the size of rows from elsewhere.
    unknown = spark.createDataFrame(points.rdd, points.schema)
    assert "rangepartitioning" in ordering.by_time(unknown)._jdf.queryExecution().toString()
