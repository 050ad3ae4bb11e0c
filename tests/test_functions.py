from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulseframe.functions import codes, naming, text, timeparts, topics
from pulseframe.functions.timeparts import TimeRange, resolve_range
from pulseframe.operators import filters


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def texts(spark, function, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


def test_param_codes(spark):
    given = ["P00001", "A12345", "Z99999", "p00001", "B00001", "P0001", "P000001", "P0000x", "P00001\n", ""]
    assert texts(spark, codes.is_param_code, *given) == [True] * 3 + [False] * 7
    assert texts(spark, codes.normalise_param, " \tp00001\n") == ["P00001"]


def test_expand_specs(spark):
    expand = lambda *specs: one(spark, codes.expand_specs(F.array(*[F.lit(s) for s in specs])))
    assert expand("A00001~A00003", "z00001", " ") == ["A00001", "A00002", "A00003", "Z00001"]
    assert expand(" a00009 ~ A00009 ") == ["A00009"]
    for bad in ("A00002~Z00003", "A00003~A00001", "X00001", "A1~A2", "A00001~", "A00001~A00002~A00003"):
        with pytest.raises(PySparkException):
            expand(bad)


def test_expand_specs_lenient(spark):
    expand = lambda t: one(spark, codes.expand_specs_lenient(F.lit(t)))
    assert expand("P1~P3, p00001 ,Q~, _X9~_X11,P5~P2,P1") == ["P1", "P2", "P3", "P00001", "_X09", "_X10", "_X11"]
    assert expand("") == []
    assert expand("A1~B2,~A1,free text") == ["FREE TEXT"]


def test_specs_are_valid(spark):
    valid = lambda *specs: one(spark, codes.specs_are_valid(F.array(*[F.lit(s) for s in specs])))
    assert valid("P00001", "B00003~B00010")
    assert not valid(" ")
    assert not valid("P00001", "P00010~P00003")
    assert not valid("P00001~A00002")
    assert not valid("P0001")


def test_point_indexes(spark):
    assert texts(spark, codes.point_index, "P0001", "P0000", "P10000", "p0001", "X1", "P", "P1x") == [1, 0, 10000, None, None, None, None]
    assert texts(spark, codes.point_column_index, "point_0001", "0012", "point_0000", "point_10001", "x") == [1, 12, None, None, None]
    assert one(spark, codes.point_column_name(F.lit(7))) == "point_0007"
    assert one(spark, codes.point_column_name(F.lit(0))) is None


def test_calendar_parts_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    ts = 1777050000123  # 2026-04-24T17:00:00.123Z
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            c = F.lit(ts).cast("bigint")
            assert one(spark, timeparts.day_key(c)) == "2026-04-24"
            assert one(spark, timeparts.hour_of_day(c)) == 17
            assert one(spark, timeparts.day_key(c, "Asia/Shanghai", compact=True)) == "20260425"
            assert one(spark, timeparts.hour_text(c, "Asia/Shanghai")) == "01"
            assert one(spark, timeparts.hour_start(c)) == 1777050000000
            assert one(spark, timeparts.hour_start(c, "Asia/Kolkata")) == 1777050000000 - 1800000
            assert one(spark, timeparts.hour_start_from_text(F.lit("2026042501"), "Asia/Shanghai")) == 1777050000000
            assert one(spark, timeparts.ntz_millis(timeparts.local_time(c))) == ts
            assert one(spark, timeparts.ntz_millis(F.expr("timestamp_ntz'2024-07-01 00:00:00.5'"))) == 1719792000500
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_negative_times(spark):
    c = F.lit(-1).cast("bigint")
    assert one(spark, timeparts.floor_seconds(c)) == -1
    assert one(spark, timeparts.day_key(c)) == "1969-12-31"
    assert one(spark, timeparts.hour_of_day(c)) == 23


def test_day_bounds_across_clock_changes(spark):
    # New York: 2024-03-10 has 23 hours, 2024-11-03 has 25.
    for day, hours in (("20240310", 23), ("2024-11-03", 25), ("20240601", 24)):
        start, end = timeparts.day_bounds(day, "America/New_York")
        assert end - start + 1 == hours * 3600000
        assert one(spark, timeparts.day_start_ms(F.lit(day), "America/New_York")) == start
        assert one(spark, timeparts.day_end_ms(F.lit(day), "America/New_York")) == end
    for bad in ("2024-1-1", "20240230", "2024/01/01", "x"):
        assert one(spark, timeparts.day_start_ms(F.lit(bad))) is None
    with pytest.raises(ValueError):
        timeparts.day_bounds("2024/01/01")


def test_durations(spark):
    given = ["30m", "6h", "2d", "15S", "10x", "h", "", "-5m", "1.5h"]
    want = [1800000, 21600000, 172800000, 15000, None, None, None, None, None]
    assert texts(spark, timeparts.duration_millis, *given) == want
    assert timeparts.duration_ms("2D") == 172800000
    with pytest.raises(ValueError):
        timeparts.duration_ms("10x")


def test_hour_text_and_series(spark):
    assert texts(spark, timeparts.hour_start_from_text, "2024010100", "2024010124", "202401010", "2024013101x") == [1704067200000, None, None, None]
    series = timeparts.hour_series(F.lit(1704067200001).cast("bigint"), F.lit(1704074400000).cast("bigint"))
    assert one(spark, series) == [1704067200000, 1704070800000, 1704074400000]
    assert one(spark, timeparts.hour_series(F.lit(5).cast("bigint"), F.lit(4).cast("bigint"))) == []


def test_range_modes():
    now = 1706659200000
    assert resolve_range(from_ms=1, to_ms=2, day="20240101", last="1h", now_ms=now) == TimeRange(1, 2)
    assert resolve_range(day="20240101", today=True, now_ms=now) == TimeRange(1704067200000, 1704153599999)
    assert resolve_range(today=True, now_ms=now) == TimeRange(1706659200000, 1706745599999)
    assert resolve_range(last="1h", everything=True, now_ms=now) == TimeRange(now - 3600000, now)
    assert resolve_range(last="9d", now_ms=1000) == TimeRange(0, 1000)
    assert resolve_range(everything=True, now_ms=now) == TimeRange(0, now)
    with pytest.raises(ValueError):
        resolve_range(from_ms=2, to_ms=1)
    with pytest.raises(ValueError):
        resolve_range(from_ms=2, now_ms=now)


def test_range_split():
    below, above = TimeRange(10, 20).split(15)
    assert (below, above) == (TimeRange(10, 14), TimeRange(15, 20))
    below, above = TimeRange(10, 20).split(5)
    assert below.empty and above == TimeRange(10, 20)


def test_bytes_as_text(spark):
    data = F.unhex(F.lit("000f10ff"))
    assert one(spark, text.hex_lower(data)) == "000f10ff"
    sample = F.concat(F.encode(F.lit("ABC\n"), "UTF-8"), F.unhex(F.lit("FF")))
    assert one(spark, text.printable_ascii(sample)) == "ABC.."
    assert texts(spark, lambda c: text.hex_lower(text.hex_decode(c)), "00Ff", "0", "zz", "") == ["00ff", None, None, ""]
    assert one(spark, text.payload_preview(sample, 4)) == "ABC\\n...(truncated)"
    assert one(spark, text.payload_preview(sample, 5)) == "ABC\\n�"
    assert one(spark, text.payload_preview(sample, 0)) == ""


def test_fixed_decimals_round_the_exact_value(spark):
    given = [0.0625, 0.1875, 1.5, -0.0001, 2.0, 0.0005, 123456.789, 16777216.0, None]
    df = spark.createDataFrame([(v,) for v in given], "v float")
    exact = [None if r[0] is None else float(r[0]) for r in df.select(F.col("v").cast("double")).collect()]
    got = [tuple(r) for r in df.select(text.fixed_decimals(F.col("v"), 3), text.fixed_decimals(F.col("v"), 6)).collect()]
    assert got == [(None, None) if v is None else (f"{v:.3f}", f"{v:.6f}") for v in exact]
    assert texts(spark, text.export_number, 2.0, 2.5, -3.0, 0.12345, kind="float") == ["2", "2.500", "-3", "0.123"]


def test_large_numbers_keep_their_digits(spark):
    assert texts(spark, lambda c: text.fixed_decimals(c, 0), float(2**40), -float(2**52), kind="double") == [str(2**40), str(-(2**52))]
    assert math.isinf(float(texts(spark, lambda c: c.cast("string"), math.inf, kind="double")[0]))


def test_topics(spark):
    names = ["gw/dev1/p00001", "gw/dev1/Telemetry", "x/dev1/a", "gw/a/b/c", "gw/a", ""]
    assert texts(spark, topics.topic_device, *names) == ["dev1", "dev1", "", "a", "", ""]
    assert texts(spark, topics.topic_param, *names) == ["P00001", "", "", "", "", ""]
    wild = lambda f: texts(spark, lambda c: topics.topic_matches(c, f), *names)
    assert wild("gw/+/Telemetry") == [False, True, False, False, False, False]
    assert wild("gw/#") == [True, True, False, True, True, False]
    assert wild("#") == [True] * 6
    assert wild("gw/+") == [False, False, False, False, True, False]
    assert wild("gw/dev1.p00001") == [False] * 6


def test_message_kinds(spark):
    given = ['{"points":[]}', '{"points":1}', '{"a":1}', "[1]", '"a"', "3", "true", "null", "zz", '{"a":', ""]
    want = ["telemetry", "json", "json", "json", "string", "number", "boolean", "object"] + ["text/binary"] * 3
    assert texts(spark, topics.message_kind, *given) == want


def test_pick_value(spark):
    given = {
        '{"P00001":1.5}': "1.5",
        '{"p00001":"x"}': "x",
        '{"data":{"P00001":true}}': "true",
        '{"P00001":null,"data":{"P00001":2}}': "2",
        '{"points":[{"id":"A"},{"name":" p00001 ","val":7}]}': "7",
        '{"points":[{"id":"P00001"}]}': "-",
        '{"points":[{"point_id":null,"id":"P00001","value":null,"v":[1]}]}': "[1]",
        '{"points":"none"}': "-",
        "broken": "-",
    }
    assert texts(spark, lambda c: topics.pick_param_value(c, F.lit("p00001")), *given) == list(given.values())


def test_file_names(spark):
    names = ["h07_p012.parquet", "hour_12_part_001.parquet", "h1_p2.parquet.tmp", "hour_1_2_part_3.parquet", "x.parquet"]
    assert texts(spark, naming.archive_hour, *names) == [7, 12, None, None, None]
    assert texts(spark, naming.archive_part, *names) == [12, 1, None, None, None]
    assert one(spark, naming.archive_name(F.lit(7), F.lit(12))) == "h07_p012.parquet"
    assert texts(spark, naming.segment_sequence, "seg_000012.parquet", "seg_1777050000_0004.parquet", "seg_x.parquet", "seg_1.tmp") == [12, 4, None, None]
    path = F.lit("file:/r/device_id=d1/day=2024-01-01/hour=05/part-0.parquet")
    assert one(spark, F.struct(naming.path_device(path), naming.path_day(path), naming.path_hour(path))) == ("d1", "2024-01-01", "05")
    assert one(spark, naming.path_device(F.lit("x.parquet"))) is None


def test_hour_directories(spark, rows):
    dirs = [("2024-01-01", "00"), ("2024-01-01", "5"), ("2024-01-01", "24"), ("2024-01-01", "x"), ("2024-02-30", "01"), ("20240101", "01"), ("_meta", "01")]
    df = spark.createDataFrame(dirs, "day string, hour string")
    span = TimeRange(1704067200000 + 3599999, 1704067200000 + 5 * 3600000)
    keep = lambda s, tz="UTC": rows(df.where(filters.hour_overlaps(F.col("day"), F.col("hour"), s, tz)))
    assert keep(span) == [("2024-01-01", "00"), ("2024-01-01", "5")]
    assert keep(TimeRange(span.from_ms + 1, span.to_ms)) == [("2024-01-01", "5")]
    assert keep(TimeRange(span.from_ms, span.to_ms - 1)) == [("2024-01-01", "00")]
    assert keep(span, "Asia/Shanghai") == []
    assert keep(TimeRange(5, 4)) == []
