"""Ordered chunks against brute force, with one key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import aggregates, latest, ordering, sequence
from pulseframe.streaming import presence


def sample(seed, hot=4000, keys=40, each=5):
    rng = random.Random(seed)
    names = ["hot"] * hot + [f"k{i}" for i in range(keys) for _ in range(each)] + [None] * 3
    rows = [(name, rng.randrange(0, 20000), i, rng.choice("abc")) for i, name in enumerate(names)]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def data(request, spark):
    rows = sample(request.param)
    return rows, spark.createDataFrame(rows, "k string, t bigint, id bigint, v string").repartition(8)


def ordered(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


WIDTH = 700


def test_hot_key_spans_blocks_without_a_job(spark, data):
    _, df = data
    spread = sequence._Blocks(df, ["k"], ["t", "id"], WIDTH).rows.where("k = 'hot'").select("_at").distinct().count()
    assert spread > 20
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "plans only")
    sequence.numbered(df, ["k"], ["t", "id"], "n", WIDTH)
    sequence.islands(df, ["k"], ["t", "id"], "t", lambda a, b: b - a <= 3, "i", WIDTH)
    latest.merged_rows(df.selectExpr("k AS device_id", "t AS ts_ms", "v AS param_id", "1.0D AS value"))
    aggregates.value_summary(df, "t", ["k"])
    ordering.page(df, 100_000, order=("t", "id"))
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbered(data):
    rows, df = data
    want = {r[2]: n for group in ordered(rows).values() for n, r in enumerate(group, 1)}
    got = sequence.numbered(df, ["k"], ["t", "id"], "n", WIDTH)
    assert got.columns == ["k", "t", "id", "v", "n"]
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_numbered_without_keys(data):
    rows, df = data
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r["id"]: r["n"] for r in sequence.numbered(df, [], ["t", "id"], "n", WIDTH).collect()} == want


def test_running_sum(data):
    rows, df = data
    want = {}
    for group in ordered(rows).values():
        total = 0
        for r in group:
            total += r[1]
            want[r[2]] = total
    assert {r["id"]: r["s"] for r in sequence.running_sum(df, ["k"], ["t", "id"], F.col("t"), "s", WIDTH).collect()} == want


def test_following(data):
    rows, df = data
    want = {}
    for group in ordered(rows).values():
        for r, after in zip(group, [*group[1:], None]):
            want[r[2]] = after[1] if after else None
    assert {r["id"]: r["n"] for r in sequence.following(df, ["k"], ["t", "id"], "t", "n", WIDTH).collect()} == want


def test_latest_known(data):
    rows, df = data
    want = {}
    for group in ordered(rows).values():
        known = None
        for r in group:
            known = r[1] if r[3] == "a" else known
            want[r[2]] = known
    value = F.when(F.col("v") == "a", F.col("t"))
    got = sequence.latest_known(df, ["k"], ["t", "id"], value, "n", WIDTH)
    assert {r["id"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("gap", [0, 3, 10, 100000])
def test_islands(data, gap):
    rows, df = data
    want = {}
    for group in ordered(rows).values():
        number, before = 0, None
        for r in group:
            number += 0 if before is not None and r[1] - before <= gap else 1
            before = r[1]
            want[r[2]] = number
    got = sequence.islands(df, ["k"], ["t", "id"], "t", lambda a, b: b - a <= gap, "i", WIDTH)
    assert {r["id"]: r["i"] for r in got.collect()} == want


def test_runs_of_one_hot_file(spark):
    rng = random.Random(3)
    names = [rng.choice(["P00001", "P00001", "P00002", None]) for _ in range(3000)] + ["P00003"] * 3000
    rows = [("f", i, p, i * 10) for i, p in enumerate(names)]
    want, run = [], None
    for _, i, p, ts in rows:
        if p is None:
            continue
        if run and run[0] == p:
            run = [p, run[1], i + 1, run[3], ts]
            want[-1] = tuple(run)
        else:
            run = [p, i, i + 1, ts, ts]
            want.append(tuple(run))
    df = spark.createDataFrame(rows, "file_path string, row_index bigint, param_id string, ts_ms bigint")
    got = latest.parameter_runs(df).select("param_id", "start_row", "end_row", "min_ts", "max_ts")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quantile_of_one_hot_group(spark):
    rng = random.Random(5)
    values = [rng.randrange(0, 500) / 4 for _ in range(5000)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("one", 7.0), ("two", 1.0), ("two", 2.0)], "k string, v double")
    got = {r["k"]: r for r in aggregates.value_summary(df, "v", ["k"]).collect()}
    ranked = sorted(values)
    assert got["hot"]["quantile_value"] == ranked[-(-5000 * 95 // 100) - 1]
    assert (got["hot"]["min_value"], got["hot"]["max_value"]) == (ranked[0], ranked[-1])
    assert abs(got["hot"]["avg_value"] - sum(values) / 5000) < 1e-9
    assert got["one"]["quantile_value"] == 7.0 and got["two"]["quantile_value"] == 2.0


def test_quantiles_of_many_shapes(spark):
    rng = random.Random(6)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(20_000)],
        "few": [float(rng.randrange(3)) for _ in range(9_000)],
        "ties": [1.0] * 9_499 + [2.0] * 501,
        "last": [float(k) for k in range(7)],
        "nan": [rng.random() for _ in range(900)] + [float("nan")] * 100,
        "only nan": [float("nan")] * 3,
        None: [5.0, float("inf"), float("-inf")],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("normal", None), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for q in (0.0, 0.01, 0.5, 0.95, 1.0):
        got = {r["k"]: r["quantile_value"] for r in aggregates.value_summary(df, "v", ["k"], q).collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            ranked = sorted(values, key=lambda v: (v != v, v))
            want = ranked[max(-(-round(len(values) * q * 100) // 100), 1) - 1]
            assert got[k] == want or (got[k] != got[k] and want != want), (k, q)
    flat = aggregates.value_summary(df.where("k = 'normal'"), "v").collect()
    assert flat[0]["quantile_value"] == sorted(groups["normal"])[18_999] and len(flat) == 1
    assert aggregates.value_summary(df.where("false"), "v").collect() == [(None, None, None, None)]


@pytest.mark.parametrize("width", [1, 37, 100_000])
def test_pages_of_any_depth(spark, width):
    rng = random.Random(width)
    rows = [(i, rng.choice([None, *range(0, 900)]), rng.choice("xyz")) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, ts_ms long, param_id string").repartition(5)
    ranked = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    for offset, limit in ((0, 10), (3, 1), (3210, 50), (3990, 50), (4000, 5), (9000, 5)):
        got = ordering.page(df, offset, limit, ("ts_ms", "param_id"), width=width).collect()
        assert [tuple(r) for r in got] == ranked[offset : offset + limit]
    assert ordering.page(df.where("false"), 0, 5).collect() == []
    with pytest.raises(ValueError):
        ordering.page(df, -1)


def test_top_per_key_with_a_hot_key(spark):
    df = spark.range(0, 30000, numPartitions=16).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("device_id"),
        (F.col("id") * 7919 % 30011).alias("ts_ms"),
    )
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1])
    want = sorted((k, t) for k, ts in groups.items() for t in sorted(ts, reverse=True)[:3])
    assert sorted(map(tuple, latest.recent_packets(df, 3).collect())) == want


def test_expired_clients_against_brute_force(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"c{rng.randrange(20)}", rng.randrange(0, 4000000), rng.choice([True, False, False, None])) for _ in range(3000)]
    rows = list({(c, t): (c, t, o) for c, t, o in rows}.values())
    until, grace, want = 4100000, 5000, []
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        for r, after in zip(group, [*group[1:], None]):
            if r[2] is False and (after[1] if after else until) > r[1] + grace:
                want.append((r[0], r[1], r[1] + grace))
    events = spark.createDataFrame(rows, "client_id string, ts_ms bigint, online boolean")
    assert sorted(map(tuple, presence.expired_clients(events, until, grace).collect())) == sorted(want)
