"""Atomic upserts, hourly sketches and overlap joins against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import HOUR_MS, TimeRange
from pulseframe.operators import sketches
from pulseframe.operators.overlap import overlap_join
from pulseframe.sinks.catalogstore import CatalogStore, CommitConflict, segment_schema


def entries(spark, *rows):
    """(device, day, segment, rows, created)"""
    full = [(d, day, "05", s, 1, 2, n, created) for d, day, s, n, created in rows]
    return spark.createDataFrame(full, segment_schema())


def held(df):
    return sorted((r["device_id"], r["day"], r["segment_file"], r["rows"]) for r in df.collect())


def test_upserts_are_versions(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path), segment_schema())
    assert store.versions() == [] and held(store.read()) == []
    first = store.upsert(entries(spark, ("a", "2024-01-01", "s1", 1, 5), ("a", "2024-01-02", "s2", 2, 5)))
    second = store.upsert(entries(spark, ("a", "2024-01-02", "s2", 20, 6), ("b", "2024-01-02", "s3", 3, 6), ("a", "2024-01-02", "s2", 9, 1)))
    assert (first, second) == (1, 2)
    assert held(store.read()) == [("a", "2024-01-01", "s1", 1), ("a", "2024-01-02", "s2", 20), ("b", "2024-01-02", "s3", 3)]
    assert held(store.read(1)) == [("a", "2024-01-01", "s1", 1), ("a", "2024-01-02", "s2", 2)]
    # The day that was not touched is where it was.
    assert store._days(1)["2024-01-01"] == store._days(2)["2024-01-01"]
    assert store._days(1)["2024-01-02"] != store._days(2)["2024-01-02"]
    assert store.upsert(entries(spark)) == 2
    before = held(store.read())
    store.expire(1)
    assert store.versions() == [2] and held(store.read()) == before


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path), segment_schema())
    store.upsert(entries(spark, ("a", "2024-01-01", "s1", 1, 5)))
    broken = entries(spark, ("a", "2024-01-01", "s1", 7, 9)).withColumn(
        "rows", F.when(F.col("rows") > 0, F.raise_error(F.lit("boom")).cast("bigint"))
    )
    with pytest.raises(Exception, match="boom"):
        store.upsert(broken)
    again = CatalogStore(spark, str(tmp_path), segment_schema())
    assert again.versions() == [1] and held(again.read()) == [("a", "2024-01-01", "s1", 1)]


def test_two_writers_of_one_version(spark, tmp_path):
    one, other = (CatalogStore(spark, str(tmp_path), segment_schema()) for _ in range(2))
    one.upsert(entries(spark, ("a", "2024-01-01", "s1", 1, 5)))
    stale = other._days(1)
    one.upsert(entries(spark, ("a", "2024-01-01", "s1", 2, 6)))
    with pytest.raises(CommitConflict):
        other._commit(2, stale)
    assert held(other.read()) == [("a", "2024-01-01", "s1", 2)]


def test_sketches_of_hours_unite(spark):
    rows = [("hot" if k % 3 else "cold", (k % 50) * HOUR_MS + k, f"d{k % 700}", f"P{k % 5}") for k in range(6000)]
    df = spark.createDataFrame(rows, "source string, ts_ms bigint, device_id string, param_id string")
    parts = [sketches.hourly_sketches(df.where(F.pmod("ts_ms", F.lit(2)) == k)) for k in range(2)]
    stored = sketches.united_sketches(*parts)
    assert stored.count() == 100
    exact = {s: len({d for x, _, d, _ in rows if x == s}) for s in ("hot", "cold")}
    for r in sketches.distinct_over(stored).collect():
        assert (r["hours"], r["params"]) == (50, 5) and r["points"] == sum(x[0] == r["source"] for x in rows)
        assert abs(r["devices"] - exact[r["source"]]) <= 0.08 * exact[r["source"]]
    day = {r["source"]: r["points"] for r in sketches.distinct_over(stored, TimeRange(0, 24 * HOUR_MS - 1)).collect()}
    assert day == {s: sum(x[0] == s and x[1] < 24 * HOUR_MS for x in rows) for s in ("hot", "cold")}


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join(spark, seed):
    rng = random.Random(seed)

    def span(longest):
        start = rng.randrange(-5 * HOUR_MS, 9000 * HOUR_MS)
        return start, start + rng.choice([0, 1, HOUR_MS - 1, HOUR_MS, rng.randrange(longest * HOUR_MS), -5])

    asked = [(f"d{rng.randrange(3)}", *span(9000), k) for k in range(60)] + [("d0", 0, 1 << 45, 60), ("d1", -9, -1, 61)]
    stored = [(f"d{rng.randrange(3)}", *span(rng.choice([2, 30, 700, 9000])), k) for k in range(300)]
    a = spark.createDataFrame(asked, "device_id string, from_ms bigint, to_ms bigint, q int")
    b = spark.createDataFrame(stored, "device_id string, min_ts bigint, max_ts bigint, s int")
    want = sorted((q, s) for d, f, t, q in asked for e, x, y, s in stored if d == e and f <= t and x <= y and y >= f and x <= t)
    got = overlap_join(a, b)
    assert sorted((r["q"], r["s"]) for r in got.collect()) == want
    assert set(got.columns) == {"device_id", "from_ms", "to_ms", "q", "min_ts", "max_ts", "s"}


def test_a_segment_is_four_rows_at_most(spark):
    from pulseframe.operators import overlap

    lengths = spark.createDataFrame([(k, k + n) for k in (0, 7, 127, 5000) for n in (0, 1, 8, 63, 500, 100_000)], "a bigint, b bigint")
    sizes = lengths.select(F.size(overlap._of_segment(F.col("a"), F.col("b"))).alias("n")).agg(F.max("n"), F.min("n")).first()
    assert sizes[0] <= 4 and sizes[1] >= 3
