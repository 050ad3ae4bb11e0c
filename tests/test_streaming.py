from __future__ import annotations

import json
from functools import reduce
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import latest
from pulseframe.session import scratch_path, shared_dir
from pulseframe.sources.segments import read_table
from pulseframe.streaming import ingest, live, presence

T0 = 1704067200000


def packet(device, ts, **values):
    return json.dumps({"id": device, "t": ts, "s": 1, "p": values}) + "\n"


def test_ingest_survives_a_restart(spark, tmp_path, rows):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()

    def run():
        stream = ingest.packet_line_stream(spark, str(source))
        ingest.ingest_packets(stream, table, state, interval=None).awaitTermination()
        return rows(read_table(spark, table), "device_id", "ts_ms", "param_id", "value", "day", "hour")

    (source / "a.jsonl").write_text(packet("d1", T0 + 3600000, P00001=1.5) + "broken\n")
    assert run() == [("d1", T0 + 3600000, "P00001", 1.5, "2024-01-01", "01")]
    # A point of an earlier hour arrives after the restart and lands in its own hour.
    (source / "b.jsonl").write_text(packet("d1", T0 - 1, P00001=2.5))
    after = run()
    assert after == [("d1", T0 - 1, "P00001", 2.5, "2023-12-31", "23"), ("d1", T0 + 3600000, "P00001", 1.5, "2024-01-01", "01")]
    assert run() == after


def test_restart_after_a_failed_batch_loses_nothing(spark, tmp_path, rows):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.jsonl").write_text(packet("d1", T0, P00001=1))
    stream = ingest.packet_line_stream(spark, str(source))
    failing = stream.withColumn("ts_ms", F.when(F.col("ts_ms") == T0, F.raise_error(F.lit("boom")).cast("bigint")))
    with pytest.raises(Exception):
        ingest.ingest_packets(failing, table, state, interval=None).awaitTermination()
    ingest.ingest_packets(ingest.packet_line_stream(spark, str(source)), table, state, interval=None).awaitTermination()
    assert rows(read_table(spark, table), "device_id", "ts_ms") == [("d1", T0)]


def test_view_keeps_the_newest_version(spark, tmp_path, rows):
    source, view, state = str(tmp_path / "in"), str(tmp_path / "view"), str(tmp_path / "state")
    schema = "device_id string, ts_ms bigint, param_id string, value double"

    def run(*points):
        spark.createDataFrame(list(points), schema).coalesce(1).write.mode("append").parquet(source)
        values = latest.current_values(spark.readStream.schema(schema).parquet(source))
        live.upsert_view(values, view, state, None).awaitTermination()
        return rows(live.latest_version(spark.read.parquet(view), ["device_id", "param_id"]))

    assert run(("d", 5, "P00001", 1.0), ("d", 5, "Z00001", 7.0)) == [("d", "P00001", 1.0, 5), ("d", "Z00001", 7.0, 5)]
    assert run(("d", 4, "P00001", 9.0)) == [("d", "P00001", 1.0, 5), ("d", "Z00001", 7.0, 5)]
    assert run(("d", 6, "P00001", 2.0)) == [("d", "P00001", 2.0, 6), ("d", "Z00001", 7.0, 5)]


def drain(spark, frames, build, tmp_path):
    """Feed the frames one after another; return everything the query wrote."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(frame.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_presence_across_batches(spark, tmp_path, rows):
    schema = "client_id string, ts_ms bigint, online boolean"

    def frame(*events):
        return spark.createDataFrame([(c, T0 + t, o) for c, t, o in events], schema)

    frames = [
        frame(("back", 0, False), ("gone", 0, False), ("command", 0, False), ("again", 0, False), ("same", 5, False), ("edge", 29000, False)),
        frame(("edge", 58999, True), ("back", 30000, True), ("command", 29999, None), ("again", 20000, False), ("tick", 31000, True)),
        frame(("tick", 45000, True), ("again", 49000, True)),
        frame(("tick", 60500, True)),
        frame(("tick", 62000, True)),
        frame(("tick", 10_000_000, True)),
        frame(("tick", 20_000_000, True)),
    ]
    spark.conf.set(presence.STATE_STORE_CONF, presence.ROCKSDB)
    got = drain(spark, frames, lambda s: presence.expired_client_stream(s, 30000, "1 second"), tmp_path)
    found = [(c, a - T0, b - T0) for c, a, b in rows(got)]
    assert found == [("gone", 0, 30000), ("same", 5, 30005)]
    batch = presence.expired_clients(reduce(DataFrame.unionByName, frames), T0 + 20_000_000)
    assert [(c, a - T0, b - T0) for c, a, b in rows(batch)] == found


def test_merged_rows_on_a_stream(spark, tmp_path, rows):
    schema = "device_id string, ts_ms bigint, param_id string, value double"
    updates = [("d", T0, "P00001", 1.0), ("d", T0 + 300, "P00001", 2.0), ("d", T0 + 400, "Z00001", 5.0), ("d", T0 + 701, "P00001", 3.0)]
    closing = [("x", T0 + 10_000_000, "P00001", 0.0)]
    frames = [spark.createDataFrame(part, schema) for part in (updates[:2], updates[2:], closing)]
    got = drain(spark, frames, lambda s: live.merged_row_stream(s, ["P00001", "Z00001"], 300, "10 seconds"), tmp_path)
    assert rows(got) == [("d", T0, T0 + 400, 2.0, 5.0), ("d", T0 + 701, T0 + 701, 3.0, None)]
    batch = latest.merged_rows(spark.createDataFrame(updates, schema)).select("label_ts", "ts_ms")
    assert rows(batch) == [(T0, T0 + 400), (T0 + 701, T0 + 701)]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())
    assert scratch_path(spark, "a").startswith(shared_dir(spark).rstrip("/"))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


@pytest.mark.parametrize("master", ["local[2]", "yarn"])
def test_only_a_local_master_may_use_its_own_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=Context(master))
    if master == "yarn":
        with pytest.raises(ValueError):
            shared_dir(session)
    else:
        assert shared_dir(session) == shared_dir(session) == session.sparkContext.folder


def test_a_large_day_is_split_and_small_ones_are_not(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    day = 86_400_000
    # Nine tenths of the rows are of one day.
    ts = F.when(F.col("id") % 10 < 9, T0 + F.col("id")).otherwise(T0 + day * (1 + F.col("id") % 7) + F.col("id"))
    points = spark.range(300_000).select(
        F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("device_id"),
        ts.alias("ts_ms"),
        F.lit("P00001").alias("param_id"),
        F.xxhash64("id").cast("double").alias("value"),
    )
    points.repartition(8).write.parquet(source)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "512k")
    try:
        stream = spark.readStream.schema(points.schema).parquet(source)
        ingest.ingest_points(stream, table, state, None, partition_by=("day",)).awaitTermination()
    finally:
        spark.conf.set(size, before)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "table").glob("day=*")}
    assert len(files) == 8
    assert files.pop("day=2024-01-01") >= 3
    assert set(files.values()) == {1}
    assert read_table(spark, table).count() == 300_000
