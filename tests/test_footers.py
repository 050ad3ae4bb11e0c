from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pulseframe.operators import quality
from pulseframe.sources import catalogs, footers
from pulseframe.sources.segments import read_raw_archive


def archive_table(n, device="d1"):
    return pa.table(
        {
            "schema_version": pa.array([1] * n, pa.int16()),
            "device_id": pa.array([device] * n, pa.string()),
            "timestamp_ms": pa.array(range(n), pa.int64()),
            "payload": pa.array([bytes([i % 251]) * 40 for i in range(n)], pa.binary()),
        }
    )


@pytest.fixture
def archive(spark, tmp_path):
    """Whole, empty (two writers), half-readable, cut and foreign files."""
    day = tmp_path / "d1" / "20240101"
    day.mkdir(parents=True)

    def put(name, n, **options):
        pq.write_table(archive_table(n), day / name, compression="zstd", use_dictionary=False, **options)
        return day / name

    put("h00_p001.parquet", 3)
    put("h01_p001.parquet", 0)
    with pq.ParquetWriter(day / "h02_p001.parquet", archive_table(0).schema):
        pass
    broken = put("h03_p001.parquet", 20_000)
    data = bytearray(broken.read_bytes())
    start = pq.ParquetFile(broken).metadata.row_group(0).column(3).data_page_offset
    data[start + 40 : start + 400] = b"\xff" * 360
    broken.write_bytes(bytes(data))
    cut = put("h04_p001.parquet", 2_000)
    cut.write_bytes(cut.read_bytes()[:-20])
    (day / "h05_p001.parquet").write_text("not parquet")
    (day / "h06_p001.parquet").write_bytes(b"PAR1" + b"\xff" * 30 + b"\x10\x00\x00\x00PAR1")
    (day / "h07_p001.parquet").write_bytes(b"")
    put("h08_p001.parquet", 5_000, row_group_size=500)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "false")


def short(path):
    return path.rsplit("/", 1)[1][:3]


def test_footers_tell_empty_files_from_broken_ones(spark, archive):
    got = {short(r["file_path"]): r["rows"] for r in footers.footer_rows(spark, archive).collect()}
    assert got == {"h00": 3, "h01": 0, "h02": 0, "h03": 20_000, "h08": 5_000}


def test_archive_verdicts_without_a_manifest(spark, archive):
    inventory = footers.with_footer_rows(spark, catalogs.file_inventory(spark, archive, "*.parquet"), archive)
    checked = quality.archive_check(read_raw_archive(spark, archive), inventory)
    good = {short(r["file_path"]): r["readable"] for r in checked.collect()}
    # Scans do not list files of no bytes at all.
    assert good == {f"h0{i}": i in (0, 1, 2, 8) for i in range(9) if i != 7}
    assert tuple(quality.archive_summary(checked).first()) == (4, 5_003, 4)


def test_larger_files_without_rows_are_not_opened(spark, archive):
    got = {short(r["file_path"]) for r in footers.footer_rows(spark, archive, empty_bytes=10).collect()}
    assert got == {"h00", "h03", "h08"}


def test_counting_reads_no_column(spark, archive):
    plan = footers.footer_rows(spark, archive)._jdf.queryExecution().toString()
    assert "_none" not in plan.split("== Physical Plan ==")[1]


def test_a_tree_without_files(spark, tmp_path):
    assert footers.footer_rows(spark, str(tmp_path)).collect() == []
