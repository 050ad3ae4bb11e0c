"""Row counts of Parquet files from their footers, broken files left out.

A scan without columns answers from footers alone: Spark reads no page and gives each
file as many rows as its footer names.  A file without rows shows nothing there, nor does
one whose footer cannot be read.  Files that small are opened whole, in tasks, to tell
these two apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest file that may be found to be empty: a footer without row data.
EMPTY_BYTES = 64 << 10

_COUNTED = "file_path string, rows bigint"


def _footer_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows the footer of each file names; files without a sound one give nothing."""
    for batch in batches:
        counted = []
        for path, content in zip(batch["file_path"], batch["content"], strict=True):
            try:
                counted.append((path, pq.ParquetFile(pa.BufferReader(content)).metadata.num_rows))
            except (pa.ArrowException, OSError):
                continue
        yield pd.DataFrame(counted, columns=["file_path", "rows"])


def footer_rows(
    spark: SparkSession, root: str, glob: str = "*.parquet", empty_bytes: int = EMPTY_BYTES
) -> DataFrame:
    """``file_path, rows`` of every file below a tree whose footer can be read.

    Joined to an inventory, this is what ``archive_check`` expects of each file: a file
    that breaks off half way has fewer rows than its footer names, an empty one has as
    many.  A file without rows of more than ``empty_bytes`` counts as broken.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    # The schema is given, so no file is opened for it; no column of it is read.
    counted = (
        spark.read.options(**options, ignoreCorruptFiles="true")
        .schema("_none int")
        .parquet(root)
        .groupBy(F.col("_metadata.file_path").alias("file_path"))
        .agg(F.count("*").alias("rows"))
    )
    # ``length`` is pushed down: the content of larger files is not read.
    small = (
        spark.read.options(**options)
        .format("binaryFile")
        .load(root)
        .where((F.col("length") <= empty_bytes) & (F.substring("content", -4, 4) == F.lit("PAR1").cast("binary")))
        .select(F.col("_metadata.file_path").alias("file_path"), "content")
    )
    empty = small.join(counted, "file_path", "left_anti").mapInPandas(_footer_counts, _COUNTED)
    return counted.unionByName(empty.where(F.col("rows") == 0))


def with_footer_rows(
    spark: SparkSession, inventory: DataFrame, root: str, glob: str = "*.parquet", empty_bytes: int = EMPTY_BYTES
) -> DataFrame:
    """An inventory with the ``rows`` each footer names, NULL where there is no sound footer."""
    footers = footer_rows(spark, root, glob, empty_bytes)
    return inventory.drop("rows").join(footers, "file_path", "left")
