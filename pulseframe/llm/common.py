"""Small helpers of the text operators: reading, Arrow batches, written intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from pulseframe.session import scratch_path

# Fixed value: what separates words, ``[\x20\x09-\x0D]``; bytes.split() splits at the same six.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, as ``doc_id`` and ``text``; a null text counts as empty.

    Operators work on these two columns, so other columns of any name never clash
    with what they add.
    """
    return docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def mapped(df: DataFrame, schema: str | StructType, fn: Callable[[dict[str, list]], dict[str, Any]]) -> DataFrame:
    """Apply ``fn`` to Arrow batches: lists by column in, lists (or arrays) by column out."""
    return mapped_batches(df, schema, lambda batches: map(fn, batches))


def mapped_batches(
    df: DataFrame,
    schema: str | StructType,
    fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, Any]]],
) -> DataFrame:
    """As ``mapped``, for functions that keep something from batch to batch of a task."""
    return mapped_columns(
        df, schema, lambda batches: fn({n: c.to_pylist() for n, c in batch.items()} for batch in batches)
    )


def mapped_columns(
    df: DataFrame,
    schema: str | StructType,
    fn: Callable[[Iterator[dict[str, pa.Array]]], Iterator[dict[str, Any]]],
) -> DataFrame:
    """As ``mapped_batches``, for functions that take Arrow columns, as ``matrix`` does."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches):
        # An empty partition gives no batch and so no rows.
        for out in fn({n: b.column(n) for n in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, without nulls, as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    Cuts the lineage: a lost executor costs its running tasks, not what led to them.
    The write starts at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_type(df: DataFrame) -> str:
    """The type of the key, in DDL."""
    return df.schema["doc_id"].dataType.simpleString()
