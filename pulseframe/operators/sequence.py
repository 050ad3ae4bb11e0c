"""Order-dependent work on groups of any size, as one lazy plan.

A window over ``partitionBy(key)`` sorts a whole key inside one task, which a hot
key does not survive.  Here the first order column, a time or a row number, is cut
into blocks of fixed width, so the block of a row depends on the row alone: it is the
same in every scan and after every lost task, and nothing has to be kept on disk.
Windows run per ``(key, block)``.  What crosses block borders is found from one
summary row per block (with a partial step before its shuffle) and joined back to the
rows, which are already placed by block.

A block is one task's work at most and a key's blocks are summed up in one window, so
``width`` should hold at most some millions of rows of a key, and a key should span at
most some millions of blocks.  ``order`` should end in a tie-break: rows equal in it
are numbered in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.functions.timeparts import MINUTE_MS, floor_div

_AT, _BLOCK = "_at", "_block"

#: Blocks of a millisecond time, and of a row number.
TIME_WIDTH = 5 * MINUTE_MS
ROW_WIDTH = 1 << 20


def total_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    """``order`` and all other columns that can be ordered: only equal rows are left to tie."""

    def sortable(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return sortable(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(sortable(f.dataType) for f in kind)
        return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))

    return [*order, *[f.name for f in df.schema if f.name not in order and sortable(f.dataType)]]


class _Blocks:
    """Rows with their key and block as one column, and summaries of the blocks."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int):
        self.columns, self.keys = df.columns, list(keys)
        block = floor_div(F.col(order[0]), width).cast("bigint").alias(_BLOCK)
        # A struct is never NULL and equals itself with NULL inside, so plain equality joins it.
        self.rows = df.withColumn(_AT, F.struct(*self.keys, block))
        self.order = F.struct(*order)
        self.window = Window.partitionBy(_AT).orderBy(*order)

    def summary(self, **values: Column) -> DataFrame:
        """One row per block."""
        return self.rows.groupBy(_AT).agg(*[value.alias(name) for name, value in values.items()])

    def first(self, value: Column) -> Column:
        return F.min_by(F.struct(value.alias("v")), self.order)

    def last(self, value: Column) -> Column:
        return F.max_by(F.struct(value.alias("v")), self.order)

    def across(self):
        """Window over the blocks of a key."""
        own = [F.col(_AT)[k] for k in self.keys] or [F.lit(0)]
        return Window.partitionBy(*own).orderBy(F.col(_AT)[_BLOCK])

    def attach(self, carried: DataFrame, column: str) -> DataFrame:
        """Rows with what is carried into their block."""
        other = carried.where(F.col(column).isNotNull()).select(F.col(_AT).alias("_of"), column)
        return self.rows.join(other, F.col(_AT) == F.col("_of"), "left")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = TIME_WIDTH
) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to each row."""
    blocks = _Blocks(df, keys, order, width)
    earlier = blocks.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.summary(_total=F.sum(value)).withColumn("_carried", F.sum("_total").over(earlier))
    so_far = blocks.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks.rows = blocks.rows.withColumn("_local", F.sum(value).over(so_far))
    rows = blocks.attach(carried, "_carried")
    return rows.select(*blocks.columns, (F.col("_local") + F.coalesce("_carried", F.lit(0))).alias(name))


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, width: int = TIME_WIDTH
) -> DataFrame:
    """Row number from 1 within the key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, width)


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int = TIME_WIDTH
) -> DataFrame:
    """``value`` of the next row within the key, NULL on the last."""
    return _neighbour(df, keys, order, value, name, width, before=False)


def preceding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int = TIME_WIDTH
) -> DataFrame:
    """``value`` of the row before within the key, NULL on the first."""
    return _neighbour(df, keys, order, value, name, width, before=True)


def _neighbour(df, keys, order, value: str, name: str, width: int, before: bool) -> DataFrame:
    blocks = _Blocks(df, keys, order, width)
    here = F.col(value)
    beside, edge = (F.lag, blocks.last(here)) if before else (F.lead, blocks.first(here))
    carried = blocks.summary(_edge=edge).withColumn("_carried", beside("_edge").over(blocks.across()))
    blocks.rows = blocks.rows.withColumn("_local", beside(F.struct(here.alias("v"))).over(blocks.window))
    rows = blocks.attach(carried, "_carried")
    return rows.select(*blocks.columns, F.coalesce("_local", "_carried")["v"].alias(name))


def latest_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, width: int = TIME_WIDTH
) -> DataFrame:
    """The last ``value`` that is not NULL up to each row, the row itself included."""
    blocks = _Blocks(df, keys, order, width)
    known = F.when(value.isNotNull(), F.struct(value.alias("v")))
    last = F.max_by(known, F.when(value.isNotNull(), blocks.order))
    earlier = blocks.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.summary(_last=last).withColumn("_carried", F.last_value("_last", True).over(earlier))
    so_far = blocks.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks.rows = blocks.rows.withColumn("_local", F.last_value(known, True).over(so_far))
    rows = blocks.attach(carried, "_carried")
    return rows.select(*blocks.columns, F.coalesce("_local", "_carried")["v"].alias(name))


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    continues: Callable[[Column, Column], Column],
    name: str,
    width: int = TIME_WIDTH,
) -> DataFrame:
    """Number the stretches of neighbouring rows, from 1 within the key.

    ``continues(before, value)`` tells whether a row belongs to the stretch of the
    row before.  Per block the first row opens a stretch; where it continues one
    of the block before, the numbers from there on are one too high.
    """
    blocks = _Blocks(df, keys, order, width)
    here = F.col(value)
    joined = F.coalesce(continues(F.lag(here).over(blocks.window), here), F.lit(False))
    so_far = blocks.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks.rows = blocks.rows.withColumn("_opens", F.when(joined, 0).otherwise(1).cast("bigint")).withColumn(
        "_local", F.sum("_opens").over(so_far)
    )
    ends = blocks.summary(_first=blocks.first(here), _last=blocks.last(here), _total=F.max("_local"))
    over = blocks.across()
    before = F.lag("_last").over(over)
    merged = F.coalesce(continues(before["v"], F.col("_first")["v"]), F.lit(False)).cast("bigint")
    earlier = F.sum("_total").over(over.rowsBetween(Window.unboundedPreceding, -1))
    until_here = F.sum("_merged").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = ends.withColumn("_merged", merged).withColumn("_carried", earlier - until_here)
    rows = blocks.attach(carried, "_carried")
    return rows.select(*blocks.columns, (F.col("_local") + F.coalesce("_carried", F.lit(0))).alias(name))
