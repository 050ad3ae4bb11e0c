"""Packing by optimal length buckets.

The histogram of piece lengths, one row per length and so at most ``max_len + 1`` rows,
goes to the driver.  Dynamic programming over it finds the bucket bounds with the least
padding.  Pieces are numbered inside their bucket, and a batch is a run of as many
pieces as the token budget holds at the bucket's bound.

The number of a piece is its number in a slice (a hash of the key) plus the rows of the
slices before, so no task holds a bucket and all batches but the last of a bucket are full.

Defined results: texts longer than ``max_len`` are cut into pieces of that length; an
empty or null text is one piece of length 0; equal rows are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import WORD, table, texts, written

MAX_LEN = 8192
TOKEN_BUDGET = 65536
BUCKETS = 16
#: Rows that one task numbers, about.
SLICE_ROWS = 100_000


def optimal_bounds(histogram: dict[int, int], count: int) -> list[int]:
    """At most ``count`` upper bounds of lengths that minimise ``sum(bound - length)``.

    With C and S the running sums of rows and of lengths, a bucket over the lengths
    after i up to j costs ``(C[j] - C[i]) * len[j] - (S[j] - S[i])``.  For a fixed j that
    is a line in ``len[j]`` for every i, so a lower hull of lines gives each layer in
    linear time.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    rows, total = [0], [0]
    for n in lengths:
        rows.append(rows[-1] + histogram[n])
        total.append(total[-1] + histogram[n] * n)
    best: list[int | None] = [0] + [None] * len(lengths)
    back: list[list[int]] = []
    for _ in range(min(count, len(lengths))):
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        layer: list[int | None] = [None] * (len(lengths) + 1)
        chosen = [0] * (len(lengths) + 1)
        head = 0
        for j in range(1, len(lengths) + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) - head >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while head + 1 < len(hull) and _at(hull[head + 1], x) <= _at(hull[head], x):
                head += 1
            if head < len(hull):
                layer[j] = _at(hull[head], x) + rows[j] * x - total[j]
                chosen[j] = hull[head][2]
        best, back = layer, [*back, chosen]
    bounds, j = [], len(lengths)
    for chosen in reversed(back):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = chosen[j]
    return bounds[::-1]


def _at(line: tuple[int, int, int], x: int) -> int:
    return line[0] * x + line[1]


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pieces(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Rows ``doc_id, n_tokens`` cut into ``doc_id, piece, offset, length``."""
    last = F.greatest(F.ceil(F.col("n_tokens") / max_len) - 1, F.lit(0)).cast("int")
    return (
        lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("offset", F.col("piece").cast("long") * max_len)
        .withColumn("length", F.least(F.col("n_tokens") - F.col("offset"), F.lit(max_len)).cast("int"))
        .select("doc_id", "piece", "offset", "length")
    )


def packed(
    lengths: DataFrame, max_len: int = MAX_LEN, budget: int = TOKEN_BUDGET, buckets: int = BUCKETS
) -> DataFrame:
    """Rows ``doc_id, n_tokens`` as pieces with bucket, bound, batch of the bucket and slot of the batch."""
    cut = written(pieces(lengths, max_len), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = optimal_bounds(histogram, buckets)
    slices = max(1, sum(histogram.values()) // SLICE_ROWS)
    which = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    # The bucket is the first bound that holds the piece.
    bucket = F.size(F.filter(which, lambda b: b < F.col("length")))
    placed = cut.withColumn("bucket", bucket).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(slices)).cast("int")
    )
    counts = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("bucket").alias("b"), F.col("slice").alias("s"), before.alias("start"))
    own = Window.partitionBy("bucket", "slice").orderBy(F.xxhash64("piece", "doc_id"), "doc_id", "piece")
    numbered = (
        placed.withColumn("row", F.row_number().over(own) - 1)
        .join(starts, (F.col("bucket") == F.col("b")) & (F.col("slice") == F.col("s")))
        .withColumn("row", F.col("row") + F.col("start"))
        .withColumn("bound", F.get(which, F.col("bucket")))
    )
    room = F.greatest(F.lit(budget) / F.greatest("bound", F.lit(1)), F.lit(1)).cast("long")
    return numbered.select(
        "doc_id",
        "piece",
        "offset",
        "length",
        "bucket",
        "bound",
        F.floor(F.col("row") / room).alias("batch"),
        F.pmod(F.col("row"), room).alias("slot"),
    )


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ``doc_id, n_tokens``, a token being a word."""
    return texts(docs, id_col, text_col).select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(word_lengths(table(spark, sf_dir, "documents")))
