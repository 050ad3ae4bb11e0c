"""Embedding whitening by spectrum slicing.

Entries become integers, so sums are exact whatever the order of the work: the fit list
(every distinct vector once) gives counts and sums, then products of entries less the
integer nearest to their mean.  Products are summed per batch as doubles only while they
fit 53 bits and as integers otherwise, so the covariance is the correctly rounded one.

Its leading eigenpairs are found one by one on the driver, from one matrix of dimensions
squared.  The signs in the LDL' factors of the matrix less a shift count the eigenvalues
below the shift; bisection on such counts isolates each leading eigenvalue.  Rayleigh
quotient iteration from inside the interval converges cubically, and the counts beside the
result certify its number.  Where the interval shrinks to rounding before it holds a single
eigenvalue, the vectors of the cluster are kept orthogonal and share their place.

Defined results: rows whose vector is null or holds a null or non-finite entry are left
out, and so are entries of 2^34 or more, whose squares leave the range of exact sums, and
vectors whose length isn't the most frequent one (the longer at a tie); directions without
variance, up to rounding, give no component; a deviation beyond a long is null; rows that
repeat stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import mapped_columns, matrix, table, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 34)
#: Doubles hold integers up to here exactly.
_EXACT = 1 << 53


# ---- eigenpairs


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below ``shift``, by LDL' factors.

    Diagonal pivoting with blocks of one and two keeps the factors bounded.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).tiny
    below = 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        if len(a) > 1:
            off = np.abs(a - np.diag(np.diag(a)))
            i, j = np.unravel_index(int(off.argmax()), off.shape)
            if diagonal[k] < alpha * off[i, j]:
                # A block of two: its eigenvalues have opposite signs.
                pair, rest = [i, j], np.setdiff1d(np.arange(len(a)), [i, j])
                block, side = a[np.ix_(pair, pair)], a[np.ix_(rest, pair)]
                determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
                below += 1 if determinant < 0 else 2 * (block[0, 0] + block[1, 1] < 0)
                inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / determinant
                a = a[np.ix_(rest, rest)] - side @ inverse @ side.T
                continue
        pivot = a[k, k] if diagonal[k] > tiny else tiny
        below += pivot < 0
        rest = np.delete(np.arange(len(a)), k)
        side = a[rest, k]
        a = a[np.ix_(rest, rest)] - np.outer(side, side) / pivot
    return below


def _rayleigh(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], rng) -> tuple[float, np.ndarray] | None:
    """An eigenpair by Rayleigh quotient iteration from the middle of an interval; None if it leaves it."""
    size = len(matrix)
    scale = np.abs(matrix).max() * size
    shift, vector = (low + high) / 2, rng.standard_normal(size)
    best = None
    for step in range(40):
        for other in found:
            vector = vector - (vector @ other) * other
        vector = vector / np.linalg.norm(vector)
        if step > 1:  # two steps of inverse iteration from the middle first
            shift = vector @ matrix @ vector
        residual = np.linalg.norm(matrix @ vector - (vector @ matrix @ vector) * vector)
        if best is not None and residual <= 8 * np.finfo(float).eps * scale and residual >= best / 2:
            break
        best = residual if best is None else min(best, residual)
        shifted = matrix - shift * np.eye(size)
        try:
            vector = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue itself
            vector = np.linalg.solve(shifted + np.finfo(float).eps * scale * np.eye(size), vector)
        if not np.isfinite(vector).all():
            return None
    value = float(vector @ matrix @ vector)
    edge = 64 * np.finfo(float).eps * scale
    return (value, vector) if low - edge <= value <= high + edge else None


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that are zero up to rounding are left out.
    """
    size = len(matrix)
    if not size or not np.abs(matrix).max():
        return np.zeros(0), np.zeros((size, 0))
    radius = np.abs(matrix).sum(axis=1).max()
    floor = size * np.finfo(float).eps * radius
    rng = np.random.default_rng(size)
    # below[s]: eigenvalues under s, for every shift counted so far.
    below = {-radius - floor: 0, radius + floor: size}

    def counted(shift: float) -> int:
        if shift not in below:
            below[shift] = inertia(matrix, shift)
        return below[shift]

    values, vectors = [], []
    for number in range(min(count, size)):
        rank = size - number  # among rising eigenvalues
        low = max(s for s, n in below.items() if n < rank)
        high = min(s for s, n in below.items() if n >= rank)
        got = None
        while True:
            alone = counted(high) - counted(low) == 1
            narrow = high - low <= 4 * floor
            if alone or narrow:
                got = _rayleigh(matrix, low, high, vectors, rng)
                if got is not None or narrow:
                    break
            middle = (low + high) / 2
            low, high = (low, middle) if counted(middle) >= rank else (middle, high)
        if got is None:  # a cluster within rounding: any direction that is left in it
            got = _inverse(matrix, (low + high) / 2, vectors, rng)
        value, vector = got
        if value <= floor:
            break
        # Certificate: exactly the larger ones lie above, up to rounding.
        edge = 64 * floor
        if not inertia(matrix, value - edge) < rank <= inertia(matrix, value + edge):
            raise ArithmeticError(f"eigenvalue {number + 1} is not certified")
        values.append(value)
        vectors.append(vector)
    if not values:
        return np.zeros(0), np.zeros((size, 0))
    return np.array(values), np.array(vectors).T


def _inverse(matrix: np.ndarray, shift: float, found: list[np.ndarray], rng) -> tuple[float, np.ndarray]:
    """An eigenpair of a cluster at ``shift``, orthogonal to what was found."""
    size = len(matrix)
    eps = np.finfo(float).eps * np.abs(matrix).max() * size
    vector = rng.standard_normal(size)
    for _ in range(6):
        for other in found * 2:
            vector = vector - (vector @ other) * other
        vector = vector / np.linalg.norm(vector)
        vector = np.linalg.solve(matrix - (shift + eps) * np.eye(size), vector)
    for other in found * 2:
        vector = vector - (vector @ other) * other
    vector = vector / np.linalg.norm(vector)
    return float(vector @ matrix @ vector), vector


# ---- sums over the table


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the integers of the vector; rows that take no part are left out."""
    own = rows.select(rows[id_col].alias("vec_id"), rows[vector_col].cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    own = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & fits)
    lengths = own.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    # One number; without rows there is nothing to compare it with.
    own = own.where(F.size("v") == (size["size"] if size else 0))
    return own.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Every distinct ``x`` once."""
    return rows.select("x").distinct()


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    each = fit.select(F.posexplode("x").alias("d", "x"))
    rows = each.groupBy("d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = rows.orderBy("d").collect()  # one row per dimension
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact products of integer columns."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < _EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the fit list, divisor n, rounded once."""
    size = len(total)
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(size)

    def products(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        gram = np.zeros((size, size), object)
        for batch in batches:
            if len(batch["x"]):
                gram = gram + _gram(matrix(batch["x"]) - middle)
        # A row per entry and task, so that the sum over tasks is spread out too.
        yield {"i": upper[0].tolist(), "j": upper[1].tolist(), "s": [str(v) for v in gram[upper]]}

    rows = mapped_columns(fit.select("x"), "i int, j int, s string", products)
    rows = rows.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    # What the integer middle leaves of each mean, times n.
    left = [s - n * int(m) for s, m in zip(total, middle)]
    out = np.zeros((size, size))
    for r in rows:
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["s"]) - left[i] * left[j]) / (n * n)
    return out


class Whitening:
    """What a fit gives: n, sums, eigenvalues, their vectors and the trace."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.total, self.values, self.vectors, self.trace = n, total, values, vectors, trace
        self.middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
        self.left = np.array([(s - n * int(m)) / n for s, m in zip(total, self.middle)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers as whitened components."""
        return ((x - self.middle) - self.left) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        left = [s - self.n * int(m) for s, m in zip(self.total, self.middle)]
        y = x - self.middle
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * max(len(left), 1) < 1 << 63:
            z = self.n * y - np.array(left, np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - np.array(left, object)
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors ``x``; None without vectors."""
    n, total = sums(vectors)
    if not n:
        return None
    spread = covariance(vectors, n, total)
    values, directions = leading(spread, components)
    return Whitening(n, total, values, directions, float(np.trace(spread)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(model.values)

    def products(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        gram, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch["x"]):
                w = model.whitened(matrix(batch["x"]))
                gram, mean = gram + w.T @ w, mean + w.sum(axis=0)
        entries = [(i, j, gram[i, j]) for i in range(k) for j in range(i, k)] + [(i, -1, mean[i]) for i in range(k)]
        yield {name: [e[c] for e in entries] for c, name in enumerate("ijs")}

    rows = mapped_columns(vectors.select("x"), "i int, j int, s double", products)
    found = {(r["i"], r["j"]): r["s"] / model.n for r in rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    off = (
        abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(i, k)
    )
    return float(max(off, default=0.0))


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, the exact ``deviation`` and the list ``whitened`` of each row of ``usable``."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            if len(batch["x"]):
                x = matrix(batch["x"])
                yield {
                    "vec_id": batch["vec_id"],
                    "deviation": model.deviations(x),
                    "whitened": list(model.whitened(x)),
                }

    return mapped_columns(rows.select("vec_id", "x"), f"vec_id {kind}, deviation long, whitened array<double>", run)


def _constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    distinct = written(fit_list(rows), "fit")
    model = fit(distinct)
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 1.0)
        error = 0.0
    else:
        error = identity_error(distinct, model)
    each = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = _constant((model.values / model.trace).tolist() if len(model.values) else [])
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
