"""Nearest neighbours by Euclidean distance over vantage-point trees, one per shard.

Distinct vectors are dealt into shards of about ``SHARD`` by a hash, so that copies, however
many, are one entry and shards are even.  A task builds the tree of its shard: a node keeps
a vantage point and, for the nearer and the farther half of its vectors, the smallest and
the largest distance to it.  A query's distance to the vantage point then bounds the
distance to each half from below (triangle inequality); a half is passed over when
``factor`` times the bound exceeds the radius of interest.  With factor one nothing is lost
and the search is exact; larger factors visit less and may miss neighbours.

Rows and queries of a shard come sorted, rows first; queries go down the tree in blocks, so
distances are matrix products, and a task holds one tree and one block.  What a product says is only used to pass over; distances that are
returned are sums of squared differences of the original vectors.  At most ``SAMPLE`` vectors
form a shard of their own that is searched with factor one.  The distance of a query's k-th
nearest there is its first radius elsewhere, so shards that hold nothing near return nothing,
and every query finds its k rows.

Defined results: a vector that is null, empty, zero or has null or non-finite components
takes no part, nor does one whose length differs from the most frequent length (the longer
at a tie); ties go to the smaller key, null keys last; a query leaves out its own row only:
rows that repeat its vector are its neighbours at distance 0, also where they repeat its
key; rows that repeat key and vector are one query; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import mapped_columns, matrix, table, written

NEIGHBOURS = 10
#: Vectors of a shard, of a leaf, and of the sample that bounds the first radius.
SHARD = 16_384
LEAF = 256
SAMPLE = 2_048
#: Queries that go down a tree together.
QUERIES = 512
#: Of the production query; recall and share of visited vectors are in the README.
FACTOR = 4.0
#: What rounding may add to or take from a distance squared, by the size of the vectors.
_SLACK = 1e-12


def _squares(points: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", points, points)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, up to rounding."""
    return np.sqrt(np.maximum(_squares(a)[:, None] + _squares(b) - 2 * (a @ b.T), 0))


def distances(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances as sums of squared differences."""
    return np.sqrt(((others - point) ** 2).sum(axis=1))


class Tree:
    """A vantage-point tree over the rows of a matrix, in arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        #: Per node: first and last row, vantage point, the bounds of both halves, first child.
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(len(points))
        todo = [(0, len(points))]
        at = 0
        while at < len(todo):
            low, high = todo[at]
            if high - low <= leaf:
                self.nodes.append((low, high, -1, None, 0))
            else:
                own = self.order[low:high]
                vantage = int(own[rng.integers(len(own))])
                far = distances(points[vantage], points[own])
                by = np.argsort(far, kind="stable")
                self.order[low:high], far = own[by], far[by]
                middle = (high - low) // 2
                bounds = (far[0], far[middle - 1], far[middle], far[-1])
                self.nodes.append((low, high, vantage, bounds, len(todo)))
                todo += [(low, low + middle), (low + middle, high)]
            at += 1

    def search(self, queries: np.ndarray, radius: np.ndarray, count: int, factor: float = 1.0):
        """Per query the rows that may be among its ``count`` nearest within ``radius``, and how many were visited.

        ``radius`` is narrowed on the way.
        """
        slack = np.sqrt(_SLACK * (_squares(self.points).max(initial=0) + _squares(queries).max(initial=0)))
        radius = radius + slack
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        visited = np.zeros(len(queries), np.int64)
        best = np.full((len(queries), count), np.inf)  # the nearest distances so far
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, who, bound = todo.pop()
            who = who[factor * bound <= radius[who]]  # the radius may have shrunk since
            if not len(who):
                continue
            low, high, vantage, bounds, child = self.nodes[node]
            if vantage < 0:
                rows = self.order[low:high]
                far = products(queries[who], self.points[rows])
                visited[who] += len(rows)
                near = far <= radius[who][:, None]
                for k in np.flatnonzero(near.any(axis=1)):
                    picked = near[k]
                    found[who[k]].append((far[k][picked], rows[picked]))
                merged = np.concatenate((best[who], far), axis=1)
                best[who] = np.partition(merged, count - 1, axis=1)[:, :count]
                radius[who] = np.minimum(radius[who], best[who].max(axis=1) + 2 * slack)
                continue
            far = products(queries[who], self.points[vantage : vantage + 1])[:, 0]
            inner = np.maximum(np.maximum(bounds[0] - far, far - bounds[1]), 0) - slack
            outer = np.maximum(np.maximum(bounds[2] - far, far - bounds[3]), 0) - slack
            # The nearer half is searched first, for each query its own.
            first = inner <= outer
            for k in (False, True):
                own = first == k
                halves = [(child, who[own], inner[own]), (child + 1, who[own], outer[own])]
                todo += halves[::-1] if k else halves
        out = []
        for k, parts in enumerate(found):
            if not parts:
                out.append(np.zeros(0, np.int64))
                continue
            far, rows = (np.concatenate(x) for x in zip(*parts))
            out.append(rows[far <= radius[k]])
        return out, visited


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and the vector ``v`` in doubles; rows that take no part are left out."""
    own = rows.select(rows[id_col].alias("vec_id"), rows[vector_col].cast("array<double>").alias("v"))
    largest = F.lit(float(np.finfo(np.float64).max))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= largest))
    own = own.where(F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    lengths = own.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    # Zero of either sign is one value.
    return own.where(F.size("v") == (size["size"] if size else 0)).select(
        "vec_id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")
    )


def entries(rows: DataFrame, count: int) -> DataFrame:
    """Distinct vectors ``v`` with the ``ids`` of their first ``count + 1`` rows, by key."""
    # The limit per vector applies before the shuffle already.
    by = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("at", F.row_number().over(by)).where(F.col("at") <= count + 1)
    order = F.array_sort(F.collect_list(F.struct("at", "vec_id")))
    return few.groupBy("v").agg(order.alias("ids")).select("v", F.transform("ids", lambda x: x["vec_id"]).alias("ids"))


def nearest(
    rows: DataFrame, queries: DataFrame, count: int = NEIGHBOURS, factor: float = FACTOR, shard: int = SHARD
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``count`` nearest rows found for each query.

    ``rows`` and ``queries`` as ``usable`` gives them; queries are rows of ``rows``.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    distinct = written(entries(rows, count).withColumn("h", F.xxhash64("v")), "vectors")
    shards = max(-(-distinct.count() // shard), 1)
    # A bounded sample, by hash.
    by = [F.xxhash64("v", F.lit(3)), F.col("h")]
    sample = distinct.select("v", F.struct(*by).alias("by")).orderBy("by").limit(SAMPLE).collect()
    points = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), len(sample[0]["v"]) if sample else 0)
    last = F.struct(*[F.lit(x).cast("long") for x in (sample[-1]["by"] if sample else (0, 0))])

    def bounded(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            own = matrix(batch["v"])
            for s in range(0, len(own), QUERIES):
                part = own[s : s + QUERIES]
                radius = np.full(len(part), np.inf)
                if len(points) > count:  # one more than wanted, as the query may be in the sample itself
                    radius = np.partition(products(part, points), count, axis=1)[:, count]
                yield {"vec_id": batch["vec_id"][s : s + QUERIES], "v": list(part), "radius": radius}

    asked = queries.select("vec_id", "v").distinct()
    asked = mapped_columns(asked, f"vec_id {kind}, v array<double>, radius double", bounded)
    to = F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("shard")
    asked = asked.select(to, F.lit(1).alias("tag"), F.xxhash64("v").alias("h"), "v", F.array("vec_id"), "radius")
    own = F.when(F.struct(*by) <= last, shards).otherwise(F.pmod("h", F.lit(shards)).cast("int"))
    every = distinct.select(own.alias("shard"), F.lit(0), "h", "v", "ids", F.lit(None).cast("double"))
    every = asked.union(every).toDF("shard", "tag", "h", "v", "ids", "radius")
    every = every.repartition(shards + 1, "shard").sortWithinPartitions("shard", "tag", "h")

    def search(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        now, tree, stored, keys = None, None, [], []
        for batch in batches:
            # Runs of rows of one shard that are all entries or all queries.
            kinds = np.stack([batch["shard"].to_numpy(), batch["tag"].to_numpy()])
            cuts = np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch["tag"])]):
                if low == high:
                    continue
                number, tag = kinds[:, low].tolist()
                vectors = matrix(batch["v"].slice(low, high - low))
                ids = batch["ids"].slice(low, high - low).to_pylist()
                if number != now:
                    now, tree, stored, keys = number, None, [], []
                if tag == 0:
                    stored.append(vectors)
                    keys += ids
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(stored) if stored else np.zeros((0, vectors.shape[1])))
                    stored = []
                radius = batch["radius"].slice(low, high - low).to_numpy()
                hashes = batch["h"].slice(low, high - low).to_numpy()
                for s in range(0, len(vectors), QUERIES):
                    part = slice(s, s + QUERIES)
                    own = factor if number < shards else 1.0
                    yield _found(tree, keys, vectors[part], radius[part], ids[part], hashes[part], count, own)

    found = mapped_columns(every, f"query_id {kind}, h long, vec_id {kind}, score double", search)
    best = Window.partitionBy("query_id", "h").orderBy("score", F.col("vec_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    return found.select("query_id", "rank", "vec_id", "score")


def _found(tree: Tree, keys: list, vectors, radius, ids, hashes, count: int, factor: float) -> dict[str, list]:
    """The nearest rows of one shard for a block of queries; the own row of each is left out."""
    out: dict[str, list] = {n: [] for n in ("query_id", "h", "vec_id", "score")}
    got, _ = tree.search(vectors, radius, count + 1, factor)
    for point, (key,), own, rows in zip(vectors, ids, hashes.tolist(), got):
        far = distances(point, tree.points[rows]).tolist()
        best = [(d, k is None, k) for d, r in zip(far, rows.tolist()) for k in keys[r]]
        best.sort(key=lambda x: x[:2] if x[1] else x)
        if (0.0, key is None, key) in best:
            best.remove((0.0, key is None, key))
        best = best[:count]
        out["query_id"] += [key] * len(best)
        out["h"] += [own] * len(best)
        out["vec_id"] += [k for *_, k in best]
        out["score"] += [d for d, *_ in best]
    return out


def op13_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
