"""Near copies by the Jaccard similarity of their sets of five-word shingles.

Pairs to compare come from two sources.  A text's min-hashes, five to a band, put it into
a bucket per band; two texts of similarity 0.8 miss each other in all 20 bands with a
chance of 0.0004.  And texts whose SimHash fingerprints are linked (``simhash``) share a
bucket.  Every pair is verified on its whole shingle sets, and groups are what the links
connect, so pairs within a group need not all be looked at.  That is used for large buckets:

1. Buckets of up to ``SMALL`` texts give all their pairs; in larger ones every text is
   paired with the bucket's leaders, one per salt.  A group of copies is then connected.
2. Large buckets that hold several of the groups found so far are searched whole, by
   prefixes: of two sets of similarity 0.8 or more, each holds one of the other's rarest
   shingles, about a fifth of its own.  Texts of different groups that share a shingle of
   both prefixes are verified too.  No pair of such a bucket is lost, whatever its size.

Defined results: words are split and lower-cased as for SimHash, equal word lists are one
text; a text of fewer than five words is one shingle, one without words equals only its
like; null keys come last; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import id_type, mapped, mapped_columns, texts, written
from pulseframe.llm.components import components
from pulseframe.llm.simhash import first_rows, simhash_nodes

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 5
#: Buckets up to this size give all pairs; larger ones go through leaders and prefixes.
SMALL = 16
SALTS = 3
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    if not width:
        return hashes
    out = hashes[: len(words) - width + 1]
    for k in range(1, width):
        out = _scattered(out) + hashes[k : len(words) - width + 1 + k]
    return np.unique(_scattered(out))


def bands(values: np.ndarray) -> list[int]:
    """One bucket per band, as signed numbers; none without shingles."""
    if not len(values):
        return []
    least = np.array([(values * odd >> np.uint64(16)).min() for odd in _ODD], np.uint64)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def _prints(batch: dict[str, list]) -> dict[str, list]:
    sets = [shingles(t) for t in batch["text"]]
    joined = [b" ".join((t or "").encode().lower().split()) for t in batch["text"]]
    return {
        "doc_id": batch["doc_id"],
        "text_hash": batch["text_hash"],
        "node": [xxhash.xxh64_intdigest(j, SEED) - (1 << 63) for j in joined],
        "size": [len(s) for s in sets],
        "bands": [bands(s) for s in sets],
    }


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Views of the lists of a column; nothing is copied."""
    values, cuts = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(cuts, cuts[1:])]


def _verified(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        out: dict[str, list] = {"a": [], "b": []}
        ends = (batch[n].to_numpy().tolist() for n in "ab")
        for a, b, x, y in zip(*ends, _lists(batch["set_a"]), _lists(batch["set_b"])):
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= LEAST * (len(x) + len(y) - common) - 1e-9:
                out["a"].append(a)
                out["b"].append(b)
        yield out


def _pairs(members: DataFrame, small: int) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes that share a bucket and whose sizes allow the similarity."""
    counts = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "size")).alias(f"l{k}") for k in range(SALTS)],
    )
    counts = written(counts.where("n > 1").withColumnRenamed("bucket", "k"), "buckets")
    few = members.join(counts.where(F.col("n") <= small).select("k"), F.col("bucket") == F.col("k"))
    few = few.groupBy("bucket").agg(F.collect_list(F.struct("node", "size")).alias("m"))
    few = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    many = counts.where(F.col("n") > small).select("k", F.array(*[f"l{k}" for k in range(SALTS)]).alias("m"))
    many = members.join(many, F.col("bucket") == F.col("k")).select(
        F.struct("node", "size").alias("x"), F.explode("m").alias("y")
    )
    both = few.select("x.node", "x.size", F.col("y.node").alias("other"), F.col("y.size").alias("n")).union(
        many.select("x.node", "x.size", "y.node", "y.size")
    )
    alike = F.least("size", "n") >= LEAST * F.greatest("size", "n") - 1e-9
    both = both.where((F.col("node") != F.col("other")) & alike)
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar enough, verified on their whole sets."""
    left, right = sets.toDF("na", "set_a"), sets.toDF("nb", "set_b")
    beside = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    return mapped_columns(beside.select("a", "b", "set_a", "set_b"), "a long, b long", _verified)


def _divided(members: DataFrame, groups: DataFrame, small: int) -> DataFrame:
    """``n, group`` of the texts in large buckets that hold more than one group."""
    own = groups.withColumnsRenamed({"node": "g", "component": "group"})
    of = members.join(own, F.col("node") == F.col("g"), "left").withColumn("group", F.coalesce("group", "node"))
    of = of.select("bucket", "node", "group")
    several = of.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("x"), F.max("group").alias("y"))
    several = several.where((F.col("n") > small) & (F.col("x") < F.col("y"))).select(F.col("bucket").alias("k"))
    held = of.join(several, F.col("bucket") == F.col("k"))
    return held.select(F.col("node").alias("n"), "group").distinct()


def _prefix_pairs(texts_in: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of texts of different groups that share a shingle of both prefixes and may be similar."""
    own = texts_in.withColumnRenamed("n", "m").join(sets, F.col("m") == F.col("n"))
    items = own.select("n", "group", F.explode("set").alias("s"))
    times = items.groupBy("s").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("s", "of")
    counted = items.join(times, F.col("s") == F.col("of")).groupBy("n", "group")
    counted = counted.agg(F.array_sort(F.collect_list(F.struct("times", "s"))).alias("items"))
    # Of each set its rarest shingles, as many as two similar sets can't both do without.
    size = F.size("items")
    length = size - F.ceil(size * LEAST - 1e-9).cast("int") + 1
    prefix = F.transform(F.slice("items", F.lit(1), length), lambda i: i["s"])
    posts = counted.select("n", "group", size.alias("size"), F.posexplode(prefix).alias("pos", "s"))
    posts = written(posts, "posts")
    # A shingle that one group has to itself joins nothing.  Shingles of the same texts, as those of
    # a shared passage, give the same pairs: they are one class, placed at the first of them.
    held = F.xxhash64(F.bit_xor(F.xxhash64("n")), F.sum(F.pmod(F.xxhash64("n"), F.lit(1 << 31))), F.count(F.lit(1)))
    shared = posts.groupBy(F.col("s").alias("k")).agg(F.min("group").alias("x"), F.max("group").alias("y"), held.alias("class"))
    posts = posts.join(shared.where("x < y").select("k", "class"), F.col("s") == F.col("k"))
    posts = posts.groupBy("class", "n", "group", "size").agg(F.min("pos").alias("pos"))
    posts = written(posts, "classes")
    other = posts.toDF("class2", "n2", "group2", "size2", "pos2")
    alike = F.least("size", "size2") >= LEAST * F.greatest("size", "size2") - 1e-9
    # Before the first shingle they share two sets share nothing; what follows must hold enough.
    follow = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
    enough = follow >= LEAST / (1 + LEAST) * (F.col("size") + F.col("size2")) - 1e-9
    both = posts.join(
        other,
        (F.col("class") == F.col("class2")) & (F.col("n") < F.col("n2")) & (F.col("group") != F.col("group2")) & alike & enough,
    )
    return both.select(F.col("n").alias("a"), F.col("n2").alias("b")).distinct()


def near_copies(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """``doc_id, text_hash, node`` of every row; rows linked by near copies have one node."""
    picked = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    schema = f"doc_id {id_type(picked)}, text_hash long, node long, size int, bands array<long>"
    prints = written(mapped(picked, schema, _prints), "copies")
    of_text = prints.groupBy("node").agg(F.min("text_hash").alias("h"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    of_text = written(of_text, "texts")
    linked = simhash_nodes(docs).select("text_hash", F.xxhash64(F.lit("simhash"), "node").alias("bucket")).distinct()
    linked = linked.withColumnRenamed("text_hash", "t")
    members = of_text.select("node", "size", F.explode("bands").alias("bucket")).union(
        of_text.join(linked, F.col("h") == F.col("t")).select("node", "size", "bucket")
    )
    members = written(members, "members")
    pairs = written(_pairs(members, small), "pairs")
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    wanted = of_text.join(wanted, F.col("node") == F.col("w")).select("node", "h")
    # Copies are brought together before the shuffle, so a very common text is one row.
    once = picked.groupBy("text_hash").agg(F.first("text").alias("text"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        return mapped(
            once.join(nodes, F.col("text_hash") == F.col("h")).select("node", "text"),
            "n long, set array<long>",
            lambda b: {"n": b["node"], "set": [shingles(t).view(np.int64) for t in b["text"]]},
        )

    sets = written(sets_of(wanted), "sets")
    links = written(_links(pairs, sets), "similar")
    of = components(links)
    divided = written(_divided(members, of, small), "divided")
    if divided.take(1):
        missing = divided.join(sets, "n", "left_anti").withColumnRenamed("n", "w")
        more = sets_of(of_text.join(missing, F.col("node") == F.col("w")).select("node", "h"))
        sets = written(sets.join(divided, "n", "left_semi").union(more), "divided-sets")
        found = written(_links(written(_prefix_pairs(divided, sets), "prefix-pairs"), sets), "found")
        if found.take(1):
            of = components(links.union(found))
    of = of.withColumnRenamed("node", "member")
    return prints.join(of, F.col("node") == F.col("member"), "left").select(
        "doc_id", "text_hash", F.coalesce("component", "node").alias("node")
    )


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of near copies the document with the smallest key."""
    return first_rows(docs, near_copies(docs))
