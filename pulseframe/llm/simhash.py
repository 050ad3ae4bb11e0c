"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared once per distinct value.  Two values that differ in at most
three bits agree in one of four 16-bit bands, so each value goes to four buckets.  A
bucket that is too large is split again, exactly: within it, all values share a band,
and two near ones agree in one of four parts of the other 48 bits, and then in one of
four parts of what is left after that.  What is still too large after this is cut into
tiles, and every pair of tiles is a bucket of its own.  So no bucket exceeds
twice the limit and no pair within the radius is lost.

Inside a bucket the values are stored as bit planes: 64 candidates share a machine word
per bit.  A row holds one value against one such block; per plane, the differences of
64 candidates are added into carry-save counters with a few word operations, and rows
in which every candidate has exceeded the radius are dropped on the way.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
equal rows share a fingerprint; a null key takes part, but is never the smallest key; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import id_type, mapped, table, texts, written
from pulseframe.llm.components import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET_LIMIT = 4096
_ONE = np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = starts + sizes
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        cuts = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - SHINGLE + 1
        )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):  # bounds the unpacked bits of long texts
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little")
        counts += part.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def near_pairs(sizes: np.ndarray, values: np.ndarray, radius: int = RADIUS, step: int = 1 << 18):
    """Index pairs (i < j) within a bucket whose values differ in at most ``radius`` bits.

    ``values`` holds the buckets one after the other, ``sizes`` their lengths.
    """
    values = values.astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    blocks = (sizes + 63) // 64
    block_starts = np.concatenate(([0], np.cumsum(blocks)))
    # Bit planes: planes[b][k] has bit b of the 64 values of block k.
    slot = np.repeat(block_starts[:-1] * 64 - starts, sizes) + np.arange(len(values))
    grid = np.zeros(block_starts[-1] * 64, np.uint64)
    grid[slot] = values
    bits = np.unpackbits(grid.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64, BITS)
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(BITS, -1, 8)
    planes = np.ascontiguousarray(planes).view(np.uint64)[:, :, 0]
    base = np.repeat(block_starts[:-1], sizes)  # first block of a value's bucket
    own = slot // 64  # its own block
    many = own - base + 1  # blocks it is compared with
    ends = np.cumsum(many)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    at = 0
    while at < len(values):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        who = np.repeat(np.arange(at, upto), many[at:upto])
        offset = np.arange(len(who)) - np.repeat(ends[at:upto] - many[at:upto] - (ends[at - 1] if at else 0), many[at:upto])
        block = base[who] + offset
        # Over the radius from the start: the value itself and what follows it in its block.
        in_block = (slot[who] % 64).astype(np.uint64)
        over = np.where(block == own[who], ~((_ONE << in_block) - _ONE), np.uint64(0))
        a, b = _compare(planes, values, who, block, over, radius)
        left.append(a)
        right.append(b)
        at = upto
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, cell = np.concatenate(left), np.concatenate(right)
    index = np.zeros(len(grid), np.int64)
    index[slot] = np.arange(len(values))
    return index[cell], found


def _compare(planes, values, who, block, over, radius):
    """Values ``who`` against blocks; returns the value and the cell of each near pair."""
    levels = (radius + 1).bit_length()
    # Counters start so that they overflow into ``over`` at radius + 1.
    start = (1 << levels) - (radius + 1)
    counters = [np.full(len(who), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(levels)]
    mine = values[who]
    for plane in range(BITS):
        wanted = np.uint64(0) - ((mine >> np.uint64(plane)) & _ONE)
        carry = planes[plane][block] ^ wanted
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if plane % 8 == 7:  # abandon the blocks in which all are over
            live = over != ~np.uint64(0)
            if not live.all():
                who, block, over, mine = who[live], block[live], over[live], mine[live]
                counters = [c[live] for c in counters]
            if not len(who):
                break
    row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return who[row], block[row] * 64 + lane


def _spanning(batch: dict[str, list]) -> dict[str, list]:
    """Links that connect each bucket's near values as its near pairs do."""
    sizes = np.array([len(x) for x in batch["members"]], np.int64)
    out: dict[str, list] = {"a": [], "b": []}
    if not len(sizes):
        return out
    values = np.concatenate([np.array(x, np.int64) for x in batch["members"]])
    i, j = near_pairs(sizes, values.view(np.uint64))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out["a"].append(int(values[a]))
            out["b"].append(int(values[b]))
    return out


def _part(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _free(used: set[int], count: int) -> list[list[int]]:
    """The bits that are left, cut into ``count`` runs of about equal length."""
    rest = [b for b in range(BITS) if b not in used]
    cuts = [len(rest) * i // count for i in range(count + 1)]
    return [rest[a:b] for a, b in zip(cuts, cuts[1:])]


def _bits_key(bits: list[int]) -> Column:
    """The value of the given bits, which may lie in several runs."""
    runs: list[list[int]] = []
    for b in bits:
        if runs and runs[-1][-1] == b - 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    return F.concat_ws(".", *[_part(r[0], len(r)).cast("string") for r in runs])


def buckets(values: DataFrame, limit: int = BUCKET_LIMIT, radius: int = RADIUS) -> DataFrame:
    """Distinct values ``fp`` as buckets of at most ``2 * limit`` members that hold every near pair.

    ``path`` tells which parts of the bits the members share.  Only counts of buckets
    cross between the rounds; a bucket within the limit is not touched again.
    """
    parts = radius + 1
    level = [("", [])]
    members = values.select("fp", F.lit("").alias("key"), F.lit("").alias("path"))
    done = []
    for depth in range(3):
        exploded = []
        following = []
        for path, used in level:
            for k, bits in enumerate(_free(set(used), parts)):
                name = f"{path}{k}"
                exploded.append((path, name, bits))
                following.append((name, used + bits))
        # One expression for the whole level: the parts depend on the path so far.
        choices = None
        for path in dict.fromkeys(p for p, _, _ in exploded):
            own = F.array(
                *[
                    F.struct(F.lit(name).alias("path"), _bits_key(bits).alias("v"))
                    for p, name, bits in exploded
                    if p == path
                ]
            )
            choices = F.when(F.col("path") == path, own) if choices is None else choices.when(F.col("path") == path, own)
        spread = members.select("fp", F.col("key").alias("above"), F.explode(choices).alias("p")).select(
            "fp", F.concat_ws("/", "above", "p.v").alias("key"), F.col("p.path").alias("path")
        )
        spread = written(spread, "bands")
        counts = spread.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = written(counts.where(F.col("n") > limit), "large")
        names = ["path", "key"]
        small = spread.join(large.select(*names), names, "left_anti")
        done.append(small.groupBy(*names).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1))
        if not large.take(1):
            return _together(done)
        members, level = spread.join(large.select(*names), names, "left_semi"), following
    tiles = spread.join(large, names).withColumn("tiles", F.ceil(F.col("n") / limit).cast("int"))
    tiles = tiles.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = tiles.withColumn("u", other).select(
        "fp", "path", "key", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")
    )
    done.append(paired.groupBy("path", "key", "t", "u").agg(F.collect_list("fp").alias("members")))
    return _together(done)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("members")
    for other in parts[1:]:
        out = out.union(other.select("members"))
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint (16 lower-case hex digits) and its component.

    ``component_id`` is the smallest key reachable by links of at most three bits,
    the document itself included; ``text_hash`` tells rows apart that repeat a key.
    """
    return simhash_nodes(docs, id_col, text_col).drop("node")


def simhash_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``simhash_groups``, with the component's smallest fingerprint as ``node``.

    Components whose smallest key is the same have different nodes.
    """
    picked = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    prints = written(
        mapped(
            picked,
            f"doc_id {id_type(picked)}, text_hash long, fp long",
            lambda b: {
                "doc_id": b["doc_id"],
                "text_hash": b["text_hash"],
                "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64),
            },
        ),
        "prints",
    )
    values = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "values")
    links = mapped(buckets(values.select("fp")), "a long, b long", _spanning)
    of = components(links)
    # Only values that are linked or repeated have anything to add to their documents.
    named = values.join(of, values["fp"] == of["node"], "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("c"), F.col("component").isNotNull().alias("linked")
    )
    firsts = named.where("linked").groupBy("c").agg(F.min("least").alias("first")).withColumnRenamed("c", "g")
    smallest = named.join(firsts, named["c"] == firsts["g"], "left").where("linked OR n > 1")
    smallest = written(smallest.select("fp", "c", F.coalesce("first", "least").alias("component_id")), "smallest")
    return (
        prints.join(smallest.withColumnRenamed("fp", "k"), F.col("fp") == F.col("k"), "left")
        .select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "text_hash",
            F.coalesce("c", "fp").alias("node"),
        )
    )


def one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the document with the smallest key."""
    return first_rows(docs, simhash_nodes(docs))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each ``node`` of ``groups`` the one with the smallest key.

    ``groups`` has doc_id, text_hash and node of every row.  Null keys come last; of rows that
    repeat the key, the one with the smallest text hash stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("node").agg(F.min(order).alias("f"))
    first = first.select(_text_key(F.col("f.doc_id")).alias("__keep_id"), F.col("f.text_hash").alias("__keep_hash"))
    first = written(first, "kept")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__group_id": _text_key(F.col("doc_id")), "__group_hash": F.xxhash64(text)})
    both = (F.col("__group_id") == F.col("__keep_id")) & (F.col("__group_hash") == F.col("__keep_hash"))
    kept = keyed.join(first, both, "left_semi")
    return kept.dropDuplicates(["__group_id", "__group_hash"]).select(*docs.columns)


def _text_key(key: Column) -> Column:
    """A key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
