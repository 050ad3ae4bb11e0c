"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into paragraphs (lines, and sentences within a line; a sentence of more than
400 characters is cut again where its content says), and the set of their 64-bit digests goes into a sketch: three tables of cells, a digest in one cell of
each; a cell keeps the number of its digests, their XOR and the XOR of their check values.
Subtracting two sketches cell by cell leaves the digests in which the texts differ.
Peeling takes a cell with a single digest, reports it, and removes it from its other
cells, until all are empty.  If that gets stuck, the digests are spread over more tables
by another hash and the sketches are larger, until it succeeds.

The fingerprint is the number of digests and the sketch at the base size, as text.  Likeness is the Jaccard
coefficient of the two digest sets, from their sizes and the number of recovered digests.

Defined results: a null or empty text has no paragraphs, and two such texts are alike (1);
equal texts have equal fingerprints; a null key comes last in the order of documents; rows
that repeat key and text count as one in that order; a sole document is its own successor;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import let, table, texts, written
from pulseframe.session import parallelism

TABLES = 3
#: Cells of each table in a fingerprint, and in the sketches of the retries.
BASE_CELLS = 8
RETRY_CELLS = (8, 16, 32, 64, 256, 1024)
#: Digests that share a sketch in the retries, about; long lists are dealt in two steps.
GROUP = 8
LARGE_GROUP = 64
ROUNDS = 24
#: Pieces of long sentences: up to a space between two such letters, then to any space, then as is.
LEAST_PIECE = 400
PIECE = r"(?s).{400,799}?(?<=[a-h]) (?=[a-d])|.{800,2047}? |.{2048}|.+"
_CHECK_SEED = 7


def paragraphs(text: Column) -> Column:
    """Lines and their sentences, without empty ones; long sentences in pieces."""
    # A blank after a stop ends a sentence as a line end does.
    for stop in ".!?":
        text = F.replace(text, F.lit(f"{stop} "), F.lit(f"{stop}\n"))
    sentences = F.filter(F.split(text, "\n"), lambda p: p != "")
    pieces = F.transform(
        sentences,
        lambda p: F.when(F.char_length(p) > LEAST_PIECE, F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))).otherwise(
            F.array(p)
        ),
    )
    return F.flatten(pieces)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _places(digest: Column, cells: Column) -> list[Column]:
    """The cell of a digest in each table, numbered through all tables; another size takes another hash."""
    mixed = F.xxhash64(digest, cells)
    return [F.pmod(F.shiftrightunsigned(mixed, 21 * t), cells).cast("int") + t * cells for t in range(TABLES)]


def _entry(digest: Column, sign: Column, cells: Column) -> Column:
    """What a digest adds to each of its cells, with their numbers."""
    return F.struct(
        digest.alias("k"),
        sign.alias("n"),
        F.xxhash64(digest, F.lit(_CHECK_SEED)).alias("c"),
        *[p.alias(f"p{t}") for t, p in enumerate(_places(digest, cells))],
    )


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _add(cells: Column | None, entries: Column, sign: int, count: Column) -> Column:
    """Cells (none: empty ones) after ``sign`` times the entries; entries of table t touch only its cells."""
    tables = []
    for t in range(TABLES):

        def fold(cell: Column, i: Column, t: int = t) -> Column:
            own = F.filter(entries, lambda e: e[f"p{t}"] == i)
            return F.aggregate(
                own,
                cell,
                lambda a, e: _cell(
                    a["n"] + sign * e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])
                ),
            )

        numbers = F.sequence(count * t, count * (t + 1) - 1)
        tables.append(F.transform(numbers, _folder(cells, fold)))
    return F.concat(*tables)


def _folder(cells: Column | None, fold):
    return lambda i: fold(_cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")) if cells is None else F.get(cells, i), i)


def sketch(values: Column, count: Column) -> Column:
    """The sketch of a list of distinct digests, ``count`` cells per table."""
    entries = F.transform(values, lambda d: _entry(d, F.lit(1), count))
    return let(entries, lambda own: _add(None, own, 1, count))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))
    )


def peel(cells: Column, count: Column) -> Column:
    """Recovered digests of a difference sketch: ``left`` and ``right`` lists and ``done``."""

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["stuck"], acc).otherwise(let(pure(acc["cells"]), lambda own: remove(acc, own)))

    def pure(all_cells: Column) -> Column:
        single = F.filter(
            all_cells, lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], F.lit(_CHECK_SEED)) == x["c"])
        )
        return F.array_distinct(F.transform(single, lambda x: _entry(x["k"], x["n"], count)))

    def remove(acc: Column, own: Column) -> Column:
        seen = F.transform(own, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n")))
        stuck = F.size(own) == 0
        return F.struct(
            F.when(stuck, acc["cells"]).otherwise(_add(acc["cells"], own, -1, count)).alias("cells"),
            F.concat(acc["found"], seen).alias("found"),
            stuck.alias("stuck"),
        )

    start = F.struct(
        cells.alias("cells"),
        F.array().cast("array<struct<k:bigint,n:int>>").alias("found"),
        F.lit(False).alias("stuck"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda acc: F.struct(
            F.transform(F.filter(acc["found"], lambda x: x["n"] > 0), lambda x: x["k"]).alias("left"),
            F.transform(F.filter(acc["found"], lambda x: x["n"] < 0), lambda x: x["k"]).alias("right"),
            (~F.exists(acc["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))).alias("done"),
        ),
    )


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Digests only in a (``left``) and only in b (``right``), by sketches.

    First the base sketches are subtracted, unless the numbers of digests differ by more than a
    sketch has cells.  If they do not peel, both lists are dealt into groups by hash and each group is sketched, larger at each failure.  A group that fails at the
    last size, which takes a clash of digests, is compared as lists.
    """
    hopeless = F.abs(F.size(a) - F.size(b)) > TABLES * BASE_CELLS
    first = F.when(hopeless, _none(False)).otherwise(peel(subtract(sketch_a, sketch_b), F.lit(BASE_CELLS)))
    return let(
        first,
        lambda f: F.when(f["done"], f).otherwise(
            _by_groups(a, b, LARGE_GROUP, 32, lambda x, y: _by_groups(x, y, GROUP, 0, _retried))
        ),
    )


def _none(done: bool) -> Column:
    empty = [F.array().cast("array<bigint>").alias(n) for n in ("left", "right")]
    return F.struct(*empty, F.lit(done).alias("done"))


def _by_groups(a: Column, b: Column, size: int, shift: int, compare) -> Column:
    """``compare`` of the digests of each group, put together; 31 bits of a digest, from ``shift`` on, deal it."""
    groups = F.greatest(F.ceil(F.greatest(F.size(a), F.size(b)) / size).cast("int"), F.lit(1))

    def of_group(acc: Column, g: Column) -> Column:
        def own(values: Column) -> Column:
            return F.filter(
                values, lambda d: F.shiftrightunsigned(d, shift).bitwiseAND(F.lit(0x7FFFFFFF)) % groups == g
            )

        def joined(got: Column) -> Column:
            return F.struct(
                F.concat(acc["left"], got["left"]).alias("left"),
                F.concat(acc["right"], got["right"]).alias("right"),
                F.lit(True).alias("done"),
            )

        both = F.struct(own(a).alias("a"), own(b).alias("b"))
        return let(let(both, lambda x: compare(x["a"], x["b"])), joined)

    return F.aggregate(F.sequence(F.lit(0), groups - 1), _none(True), of_group)


def _retried(a: Column, b: Column) -> Column:
    def attempt(acc: Column, count: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(peel(subtract(sketch(a, count), sketch(b, count)), count))

    def exact(acc: Column) -> Column:
        lists = F.struct(
            F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"), F.lit(True).alias("done")
        )
        return F.when(acc["done"], acc).otherwise(lists)

    return F.aggregate(F.array(*map(F.lit, RETRY_CELLS)), _none(False), attempt, exact)


def likeness(n_a: Column, n_b: Column, apart: Column) -> Column:
    """Jaccard coefficient from the sizes of two sets and of their difference."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - apart) / (n_a + n_b + apart))


def fingerprint(cells: Column, size: Column) -> Column:
    """The number of digests and the cells as text: number, XOR of digests, XOR of checks, in hex."""
    shown = F.transform(cells, lambda x: F.concat_ws(":", *[F.lower(F.hex(x[n])) for n in ("n", "k", "c")]))
    return F.concat_ws("|", size.cast("string"), F.array_join(shown, ";"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` as ``key, hash, text``; the key is text and never null, so plain equality joins it.

    Whoever reads all three columns shares one shuffle by key and hash.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return docs.select(key.alias("key"), F.xxhash64("text").alias("hash"), "text")


def successors(docs: DataFrame) -> DataFrame:
    """For every distinct key and text hash the ones that follow, by falling key; the last's is the first.

    Only keys and hashes are ordered: they are dealt into ranges, written, and every range
    gets the first of the next one for its last row.
    """
    keys = keyed(docs.select("doc_id", "text")).select("key", "hash", F.char_length("text").alias("chars")).distinct()
    own_key = F.expr("substring(key, 2)").cast(docs.schema["doc_id"].dataType)
    keys = keys.withColumn("doc_id", F.when(F.col("key") != "", own_key))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    dealt = keys.repartitionByRange(parallelism(docs.sparkSession), *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "order")
    own = Window.partitionBy("range").orderBy(*order)
    here = F.struct("key", "hash")
    followed = dealt.withColumn("following", F.lead(here).over(own))
    # One row per range, so no more than there are partitions.
    heads = dealt.withColumn("number", F.row_number().over(own)).where("number = 1").select("range", here.alias("head"))
    ranges = Window.orderBy("range")
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        F.col("range").alias("r"), F.coalesce(F.lead("head").over(ranges), F.first("head").over(everything)).alias("head")
    )
    joined = followed.join(after, F.col("range") == F.col("r"))
    return joined.select("key", "hash", "chars", F.coalesce("following", "head").alias("next")).select(
        F.col("key").alias("from_key"),
        F.col("hash").alias("from_hash"),
        F.col("chars").alias("from_chars"),
        F.col("next.key").alias("next_key"),
        F.col("next.hash").alias("next_hash"),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_head, next_digests``: each document beside what it needs of the next one.

    That is as much of its text as the edit takes, and its digests.  Texts are shuffled by
    their own key, for both joins, and these heads by the key of the document before.
    """
    pairs = written(successors(docs), "pairs")
    following = pairs.join(keyed(docs), (F.col("next_key") == F.col("key")) & (F.col("next_hash") == F.col("hash")))
    following = following.select(
        "from_key",
        "from_hash",
        F.substring("text", F.lit(1), F.floor(F.col("from_chars") / 2).cast("int")).alias("head"),
        digests(F.col("text")).alias("digests"),
    )
    # Rows that repeat a key and its text are one successor.
    following = following.groupBy("from_key", "from_hash").agg(
        F.first("head").alias("next_head"), F.first("digests").alias("next_digests")
    )
    joined = keyed(docs).join(
        following, (F.col("key") == F.col("from_key")) & (F.col("hash") == F.col("from_hash"))
    )
    own_key = F.expr("substring(key, 2)").cast(docs.schema["doc_id"].dataType)
    return joined.select(F.when(F.col("key") != "", own_key).alias("doc_id"), "text", "next_head", "next_digests")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of the next text."""
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - half), F.substring(following, F.lit(1), half))


def compared(pairs: DataFrame) -> DataFrame:
    """Fingerprints and likeness of ``text`` to its edited form and to the next text."""
    df = pairs.withColumn("edited", edited(F.col("text"), F.col("next_head")))
    own = {"d_a": digests(F.col("text")), "d_e": digests(F.col("edited")), "d_x": F.col("next_digests")}
    df = df.withColumns(own)
    df = df.withColumns({f"s_{k}": sketch(F.col(f"d_{k}"), F.lit(BASE_CELLS)) for k in "aex"})
    for k, name in (("e", "near_edited"), ("x", "near_next")):
        apart = difference(F.col("d_a"), F.col(f"d_{k}"), F.col("s_a"), F.col(f"s_{k}"))
        df = df.withColumn(f"apart_{k}", apart)
        both = F.size(f"apart_{k}.left") + F.size(f"apart_{k}.right")
        df = df.withColumn(name, likeness(F.size("d_a"), F.size(f"d_{k}"), both))
    return df


def op4_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(texts(table(spark, sf_dir, "documents")))
    return compared(pairs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("s_a"), F.size("d_a")).alias("fingerprint"),
        fingerprint(F.col("s_e"), F.size("d_e")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
