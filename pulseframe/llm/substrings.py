"""Substring dedup: words covered by windows that occur elsewhere, by FM-indexes.

An index of the whole corpus fits nowhere, and matching every document against every
index of a part would grow with the square of the corpus.  So the shards are cut by
content: a window of words is routed by its smallest hash of eight consecutive words (its
anchor), and equal windows have equal anchors.  Neighbouring windows mostly share their
anchor and travel as one segment.

1. Anchors of all windows are counted.  A window whose anchor stands in one place is unique.
2. Segments of anchors that occur twice or more are written once per task, and where they stand.
3. Per shard, an FM-index over its segments is built, all segments are streamed against it by
   backward search, and stretches whose windows occur twice or more are reported.  A segment
   that stands in more than one place is repeated as a whole.
4. Stretches go back to their documents.

Anchors with very many segments (a line in a third of all documents) are cut into single
windows, routed by a hash of all their words, so that no shard holds them all.

Words are compared by 64-bit hashes, within a shard; segments are known by two of them.

Defined results: a null or empty text has no words and loses none; texts shorter than the
window lose none; equal rows are copies of each other; a null key is a key like any other;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pulseframe.llm.common import id_type, mapped, mapped_batches, table, texts, written
from pulseframe.llm.fmindex import repeated_windows

WINDOW = 35
ANCHOR = 8
#: Words in the segments of a shard, about.
SHARD_WORDS = 1_000_000
#: Anchors with more segments than this are routed window by window.
HOT_RUNS = 3_000
#: Windows of a segment, at most.
LONGEST_RUN = 8_192
#: Segments that a task remembers as already written.
REMEMBERED = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def runs(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every stretch of windows with one anchor.

    A stretch of more than ``LONGEST_RUN`` windows, as in periodic texts, comes in pieces.
    """
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _rolled(hashes, ANCHOR)
    width, wanted = 1, window - ANCHOR + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    pieces = -(-np.diff(np.append(first, len(least))) // LONGEST_RUN)
    if pieces.max() > 1:
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + piece * LONGEST_RUN
    return least[first].view(np.int64), first, np.diff(np.append(first, len(least)))


def _key(docs: DataFrame) -> Column:
    """The key without nulls."""
    kind = docs.schema["doc_id"].dataType
    return F.coalesce("doc_id", (F.lit("") if isinstance(kind, StringType) else F.lit(-1)).cast(kind))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``did, hash, anchor`` of every run of every document, twice if the document holds the anchor again.

    Windows that repeat within one run, as in periodic texts, would else go unnoticed.
    """

    def find(batch: dict[str, list]) -> dict[str, list]:
        own = []
        for text in batch["text"]:
            hashes = word_hashes(text.encode().split())
            found = runs(hashes, window)[0]
            if len(found):
                values, times = np.unique(_rolled(hashes, ANCHOR).view(np.int64), return_counts=True)
                found = np.concatenate((found, found[times[np.searchsorted(values, found)] > 1]))
            own.append(found)
        return {"did": batch["did"], "hash": batch["hash"], "anchors": own}

    schema = f"did {id_type(docs)}, hash long, anchors array<long>"
    found = mapped(docs.select("did", "hash", "text"), schema, find)
    return found.select("did", "hash", F.explode("anchors").alias("anchor"))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, to be shuffled."""

    def pack(batch: dict[str, list]) -> dict[str, list]:
        tool = zstandard.ZstdCompressor(level=3)
        return {**batch, "text": [tool.compress(t.encode()) for t in batch["text"]]}

    kind = id_type(docs)
    return mapped(docs.select("doc_id", "did", "hash", "text"), f"doc_id {kind}, did {kind}, hash long, text binary", pack)


def _unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def segments(docs: DataFrame, window: int, hot: int) -> DataFrame:
    """Where the segments of repeated anchors stand, and their words the first time a task meets them."""
    pairs = anchors(docs, window)
    counts = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts.select("anchor", (F.col("n") > hot).alias("hot")), "anchors")
    kept = pairs.distinct().join(counts.withColumnRenamed("anchor", "known"), F.col("anchor") == F.col("known"))
    # By key and text: rows that only share a key have lists of their own.
    wanted = kept.groupBy(F.col("did").alias("of"), F.col("hash").alias("and"))
    wanted = wanted.agg(F.collect_list(F.struct("anchor", "hot")).alias("wanted"))
    same = (F.col("did") == F.col("of")) & (F.col("hash") == F.col("and"))
    both = _packed(docs).join(wanted, same).select("did", "hash", "text", "wanted")

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for did, text_hash, blob, own in zip(*(batch[n] for n in ("did", "hash", "text", "wanted"))):
                words = _unpacked(blob).split()
                hashes = word_hashes(words)
                hot_of = {w["anchor"]: w["hot"] for w in own}
                for route, first, size in _routed(hashes, hot_of, window):
                    piece = b" ".join(words[first : first + size])
                    sid = xxhash.xxh3_64_intdigest(piece)
                    sid -= (sid >> 63) << 64
                    new = (route, sid) not in seen
                    if new:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add((route, sid))
                    row = (did, text_hash, route, sid, first, size, piece.decode() if new else None)
                    for name, value in zip(names, row):
                        out[name].append(value)
            yield out

    names = ["did", "hash", "route", "sid", "first", "size", "words"]
    kind = id_type(docs)
    return mapped_batches(
        both, f"did {kind}, hash long, route long, sid long, first int, size int, words string", cut
    )


def _routed(hashes: np.ndarray, hot_of: dict[int, bool], window: int) -> Iterator[tuple[int, int, int]]:
    """Route, first word and number of words of the segments of wanted anchors."""
    whole = None
    for anchor, first, count in zip(*(x.tolist() for x in runs(hashes, window))):
        hot = hot_of.get(anchor)
        if hot is None:
            continue
        if not hot:
            yield anchor, first, count + window - 1
            continue
        if whole is None:
            whole = _rolled(hashes, window).view(np.int64).tolist()
        for w in range(first, first + count):
            yield whole[w], w, window


def _searched(window: int):
    """Per shard: repeated stretches of its segments."""

    def search(shard: pa.Table) -> pa.Table:
        columns = [shard.column(n).to_pylist() for n in ("route", "sid", "words")]
        distinct = {(route, sid): words for route, sid, words in zip(*columns)}
        found = repeated_windows([word_hashes(w.encode().split()) for w in distinct.values()], window)
        rows = [(key, spans) for key, spans in zip(distinct, found) if spans]
        return pa.table(
            {
                "route": pa.array([r for (r, _), _ in rows], pa.int64()),
                "sid": pa.array([s for (_, s), _ in rows], pa.int64()),
                "spans": pa.array([[{"a": a, "b": b} for a, b in spans] for _, spans in rows], _SPANS),
            }
        )

    return search


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot: int = HOT_RUNS) -> DataFrame:
    """``did, hash, spans`` for documents (with ``did, hash, text``) that hold repeated windows.

    A span is a stretch of words, end exclusive; spans of a document may overlap.
    """
    found = written(segments(docs, window, hot), "segments")
    own = found.where(F.col("words").isNotNull()).select("route", "sid", "size", "words")
    total = own.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    own = own.select(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"), "route", "sid", "words")
    matched = own.groupBy("shard").applyInArrow(
        _searched(window), "route long, sid long, spans array<struct<a: int, b: int>>"
    )
    many = found.groupBy("route", "sid").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n > 1")
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    either = matched.unionByName(many.select("route", "sid", everything.alias("spans")))
    either = written(either.groupBy("route", "sid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "matches")
    places = found.select("did", "hash", "route", "sid", "first").join(
        either.toDF("of", "and", "spans"), (F.col("route") == F.col("of")) & (F.col("sid") == F.col("and"))
    )
    moved = F.transform(
        "spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b"))
    )
    # A set, so that rows that repeat key and text add nothing to the spans they share.
    return places.groupBy("did", "hash").agg(F.flatten(F.collect_set(moved)).alias("spans"))


def _covered(count: int, spans: list[dict[str, int]] | None) -> np.ndarray:
    steps = np.zeros(count + 1, np.int64)
    for s in spans or ():
        steps[s["a"]] += 1
        steps[s["b"]] -= 1
    return np.cumsum(steps[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("did", _key(docs)).withColumn("hash", F.xxhash64("text"))


def removed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **sizes: int
) -> DataFrame:
    """Per document: its words, how many are removed, and SHA-256 of the kept ones joined by a space."""
    keyed = _keyed(texts(docs, id_col, text_col))
    spans = written(repeated_spans(keyed, window, **sizes), "spans").toDF("of", "and", "spans")
    joined = _packed(keyed).join(spans, (F.col("did") == F.col("of")) & (F.col("hash") == F.col("and")), "left")

    def digest(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
        for blob, spans in zip(batch["text"], batch["spans"]):
            words = _unpacked(blob).split()
            gone = _covered(len(words), spans)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    return mapped(
        joined.select("doc_id", "text", "spans"),
        f"doc_id {id_type(keyed)}, n_words long, n_removed long, kept_sha256 string",
        digest,
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns; repeated words are cut out of ``text`` with the blanks before them.

    ``n_chars``, if there, follows the text.  Texts without repeats stay as they are.
    """
    own = docs.columns
    keyed = _keyed(texts(docs.select("doc_id", "text")))
    spans = written(repeated_spans(keyed, window), "spans").toDF("__dedup_of", "__dedup_and", "__dedup_spans")
    text = F.coalesce("text", F.lit(""))
    joined = docs.withColumns({"__dedup_did": _key(docs), "__dedup_hash": F.xxhash64(text)}).join(
        spans, (F.col("__dedup_did") == F.col("__dedup_of")) & (F.col("__dedup_hash") == F.col("__dedup_and")), "left"
    )
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            data = [batch.column(n) for n in own]
            new = []
            for old, spans in zip(batch.column("text").to_pylist(), batch.column("__dedup_spans").to_pylist()):
                if spans:
                    pieces = _PIECE.findall(old.encode())
                    gone = _covered(len(pieces), spans).tolist()
                    old = b"".join([p for p, g in zip(pieces, gone) if not g]).decode().lstrip(" \t\n\v\f\r")
                new.append(old)
            data[own.index("text")] = pa.array(new, pa.string())
            if "n_chars" in own:
                sizes = batch.column("n_chars").to_pylist()
                changed = [len(n) if s else z for n, s, z in zip(new, batch.column("__dedup_spans").to_pylist(), sizes)]
                data[own.index("n_chars")] = pa.array(changed, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(data, names=own)

    return joined.select(*own, "__dedup_spans").mapInArrow(cut, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})
), many AS (
  SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS p FROM many, (SELECT unnest(range({WINDOW})) AS k)
), kept AS (
  SELECT t.doc_id, count(*) AS n, string_agg(t.x, ' ' ORDER BY t.p) AS words
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
  ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p
  GROUP BY t.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
