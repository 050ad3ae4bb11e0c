"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, every one of them encoded.  Only documents carry labels,
so the model learns which passages to look at: gated attention

    a_k  ~  exp(w . (tanh(V h_k) * sigmoid(U h_k))),    score = sigmoid(c . sum_k a_k h_k + b)

over the encoded passages h_k.  It is fitted on the driver with a bounded sample of the
labelled rows (at most ``TRAIN_ROWS`` documents with at most ``TRAIN_PASSAGES`` passages
together, each document whole); scoring runs over every passage of every document in Arrow batches.

A passage is encoded by what its characters and words look like: frequencies of pairs of
character classes, word lengths, and how much of it repeats.  Key, language and source are
not looked at.

Defined results: a null or empty text is one passage without words; a document with a null
key counts as not held out and has no label; equal texts have equal scores; rows without a
label are not learnt from; with labels of one class only, or none, the score is the same for
all: their mean, or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import id_type, mapped, table, texts

PASSAGE_WORDS = 64
#: Bounds of the training sample: labelled documents, and passages of all of them together.
TRAIN_ROWS = 6000
TRAIN_PASSAGES = 120_000
HIDDEN = 16
STEPS = 1500
BAGS_PER_STEP = 64

# Character classes: lower, upper, digit, blank, line end, stop, comma, exclamation, other
# punctuation, bar, symbols, non-ASCII.
CLASSES = 12
_CLASS = np.full(256, 8, np.int64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[ord(".")] = 5
_CLASS[ord(",")] = 6
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 9
_CLASS[[ord(c) for c in "#*$%&<>"]] = 10
_CLASS[0x80:] = 11
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WIDTH = CLASSES * CLASSES + 6


def _repeats(hashes: np.ndarray, size: int) -> np.ndarray:
    """Words that lie in a run of ``size`` words which the text holds more than once."""
    out = np.zeros(len(hashes), bool)
    count = len(hashes) - size + 1
    if count < 2:
        return out
    mixed = np.zeros(count, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    for at in (order[1:][same], order[:-1][same]):
        for k in range(size):
            out[at + k] = True
    return out


def encode(text: str | None) -> np.ndarray:
    """All passages of a text, one row each."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    n = len(starts)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    passages = -(-n // PASSAGE_WORDS)
    of_word = np.arange(n) // PASSAGE_WORDS
    words = np.bincount(of_word, minlength=passages).astype(np.float64)
    first = np.zeros(len(raw), np.int64)
    first[starts[PASSAGE_WORDS::PASSAGE_WORDS]] = 1
    of_byte = np.cumsum(first)
    kind = _CLASS[raw]
    pairs = of_byte[1:] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:]
    table = np.bincount(pairs, minlength=passages * CLASSES**2).reshape(passages, -1)
    frequencies = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
    data = raw.tobytes()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n
    )
    twin = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    mixed = (hashes ^ of_word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    _, distinct = np.unique(mixed, return_index=True)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=mask, minlength=passages) / words

    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    extra = np.stack(
        [
            np.log1p(words) / 5,
            np.bincount(of_word, weights=ends - starts, minlength=passages) / words / 10,
            share(twin),
            np.bincount(of_word[distinct], minlength=passages) / words,
            share(_repeats(hashes, 3)),
            share(upper[ends] - upper[starts] > 1),
        ],
        axis=1,
    )
    return np.concatenate([frequencies, extra], axis=1).astype(np.float32)


@dataclass
class Model:
    """Weights of the gated attention and of the score, and the scaling of the input."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def scaled(self, passages: np.ndarray) -> np.ndarray:
        return np.clip((passages - self.mean) * self.scale, -6, 6)

    def score(self, passages: np.ndarray) -> float:
        h = self.scaled(passages)
        gate = np.tanh(h @ self.v) / (1 + np.exp(-(h @ self.u)))
        e = gate @ self.w
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h @ self.c + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on the mean log loss, with a small weight penalty."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    sizes = np.array([len(b) for b in bags])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Widened and scaled batch by batch: the sample stays as narrow as it came.
    parts = [slice(k, k + 8192) for k in range(0, len(rows), 8192)]
    mean = sum(rows[p].astype(np.float64).sum(axis=0) for p in parts) / len(rows)
    deviation = np.sqrt(sum(((rows[p].astype(np.float64) - mean) ** 2).sum(axis=0) for p in parts) / len(rows))
    # Values that hardly vary in the sample would be blown up by their deviation.
    scale = 1 / np.maximum(deviation, 0.02)
    width = rows.shape[1]
    model = Model(
        mean,
        scale,
        rng.normal(0, width**-0.5, (width, HIDDEN)),
        rng.normal(0, width**-0.5, (width, HIDDEN)),
        rng.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(width),
        0.0,
    )
    state = {n: [0.0, 0.0] for n in "vuwcb"}
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(bags), min(BAGS_PER_STEP, len(bags)))
        of = np.repeat(np.arange(len(pick)), sizes[pick])
        cuts = np.concatenate(([0], np.cumsum(sizes[pick])[:-1]))
        h = model.scaled(rows[np.repeat(starts[pick] - cuts, sizes[pick]) + np.arange(len(of))].astype(np.float64))
        t, s = np.tanh(h @ model.v), 1 / (1 + np.exp(-(h @ model.u)))
        e = (t * s) @ model.w
        a = np.exp(e - np.maximum.reduceat(e, cuts)[of])
        a /= np.add.reduceat(a, cuts)[of]
        z = np.add.reduceat(a[:, None] * h, cuts)
        p = 1 / (1 + np.exp(-np.clip(z @ model.c + model.b, -30, 30)))
        error = (p - labels[pick]) / len(pick)
        # Through the softmax: each passage moves the score by its distance to the bag's mean.
        reach = (h - z[of]) @ model.c
        to_gate = (error[of] * a * reach)[:, None] * model.w
        grads = {
            "c": z.T @ error + 1e-4 * model.c,
            "b": error.sum(),
            "w": (t * s).T @ (error[of] * a * reach),
            "v": h.T @ (to_gate * s * (1 - t * t)),
            "u": h.T @ (to_gate * t * s * (1 - s)),
        }
        for name, g in grads.items():
            m, v = state[name]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = [m, v]
            move = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            setattr(model, name, getattr(model, name) - move)
    return model


def fold(id_col: str = "doc_id") -> Column:
    """CRC-32 of the key's decimal text modulo 3; 1 is held out of learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def passages_of(text: str | None) -> int:
    return max(-(-len((text or "").encode().split()) // PASSAGE_WORDS), 1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    rows: int = TRAIN_ROWS,
    passages: int = TRAIN_PASSAGES,
) -> Model | float:
    """Learn from labelled documents that are not held out; a constant if there is nothing to tell apart.

    Documents come in the order of a hash of their key; one that would exceed ``passages``
    is left out, the others are learnt from with every passage.
    """
    known = labels.select(labels["doc_id"].alias("_id"), labels[label_col].cast("int").alias("label"))
    # At most ``rows`` rows of two numbers, chosen by a hash of the key.
    known = known.where((fold("_id") != 1) & F.col("label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    picked = texts(docs)
    joined = picked.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")

    def counted(batch: dict[str, list]) -> dict[str, list]:
        return {**{n: batch[n] for n in ("doc_id", "label")}, "n": [passages_of(t) for t in batch["text"]]}

    def encoded(batch: dict[str, list]) -> dict[str, list]:
        return {
            "doc_id": batch["doc_id"],
            "label": batch["label"],
            "bag": [encode(t).astype(np.float16).tobytes() for t in batch["text"]],
        }

    kind = id_type(picked)
    # Rows that repeat a key are one example, so that ``rows`` bounds what comes here.
    sizes = mapped(joined, f"doc_id {kind}, label int, n int", counted).groupBy("doc_id").agg(F.max("n").alias("n"))
    chosen, left = [], passages
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left:
            chosen.append((r["doc_id"],))
            left -= r["n"]
    if not chosen:
        return 0.5
    own = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"_own {kind}"))
    bags = mapped(joined.join(own, F.col("doc_id") == F.col("_own")).drop("_own"), f"doc_id {kind}, label int, bag binary", encoded)
    got = bags.groupBy("doc_id", "label").agg(F.min("bag").alias("bag")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"]))
    y = np.array([r["label"] for r in got], np.float64)
    if y.min() == y.max():
        return float(y[0])
    return fit([np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in got], y)


def score_of(model: Model | float, text: str | None) -> float:
    return model if isinstance(model, float) else model.score(encode(text))


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` of every document."""
    picked = texts(docs)

    def score(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "score": [score_of(model, t) for t in batch["text"]]}

    return mapped(picked, f"doc_id {id_type(picked)}, score double", score)


def good_documents(docs: DataFrame, model: Model | float) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least one half."""

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([score_of(model, t) >= 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return result.select(
        "doc_id",
        (fold() == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
