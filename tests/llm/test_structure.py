"""Conversation repair, whitening and vantage-point trees against brute force."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import conversations as conv
from pulseframe.llm import vptrees, whitening
from pulseframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


# ---- 11 conversations


def cheapest(symbols):
    """Every edit string, longest first dropped: least cost and, at a tie, ASCII-least."""
    best = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for s, (cost, edits) in list(states.items()):
                to, new = (3, 2)[s != 2], (cost + 3, edits + "I")
                if to not in states or new < states[to]:
                    states[to] = new
        return states

    for symbol in symbols:
        after = {}
        for s, (cost, edits) in inserted(best).items():
            ways = [("D", 4, s)]
            if symbol:
                extra, letter = (3 if symbol > 4 else 0), (symbol - 1) % 4
                ways.append(("R", 3 + extra, 3 if s == 2 else 2))
                if letter == 0 and s == 0:
                    ways.append(("K", extra, 1))
                if letter == 1 and s != 2:
                    ways.append(("K", extra, 2))
                if letter == 2 and s == 2:
                    ways.append(("K", extra, 3))
            for edit, more, to in ways:
                new = (cost + more, edits + edit)
                if to not in after or new < after[to]:
                    after[to] = new
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def brute_repair(rows, damage=False):
    """All result columns by conversation, from (conv_id, turn, role, text) rows."""
    by = {}
    for key, turn, role, text in rows:
        own = by.setdefault(key, [])
        role, text, times = " " if role is None else role, " " if text is None else text, 1
        if damage:
            kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            role, times = ("user" if kind == 4 else role), {0: 0, 3: 2}.get(kind, 1)
        own += [(turn, role, text)] * times
    out = {}
    for key, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], text_hash(r[2])))
        seen, symbols, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            if not body:
                blank += 1
                symbols.append(0)
            elif (role, text) in seen:
                duplicate += 1
                symbols.append(0)
            else:
                cut = body[-1] not in ".!?"
                truncated += cut
                symbols.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 4) + 4 * cut)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, audit = cheapest(symbols) if own else (0, "")
        lines, letters, left = [], "", iter(own)
        for edit in audit:
            if edit != "I":
                _, role, text = next(left)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if letters.endswith("u") else "user"
            lines.append(f"{role}:{'' if edit == 'I' else text}")
            letters += role[0]
        assert re.fullmatch("(s?(ua)+)?", letters) and not list(left)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[key] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair(spark, rows):
    own = conv.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int, h int"))
    found = conv.repairs(own)
    hashes = conv.text_digests(conv.repaired(own, found.select("key", "audit")))
    digests = {r["key"]: r["digest"] for r in hashes.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    number = lambda key: int(key[1:]) if key else None
    return {number(r["key"]): (*(r[c] for c in COLUMNS), digests.get(r["key"], nothing)) for r in found.collect()}


@pytest.mark.parametrize("block", [1, 2, 4])
def test_block_tables(block):
    t = conv.Tables(block)
    rng = random.Random(block)
    for _ in range(1500):
        symbols = bytes(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(15)))
        edits, state = t.trace(symbols)
        audit = "".join(edits) + t.tail[state]
        undeleted = sum(s > 4 and not e.endswith("D") for s, e in zip(symbols, edits))
        assert (conv.cost_of(audit, undeleted), audit) == cheapest(symbols)
        # Any cut into two segments gives the same, from their summaries.
        at = rng.randrange(len(symbols) + 1)
        vector = t.summary(symbols[at:])[0][0]
        head, middle = t.trace(symbols[:at], vector)
        assert middle == t.summary(symbols[:at])[1][4 * vector]
        tail, last = t.trace(symbols[at:], 0, middle)
        assert head + tail == edits and last == state


def test_repair(spark):
    rng = random.Random(11)
    long_text = "a very long text " * 20_000 + "."
    rows = [
        (1, 0, "system", "s."), (1, 1, "user", "u!"), (1, 2, "assistant", "a?  \n"),
        (2, 0, "user", "same."), (2, 1, "assistant", "x."), (2, 2, "user", "same."), (2, 9, "assistant", "y"),
        (3, None, "user", "no turn."), (3, None, "user", "no turn."), (3, 4, "assistant", "b."),
        (None, 1, "user", "null key."), (None, 2, None, None), (None, None, None, "c."),
        (4, 0, "tool", "t."), (5, 0, "assistant", ""), (6, 0, "system", "only."), (7, 3, "", "x."),
        (8, -5, "user", long_text), (8, 2**62, "assistant", long_text), (9, 0, "user", "q. "), (9, 1, "user", " "),
        (10, -(2**63), "user", "first."), (10, 2**63 - 1, "assistant", "last."),
    ]
    for k in range(100, 160):
        for turn in range(rng.randrange(1, 12)):
            rows.append((k, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", "system", "u", "bot"]), rng.choice(["a.", "b", " ", f"t{turn}.", "é!"])))
    want = brute_repair(rows)
    want[10] = (None, *want[10][1:])  # more gaps than a long holds
    assert repair(spark, [(*r, 0, 0) for r in rows]) == want
    assert repair(spark, []) == {}


def test_a_conversation_over_all_ranges(spark):
    rng = random.Random(5)
    rows = [
        (1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["ok.", "no", "", f"{t}."]))
        for t in range(4000)
    ]
    rows += [(1, 17, "user", "again.")] * 500 + [(0, 0, "user", "u."), (2, 0, "user", "u.")]
    assert repair(spark, [(*r, 0, 0) for r in rows]) == brute_repair(rows)


@tables
@pytest.mark.parametrize("sf", [SF, LARGER])
def test_op11(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, sf).collect()
    assert {r["conv_id"]: (*(r[c] for c in COLUMNS), r["repaired_sha256"]) for r in got} == brute_repair(rows, True)
    assert len(got) == len({r[0] for r in rows})


def test_op11_odd(spark, tmp_path):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, 5, None, "b!"), (2, 7, "user", None)]
    rows += [(k, t, "assistant" if t % 2 else "user", f"x{t}. y?" * (t % 3)) for k in range(3, 60) for t in range(3)]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped."))
    schema = "conv_id long, turn long, role string, text string, audit string, key int"
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, f"{tmp_path}/a").collect()
    assert {r["conv_id"]: (*(r[c] for c in COLUMNS), r["repaired_sha256"]) for r in got} == brute_repair(rows, True)
    assert [(r["gaps"], r["audit"]) for r in got if r["conv_id"] == gone] == [(0, "")]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, f"{tmp_path}/b").collect() == []


# ---- 12 whitening


@pytest.mark.parametrize("kind", ["plain", "wide", "repeated", "deficient", "identity"])
def test_leading_eigenpairs(kind):
    rng = np.random.default_rng(len(kind))
    for size in (1, 2, 5, 17, 40):
        a = rng.standard_normal((size, size))
        q = np.linalg.qr(a)[0]
        matrix = {
            "plain": a @ a.T,
            "wide": q @ np.diag(10.0 ** -np.linspace(0, 12, size)) @ q.T,
            "repeated": q @ np.diag(np.repeat([5.0, 2.0, 1.0], size)[:size]) @ q.T,
            "deficient": a[:, : size // 2 + 1] @ a[:, : size // 2 + 1].T,
            "identity": 3.0 * np.eye(size),
        }[kind]
        matrix = (matrix + matrix.T) / 2
        true = np.linalg.eigvalsh(matrix)[::-1]
        for shift in (*rng.standard_normal(4) * 3, (true[0] + true[-1]) / 2 + 0.01):
            assert whitening.inertia(matrix, shift) == int((true < shift).sum())
        values, vectors = whitening.leading(matrix, 16)
        assert np.allclose(values, true[: len(values)], rtol=0, atol=1e-13 * true[0] * size)
        assert len(values) >= min(16, int((true > 1e-11 * true[0]).sum()))
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * true[0] * size
    assert len(whitening.leading(np.zeros((3, 3)), 16)[0]) == 0


def brute_whitening(rows):
    vectors = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    distinct = np.unique(vectors, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    z = distinct - total / n
    values, directions = np.linalg.eigh(z.T @ z / n)
    values, directions = values[::-1][:16], directions[:, ::-1][:, :16]
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, total)) for x in vectors]
    return n, deviations, (vectors - total / n) @ directions / np.sqrt(values), values / np.trace(z.T @ z / n)


def write_vectors(spark, path, rows):
    schema = "vec_id long, embedding array<float>, x int, v int, h string"
    spark.createDataFrame([(*r, 1, 2, "h") for r in rows], schema).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def by_component(got):
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    keys = [k for k, _ in itertools.groupby(r["vec_id"] for r in got)]
    return keys, np.array([r["whitened"] for r in got]).reshape(len(keys), -1), got


def test_op12(spark, tmp_path):
    rng = np.random.default_rng(12)
    good = [(k, (rng.standard_normal(20) * rng.uniform(0.1, 9, 20)).astype(np.float32).tolist()) for k in range(300)]
    good += [(k, good[0][1]) for k in range(300, 450)]  # a third are copies
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [nan] * 20), (903, [inf] + [0.0] * 19), (904, [None] * 20), (905, [1.0] * 7), (906, [1e30] * 20)]
    path = write_vectors(spark, tmp_path / "a", good + odd)
    keys, whitened, got = by_component(QUERIES["op12_embedding_whitening"](spark, path).collect())
    n, deviations, want, explained = brute_whitening(good)
    assert keys == [k for k, _ in good] and {r["n"] for r in got} == {n} and whitened.shape == want.shape
    assert [r["deviation"] for r in got if r["component"] == 1] == deviations
    signs = np.sign((whitened * want).sum(axis=0))
    assert np.abs(whitened - want * signs).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-10)
    assert {r["identity_error"] for r in got} < {r["identity_error"] for r in got} | {1} and got[0]["identity_error"] < 1e-9
    assert [r["component"] for r in got[:16]] == list(range(1, 17))


def test_op12_without_spread(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, [0.5, 0.25]), (2, [0.5, 0.25])]), ("bad", [(1, None)])):
        path = write_vectors(spark, tmp_path / name, rows)
        assert QUERIES["op12_embedding_whitening"](spark, path).collect() == []
    line = [(k, [0.25 * k, 1.0, 0.5 * k]) for k in range(9)] + [(3, [0.75, 1.0, 1.5]), (None, [0.0, 1.0, 0.0])]
    got = QUERIES["op12_embedding_whitening"](spark, write_vectors(spark, tmp_path / "line", line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 11
    assert {round(r["explained"], 12) for r in got} == {1.0} and len({r["vec_id"] for r in got}) == 10


def test_exact_sums_of_large_entries():
    y = np.array([[1 << 35, 3], [-(1 << 35), 5]], np.int64)
    assert whitening._gram(y).tolist() == [[2 << 70, -2 << 35], [-2 << 35, 34]]
    model = whitening.Whitening(1 << 20, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(np.array([[3, -4], [1 << 36, 0]], np.int64)) == [25 << 40, None]


# ---- 13 vantage-point trees


def brute_nearest(rows, queries, count=10):
    out = {}
    for q in queries:
        key, vector = rows[q]
        far = [(float(np.sqrt(((np.array(vector) - np.array(v)) ** 2).sum())), k is None, k or 0, k) for i, (k, v) in enumerate(rows) if i != q]
        out[key] = [(d, k) for d, _, _, k in sorted(far, key=lambda x: x[:3])[:count]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptrees, "SAMPLE", 40)
    monkeypatch.setattr(vptrees, "QUERIES", 7)
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((12, 6)) * 5
    rows = [(k, (centres[k % 12] + rng.standard_normal(6) * 0.2).tolist()) for k in range(700)]
    rows += [(k, rows[1][1]) for k in range(700, 1000)]  # a third are copies
    rows += [(None, rows[1][1]), (None, rows[2][1]), (100, rows[5][1])]
    df = vptrees.usable(spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, v int"))
    asked = [i for i, (k, _) in enumerate(rows) if k is not None and k % 25 == 0 and i != 1002]
    wanted = df.where("vec_id % 25 = 0").join(df.where("vec_id = 5").select(F.col("v").alias("w")), F.col("v") == F.col("w"), "left_anti")
    got = found(vptrees.nearest(df, wanted, factor=1.0, shard=100))
    assert got == brute_nearest(rows, asked)
    some = found(vptrees.nearest(df, wanted, factor=3.0, shard=100))
    assert all(len(x) == 10 for x in some.values()) and some.keys() == got.keys()
    hits = sum(len({k for _, k in some[q]} & {k for _, k in got[q]}) for q in got)
    assert hits >= 9 * len(got)


def test_trees_prune():
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 1, (5000, 3))
    tree = vptrees.Tree(points, leaf=16)
    queries = points[:50]
    got, visited = tree.search(queries, np.full(50, np.inf), 11)
    for q, rows in zip(queries, got):
        best = np.sort(vptrees.distances(q, points))[:11]
        assert np.array_equal(np.sort(vptrees.distances(q, points[rows]))[:11], best)
    assert visited.mean() < 1500 and tree.search(queries, np.full(50, np.inf), 11, 4.0)[1].mean() < visited.mean()


def test_op13_odd(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (100, [0.0, 0.0]), (200, [nan, 1.0]), (300, [inf, 1.0]), (400, [None, 1.0]), (500, [1.0]), (600, [])]
    good = [(700, [1.0, 0.0]), (700, [1.0, 0.0]), (5, [0.0, 1.0]), (None, [3.0, 0.0]), (6, [-0.0, 1.0])]
    got = found(QUERIES["op13_vantage_search"](spark, write_vectors(spark, tmp_path / "a", odd + good)))
    assert got == {700: [(0.0, 700), (2**0.5, 5), (2**0.5, 6), (2.0, None)]}
    assert found(QUERIES["op13_vantage_search"](spark, write_vectors(spark, tmp_path / "b", []))) == {}
    assert found(QUERIES["op13_vantage_search"](spark, write_vectors(spark, tmp_path / "c", [(100, [2.0])]))) == {}


@tables
@pytest.mark.parametrize("sf", [SF, LARGER])
def test_op13_recall(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, [i for i, (k, _) in enumerate(rows) if k % 100 == 0])
    got = found(QUERIES["op13_vantage_search"](spark, sf))
    hits = sum(len({k for _, k in got[q]} & {k for _, k in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and got.keys() == want.keys()
