"""Conversation structure repair with Four-Russians block tables.

A row of a conversation is a symbol: what its role starts with, whether it has to be
deleted, whether it breaks off.  What the rest of a conversation costs, for each of four
states (at the start, after system, after user, after assistant), is a cost vector; less
its smallest entry there are only a few dozen such vectors.  The tables hold, for every
vector and every block of ``BLOCK`` symbols, the vector before the block, what the block
adds to the cost, and the state each state comes out in.  A conversation is read from its
end, one lookup a block; then every block is expanded backward from the vector behind it
and traced forward, taking the ASCII-least edit that keeps the cost, so ties are decided
by what follows and not by the order of the work.

On Spark, rows are brought into order by ranges of (conversation, turn, ...), so one
conversation may span any number of ranges.  A range gives one segment per conversation;
only the first and the last conversation of a range can go on elsewhere.  For those,
looked up for all vectors at once, the segment is a small table too, and the tables of a
conversation are put together (one small row per range).  Texts are not gathered: repaired
rows stream through a sort by conversation.  An audit is as long as its conversation has
edits, as it is one value.

Defined results: a null role or text is one space, a null conversation a conversation of
its own, null turns come first; rows of the same turn are ordered by role and the hash of
the text, so equal rows are neighbours, and all but the first of them are duplicates (or
all are blank); roles count by their first letter, exactly ``s``, ``u`` or ``a``; gaps
that exceed a long are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import mapped, mapped_batches, table, written
from pulseframe.session import parallelism

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
#: States, and the state an insertion leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = (USER, USER, ASSISTANT, USER)
#: Symbols: to be deleted; then by first letter s, u, a, other; then the same, truncated.
SYMBOLS = 9
_NEVER = 1 << 40
_LEGAL = {(1, 2), (2, 3), (3, 2)}
BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
DAMAGE_OUT_OF = 20


def _closed(raw: list[int]) -> list[int]:
    """Costs when insertions may come first."""
    user = min(raw[USER], INSERT + raw[ASSISTANT])
    assistant = min(raw[ASSISTANT], INSERT + raw[USER])
    return [min(raw[START], INSERT + user), min(raw[SYSTEM], INSERT + user), user, assistant]


def _kept(state: int, symbol: int) -> int | None:
    """The state after a row is kept; None where it can't be."""
    first = (symbol - 1) % 4 + 1
    if first == 1:
        return SYSTEM if state == START else None
    if first == 2:
        return USER if state != USER else None
    return ASSISTANT if first == 3 and state == USER else None


def _edits(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in ASCII order, with their cost and next state; insertions aside."""
    yield "D", DELETE, state
    if symbol:
        extra = TRUNCATED if symbol > 4 else 0
        after = _kept(state, symbol)
        if after is not None:
            yield "K", KEEP + extra, after
        yield "R", REROLE + extra, ASSISTANT if state == USER else USER


class Tables:
    """Transitions of normalised cost vectors, by symbol and by block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = tuple(_closed([0, _NEVER, _NEVER, 0]))
        self.vectors, number = [end], {end: 0}
        after, added, out, text = [], [], [], []
        for vector in self.vectors:  # grows until no new vector turns up
            rows = [self._before(vector, symbol) for symbol in range(SYMBOLS)]
            for costs, *_ in rows:
                normal = tuple(c - min(costs) for c in costs)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
            after.append([number[tuple(c - min(costs) for c in costs)] for costs, *_ in rows])
            added.append([min(costs) for costs, *_ in rows])
            out.append([states for _, states, _ in rows])
            text.append([edits for _, _, edits in rows])
        self.after, self.text, self.out = after, text, out
        #: What a conversation that ends in a state still needs.
        self.tail = ["", "II", "I", ""]
        self._blocks(np.array(after), np.array(added), np.array(out))

    @staticmethod
    def _before(vector: tuple[int, ...], symbol: int):
        """Costs before a symbol, and per state the state after it and the edits taken."""
        raw = [min(cost + vector[after] for _, cost, after in _edits(s, symbol)) for s in range(4)]
        costs = _closed(raw)
        states, edits = [], []
        for state in range(4):
            taken, now = "", state
            while True:
                fits = [(e, a) for e, cost, a in _edits(now, symbol) if cost + vector[a] == costs[now]]
                if INSERT + costs[_INSERTED[now]] == costs[now]:
                    fits.append(("I", _INSERTED[now]))
                edit, after = min(fits)
                taken, now = taken + edit, after
                if edit != "I":
                    break
            states.append(now)
            edits.append(taken)
        return costs, states, edits

    def _blocks(self, after: np.ndarray, added: np.ndarray, out: np.ndarray) -> None:
        codes = np.arange(SYMBOLS**self.block)
        shape = (len(after), len(codes))
        now = np.broadcast_to(np.arange(len(after))[:, None], shape)
        cost = np.zeros(shape, np.int64)
        states = np.broadcast_to(np.arange(4), (*shape, 4))
        for k in range(self.block):  # from the last symbol of the block to its first
            symbol = np.broadcast_to(codes // SYMBOLS**k % SYMBOLS, shape)
            cost = cost + added[now, symbol]
            states = np.take_along_axis(states, out[now, symbol], axis=2)
            now = after[now, symbol]
        self.block_after, self.block_cost, self.block_out = now, cost, states
        self.lookup = now.tolist()
        self.weights = SYMBOLS ** np.arange(self.block)[::-1]

    def _cut(self, symbols: bytes) -> tuple[bytes, list[int]]:
        """The symbols before the first whole block, and the codes of the blocks."""
        head = len(symbols) % self.block
        blocks = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, self.block)
        return symbols[:head], (blocks @ self.weights).tolist()

    def summary(self, symbols: bytes) -> tuple[list[int], list[int]]:
        """For every vector behind the symbols: the one before them, and the state each state comes out in."""
        now = np.arange(len(self.vectors))
        states = np.broadcast_to(np.arange(4), (len(now), 4))
        head, codes = self._cut(symbols)
        for code in reversed(codes):
            states = np.take_along_axis(states, self.block_out[now, code], axis=1)
            now = self.block_after[now, code]
        after, out = np.array(self.after), np.array(self.out)
        for symbol in reversed(head):
            states = np.take_along_axis(states, out[now, symbol], axis=1)
            now = after[now, symbol]
        return now.tolist(), states.ravel().tolist()

    def trace(self, symbols: bytes, vector: int = 0, state: int = START) -> tuple[list[str], int]:
        """The edits of each symbol, given the vector behind them and the state before; and the state after."""
        head, codes = self._cut(symbols)
        behind = [vector]
        for code in reversed(codes):
            behind.append(self.lookup[behind[-1]][code])
        edits: list[str] = []
        at = len(head)
        state = self._expand(head, behind.pop(), state, edits)
        while behind:
            state = self._expand(symbols[at : at + self.block], behind.pop(), state, edits)
            at += self.block
        return edits, state

    def _expand(self, symbols: bytes, vector: int, state: int, edits: list[str]) -> int:
        inner = [vector]
        for symbol in reversed(symbols[1:]):
            inner.append(self.after[inner[-1]][symbol])
        for symbol in symbols:
            vector = inner.pop()
            edits.append(self.text[vector][symbol][state])
            state = self.out[vector][symbol][state]
        return state


_TABLES: list[Tables] = []


def tables() -> Tables:
    """The block tables, made once per worker."""
    if not _TABLES:
        _TABLES.append(Tables())
    return _TABLES[0]


def cost_of(edits: str, truncated: int) -> int:
    """The cost of an audit of which ``truncated`` undeleted rows are truncated."""
    return DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R") + TRUNCATED * truncated


def conversations(rows: DataFrame) -> DataFrame:
    """Only ``conv_id, turn, role, text``, nulls filled; ``key`` is the conversation as text, never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a hash of conversation and turn."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.encode(F.concat_ws(":", *names), "UTF-8")), F.lit(DAMAGE_OUT_OF))
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return (
        rows.withColumn("kind", kind)
        .where("kind <> 0")
        .withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text})
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("kind", "copy")
    )


def _first_letter(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")]


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, by ranges in order: repeats ``n``, first letter, symbol and faults."""
    names = ["key", "turn", "role", "h", "h2"]
    last = ~F.rlike(F.col("text"), F.lit(ENDED))
    blank = F.rlike(F.col("text"), F.lit(BLANK))
    each = rows.select("key", "turn", "role", *_hashes(), blank.alias("blank"), last.alias("cut"))
    each = each.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    each = written(each, "rows")
    # Duplicates are what stands later than the first row of its role and text.
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("at"))
    marked = each.where("NOT blank").withColumn("order", order)
    same = ["key", "role", "h", "h2"]
    firsts = marked.groupBy(*same).agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("times"))
    # What has no other turn needs no look at where it stands first.
    again = firsts.where("times > 1").select(*[F.col(c).alias(f"{c}_of") for c in same], "first")
    equal = (F.col("key") == F.col("key_of")) & (F.col("role") == F.col("role_of"))
    equal = equal & (F.col("h") == F.col("h_of")) & (F.col("h2") == F.col("h2_of"))
    each = each.withColumn("order", order).join(again, equal, "left")
    repeated = F.coalesce(F.col("order") > F.col("first"), F.lit(False)) & ~F.col("blank")
    letter = _first_letter(F.col("role"))
    symbol = F.when(F.col("blank") | F.col("repeated"), 0).otherwise(letter + F.when(F.col("cut"), 4).otherwise(0))
    each = each.withColumn("repeated", repeated).select(
        *names, "n", letter.alias("letter"), symbol.alias("symbol"), "blank", "repeated", "cut"
    )
    by = ["key", F.col("turn").asc_nulls_first(), "role", "h", "h2"]
    return each.repartitionByRange(parallelism(rows.sparkSession), *by).sortWithinPartitions(*by)


_SEGMENT = (
    "key string, part int, edge boolean, symbols binary, more array<long>, blank long, duplicate long,"
    " truncated long, illegal long, first int, last int, low long, high long, turns long,"
    " before array<int>, states array<int>"
)


class _Segment:
    """What a range holds of one conversation."""

    def __init__(self, key: str, letter: int):
        self.key, self.symbols, self.more = key, bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first, self.last, self.low, self.high = letter, None, None, None

    def add(self, turn, n, letter, symbol, blank, repeated, cut) -> None:
        self.symbols.append(symbol)
        self.more.append(n - 1)
        if self.last is not None:
            self.illegal += (self.last, letter) not in _LEGAL
        self.illegal += n - 1  # equal neighbours have equal letters
        self.last = letter
        if blank:
            self.blank += n
        else:
            self.duplicate += n if repeated else n - 1
            self.truncated += cut and not repeated
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, part: int, edge: bool) -> dict:
        before, states = tables().summary(bytes(self.symbols)) if edge else (None, None)
        own = {k: v for k, v in self.__dict__.items() if k not in ("symbols", "more")}
        more = self.more if any(self.more) else None
        return {**own, "symbols": bytes(self.symbols), "more": more, "part": part, "edge": edge, "before": before, "states": states}


def segments(rows: DataFrame) -> DataFrame:
    """One row per conversation and range; ``edge`` where the conversation may go on in another range."""

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        part = TaskContext.get().partitionId()
        now, edge, out = None, True, []
        for batch in batches:
            for key, *values in zip(*(batch[c] for c in columns)):
                if now is None or key != now.key:
                    if now is not None:
                        out.append(now.row(part, edge))
                        edge = False
                    now = _Segment(key, values[2])
                now.add(*values)
            if len(out) >= 1000:
                yield as_columns(out)
                out = []
        if now is not None:
            out.append(now.row(part, True))
        yield as_columns(out)

    columns = ["key", "turn", "n", "letter", "symbol", "blank", "repeated", "cut"]
    names = [c.split()[0] for c in _SEGMENT.split(",")]

    def as_columns(out: list[dict]) -> dict[str, list]:
        return {n: [r[n] for r in out] for n in names}

    return mapped_batches(ordered(rows).select(*columns), _SEGMENT, cut)


def _placed(batch: dict[str, list]) -> dict[str, list]:
    """Segments of one conversation put together: the vector behind each and the state before it."""
    out: dict[str, list] = {n: [] for n in ("k", "p", "vector", "state", "final", "joint", "shared")}
    for key, parts in zip(batch["key"], batch["parts"]):
        parts = sorted(parts, key=lambda p: p["part"])
        vectors = [0]
        for p in reversed(parts[1:]):
            vectors.append(p["before"][vectors[-1]])
        state, earlier = START, None
        for k, (p, vector) in enumerate(zip(parts, reversed(vectors))):
            row = (
                key, p["part"], vector, state, k == len(parts) - 1,
                int(earlier is not None and (earlier["last"], p["first"]) not in _LEGAL),
                int(earlier is not None and earlier["high"] is not None and earlier["high"] == p["low"]),
            )
            for name, value in zip(out, row):
                out[name].append(value)
            state = p["states"][4 * vector + state]
            earlier = p if p["high"] is not None or earlier is None else {**p, "high": earlier["high"]}
    return out


def _traced(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"audit": [], "cost": []}
    for symbols, more, vector, state, final in zip(*(batch[c] for c in ("symbols", "more", "vector", "state", "final"))):
        edits, state = tables().trace(symbols, vector, state)
        undeleted = sum(s > 4 and not e.endswith("D") for s, e in zip(symbols, edits))
        if more is not None:
            edits = [e + "D" * n for e, n in zip(edits, more)]
        audit = "".join(edits) + (tables().tail[state] if final else "")
        out["audit"].append(audit)
        out["cost"].append(cost_of(audit, undeleted))
    return {**{n: batch[n] for n in _CARRIED}, **out}


_CARRIED = ["key", "part", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]


def repairs(rows: DataFrame) -> DataFrame:
    """Per conversation (``key``) its faults, the cost of the cheapest repair and its ``audit``.

    ``rows`` as ``conversations`` gives them.
    """
    parts = written(segments(rows), "segments")
    few = F.struct("part", "before", "states", "first", "last", "low", "high")
    joint = parts.where("edge").groupBy("key").agg(F.collect_list(few).alias("parts"))
    places = "k string, p int, vector int, state int, final boolean, joint int, shared int"
    joint = mapped(joint, places, _placed)
    both = parts.join(joint, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")), "left").withColumns(
        {
            "vector": F.coalesce("vector", F.lit(0)),
            "state": F.coalesce("state", F.lit(START)),
            "final": F.coalesce("final", F.lit(True)),
            "illegal": F.col("illegal") + F.coalesce("joint", F.lit(0)),
            "turns": F.col("turns") - F.coalesce("shared", F.lit(0)),
        }
    )
    kinds = "key string, part int, " + ", ".join(f"{n} long" for n in _CARRIED[2:]) + ", audit string, cost long"
    traced = mapped(both.select(*_CARRIED, "symbols", "more", "vector", "state", "final"), kinds, _traced)
    pieces = F.array_sort(F.collect_list(F.struct("part", "audit")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")]
    whole = traced.groupBy("key").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), pieces.alias("pieces"))
    gaps = F.expr("try_cast(cast(high AS decimal(38,0)) - low + 1 - turns AS bigint)")
    return whole.select(
        "key",
        F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(gaps).alias("gaps"),
        *["blank", "duplicate", "truncated", "illegal", "cost"],
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"),
    )


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``key, edit, role, text`` in order, deleted rows left out.

    ``audits`` has key and audit.  Conversations are contiguous, and rows in order, within
    the partitions of the result; a task holds one audit and one batch of rows.
    """
    nothing = F.lit(None).cast("long")
    lead = audits.select("key", F.lit(0), nothing, "audit", F.lit(""), nothing, nothing)
    every = rows.select("key", F.lit(1).alias("tag"), "turn", "role", "text", *_hashes())
    by = ["key", "tag", F.col("turn").asc_nulls_first(), "role", "h", "h2"]
    every = every.union(lead).repartition("key").sortWithinPartitions(*by).select("key", "tag", "role", "text")

    def apply(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        audit, body, at, state = "", 0, 0, START
        for batch in batches:
            out: list[tuple] = []
            for key, tag, role, text in zip(*(batch[c] for c in ("key", "tag", "role", "text"))):
                if tag == 0:
                    audit, body, at, state = role, len(role.rstrip("I")), 0, START
                    continue
                upto = at
                while audit[upto] == "I":
                    upto += 1
                state = _inserted(out, key, audit[at:upto], state)
                edit, at = audit[upto], upto + 1
                if edit == "K":
                    state = _kept(state, "sua".index(role[0]) + 1)
                    out.append((key, edit, role, text))
                elif edit == "R":
                    state = ASSISTANT if state == USER else USER
                    out.append((key, edit, _NAMES[state], text))
                if at == body:
                    state = _inserted(out, key, audit[at:], state)
            yield {n: [o[i] for o in out] for i, n in enumerate(("key", "edit", "role", "text"))}

    return mapped_batches(every, "key string, edit string, role string, text string", apply)


_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _inserted(out: list[tuple], key: str, edits: str, state: int) -> int:
    for _ in edits:
        state = _INSERTED[state]
        out.append((key, "I", _NAMES[state], ""))
    return state


def text_digests(rows: DataFrame) -> DataFrame:
    """``key, digest``: SHA-256 of the ``role:text`` lines of each conversation of ``repaired``."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        now, state = None, None
        for batch in batches:
            out: dict[str, list] = {"key": [], "digest": []}
            for key, role, text in zip(*(batch[c] for c in ("key", "role", "text"))):
                if state is None or key != now:
                    if state is not None:
                        out["key"].append(now)
                        out["digest"].append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield out
        if state is not None:
            yield {"key": [now], "digest": [state.hexdigest()]}

    return mapped_batches(rows, "key string, digest string", run)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = conversations(table(spark, sf_dir, "conversations"))
    rows = damaged(original)
    found = written(repairs(rows), "repairs")
    hashes = text_digests(repaired(rows, found.select("key", "audit"))).withColumnRenamed("key", "of")
    every = original.select("key", "conv_id").distinct().withColumnRenamed("key", "own")
    both = every.join(found, F.col("own") == F.col("key"), "left").join(hashes, F.col("own") == F.col("of"), "left")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(c, none).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(
        "conv_id",
        F.when(F.col("key").isNull(), none).otherwise(F.col("gaps")).alias("gaps"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
