"""Byte-level BPE in recursive DuckDB queries, one engine per Python worker.

Spark deals documents to tasks in Arrow batches.  In a task, texts are cut into words by
the tokenizer's pattern, and the distinct words that the worker has not met yet go into
one recursive query: token-position rows join the merge table, each word contracts its
leftmost pair of the smallest rank, and words without a mergeable pair drop out, until
none is left.  Ordered aggregation over the vocabulary turns ids back into bytes.

No token holds two bytes side by side that no token of the vocabulary has side by side, so
words are first cut there; the parts do not influence each other.  Long parts contract
many places of their smallest pair in one round, two tokens apart or more; that equals
contracting them one by one unless a merge creates a pair of smaller rank than its own,
which is checked, and such parts are done again one pair at a time.

Memory: a worker keeps at most ``KEEP_WORDS`` words with their ids beside those of the texts
at hand, a query takes at most ``ROUND_BYTES`` bytes of words (or one longer word), and DuckDB
has a limit and no spill folder.  Time of a part without cuts grows with its length times its
number of different merges.

Defined results: a null or empty text has no ids; equal texts have equal ids; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.common import id_type, mapped_batches, table, texts

RANKS = "byte_bpe_50k.tiktoken"
#: Words kept by a worker and their characters; texts (in characters), words and bytes of one round of work.
KEEP_WORDS = 500_000
KEEP_CHARS = 20_000_000
ROUND_CHARS = 4_000_000
ROUND_WORDS = 80_000
ROUND_BYTES = 1_000_000
#: Parts with more bytes than this contract many places at once.
LONG_PART = 64
MEMORY = "350MB"

# The smallest rank and then the leftmost place, in one number: rank << 32 | place.
ONE_BY_ONE = """
WITH RECURSIVE state(w, ids) USING KEY (w) AS (
  SELECT w, list(id ORDER BY p) FROM bytes_in GROUP BY w
  UNION
  SELECT s.w, list_concat(list_append(ids[:(best & 4294967295) - 1], best >> 32), ids[(best & 4294967295) + 2:])
  FROM state s JOIN (
    SELECT w, min((m.made << 32) + p) AS best
    FROM (SELECT w, unnest(list_zip(ids, ids[2:])) AS z, unnest(range(1, len(ids) + 1)) AS p FROM state)
    JOIN merges m ON m.pair = z[1]::BIGINT * 4294967296 + z[2]
    GROUP BY w) b ON b.w = s.w
)
SELECT w, ids, false AS again FROM state
"""

MANY = """
WITH RECURSIVE state(w, ids, last, again) USING KEY (w) AS (
  SELECT w, list(id ORDER BY p), -1, false FROM bytes_in GROUP BY w
  UNION
  (WITH tokens AS (
    SELECT w, last, again, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS p FROM state
  ), pairs AS (
    SELECT *, lead(id) OVER (PARTITION BY w ORDER BY p) AS following FROM tokens
  ), least AS (
    SELECT w, p, m.made FROM pairs JOIN merges m ON m.pair = id::BIGINT * 4294967296 + following
    QUALIFY m.made = min(m.made) OVER (PARTITION BY w)
  ), opened AS (
    SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY w ORDER BY p) <= 2 THEN NULL ELSE p END AS opens FROM least
  ), places AS (
    SELECT w, p, made FROM (
      SELECT *, max(opens) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING) AS start FROM opened)
    WHERE (p - start) % 4 = 0
  )
  SELECT t.w, list(coalesce(here.made, t.id) ORDER BY t.p) FILTER (WHERE before.w IS NULL), any_value(one.made),
         any_value(t.again) OR any_value(one.made) < any_value(t.last)
  FROM tokens t JOIN (SELECT w, any_value(made) AS made FROM places GROUP BY w) one ON one.w = t.w
  LEFT JOIN places here ON here.w = t.w AND here.p = t.p
  LEFT JOIN places before ON before.w = t.w AND before.p = t.p - 1
  GROUP BY t.w)
)
SELECT w, ids, again FROM state
"""

# Parts of a word follow each other in the order of their numbers.  The engine has one
# thread, so the aggregates take the rows as they were sorted.
DECODE = """
SELECT word, string_agg(id, ' '), string_agg(digits, '')
FROM (
  SELECT word, id, digits
  FROM (SELECT w, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM found)
  JOIN owner USING (w) JOIN vocabulary USING (id)
  ORDER BY word, w, p)
GROUP BY word
"""


class Coder:
    """The vocabulary and merge table of a rank file in a DuckDB of its own."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        # White space as Unicode has it; the library's \s also takes four separators of ASCII.
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.beside = np.zeros((256, 256), bool)
        merges: list[tuple[int, int]] = []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                self.beside[token[k - 1], token[k]] = True
                first, second = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if first is not None and second is not None:
                    merges.append((first << 32 | second, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._load("merges", {n: pa.array(c, pa.int64()) for n, c in zip(("pair", "made"), zip(*merges))})
        self._load("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "digits": [t.hex() for t in self.ranks]})
        self.known: dict[str, tuple[str, bytes]] = {}

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode words and decode their ids, and keep both."""
        raw = [w.encode() for w in words]
        # A word that is a token as a whole is that token.
        self.known.update((w, (str(self.ranks[r]), r)) for w, r in zip(words, raw) if r in self.ranks)
        words = [w for w, r in zip(words, raw) if r not in self.ranks]
        # Rounds are bounded in words and in bytes, also within one text.
        at, size = 0, 0
        for k, word in enumerate(words):
            own = len(word.encode())
            if k > at and (k - at >= ROUND_WORDS or size + own > ROUND_BYTES):
                self._learn(words[at:k])
                at, size = k, 0
            size += own
        if at < len(words):
            self._learn(words[at:])

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        of_word = np.repeat(np.arange(len(raw)), sizes)
        cut = np.ones(len(data), bool)
        cut[1:] = (of_word[1:] != of_word[:-1]) | ~self.beside[data[:-1], data[1:]]
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(data)))
        part = np.cumsum(cut) - 1
        place = np.arange(len(data)) - starts[part]
        is_long = lengths[part] > LONG_PART
        self._load("owner", {"w": np.arange(len(starts)), "word": of_word[starts]})
        self.db.execute("CREATE OR REPLACE TABLE found (w BIGINT, ids INTEGER[], again BOOLEAN)")
        self._contract(ONE_BY_ONE, part, place, data, ~is_long)
        self._contract(MANY, part, place, data, is_long)
        again = [w for (w,) in self.db.execute("DELETE FROM found WHERE again RETURNING w").fetchall()]
        self._contract(ONE_BY_ONE, part, place, data, np.isin(part, again))
        for k, text, digits in self.db.execute(DECODE).fetchall():
            self.known[words[k]] = (text, bytes.fromhex(digits))

    def _contract(self, query, part, place, data, chosen) -> None:
        """Run one of the recursions on the chosen bytes and add what it finds."""
        if chosen.any():
            columns = {"w": part[chosen], "p": place[chosen], "id": self.of_byte[data[chosen]]}
            self._load("bytes_in", {n: pa.array(c, pa.int32()) for n, c in columns.items()})
            self.db.execute(f"INSERT INTO found {query}")

    def documents(self, batch: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids as text, joined by a space, and decoded bytes of each text."""
        at = 0
        while at < len(batch):
            cut, chars = [], 0
            while at < len(batch) and (not cut or chars + len(batch[at]) <= ROUND_CHARS):
                cut.append(self.words.findall(batch[at]))
                chars += len(batch[at])
                at += 1
            if len(self.known) > KEEP_WORDS or sum(map(len, self.known)) > KEEP_CHARS:
                self.known.clear()
            new = {w for words in cut for w in words if w not in self.known}
            if new:
                self.learn(sorted(new))
            for words in cut:
                found = [self.known[w] for w in words]
                yield " ".join([f[0] for f in found]), b"".join([f[1] for f in found])


@cache
def coder(path: str, pattern: str) -> Coder:
    """One per worker: the merge table is built once for all its tasks."""
    return Coder(path, pattern)


def encoded(
    docs: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document its ids and the text they decode to."""
    return _per_document(
        docs, path, pattern, id_col, text_col, "ids array<int>, decoded binary",
        lambda ids, data: {"ids": list(map(int, ids.split())), "decoded": data},
    )


def _per_document(docs, path, pattern, id_col, text_col, schema, row) -> DataFrame:
    picked = texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            rows = [row(*one) for one in coder(path, pattern).documents(batch["text"])]
            yield {"doc_id": batch["doc_id"], **{n: [r[n] for r in rows] for n in names}}

    names = [part.split()[0] for part in schema.split(", ")]
    return mapped_batches(picked, f"doc_id {id_type(picked)}, {schema}", run)


def token_digests(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document the number of ids and SHA-256 of the ids and of the decoded bytes."""
    return _per_document(
        docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, data: {
            "n_tokens": ids.count(" ") + 1 if ids else 0,
            "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(data).hexdigest(),
        },
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
