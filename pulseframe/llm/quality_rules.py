"""Quality rules as a ledger of bits.

Every rule is evaluated once per document.  The ledger keeps what was measured and one
failure bit per rule; a policy is a named, versioned set of rules, that is a mask, and
is applied to the ledger later without a look at any text.  What each rule of a policy
costs (the ablation) comes from sums over the bits.

Defined results: a null or empty text has no words, so it fails ``few_words``; equal
rows give equal rows; an empty table gives an empty ledger and ablation sums of 0.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import id_type, mapped, table, texts, written

#: Measurements, in the order of the ledger's columns.
MEASURES = (
    "n_words n_chars word_chars n_symbols n_bangs n_upper n_letters n_lines n_dup_lines n_repeat_words n_same_words".split()
)

#: Rules by bit; true is a failure.  Counts are compared, so nothing is divided by zero.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "exclamations": "10 * n_bangs > 3 * n_words",
    "upper_case": "10 * n_upper > 4 * n_letters",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "stutter": "100 * n_same_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: Policies by version; a policy rejects a document that fails one of its rules.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "exclamations", "duplicate_lines"],
    "v2": list(RULES),
}

# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
# Bytes of letters: ASCII letters, and every byte of a non-ASCII character.
_NO_LETTERS = bytes(c for c in range(0x80) if not chr(c).isalpha())
_WINDOW = 5


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    count = len(words) - _WINDOW + 1
    if count < 2:
        return 0
    # A window is known by a 64-bit mix of its words' hashes; windows are compared
    # within one text only, so that a clash of two is out of reach.
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(count, np.uint64)
    for k in range(_WINDOW):
        mixed = (mixed ^ h[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    steps[at] += 1
    steps[at + _WINDOW] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """All measurements of a text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    letters = raw.translate(None, _NO_LETTERS)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] * bool(words)
    return (
        len(words),
        len(text),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        raw.count(b"!"),
        upper,
        len(letters),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated(words),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The bits of the rules of a policy."""
    return sum(bit(rule) for rule in POLICIES[policy])


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document all measurements and ``failures``, a bit for every failed rule."""

    def measured(batch: dict[str, list]) -> dict[str, list]:
        columns = list(zip(*map(measure, batch["text"]))) or [()] * len(MEASURES)
        return {"doc_id": batch["doc_id"], **dict(zip(MEASURES, columns))}

    picked = texts(docs, id_col, text_col)
    schema = f"doc_id {id_type(picked)}, " + ", ".join(f"{m} long" for m in MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failures = bits[0]
    for other in bits[1:]:
        failures = failures.bitwiseOR(other)
    return mapped(picked, schema, measured).withColumn("failures", failures.cast("long"))


def fails(policy: str, failures: str = "failures") -> Column:
    """Whether a ledger row fails a policy."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) != 0


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and that fail nothing else of the policy.

    The second number is what would come back if the rule were taken out.  One
    aggregate over the bits; the result has a row per rule.
    """
    own = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count(F.lit(1)).alias("documents"), F.count(F.when(own != 0, 1)).alias("rejected")]
    for rule in POLICIES[policy]:
        sums.append(F.count(F.when(own.bitwiseAND(F.lit(bit(rule))) != 0, 1)).alias(f"failed_{rule}"))
        sums.append(F.count(F.when(own == bit(rule), 1)).alias(f"alone_{rule}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.col(f"failed_{rule}").alias("failed"), F.col(f"alone_{rule}").alias("alone")
            )
            for rule in POLICIES[policy]
        ]
    )
    return ledger.agg(*sums).select("documents", "rejected", F.explode(rows).alias("r")).select("r.*", "documents", "rejected")


def ablation_text(ledger: DataFrame, policy: str) -> Column:
    """The ablation of a policy as one value, ``rule:failed:alone`` by rule, comma-joined."""
    shown = F.concat_ws(":", "rule", F.col("failed").cast("string"), F.col("alone").cast("string"))
    rows = ablation(ledger, policy).agg(F.array_sort(F.collect_list(shown)).alias("rows"))
    return rows.select(F.array_join("rows", ",")).scalar()


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rules are evaluated once; policies and ablations only read the stored bits.
    ledger = written(rule_ledger(table(spark, sf_dir, "documents")), "ledger")
    return ledger.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        fails("base").alias("base_failed"),
        (~fails("v2")).alias("kept"),
        "failures",
        (~fails("v1")).alias("kept_v1"),
        ablation_text(ledger, "v1").alias("ablation_v1"),
        ablation_text(ledger, "v2").alias("ablation_v2"),
    )
