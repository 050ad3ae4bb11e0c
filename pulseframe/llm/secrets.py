"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule's regular expression gives a Boolean query over trigrams it cannot do
without.  The index holds, for each of these trigrams, the texts that contain it
(postings).  A text is a candidate of a rule when the postings of all trigrams of one
alternative have it; only candidates are verified with the expression itself.  Rules
without mandatory trigrams verify every text.

Texts are known to the index by a 64-bit hash: copies share their postings, and a clash
would only make one more candidate.

Spans are code points, end exclusive.  ``split`` gives the stretches between matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the places.  Sums
and replacements run in blocks of ``BLOCK`` matches: what grows by appending stays short.

Defined results: a null or empty text has no spans; equal rows give equal rows; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import let, table, texts, written
from pulseframe.llm.trigrams import clauses


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in the order in which equal starts are listed.  Runs that
# are too short are left out by the counts of ``access`` and ``hex``: a shorter match could
# not hide a longer one.  A match of ``assign`` with a short value does hide what it covers.
BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)

#: What the scan adds: well-known forms of keys and tokens.
ADDED = (
    Rule("github", "gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._-]{20,}"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + ADDED
REDACTED = "[REDACTED]"
#: Matches that are placed, or replaced, one after the other.
BLOCK = 256


def queries(rules: tuple[Rule, ...]) -> list[tuple[int, int, list[str]]]:
    """Rule number, alternative and its trigrams, for the rules that have any."""
    return [(r, k, sorted(c)) for r, rule in enumerate(rules) for k, c in enumerate(clauses(rule.pattern))]


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: ``trigram`` and the ``key`` of each text that has it."""
    wanted = sorted({t for _, _, c in queries(rules) for t in c})
    low = docs.select(text_key().alias("key"), F.lower("text").alias("low"))
    present = [F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]
    found = F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")
    return low.select("key", F.explode(found).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Texts with the rules they may match, as a bit mask: intersected postings."""
    spark = index.sparkSession
    # A few dozen rows by construction: one per trigram of a rule.
    rows = [F.struct(*map(F.lit, (r, k, len(c), t))) for r, k, c in queries(rules) for t in c]
    needed = spark.range(1).select(F.inline(F.array(*rows))).toDF("rule", "alternative", "size", "t")
    hits = index.join(F.broadcast(needed), F.col("trigram") == F.col("t"))
    full = hits.groupBy("key", "rule", "alternative", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return full.groupBy("key").agg(F.expr("bit_or(shiftleft(1L, rule))").alias("mask"))


def _blocks(items: Column) -> Column:
    """The items in lists of ``BLOCK``; at least one list."""

    def cut(own: Column) -> Column:
        last = F.greatest(F.ceil(F.size(own) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK)))

    return let(items, cut)


def _spans(rule: Rule, number: int) -> Column:
    """Spans of one rule as structs of start, rule number and end."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split("text", rule.pattern, -1), F.char_length)
    matches = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length)
    values = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.char_length)
    both = F.zip_with(between, matches, lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed_in(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def begun(acc: Column, block: Column) -> Column:
        sizes = F.aggregate(block, acc["at"], lambda n, x: n + x["gap"] + x["size"])
        return F.struct(sizes.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed_all(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(blocks, first, begun, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, placed_in))

    # The last stretch has no match after it.
    placed = let(_blocks(F.filter(both, lambda x: x["size"].isNotNull())), placed_all)
    if rule.least:
        sized = F.zip_with(placed, values, lambda s, n: F.when(n >= rule.least, s))
        return F.array_compact(sized)
    return placed


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, which has a ``text``, with ``_spans``: sorted structs of start, rule number and end."""
    index = written(postings(docs, rules), "postings")
    may = written(candidates(index, rules), "candidates")
    keyed = docs.withColumn("_key", text_key())
    joined = keyed.join(may.select(F.col("key").alias("_of"), F.col("mask").alias("_mask")), F.col("_key") == F.col("_of"), "left")
    indexed = {r for r, _, _ in queries(rules)}
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    parts = []
    for number, rule in enumerate(rules):
        if number in indexed:
            may_match = F.coalesce(F.col("_mask"), F.lit(0)).bitwiseAND(F.lit(1 << number).cast("long")) != 0
        else:
            may_match = F.col("text").rlike(rule.pattern)
        parts.append(F.when(may_match, _spans(rule, number)).otherwise(none))
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_key", "_of", "_mask")


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every span replaced; texts without one stay as they are.

    ``n_chars``, if there, follows the text.
    """
    own = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    scanned = secret_spans(inner, rules)

    def of_block(acc: Column, block: Column) -> Column:
        base = acc["at"]
        last = F.greatest(base, F.array_max(F.transform(block, lambda s: s["end"])))

        def replaced(part: Column) -> Column:
            def step(x: Column, s: Column) -> Column:
                before = F.substring(part, x["at"] - base + 1, F.greatest(s["start"] - x["at"], F.lit(0)))
                # A span that begins inside the one before only extends it.
                mark = F.when(s["start"] >= x["at"], F.concat(before, F.lit(REDACTED))).otherwise("")
                return F.struct(F.greatest(x["at"], s["end"]).alias("at"), F.concat(x["out"], mark).alias("out"))

            return F.aggregate(block, F.struct(base.alias("at"), F.lit("").alias("out")), step, lambda x: x["out"])

        out = let(F.substring(F.col("text"), base + 1, last - base), replaced)
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    whole = F.aggregate(
        _blocks(F.col("_spans")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        of_block,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))
        ),
    )
    found = F.size("_spans") > 0
    new = scanned.withColumn("_new", F.when(found, whole).otherwise(F.col("_row")[text_col]))
    changed = {text_col: F.col("_new")}
    if "n_chars" in own:
        size = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(found, size).otherwise(F.col("_row")["n_chars"])
    return new.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in own])


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per document its spans as structs of start, rule number and end."""
    return secret_spans(texts(docs, id_col, text_col), rules).select("doc_id", F.col("_spans").alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == number)).cast("long")

    counts = [count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("spans"), RULES).alias("spans")
    )


def _sql_spans(rule: Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS rule, unnest(range(1, len(m) + 1)) AS i, m, v,
         list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g
  FROM (SELECT doc_id, text, list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS m,
               list_transform(regexp_extract_all(text, '{pattern}', {rule.group}), lambda x: length(x)) AS v
        FROM d) WHERE len(m) > 0"""


_FOUND = " UNION ALL ".join(_sql_spans(rule, number) for number, rule in enumerate(RULES))
_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_LEAST = "[" + ", ".join(str(r.least) for r in RULES) + "]"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}
),
spans AS (
  SELECT doc_id, rule, CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS s, m[i] AS n
  FROM found WHERE v[i] >= {_LEAST}[rule + 1]
),
listed AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access,
         count(*) FILTER (rule = 2) AS n_hex,
         string_agg({_KINDS}[rule + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, rule)
           FILTER (rule < {len(BASE)}) AS base,
         string_agg({_KINDS}[rule + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, rule) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""
