"""Parameter codes, parameter specs and point indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.columns import evaluated_once

# Syntax of codes and specs.
PARAM_CODE = r"^[AZP][0-9]{5}\z"
ANY_LETTER_CODE = r"^[A-Z][0-9]{5}\z"
LENIENT_CODE = r"^([A-Z_]+)([0-9]+)\z"
RANGE_MARK = "~"
MAX_POINT_INDEX = 10_000


def trimmed(value: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.regexp_replace(value, r"^\s+|\s+\z", "")


def normalise_param(value: Column) -> Column:
    """Trimmed, upper-cased parameter text."""
    return F.upper(trimmed(value))


def is_param_code(value: Column) -> Column:
    """True for a valid, upper-case parameter code."""
    return value.rlike(PARAM_CODE)


def _range_ends(token: Column) -> tuple[Column, Column]:
    start = trimmed(F.substring_index(token, RANGE_MARK, 1))
    end = trimmed(F.regexp_replace(token, "(?s)^[^~]*~", ""))
    return start, end


def _code_number(code: Column) -> Column:
    return F.substring(code, 2, 5).cast("int")


def _tokens(specs: Column) -> Column:
    return F.filter(F.transform(specs, normalise_param), lambda token: token != "")


def _fail(message: str, token: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), token)).cast("array<string>")


def expand_specs(specs: Column) -> Column:
    """Array of specs (``P00001`` or ``P00001~P00010``) to an array of codes.

    A bad code, a prefix change inside a range or a reversed range is an error.
    """

    def expand(token: Column) -> Column:
        start, end = _range_ends(token)
        ends = F.struct(start.alias("start"), end.alias("end"))
        ranged = evaluated_once(ends, lambda e: in_range(token, e["start"], e["end"]))
        single = F.when(is_param_code(token), F.array(token)).otherwise(_fail("invalid param_id: ", token))
        return F.when(F.contains(token, F.lit(RANGE_MARK)), ranged).otherwise(single)

    def in_range(token: Column, start: Column, end: Column) -> Column:
        first, last = _code_number(start), _code_number(end)
        codes = F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda n: F.concat(F.substring(start, 1, 1), F.lpad(n.cast("string"), 5, "0")),
        )
        return (
            F.when(~(is_param_code(start) & is_param_code(end)), _fail("invalid range endpoint: ", token))
            .when(F.substring(start, 1, 1) != F.substring(end, 1, 1), _fail("range prefix mismatch: ", token))
            .when(first > last, _fail("range order invalid: ", token))
            .otherwise(codes)
        )

    return F.flatten(F.transform(_tokens(specs), expand))


def expand_specs_lenient(text: Column) -> Column:
    """Comma-separated specs to a list of unique names; bad ranges vanish.

    Any prefix of capitals and underscores is accepted and the wider number of
    a range sets the width of all its names.  What a range is made of is computed once
    per range, not once per name.
    """
    nothing = F.array().cast("array<string>")

    def code(text: Column) -> Column:
        """Prefix and digits of a name; both empty when it is none."""
        whole = trimmed(text)
        return F.struct(
            F.regexp_extract(whole, LENIENT_CODE, 1).alias("prefix"), F.regexp_extract(whole, LENIENT_CODE, 2).alias("digits")
        )

    def bounds(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        first, last = a["digits"].try_cast("bigint"), b["digits"].try_cast("bigint")
        width = F.greatest(F.length(a["digits"]), F.length(b["digits"]))
        fits = (a["prefix"] != "") & (a["prefix"] == b["prefix"]) & (first <= last)
        return F.struct(
            a["prefix"].alias("prefix"), first.alias("first"), last.alias("last"), width.alias("width"), fits.alias("fits")
        )

    def names(b: Column) -> Column:
        listed = F.transform(
            F.sequence(b["first"], F.greatest(b["first"], b["last"])),
            lambda n: F.concat(b["prefix"], F.lpad(n.cast("string"), b["width"], F.lit("0"))),
        )
        return F.when(b["fits"], listed).otherwise(nothing)

    def in_range(parts: Column) -> Column:
        ends = F.struct(code(F.get(parts, F.lit(0))).alias("a"), code(F.get(parts, F.lit(1))).alias("b"))
        return evaluated_once(evaluated_once(ends, bounds), names)

    def expand(token: Column) -> Column:
        ranged = evaluated_once(F.split(token, RANGE_MARK), in_range)
        return F.when(F.contains(token, F.lit(RANGE_MARK)), ranged).otherwise(F.array(token))

    return F.array_distinct(F.flatten(F.transform(_tokens(F.split(text, ",")), expand)))


def specs_are_valid(specs: Column) -> Column:
    """Check specs without expanding them; at least one token is required."""

    def token_ok(token: Column) -> Column:
        start, end = _range_ends(token)
        range_ok = (
            start.rlike(ANY_LETTER_CODE)
            & end.rlike(ANY_LETTER_CODE)
            & (F.substring(start, 1, 1) == F.substring(end, 1, 1))
            & (F.substring(start, 2, 5) <= F.substring(end, 2, 5))
        )
        return F.when(F.contains(token, F.lit(RANGE_MARK)), range_ok).otherwise(token.rlike(ANY_LETTER_CODE))

    tokens = _tokens(specs)
    return (F.size(tokens) > 0) & F.forall(tokens, token_ok)


def subscription_params(param_ids: Column) -> Column:
    """Normalised, unique, sorted, non-blank parameters of a subscription."""
    return F.array_sort(F.array_distinct(_tokens(param_ids)))


def point_index(code: Column) -> Column:
    """Number in ``P0001`` (NULL when there is none)."""
    return F.when(code.rlike(r"^P\+?[0-9]+\z"), F.substring(code, 2, 20).try_cast("int"))


def point_column_index(name: Column) -> Column:
    """Number in ``point_0001`` or ``0001`` when it names an existing column."""
    digits = F.regexp_extract(name, r"^(?:point_)?\+?([0-9]+)\z", 1)
    number = F.nullif(digits, F.lit("")).try_cast("int")
    return F.when(number.between(1, MAX_POINT_INDEX), number)


def point_column_name(index: Column) -> Column:
    """Column name of a point index."""
    return F.when(index.between(1, MAX_POINT_INDEX), F.format_string("point_%04d", index))
