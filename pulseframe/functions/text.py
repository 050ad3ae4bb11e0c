"""Bytes and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.timeparts import floor_div

# Texts that appear in output.
TRUNCATION_MARK = "...(truncated)"
UNPRINTABLE_MARK = "."

# Up to here a value times 10^6 is exact in a double when it was a 4-byte float.
_EXACT_LIMIT = float(2**33)


def hex_lower(data: Column) -> Column:
    """Lower-case hexadecimal text."""
    return F.lower(F.hex(data))


def hex_decode(text: Column) -> Column:
    """Bytes of a hexadecimal text; NULL for an odd length or another character."""
    return F.when((F.length(text) % 2 == 0) & text.rlike(r"^[0-9a-fA-F]*\z"), F.unhex(text))


def printable_ascii(data: Column) -> Column:
    """Printable ASCII characters, a dot for every other byte."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7e]", UNPRINTABLE_MARK)


def payload_preview(data: Column, max_bytes: int) -> Column:
    """First bytes as text, line ends escaped, with a mark when cut."""
    if max_bytes <= 0:
        return F.when(data.isNotNull(), F.lit(""))
    text = F.make_valid_utf8(F.substring(data, 1, max_bytes).cast("string"))
    escaped = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(escaped, F.when(F.octet_length(data) > max_bytes, F.lit(TRUNCATION_MARK)).otherwise(F.lit("")))


def fixed_decimals(value: Column, digits: int) -> Column:
    """A float with a fixed number of decimals, correctly rounded (ties to even).

    Scaling a 4-byte float by up to 10^6 is exact in a double, so ``rint`` sees
    the true value; formatting functions of the JVM round the shortest decimal
    text instead and differ on some values.
    """
    wide = value.cast("double")
    scale = 10**digits
    units = F.rint(F.abs(wide) * F.lit(float(scale))).cast("bigint")
    sign = F.when(F.startswith(wide.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    parts = [sign, floor_div(units, scale).cast("string")]
    if digits:
        parts += [F.lit("."), F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")]
    beyond = F.format_string(f"%.{digits}f", wide)
    return F.when(F.abs(wide) < F.lit(_EXACT_LIMIT), F.concat(*parts)).when(wide.isNotNull(), beyond)


def export_number(value: Column) -> Column:
    """Whole numbers without decimals, all others with three."""
    wide = value.cast("double")
    return F.when(F.rint(wide) == wide, fixed_decimals(value, 0)).otherwise(fixed_decimals(value, 3))
