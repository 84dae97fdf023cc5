"""Column expressions for text clean-up, number parsing and safe names. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: the texts that count as a number.
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
# The characters kept in an export name, and the name used when nothing is left.
UNSAFE_NAME_PATTERN = r"[^A-Za-z0-9._-]+"
EMPTY_NAME = "export"


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(value, F.lit(WHITESPACE))


def clean(value: Column) -> Column:
    """Stripped text; null, blank and missing are one thing, the empty string."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def collapse(value: Column) -> Column:
    """Turn every inner run of whitespace into one space."""
    return F.regexp_replace(value, f"[{WHITESPACE}]+", " ")


def is_blank(value: Column) -> Column:
    return clean(value) == ""


def to_number(value: Column, source_type: T.DataType) -> Column:
    """Double, or null where the value is not a number. Suffixes such as ``1d`` and NaN are not numbers."""
    if isinstance(source_type, T.NumericType):
        number = value.cast("double")
        return F.when(~F.isnan(number), number)
    text = strip(value.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def percent(rate: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(rate * 100, digits))


def name_is_traversal(name: Column) -> Column:
    return F.exists(_name_parts(name), lambda part: part == "..")


def safe_name(name: Column) -> Column:
    """File-system safe form of a name; null where a ``..`` part makes it unacceptable."""
    joined = F.array_join(_name_parts(name), "_")
    cleaned = F.regexp_replace(F.regexp_replace(joined, UNSAFE_NAME_PATTERN, "_"), r"\.{2,}", ".")
    bare = F.regexp_replace(cleaned, r"^\.+", "")
    return F.when(~name_is_traversal(name), F.when(bare == "", F.lit(EMPTY_NAME)).otherwise(bare))


def _name_parts(name: Column) -> Column:
    slashed = F.replace(clean(name), F.lit("\\"), F.lit("/"))
    return F.filter(F.split(slashed, "/"), lambda part: ~part.isin("", "."))
