"""Column-level parsing rules shared by the operators. Every function maps Columns to Columns and never raises on data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first two digits of Brazilian municipality codes.
STATE_CODES = (
    "11", "12", "13", "14", "15", "16", "17",
    "21", "22", "23", "24", "25", "26", "27", "28", "29",
    "31", "32", "33", "35",
    "41", "42", "43",
    "50", "51", "52", "53",
)


def is_blank(value: Column) -> Column:
    """Null, empty or only spaces."""
    return value.isNull() | (F.trim(value) == "")


def trimmed(value: Column) -> Column:
    """Without outer spaces; null when blank."""
    return F.nullif(F.trim(value), F.lit(""))


def lpad_never_cut(value: Column, width: int) -> Column:
    """``lpad`` cuts longer values; this leaves them alone."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def birth_day(value: Column) -> Column:
    """A date for ``yyyyMMdd`` or ``yyyy-MM-dd`` naming a real day from 1900-01-01 to 2021-12-31, else null."""
    v = F.trim(value)
    compact = F.when(v.rlike(r"^\d{8}$"), v).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.translate(v, "-", ""))
    day = F.try_to_timestamp(compact, F.lit("yyyyMMdd")).cast("date")
    return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2021-12-31").cast("date")), day)


def municipality6(value: Column) -> Column:
    """The six digits that name a place, of a well-formed code of 6 or 7 digits, else null."""
    v = F.trim(value)
    return F.when(v.rlike(r"^\d{6,7}$") & F.substring(v, 1, 2).isin(*STATE_CODES), F.substring(v, 1, 6))


def entry_moment(value: Column) -> Column:
    """A timestamp for ``yyyy-MM-dd HH:mm:ss`` or ``yyyyMMddHHmmss`` naming a real moment of 2020 or 2021, else null."""
    v = F.trim(value)
    compact = F.when(v.rlike(r"^202[01]\d{10}$"), v).when(
        v.rlike(r"^202[01]-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.translate(v, "- :", "")
    )
    return F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss"))


def tax_number(value: Column) -> Column:
    """The 14 digits of a plain or ``NN.NNN.NNN/NNNN-NN`` number whose digits aren't all the same, else null."""
    v = F.trim(value)
    digits = F.when(v.rlike(r"^\d{14}$"), v).when(v.rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$"), F.translate(v, "./-", ""))
    return F.when(~digits.rlike(r"^(\d)\1*$"), digits)


def matching(value: Column, pattern: str) -> Column:
    """The trimmed value if it has the pattern, else null."""
    v = F.trim(value)
    return F.when(v.rlike(pattern), v)


def whole_number(value: Column, most: int) -> Column:
    """A whole number from 0 to ``most``, else null."""
    n = matching(value, r"^\d{1,9}$").cast("int")
    return F.when(n <= most, n)


def amount(value: Column) -> Column:
    """An amount of at most 15 digits before a decimal point or comma and two after it, not negative, else null."""
    return F.translate(matching(value, r"^\d{1,15}([.,]\d{1,2})?$"), ",", ".").cast("decimal(18,2)")


def node_reference(value: Column) -> Column:
    """``kind:code`` in one spelling: no outer spaces, lower case, facilities with 7 digits, municipalities with 6.

    Null stays null; a blank reference becomes the empty string, which names no node.
    """
    v = F.lower(F.trim(value))
    code = F.regexp_extract(v, r"^(?:facility|municipality):(.*)$", 1)
    return (
        F.when(v.rlike(r"^facility:\d{1,6}$"), F.concat(F.lit("facility:"), F.lpad(code, 7, "0")))
        .when(v.rlike(r"^municipality:\d{7}$"), F.concat(F.lit("municipality:"), F.substring(code, 1, 6)))
        .otherwise(v)
    )


def facility7(value: Column) -> Column:
    """A facility number as 7 digits: outer spaces and a trailing ``.0`` go, lost leading zeros return. Blank becomes null."""
    v = F.regexp_replace(F.trim(value), r"\.0$", "")
    return F.nullif(F.when(v.rlike(r"^\d{1,6}$"), F.lpad(v, 7, "0")).otherwise(v), F.lit(""))
