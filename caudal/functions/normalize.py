"""Scalar rules of the flow network: codes, ages, diagnoses, flags, labels, ids. All are native column expressions.

Null and blank inputs give an empty string where a rule yields text that is joined on, else null; no rule raises on data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import lpad_never_cut

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Spellings of "true". The lower-case list serves code books and gates, the upper-case one reference tables.
TRUE_LOWER = ("1", "true", "t", "yes", "y", "sim", "s")
TRUE_UPPER = ("1", "S", "SIM", "Y", "YES", "TRUE", "T")

# ICD-10 chapters by first letter; D and H depend on the two digits that follow.
CHAPTERS = {
    "A": "I", "B": "I", "C": "II", "E": "IV", "F": "V", "G": "VI", "I": "IX", "J": "X", "K": "XI", "L": "XII", "M": "XIII",
    "N": "XIV", "O": "XV", "P": "XVI", "Q": "XVII", "R": "XVIII", "S": "XIX", "T": "XIX", "U": "XXII", "V": "XX", "W": "XX",
    "X": "XX", "Y": "XX", "Z": "XXI",
}


def text(x: Column) -> Column:
    """Null as the empty string, without outer white space of any kind."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def number(x: Column) -> Column:
    """A double, or null where a plain cast would raise, give NaN or accept a type suffix."""
    s = x.cast("string")
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def number_or(x: Column, default: float) -> Column:
    return F.coalesce(number(x), F.lit(default))


def age(x: Column) -> Column:
    """Whole years from 0 to 130, else null."""
    n = number(x)
    return F.when(n.between(0, 130) & (n % 1 == 0), n.cast("long"))


def zero_fill(x: Column, width: int = 2) -> Column:
    return lpad_never_cut(x, width)


def diagnosis(x: Column) -> Column:
    """Upper case, letters A-Z and digits only; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""), F.lit(""))


def chapter(code: Column) -> Column:
    """The ICD-10 chapter of a normalised code, in Roman numerals; null if it has none."""
    letter, pair = F.substring(code, 1, 1), F.nullif(F.regexp_extract(code, r"^[A-Z]([0-9]{2})", 1), F.lit("")).cast("int")
    by_letter = F.create_map(*[F.lit(v) for kv in CHAPTERS.items() for v in kv])
    return (
        F.when(letter == "D", F.when(pair <= 48, "II").when(pair > 48, "III"))
        .when(letter == "H", F.when(pair <= 59, "VII").when(pair > 59, "VIII"))
        .otherwise(by_letter[letter])
    )


def digits(x: Column) -> Column:
    return F.regexp_replace(text(x), r"\D", "")


# The code rules use each input once: a rule that repeats its input grows with every rule built on it, until the generated
# code is too large to compile.
def municipality(x: Column) -> Column:
    """Catalog spelling: a decimal ending goes, digits only, the last 7 of longer ones."""
    whole = F.regexp_replace(text(x), r"^(\d+)\.0+$", "$1")
    return F.regexp_extract(F.regexp_replace(whole, r"\D", ""), r"(\d{0,7})$", 1)


def municipality_for_nodes(x: Column) -> Column:
    """Node spelling: digits only, the first 6 of 7, the last 6 of more. A decimal ending is not understood here."""
    return F.regexp_extract(F.regexp_replace(digits(x), r"^(\d{6})\d$", "$1"), r"(\d{0,6})$", 1)


def code6_strict(x: Column) -> Column:
    """Six digits of a code that has 6 or 7, else empty."""
    return F.regexp_extract(municipality(x), r"^(\d{6})\d?$", 1)


def code6_loose(x: Column) -> Column:
    """The first six digits if there are as many, else empty."""
    return F.regexp_extract(municipality(x), r"^(\d{6})", 1)


def facility_code(x: Column) -> Column:
    """Digits only, the last 7 of more, filled with zeros to 7; blank stays empty."""
    return F.regexp_extract(F.concat(F.lit("000000"), digits(x)), r"(\d{7})$", 1)


def flag(x: Column) -> Column:
    """Upper case; whatever holds the single digit 0 or 1 becomes that digit."""
    raw = F.upper(text(x))
    d = F.regexp_replace(raw, r"\D", "")
    return F.when(d.isin("0", "1"), d).otherwise(raw)


def truthy_code(x: Column) -> Column:
    return F.lower(text(x)).isin(*TRUE_LOWER)


def truthy_reference(x: Column) -> Column:
    return flag(x).isin(*TRUE_UPPER)


def truthy_batch(x: Column) -> Column:
    """Also true for any spelling of the number 1."""
    return F.upper(text(x)).isin(*TRUE_UPPER) | F.coalesce(number(x) == 1, F.lit(False))


def moment(x: Column) -> Column:
    """A timestamp without zone from yyyyMMdd, yyyyMMddHHmmss, or any ISO spelling."""
    t = text(x)
    return F.coalesce(
        F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd")).cast("timestamp_ntz"),
        F.try_to_timestamp(F.when(t.rlike(r"^\d{14}$"), t), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"),
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp_ntz")),
    )


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def stable_hash(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the parts joined by a bar; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 20)


def moment_text(t: Column) -> Column:
    """As text, with six decimals only where there is a fraction of a second."""
    whole = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.date_trunc("second", t) == t, whole).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def subject_key(birth: Column, sex: Column, years: Column, residence: Column) -> Column:
    """``birth|SEX|age|residence``; empty if any part is missing."""
    b, s, a, r = F.date_format(moment(birth), "yyyy-MM-dd"), F.upper(text(sex)), age(years).cast("string"), text(residence)
    whole = b.isNotNull() & (s != "") & a.isNotNull() & (r != "")
    return F.when(whole, F.concat_ws("|", b, s, a, r)).otherwise("")


def facility_node(x: Column) -> Column:
    return F.concat(F.lit("facility:"), text(x))


def location_node(x: Column, kind: Column) -> Column:
    return F.concat(F.when(F.lower(text(kind)) == "municipality", "municipality:").otherwise("facility:"), text(x))


def facility_of_node(node: Column) -> Column:
    """What follows the first colon, or the whole id."""
    t = text(node)
    return F.regexp_replace(t, r"^[^:]*:", "")


def ratio(part: Column, whole: Column) -> Column:
    """Rounded to six digits; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def municipality_label(name: Column, state: Column) -> Column:
    return F.when(F.coalesce(state, F.lit("")) != "", F.concat(name, F.lit(" - "), state)).otherwise(name)


def facility_label(facility: Column, name: Column, state: Column) -> Column:
    bare = F.concat(F.lit("CNES "), facility)
    return F.when(name.isNull(), bare).otherwise(F.concat(bare, F.lit(" ("), municipality_label(name, state), F.lit(")")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def map_line_width(count: Column) -> Column:
    return clamp(1 + 0.35 * count, 1.0, 8.0)


def node_size(degree: Column) -> Column:
    return clamp(8 + 0.6 * degree, 8.0, 40.0)


def edge_width(count: Column) -> Column:
    return clamp(0.5 * count, 0.8, 12.0)


def page_line_width(count: Column) -> Column:
    return F.least(F.lit(5.0), F.greatest(F.lit(0.6), 0.04 * count))


def first_true(conditions: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for cond, label in conditions:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def starts_with_any(x: Column, prefixes: list[str]) -> Column:
    t = F.upper(text(x))
    return reduce(lambda a, b: a | b, [t.startswith(p.strip().upper()) for p in prefixes])
