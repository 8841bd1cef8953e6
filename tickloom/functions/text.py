"""Text predicates and exact arithmetic on decimal text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text shapes. One final newline may follow, and nothing else.
SIGNED_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?\n?\z"
UNSIGNED_DECIMAL = r"^[0-9]+(\.[0-9]+)?\n?\z"
ISO_SECONDS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?\n?\z"
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def is_blank(value: Column) -> Column:
    """Nothing but (Unicode) white space.

    A first character that prints settles nearly all values without the pattern.
    """
    return ~F.ascii(value).between(33, 126) & value.rlike(BLANK)


def is_decimal(value: Column) -> Column:
    return value.rlike(SIGNED_DECIMAL)


def is_unsigned_decimal(value: Column) -> Column:
    return value.rlike(UNSIGNED_DECIMAL)


def is_iso_time(value: Column) -> Column:
    """Shape only: month 13 passes."""
    return value.rlike(ISO_SECONDS)


def digit_count(value: Column) -> Column:
    """Digits of decimal text, without sign and point; leading zeros count."""
    return F.length(F.translate(value, "-.", ""))


def _integer_digits(value: Column) -> Column:
    return F.ltrim(F.substring_index(value, ".", 1), F.lit("0"))


def _fraction_digits(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(".")), F.substring_index(value, ".", -1)).otherwise("")


def decimal_key(value: Column) -> Column:
    """A struct that orders unsigned decimal text of any length by value.

    Digits before the point without leading zeros (longer means larger), then those
    after it without trailing zeros.
    """
    whole = _integer_digits(value)
    return F.struct(
        F.length(whole).alias("size"),
        whole.alias("whole"),
        F.rtrim(_fraction_digits(value), F.lit("0")).alias("part"),
    )


def decimal_gte(a: Column, b: Column) -> Column:
    """Exact ``a >= b`` on unsigned decimal text of any length."""
    return decimal_key(a) >= decimal_key(b)


def integer_digit_count(value: Column) -> Column:
    """Significant digits before the point of signed decimal text."""
    return F.length(_integer_digits(F.ltrim(value, F.lit("-"))))


# Text of a number with an exponent, and the largest exponent that is written out: what
# lies beyond it fits no stored type.
WITH_EXPONENT = r"^([+-]?)([0-9]*)\.?([0-9]*)[eE]([+-]?[0-9]{1,3})\z"
LARGEST_EXPONENT = 60


def plain_decimal(value: Column) -> Column:
    """Write a number with an exponent in plain digits; other text is returned as it is.

    The point moves in the text, so no digit is lost or added. Zeros at the ends of the
    result are cut.
    """

    def group(n: int) -> Column:
        return F.regexp_extract(value, WITH_EXPONENT, n)

    digits = F.concat(group(2), group(3))
    point = F.length(group(2)) + group(4).try_cast("int")
    zeros = F.lit("0")
    whole = F.when(point <= 0, "").otherwise(
        F.rpad(F.substring(digits, F.lit(1), point), F.greatest(point, F.lit(0)), "0")
    )
    part = F.when(point < 0, F.concat(F.repeat(zeros, -point), digits)).otherwise(
        F.substring(digits, point + 1, F.length(digits))
    )
    whole, part = F.ltrim(whole, zeros), F.rtrim(part, zeros)
    number = F.concat(
        F.when((group(1) == "-") & (F.concat(whole, part) != ""), "-").otherwise(""),
        F.when(whole == "", "0").otherwise(whole),
        F.when(part == "", "").otherwise(F.concat(F.lit("."), part)),
    )
    fits = value.rlike(WITH_EXPONENT) & (digits != "") & (
        F.abs(group(4).try_cast("int")) <= LARGEST_EXPONENT
    )
    return F.when(value.rlike("[eE]"), F.when(fits, number).otherwise(value)).otherwise(value)


def cut_fraction(value: Column, digits: int = 10) -> Column:
    """Drop fraction digits beyond ``digits`` (no rounding)."""
    return F.regexp_replace(value, r"(\.[0-9]{%d})[0-9]+$" % digits, "$1")


def trim_zeros(value: Column) -> Column:
    """``1.2300`` -> ``1.23``, ``5.000`` -> ``5``; text without a point is untouched."""
    trimmed = F.rtrim(F.rtrim(value, F.lit("0")), F.lit("."))
    return F.when(F.contains(value, F.lit(".")), trimmed).otherwise(value)


def day_month_year_to_iso(value: Column) -> Column:
    """``dd/mm/yyyy`` -> ``yyyy-mm-dd``; null for any other shape."""
    shape = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"
    swapped = F.regexp_replace(value, shape, "$3-$2-$1")
    return F.when(value.rlike(shape), swapped)


def pct_change(old: Column, new: Column) -> Column:
    """Relative change; null when the old value is zero or missing."""
    return (new - old) / F.nullif(F.abs(old), F.lit(0.0))
