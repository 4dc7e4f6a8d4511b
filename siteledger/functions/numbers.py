"""Number rounding as the report prints it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Nearest whole number, halves upwards (−2.5 gives −2)."""
    below = F.floor(x)
    return F.when(x - below >= 0.5, below + 1).otherwise(below).cast("bigint")


def to_fixed(x: Column, digits: int) -> Column:
    """`digits` decimals of the exact binary value, halves upwards.

    The shortest decimal text of a double can sit on a half that the double itself does
    not reach (1.005). The double is therefore scaled by a power of two to a whole
    number, which loses nothing, and rounded in whole-number arithmetic.
    """
    size = F.abs(x)

    def rounded(power: int) -> Column:
        whole = (size * float(1 << power)).cast("bigint").cast("decimal(38,0)")
        unit = F.lit(1 << power).cast("decimal(20,0)")
        twice = (whole * (2 * 10**digits) + unit).cast("decimal(38,0)")
        return F.call_function("div", twice, (unit * 2).cast("decimal(21,0)"))

    units = (
        F.when(size < 4, rounded(60))
        .when(size < 2.0**10, rounded(52))
        .when(size < 2.0**20, rounded(42))
        .when(size < 2.0**30, rounded(32))
        .when(size < 2.0**42, rounded(20))
        .when(size < 2.0**50, rounded(10))
        .otherwise(size.cast("decimal(38,0)") * 10**digits)
        .cast("bigint")
    )
    whole = F.call_function("div", units, F.lit(10**digits)).cast("string")
    text = whole if digits == 0 else F.concat(
        whole, F.lit("."), F.lpad((units % 10**digits).cast("string"), digits, "0")
    )
    return F.concat(F.when((x < 0) & (units != 0), "-").otherwise(""), text)


def grouped(x: Column, decimals: int) -> Column:
    """Thousands separators and a fixed number of decimals, halves away from zero."""
    return F.format_number(F.round(x.cast("double"), decimals).cast(f"decimal(38,{max(decimals, 1)})"), decimals)


def trimmed(x: Column, decimals: int) -> Column:
    """Like `grouped`, without trailing zeros."""
    return F.regexp_replace(grouped(x, decimals), r"\.?0+$", "") if decimals else grouped(x, 0)
