"""Text formats of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.numbers import grouped, js_round, to_fixed, trimmed

NOT_AVAILABLE = "N/A"
# Unit names.
BINARY_UNITS = ("B", "KB", "MB", "GB", "TB")
DECIMAL_UNITS = ("B", "kB", "MB", "GB", "TB", "PB", "EB")


def _known(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), NOT_AVAILABLE).otherwise(text)


def percent_diff(a: Column, b: Column) -> Column:
    """(b − a) / b in percent; NULL, printed `N/A`, when b is 0. A missing a counts as 0."""
    return F.when(b != 0, (b - F.coalesce(a, F.lit(0))) / b * 100.0)


def ratio(a: Column, b: Column) -> Column:
    """b / a; NULL, printed `N/A`, when a is 0."""
    return F.when(a != 0, b / a)


def or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit(NOT_AVAILABLE))


def _approximately(number: Column, unit: str, context: str) -> Column:
    tail = f" {context}**" if context else "**"
    return F.concat(F.lit("**~"), number, F.lit(unit + tail))


def fmt_percent(value: Column, context: str = "") -> Column:
    return _approximately(F.abs(js_round(value)).cast("string"), "% less", context)


def fmt_faster(value: Column, context: str = "") -> Column:
    return _approximately(F.abs(js_round(value)).cast("string"), "% faster", context)


def fmt_x(value: Column, context: str = "") -> Column:
    return _approximately(to_fixed(value, 1), "x faster", context)


def fmt_number(value: Column, decimals: int = 0) -> Column:
    return _known(value, grouped(value, decimals))


def fmt_rps(value: Column) -> Column:
    return _known(value, grouped(value, 2))


def _unit_power(value: Column, base: int) -> Column:
    return F.floor(F.log(value.cast("double")) / F.log(F.lit(float(base)))).cast("int")


def fmt_bytes(value: Column) -> Column:
    """1024-based size with at most one decimal; beyond the last unit it is `undefined`."""
    power = _unit_power(value, 1024)
    number = F.regexp_replace(
        to_fixed(value / F.pow(F.lit(1024.0), power), 1), r"\.0$", ""
    )
    unit = F.coalesce(F.get(F.array(*map(F.lit, BINARY_UNITS)), power), F.lit("undefined"))
    return F.when(value == 0, "0 B").otherwise(F.concat(number, F.lit(" "), unit))


def fmt_filesize(value: Column) -> Column:
    """1000-based size with at most one decimal; a rounded-up 1000 moves to the next unit."""
    power = F.when(value == 0, 0).otherwise(_unit_power(F.abs(value), 1000))
    scaled = value / F.pow(F.lit(1000.0), power)
    number = F.when(power > 0, js_round(scaled * 10) / 10.0).otherwise(js_round(scaled).cast("double"))
    carried = number == 1000
    unit = F.get(F.array(*map(F.lit, DECIMAL_UNITS)), F.when(carried, power + 1).otherwise(power))
    text = F.regexp_replace(F.format_string("%.1f", F.when(carried, 1.0).otherwise(number)), r"\.0$", "")
    return F.concat(text, F.lit(" "), unit)


def _first_unit(ms: Column) -> Column:
    """The largest non-zero unit of a span of a minute or more, rounded down."""
    def whole(size: int) -> Column:
        return F.floor(ms / float(size)).cast("bigint").cast("string")

    minute, hour, day = 60_000, 3_600_000, 86_400_000
    return (
        F.when(ms < hour, F.concat(whole(minute), F.lit("m")))
        .when(ms < day, F.concat(whole(hour), F.lit("h")))
        .when(ms < 365 * day, F.concat(whole(day), F.lit("d")))
        .otherwise(F.concat(whole(365 * day), F.lit("y")))
    )


def fmt_cpu_time(micros: Column) -> Column:
    return _known(
        micros,
        F.when(micros < 1_000, F.concat(micros.cast("string"), F.lit(" μs")))
        .when(micros < 1_000_000, F.concat(trimmed(micros / 1e3, 2), F.lit(" ms")))
        .when(micros < 60_000_000, F.concat(trimmed(micros / 1e6, 2), F.lit(" s")))
        .otherwise(_first_unit(micros / 1e3)),
    )


def fmt_duration(ms: Column) -> Column:
    whole = F.concat(js_round(ms).cast("string"), F.lit("ms"))
    seconds = F.concat(to_fixed(ms / 1000.0, 2), F.lit("s"))
    return _known(
        ms,
        F.when(ms < 1_000, whole)
        .when(ms < 10_000, F.concat(seconds, F.lit(" ("), whole, F.lit(")")))
        .when(ms < 60_000, seconds)
        .otherwise(_first_unit(ms)),
    )


def fmt_status_codes(codes: Column) -> Column:
    """`200: 9, 404: 1`, codes ascending, `undefined` last; NULL gives `N/A`."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(codes),
            lambda e: F.struct(
                F.coalesce(e["key"].try_cast("bigint"), F.lit(1 << 40)).alias("n"),
                e["key"].alias("k"),
                e["value"].alias("v"),
            ),
        )
    )
    return or_na(
        F.array_join(
            F.transform(entries, lambda e: F.concat(e["k"], F.lit(": "), e["v"].cast("string"))), ", "
        )
    )
