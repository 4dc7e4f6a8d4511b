"""Aggregates over request, error and resource logs, per site and side.

All of them are plain aggregates with partial sums before the shuffle, so a site with
most of the log costs no single task. Only the concurrency peak needs order; it works
on one row per distinct time, in time slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BY = ("site", "side")
SLICE_MS = 600_000


def duration_ms(start: Column, end: Column) -> Column:
    """end − start; NULL if either is missing or zero."""
    return F.when((start != 0) & (end != 0), end - start)


def rps(requests: Column, duration: Column) -> Column:
    """Requests per second; NULL without requests or without a duration."""
    return F.when((duration != 0) & (requests > 0), requests / (duration / 1000.0))


def request_totals(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.coalesce("bytes_down", F.lit(0))).alias("bytes_downloaded"),
        F.sum(F.coalesce("bytes_up", F.lit(0))).alias("bytes_uploaded"),
    )


def status_counts(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per status; a missing status is the bucket `undefined`."""
    code = F.coalesce(F.col("status").cast("string"), F.lit("undefined"))
    return log.groupBy(*by, code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def status_histogram(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The counts as one map per group, as large as there are status codes."""
    entries = F.sort_array(F.collect_list(F.struct("code", "n")))
    return (
        status_counts(log, by).groupBy(*by).agg(F.map_from_entries(entries).alias("status_codes"))
    )


def avg_request_time(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean of end − start where both are known; NULL when none is."""
    return log.groupBy(*by).agg(F.avg(F.col("end_ms") - F.col("start_ms")).alias("avg_request_ms"))


def error_details(errors: DataFrame) -> DataFrame:
    """Error rows with text; a missing text becomes empty. Order is (time_ms, seq)."""
    return errors.withColumn("error", F.coalesce("error", F.lit("")))


def error_summary(errors: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Error count per group; the detail list is `error_details`, one row per error."""
    return errors.groupBy(*by).agg(F.count(F.lit(1)).alias("errors"))


def max_concurrency_of_samples(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Largest in-flight value seen, not below 0."""
    return samples.groupBy(*by).agg(
        F.greatest(F.coalesce(F.max("current"), F.lit(0)), F.lit(0)).alias("max_concurrency")
    )


def max_concurrency(log: DataFrame, by: Sequence[str] = BY, slice_ms: int = SLICE_MS) -> DataFrame:
    """Most requests in flight at once, from their intervals.

    A request ending when another starts is over by then; one of no length counts at its
    instant; one whose start or end is unknown is left out. Changes are summed per
    instant first, then per time slice; a slice holds at most `slice_ms` instants, and
    only the slice totals are run through in order per group.
    """
    by = list(by)
    known = log.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    instant = F.col("start_ms") == F.col("end_ms")
    change = F.struct(
        F.col("start_ms").alias("t"),
        F.lit(1).alias("starts"),
        F.lit(0).alias("ends"),
        instant.cast("int").alias("instants"),
    )
    end = F.struct(
        F.col("end_ms").alias("t"),
        F.lit(0).alias("starts"),
        (~instant).cast("int").alias("ends"),
        F.lit(0).alias("instants"),
    )
    moments = (
        known.select(*by, F.inline(F.array(change, end)))
        .groupBy(*by, "t")
        .agg(
            F.sum("starts").alias("starts"), F.sum("ends").alias("ends"),
            F.sum("instants").alias("instants"),
        )
        .withColumns(
            {
                "_slice": F.floor(F.col("t") / slice_ms),
                "peak": F.col("starts") - F.col("ends"),
                "net": F.col("starts") - F.col("ends") - F.col("instants"),
            }
        )
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("t").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slices = (
        moments.withColumn("_level", F.coalesce(F.sum("net").over(inside), F.lit(0)) + F.col("peak"))
        .groupBy(*by, "_slice")
        .agg(F.max("_level").alias("_peak"), F.sum("net").alias("_net"))
    )
    across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.withColumn("_peak", F.coalesce(F.sum("_net").over(across), F.lit(0)) + F.col("_peak"))
        .groupBy(*by)
        .agg(F.greatest(F.max("_peak"), F.lit(0)).alias("max_concurrency"))
    )


def disk_total(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Bytes written; negative corrections count."""
    return samples.groupBy(*by).agg(
        F.sum(F.coalesce("disk_bytes", F.lit(0))).alias("disk_bytes")
    )


def _at(edge, value: str) -> Column:
    return edge(F.struct("ts_ms", "seq", value))[value]


def cpu_delta(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """User and system time between the first and the last sample; a missing first
    value counts as 0."""
    return samples.groupBy(*by).agg(
        *[
            (_at(F.max, c) - F.coalesce(_at(F.min, c), F.lit(0))).alias(f"{c}_micros")
            for c in ("cpu_user", "cpu_system")
        ]
    )


def peak_memory(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return samples.groupBy(*by).agg(
        _at(F.min, "rss").alias("start_rss"),
        _at(F.max, "rss").alias("end_rss"),
        F.max("rss").alias("peak_rss"),
    )


def metrics_summary(
    log: DataFrame | None,
    errors: DataFrame | None = None,
    samples: DataFrame | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """One nested row per group of any of the inputs, of which at least one must be given.
    The crawl runs from its first to its last sample.

    The inputs are read as one table with a column per measure, and all but the concurrency
    peak comes from one aggregation of it: first per status code, whose few rows are then merged
    per group, the codes into a map."""
    by = list(by)
    measures = {
        "code": "string", "requests": "int", "errors": "int", "down": "bigint", "up": "bigint", "took": "bigint", "disk": "bigint", "ts_ms": "bigint",
        "sample": "struct<ts_ms:bigint,seq:bigint,rss:bigint,cpu_user:bigint,cpu_system:bigint>",
    }

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*by, *(given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in measures.items()))

    parts = []
    if log is not None:
        took = F.col("end_ms") - F.col("start_ms")
        code = F.coalesce(F.col("status").cast("string"), F.lit("undefined"))
        parts.append(rows(log, code=code, requests=F.lit(1), down=F.col("bytes_down"), up=F.col("bytes_up"), took=took))
    if errors is not None:
        parts.append(rows(errors, errors=F.lit(1)))
    if samples is not None:
        sample = F.struct("ts_ms", "seq", "rss", "cpu_user", "cpu_system")
        parts.append(rows(samples, disk=F.coalesce("disk_bytes", F.lit(0)), ts_ms=F.col("ts_ms"), sample=sample))
    every = reduce(DataFrame.unionByName, parts)

    sums, resources = ("requests", "errors", "down", "up", "took", "disk"), ("rss", "cpu_user", "cpu_system")
    edges = (("from", F.min), ("to", F.max))
    known = F.col("sample").isNotNull()
    per_code = every.groupBy(*by, "code").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("took").alias("n_took"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.max("sample.rss").alias("peak_rss"),
        *[
            fn(F.when(known, F.struct("sample.ts_ms", "sample.seq", f"sample.{c}"))).alias(f"{edge}_{c}")
            for edge, fn in edges for c in resources
        ],
    )
    codes = F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", F.col("requests").alias("n")))))
    merged = per_code.groupBy(*by).agg(
        F.map_from_entries(codes).alias("status_codes"), *[F.sum(c).alias(c) for c in (*sums, "n_took")],
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("peak_rss").alias("peak_rss"),
        *[fn(f"{edge}_{c}")[c].alias(f"{edge}_{c}") for edge, fn in edges for c in resources],
    )
    df = merged.withColumns(
        {
            "avg_request_ms": F.when(F.col("n_took") > 0, F.col("took") / F.col("n_took")),
            "cpu_user_micros": F.col("to_cpu_user") - F.coalesce("from_cpu_user", F.lit(0)),
            "cpu_system_micros": F.col("to_cpu_system") - F.coalesce("from_cpu_system", F.lit(0)),
            "bytes_downloaded": F.col("down"), "bytes_uploaded": F.col("up"), "disk_bytes": F.col("disk"),
            "start_rss": F.col("from_rss"), "end_rss": F.col("to_rss"),
        }
    )
    if log is None:
        df = df.withColumn("max_concurrency", F.lit(0).cast("bigint"))
    else:
        df = df.join(max_concurrency(log, by), by, "left")
    duration = duration_ms(F.col("start_ms"), F.col("end_ms"))
    requests = F.coalesce("requests", F.lit(0))

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    return df.select(
        *by,
        F.struct(
            F.col("start_ms").alias("start"), F.col("end_ms").alias("end"),
            duration.alias("duration_ms"),
        ).alias("timing"),
        F.struct(or_zero("cpu_user_micros"), or_zero("cpu_system_micros")).alias("cpu"),
        F.struct("start_rss", "end_rss", or_zero("peak_rss")).alias("memory"),
        F.struct(
            requests.alias("total"),
            F.coalesce("status_codes", F.create_map().cast("map<string,bigint>")).alias("status_codes"),
            "avg_request_ms",
            rps(requests, duration).alias("rps"),
            or_zero("bytes_downloaded"),
            or_zero("bytes_uploaded"),
        ).alias("requests"),
        F.struct(F.coalesce("errors", F.lit(0)).alias("total")).alias("errors"),
        F.struct(or_zero("disk_bytes")).alias("disk"),
        F.struct(F.coalesce("max_concurrency", F.lit(0)).alias("max")).alias("concurrency"),
    )
