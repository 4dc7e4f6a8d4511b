"""Numbering rows inside large groups without putting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.session import durable


def rank_in_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str
) -> DataFrame:
    """Add `out`: the row's place, from 0, in its group under `order`.

    The rows are range-partitioned and sorted by (group, order), so a large group spans
    several partitions; a row's place is its place in the partition plus the group's
    rows in earlier partitions. Partition numbers are fixed by a checkpoint first.
    """
    by = list(by)
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [*by, *[f"_o{i}" for i in range(len(order))]]
    placed = durable(
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    )
    runs = placed.groupBy(*by, "_part").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(offsets, [*by, "_part"]).select(
        *df.columns, (F.col("_offset") + F.col("_id") - F.col("_first")).alias(out)
    )
