"""Keeping long expression chains from being copied around the plan."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def settled(df: DataFrame, *names: str) -> DataFrame:
    """The same table, with `names` computed here and only here.

    Spark pushes a later filter on a computed column below the projections that built
    it, with every alias written out, and a chain of columns that each use the previous
    one several times then grows without bound. Filters do not pass a generator, so the
    columns go through one that gives one row for each row.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also inside another function over an array, where
    Spark computes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def of_some(kind: DataType, one: Callable) -> Callable[[Column], Column]:
    """`one` as a UDF from text to `kind`, called for the rows that have a text. Batches without
    any, nearly all, cost no more than their nulls: nothing is made of a row."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def called(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return pa.nulls(len(texts), arrow)
        return pa.array([one(t.as_py()) if t.is_valid else None for t in texts], arrow)

    return called
