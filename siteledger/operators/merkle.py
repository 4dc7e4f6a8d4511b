"""Merkle roots over very long leaf lists.

A root is the pairwise SHA-256 of concatenated hex text, an odd last node being paired
with itself. Leaves are gathered in blocks of 2^12 neighbours, never as one list per
site: a block is reduced inside one row, its node takes the block's number as its new
position, and the next pass groups those. A site holding most of all leaves is thus
spread over as many groups as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.operators.ranking import rank_in_group

BLOCK_LEVELS = 12
BLOCK = 1 << BLOCK_LEVELS


def _next_level(nodes: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)),
        lambda i: F.sha2(
            F.concat(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.get(nodes, i))), 256
        ),
    )


def root_of(leaves: Column) -> Column:
    """Root of a short leaf array; an empty array gives an empty text."""
    top = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        leaves,
        lambda nodes, _: F.when(F.size(nodes) <= 1, nodes).otherwise(_next_level(nodes)),
    )
    return F.coalesce(F.get(top, F.lit(0)), F.lit(""))


def _block_node(leaves: Column, block: Column, levels: int) -> Column:
    """Node of one block. The first block stops at its root, as it may be the only one;
    a later block always climbs all levels, pairing a single node with itself."""
    top = F.aggregate(
        F.sequence(F.lit(1), F.lit(levels)),
        leaves,
        lambda nodes, _: F.when((block == 0) & (F.size(nodes) == 1), nodes).otherwise(
            _next_level(nodes)
        ),
    )
    return F.get(top, F.lit(0))


def _column(i: int) -> Column:
    return F.transform("_rows", lambda r: r[f"_leaf{i}"])


def _dense(df: DataFrame, by: list[str], pos: str, leaves: list[str], block: int) -> DataFrame:
    """Renumber positions without gaps, rows with no leaf left out. Block sizes and blocks come from one exchange:
    the sizes are taken from the gathered arrays, so Spark reuses the shuffle."""
    known = F.col(leaves[0]).isNotNull()
    row = F.struct(F.col(pos).alias("p"), *leaves)
    gathered = (
        df.withColumn("_block", F.floor(F.col(pos) / block))
        .groupBy(*by, "_block")
        .agg(F.sort_array(F.collect_list(F.when(known, row))).alias("_rows"))
    )
    sizes = gathered.select(*by, "_block", F.size("_rows").cast("bigint").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        gathered.join(offsets, [*by, "_block"])
        .select(*by, "_offset", F.posexplode("_rows").alias("_i", "_row"))
        .select(*by, (F.col("_offset") + F.col("_i")).alias(pos), *[f"_row.{c}" for c in leaves])
    )


def merkle_roots(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    leaves: dict[str, str],
    dense: bool = True,
    folds: dict[str, tuple[Column, str]] | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Roots per `by`, one output column per entry of `leaves` (output name -> column).

    `pos` orders the leaves, from 0. With `dense=False` it may have gaps, and rows whose
    first leaf column is NULL are skipped. `folds` names
    further aggregates taken in the same passes: output -> (first aggregate, the SQL
    aggregate that merges its values, such as `sum` or `bool_and`).
    """
    by, block = list(by), 1 << levels
    folds = folds or {}
    columns = list(leaves.values())
    if not dense:
        if folds:
            raise ValueError("folds need dense positions")
        df = _dense(df, by, pos, columns, block)
    named = [F.col(c).alias(f"_leaf{i}") for i, c in enumerate(columns)]
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), *named))).alias("_rows")
    grouped = (
        df.withColumn("_block", F.floor(F.col(pos) / block))
        .groupBy(*by, "_block")
        .agg(rows, *[first.alias(name) for name, (first, _) in folds.items()])
    )
    for last in (False, True):
        nodes = [
            _block_node(_column(i), F.col("_block"), levels).alias(f"_leaf{i}")
            for i in range(len(columns))
        ]
        reduced = grouped.select(*by, F.col("_block").alias("p"), *nodes, *folds)
        keys = by if last else [*by, "_block"]
        if not last:
            reduced = reduced.withColumn("_block", F.floor(F.col("p") / block))
        again = F.sort_array(
            F.collect_list(F.struct("p", *[f"_leaf{i}" for i in range(len(columns))]))
        ).alias("_rows")
        merged = [F.expr(f"{how}({name})").alias(name) for name, (_, how) in folds.items()]
        grouped = reduced.groupBy(*keys).agg(again, *merged)
    roots = [
        root_of(_column(i)).alias(name)
        for i, name in enumerate(leaves)
    ]
    return grouped.select(*by, *roots, *folds)


def merkle_index(modules: DataFrame, by: Sequence[str], path: str, leaf: str) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) of a new index: rows (by..., ord, path, leaf) are the modules of a group in the
    locale order of their paths, from 0; roots (by..., n, merkle_root) are over the leaves in
    that order. Modules of equal path are ordered by leaf."""
    rows = rank_in_group(modules.select(*by, path, leaf), by, [F.collate(F.col(path), "UNICODE"), F.col(leaf)], "ord")
    roots = merkle_roots(rows, by, "ord", {"merkle_root": leaf}, folds={"n": (F.count(F.lit(1)), "sum")})
    return rows.select(*by, "ord", path, leaf), roots
