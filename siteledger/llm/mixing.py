"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Of all document rates between 0 and `most` that meet
it, those closest in relative entropy to one copy each are min(most, exp(theta * size)):
exponentially tilted by size, with one dual variable per source. The dual is convex and is
solved by Newton steps over aggregates; the rates are then rounded into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import Workspace

# Fixed values of the mix: weights in turn, words taken as a share of all, most copies.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
MAX_STEPS = 60
SETTLE_ROUNDS = 4
#: Rows of one source and size that are numbered together.
BUCKET_ROWS = 4096

_SOURCE = ["_none", "_src"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(_none, _src, source_size, target) of `sizes(_none, _src, size)`.

    Targets are min(most * source size, level * weight), which is where sharing the excess
    again and again by weight ends. One row per source is ordered in one task."""
    totals = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(*_SOURCE)) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double")
    table = totals.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    table = table.withColumn("_level", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_level", *_SOURCE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    table = table.withColumn("_reach", left / F.sum("_weight").over(rest))
    # The first source whose cap is above the level that the rest can be given sets the level.
    level = F.min(F.when(F.col("_reach") <= F.col("_level"), F.struct("_level", "_reach"))).over(everything)["_reach"]
    return table.select(
        *_SOURCE, "source_size", F.least("_cap", F.coalesce(level * F.col("_weight"), F.col("_cap"))).alias("target")
    )


def _solve(work: Workspace, sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_none, _src, theta): the dual variable of each source; NULL where all rates are `most`.

    `sizes` holds one row per source and size with its number of documents. Newton steps on
    all sources at once; a step that leaves the bracket known so far is replaced by its middle."""
    state = targets.select(
        *_SOURCE,
        "target",
        (F.col("source_size") / F.col("_docs")).alias("_mean"),
        F.lit(0.0).alias("theta"),
        F.lit(None).cast("double").alias("_lo"),
        F.lit(None).cast("double").alias("_hi"),
        (F.col("target") >= most * F.col("source_size")).alias("_all"),
        ((F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))).alias("_done"),
    )
    for step in range(MAX_STEPS):
        open_ones = state.filter("NOT _done")
        x = F.col("size") / F.col("_mean")
        rate = F.exp(F.least(F.col("theta") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        sums = (
            sizes.join(open_ones.select(*_SOURCE, "theta", "_mean"), _SOURCE)
            .groupBy(*_SOURCE)
            .agg(
                F.sum(words * F.least(rate, F.lit(float(most)))).alias("_f"),
                F.sum(F.when(rate < most, words * x * rate).otherwise(0.0)).alias("_d"),
            )
        )
        moved = state.join(sums, _SOURCE, "left")
        gap = F.col("_f") - F.col("target")
        lo = F.when(gap < 0, F.col("theta")).otherwise(F.col("_lo"))
        hi = F.when(gap > 0, F.col("theta")).otherwise(F.col("_hi"))
        moved = moved.withColumns({"_gap": gap, "_lo2": lo, "_hi2": hi})
        newton = F.when(F.col("_d") > 0, F.col("theta") - F.col("_gap") / F.col("_d"))
        inside = newton.isNotNull() & (F.col("_lo2").isNull() | (newton > F.col("_lo2"))) & (F.col("_hi2").isNull() | (newton < F.col("_hi2")))
        middle = F.when(F.col("_lo2").isNull(), 2 * F.col("_hi2") - 1).when(F.col("_hi2").isNull(), 2 * F.col("_lo2") + 1).otherwise((F.col("_lo2") + F.col("_hi2")) / 2)
        near = F.abs(F.col("_gap")) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-9)
        stays = F.col("_done") | near
        state = work.keep(
            f"theta-{step}",
            moved.select(
                *_SOURCE,
                "target",
                "_mean",
                F.when(stays, F.col("theta")).when(inside, newton).otherwise(middle).alias("theta"),
                F.col("_lo2").alias("_lo"),
                F.col("_hi2").alias("_hi"),
                "_all",
                stays.alias("_done"),
            ),
        )
        if state.filter("NOT _done").isEmpty():
            break
    return state.select(*_SOURCE, "_mean", F.when(~F.col("_all"), F.col("theta")).alias("theta"))


def _copies(rates: DataFrame, most: int) -> DataFrame:
    """`rates(_none, _src, size, n, rate, target)` with copies: whole copies of all documents
    of that source and size together.

    Going up in size, the running sum of rates is rounded, so no stretch of sizes is off by a
    whole copy. What is then missing or too much is settled by the largest sizes that fit."""
    running = Window.partitionBy(*_SOURCE).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.col("n") * F.col("rate")).over(running)
    out = rates.withColumn("_upto", F.floor(upto + 0.5)).withColumn(
        "copies",
        F.col("_upto") - F.coalesce(F.lag("_upto").over(Window.partitionBy(*_SOURCE).orderBy("size")), F.lit(0)),
    )
    out = out.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), most * F.col("n"))).drop("_upto")
    whole = Window.partitionBy(*_SOURCE)
    for _ in range(SETTLE_ROUNDS):
        out = out.withColumn("_short", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(F.col("_short") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_short")) & (room > 0)
        out = out.withColumn("_pick", F.max(F.when(fits, F.col("size"))).over(whole))
        times = F.least(room, F.floor(F.abs("_short") / F.greatest("size", F.lit(1))))
        change = F.when(F.col("size") == F.col("_pick"), F.signum("_short").cast("long") * times).otherwise(0)
        out = out.withColumn("copies", F.col("copies") + change).drop("_short", "_pick")
    return out


def entropy_mix(
    docs: DataFrame, size: Column, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES, seed: int = 17
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, rate) of each row of
    `docs(doc_id, source, ...)`; `size` counts its words.

    Rows without source form the last source. Rows of size 0 take nothing. Copies follow from
    doc_id, size, source and `seed`, so runs agree; rows that repeat a doc_id are rows of
    their own. A source whose target is most * its size takes every document `most` times. An
    empty table gives an empty mix.
    """
    work = Workspace(docs.sparkSession)
    key = F.col("source").cast("string")
    rows = work.keep(
        "sizes",
        docs.select(
            F.col("doc_id"),
            key.isNull().alias("_none"),
            F.coalesce(key, F.lit("")).alias("_src"),
            size.cast("long").alias("size"),
            (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 31)) / (1 << 31)).alias("_u"),
        ),
    )
    counts = work.keep("counts", rows.groupBy(*_SOURCE, "size").agg(F.count(F.lit(1)).alias("n")))
    docs_per = counts.groupBy(*_SOURCE).agg(F.sum("n").alias("_docs"))
    targets = work.keep(
        "targets", source_targets(counts.withColumn("size", F.col("n") * F.col("size")), weights, share, most).join(docs_per, _SOURCE)
    )
    solved = _solve(work, counts, targets, most)
    x = F.col("size") / F.col("_mean")
    rate = F.when(F.col("theta").isNull(), float(most)).when(F.col("_mean") == 0, 1.0).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("theta") * x, F.lit(50.0))))
    )
    rates = counts.join(solved, _SOURCE).join(targets.drop("_docs"), _SOURCE).withColumn("rate", rate)
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))
    plan = work.keep(
        "plan",
        _copies(rates, most).select(
            *_SOURCE,
            "size",
            "rate",
            "source_size",
            "target",
            F.floor(F.col("copies") / F.col("n")).alias("_each"),
            (F.col("copies") % F.col("n")).alias("_more"),
            split.alias("_split"),
        ),
    )
    placed = rows.join(plan, [*_SOURCE, "size"]).withColumn("_bucket", F.floor(F.col("_u") * F.col("_split")))
    group = [*_SOURCE, "size"]
    buckets = placed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*group, "_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_u", "doc_id"))
    ranked = placed.withColumn("_place", place).join(offsets, [*group, "_bucket"])
    extra = F.when(F.col("_offset") + F.col("_place") <= F.col("_more"), 1).otherwise(0)
    copies = (F.col("_each") + extra).cast("long")
    return ranked.select(
        "doc_id",
        F.when(~F.col("_none"), F.col("_src")).alias("source"),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        "rate",
    )
