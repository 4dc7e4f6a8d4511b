"""Bounded samples of labelled documents, for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import held_out


def fitting(rows: list[tuple], size: int) -> list:
    """Of (key, bytes), the keys that fit into `size` bytes, taken in order; one that does not fit is
    passed over. If none fits, the smallest alone."""
    taken, total = [], 0
    for key, own in rows:
        if total + own <= size:
            taken.append(key)
            total += own
    return taken or [min(rows, key=lambda r: r[1])[0] for _ in rows[:1]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, per_class: bool) -> DataFrame:
    """(doc_id, label, text): labelled documents, none of them held out, with whole texts.

    At most `rows` (of each class if `per_class`: label 1, and all other labels), those that come
    first by a hash of their id, and of them those that fit into `size` bytes of text, in
    this order. A text is taken once, and of rows that share a doc_id one. All that is collected
    here or broadcast is bounded by `rows`."""
    marks = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    pick = F.xxhash64("doc_id", F.lit(29))
    own = F.col("label") == 1
    classes = [marks.filter(own), marks.filter(~own)] if per_class else [marks]
    # An ordered limit keeps `rows` rows per task, whatever the size of a class.
    ids = None
    for part in classes:
        part = part.orderBy(pick, "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    chosen = chosen.join(F.broadcast(ids), "doc_id")
    first = F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text"))
    chosen = chosen.groupBy("doc_id").agg(first.alias("one")).select("doc_id", "one.*")
    chosen = chosen.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("one")).select("one.*", "text")
    sizes = chosen.select("doc_id", "label", pick.alias("pick"), F.octet_length("text").alias("size")).collect()
    taken = []
    for flag in (True, False) if per_class else (None,):
        part = sorted((r for r in sizes if flag is None or (r["label"] == 1) == flag), key=lambda r: (r["pick"], r["doc_id"]))
        taken += fitting([(r["doc_id"], r["size"]) for r in part], size)
    kept = docs.sparkSession.createDataFrame([(i,) for i in taken], docs.select("doc_id").schema)
    return chosen.join(F.broadcast(kept), "doc_id", "left_semi")
