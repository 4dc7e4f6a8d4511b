"""Bottom-k sketches of word shingles: the k smallest distinct shingle hashes of a text.

Sketches of parts merge into the sketch of the whole; two sketches give the resemblance and
containment of their texts, and one gives its number of distinct shingles. Everything is
a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import let
from siteledger.session import durable

SHINGLE_WORDS = 5
SKETCH_SIZE = 64
#: Ids that one block of the search for the next document spans.
BLOCK_IDS = 4096

_DELIMITERS = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _DELIMITERS), lambda w: w != "")


def bottom_k(text: Column, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> Column:
    """The sketch of a text. With fewer words than `width` its whole word sequence is one
    shingle; a null, empty or blank text has an empty sketch."""

    def of(words: Column) -> Column:
        runs = F.greatest(F.size(words) - width + 1, F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), runs), lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(word_array(text), of))), 1, k)


def merged(one: Column, two: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(one, two)), 1, k)


def resemblance(one: Column, two: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold. Two
    empty sketches are alike, an empty and a filled one are not."""
    both = let(merged(one, two, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, one), two)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(one) == 0) & (F.size(two) == 0), 1.0).otherwise(both)


def distinct_shingles(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / reach)


def containment(one: Column, two: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the first set that the second holds, 0 to 1; 1 for an empty first."""
    shared = resemblance(one, two, k) * distinct_shingles(merged(one, two, k), k)
    return F.when(F.size(one) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(one, k)))


def merge_sketches(parts: DataFrame, by: list[str], sketch: str, k: int = SKETCH_SIZE) -> DataFrame:
    """(by..., sketch): one sketch per group from the sketches of its parts. Spark keeps at
    most k hashes of a group per task before the shuffle, whatever the group's size."""
    hashes = parts.select(*by, F.explode(sketch).alias("_hash"))
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("_hash"))
    least = hashes.withColumn("_place", place).filter(F.col("_place") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_set("_hash")).alias(sketch))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _following(keys: DataFrame) -> DataFrame:
    """(key, next): each distinct key with the next larger one, the largest with the smallest.

    Keys are range-partitioned; only the edges of partitions meet in one task."""
    placed = durable(
        keys.distinct().repartitionByRange("key").sortWithinPartitions("key").withColumn("_part", F.spark_partition_id())
    )
    edges = placed.groupBy("_part").agg(F.min("key").alias("_first"))
    order = Window.orderBy("_part")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "_part", F.coalesce(F.lead("_first").over(order), F.min("_first").over(everything)).alias("_after")
    )
    inside = F.lead("key").over(Window.partitionBy("_part").orderBy("key"))
    return placed.withColumn("_next", inside).join(edges, "_part").select(
        "key", F.coalesce("_next", "_after").alias("next")
    )


def edited_fingerprints(docs: DataFrame, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each row of `docs(doc_id, text)` and of its edited text, in which the
    beginning of the next document takes the place of the last quarter.

    Rows are ordered by doc_id (null last), then by text, so rows that repeat a doc_id have
    a defined next one; the last is followed by the first, a single row by itself. A null
    text counts as empty; empty texts have an empty fingerprint. Other columns are ignored.

    Rows meet their next one inside blocks of doc_id; only the first row of a block travels
    to the block before it. Sketches are made before that exchange.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Rows without doc_id come last, as a block of their own.
    block = F.coalesce(F.floor(F.col("doc_id") / F.lit(BLOCK_IDS)), F.lit((1 << 63) - 1)).cast("long")
    rows = rows.withColumn("block", block)
    firsts = rows.groupBy("block").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("_id"), "text"))["text"].alias("_text")
    )
    follows = _following(rows.select(F.col("block").alias("key")))
    heads = firsts.join(follows.withColumnRenamed("next", "block"), "block").select(
        F.col("key").alias("block"), F.struct(F.col("_text").alias("text"), bottom_k(F.col("_text"), k, width).alias("sketch")).alias("_head")
    )
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    within = F.lead(F.struct("text", "sketch")).over(order)
    paired = (
        rows.withColumn("sketch", bottom_k(F.col("text"), k, width))
        .withColumn("_within", within)
        .join(heads, "block", "left")
        .withColumn("_next", F.coalesce("_within", "_head"))
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    done = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("_edited"),
        "sketch",
        F.col("_next.sketch").alias("_next_sketch"),
    ).withColumns({"_edited_sketch": bottom_k(F.col("_edited"), k, width)})
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"),
    )
