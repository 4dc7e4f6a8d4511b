"""The corpus pipeline: documents in, packed training pieces out.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the
columns of documents; the last returns piece ids. Stages are written as Parquet between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import jaccard, mil, mixing, phrases, pieces, sketch
from siteledger.llm.common import Workspace, table
from siteledger.llm.queries import PIECE_MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Places from here on are those of rows that have no doc_id of their own.
LATE = 1 << 62

#: SQL cannot express the learned stages; tests hold each against a plain version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    scored = mil.classify_quality(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.filter("predicted = 1").select(*COLUMNS)


def row_key(*columns: str) -> Column:
    """A 64-bit hash of these columns, nulls told apart: equal rows have equal keys. What
    two unlike rows with one key come to is said where it is used."""
    return F.xxhash64(*(c for name in columns for c in (F.isnull(name), F.col(name))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, and one without
    doc_id only if the group has no other.

    Five-word shingles and a similarity of 0.8, judged on rows: rows that repeat a doc_id with
    unlike texts are in the groups of their texts. A row without a word is a group of its own,
    but of those that repeat doc_id and text one stays. Should two unlike rows have one key,
    both stay if either does."""
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("_key"), "text")
    found = jaccard.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"), width=5, percent=80)
    found = found.withColumnRenamed("doc_id", "_key").distinct()
    ids = keyed.select("_key", "doc_id").distinct()
    place = F.struct(F.isnull("doc_id"), "doc_id", "_key")
    kept = (
        found.join(ids, "_key")
        .groupBy("component_id")
        .agg(F.min_by(F.struct("_key", "n_shingles"), place).alias("_one"))
        .select("_one.*")
        .groupBy("_key")
        .agg(F.max("n_shingles").alias("_n"))
    )
    taken = docs.withColumn("_key", row_key("doc_id", "text")).join(kept, "_key")
    # Nothing says that rows with neither a doc_id nor a word are the same.
    own = F.when((F.col("_n") > 0) | F.col("doc_id").isNotNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = taken.withColumn("_own", own).groupBy("_key", "_own", "doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    return once.select("doc_id", "text", "_rest.*").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand earlier; what has no word left goes.

    Texts that lose nothing stay as they are. Rows without doc_id, and those that repeat one
    with another text, come after all others, each at a place of its own."""
    late = row_key("doc_id", "text").bitwiseAND(LATE - 1).bitwiseOR(LATE)
    rows = docs.select(*COLUMNS, late.alias("_late"), F.coalesce(F.col("doc_id").cast("long"), late).alias("_id"))
    several = rows.groupBy("_id").agg(F.min("_late").alias("_first"), F.max("_late").alias("_last")).filter("_first <> _last")
    several = Workspace(spark).keep("several", several.select("_id", "_first"))
    place = F.when(F.col("_late") != F.col("_first"), F.col("_late")).otherwise(F.col("_id"))
    placed = rows.join(several, "_id", "left").withColumns({"_doc_id": F.col("doc_id"), "doc_id": place})
    found = phrases.remove_repeats(placed.select("_doc_id", *COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = found.filter("n_removed = 0 OR kept <> ''").withColumns({"text": text, "doc_id": F.col("_doc_id")})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row as often as it is taken. Rows equal in all columns share their copies."""
    keyed = docs.select(row_key(*COLUMNS).alias("_key"), *COLUMNS)
    mix = mixing.entropy_mix(keyed.withColumn("doc_id", F.col("_key")), F.size(sketch.word_array(F.col("text"))))
    copies = mix.filter("copies > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").cast("int").alias("_copies"))
    taken = keyed.join(copies, "_key").dropDuplicates(["_key", *COLUMNS])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with whether they decode to it."""
    both = pieces.encode_and_decode(docs.select(*COLUMNS), PIECE_MODEL, COLUMNS)
    return both.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = work.keep(f"stage-{n}", stage(spark, docs, sf_dir))
        if n:
            work.drop([f"stage-{n - 1}"])
    return docs
