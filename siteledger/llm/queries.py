"""One query per operator over its whole table, and the oracles SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import chats, jaccard, langid, licenses, manifest, mil, mixing, phrases, pieces, rules, sketch, toxic, trie
from siteledger.llm.common import table
from siteledger.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

#: The SentencePiece model that op6 and the pipeline encode with.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.entropy_mix(_documents(spark, sf_dir), F.size(sketch.word_array(F.col("text"))))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    sha = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return phrases.remove_repeats(docs).select("doc_id", "n_words", "n_removed", sha)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda text: F.sha2(F.col(text).cast("binary"), 256)
    # Of the text, only its digest stays.
    docs = _documents(spark, sf_dir).select("doc_id", "text", sha("text").alias("_digest"))
    both = pieces.encode_and_decode(docs, PIECE_MODEL, ["doc_id", "_digest"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", sha("decoded").alias("decoded_sha256"), sha("decoded").eqNullSafe(F.col("_digest")).alias("lossless")
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pipeline imports this module for the place of the piece model.
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1,
    "op2_quality_classifier": lambda spark, sf: mil.classify_quality(_documents(spark, sf), table(spark, sf, "labels")),
    "op3_substring_dedup": op3,
    "op4_license_scans": lambda spark, sf: licenses.license_scan(_documents(spark, sf)),
    "op5_quality_rules": lambda spark, sf: rules.quality_rules(_documents(spark, sf), table(spark, sf, "labels")),
    "op6_sentencepiece": op6,
    "op7_language_id": lambda spark, sf: langid.identify_language(_documents(spark, sf)),
    "op8_ngram_jaccard_join": lambda spark, sf: jaccard.jaccard_components(_documents(spark, sf)),
    "op9_toxicity": lambda spark, sf: toxic.score_toxicity(_documents(spark, sf), table(spark, sf, "labels")),
    "op10_fingerprints": lambda spark, sf: sketch.edited_fingerprints(_documents(spark, sf)),
    "op11_chat_formatting": lambda spark, sf: chats.chat_digests(_conversations(spark, sf)),
    "op12_merkle_manifest": lambda spark, sf: manifest.tampered_manifest(_documents(spark, sf)),
    "op13_prefix_trie": lambda spark, sf: trie.prefix_trie(trie.rebuilt(_conversations(spark, sf))),
    "pipeline": pipeline,
}
