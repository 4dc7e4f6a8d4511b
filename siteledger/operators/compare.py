"""Pairing declared modules with extracted pages, and the site summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import json as J
from siteledger.operators.membership import marked, members
from siteledger.operators.merkle import merkle_roots

# Outcome texts.
SHALLOW_NOTE = "This is a shallow diff. For deep diffs, use a JSON diff tool."
ALL_MATCH = "All schemas match."
PAGE_UNREADABLE = "Page could not be read."
SOME_DIFFER = "Some schemas do not match."

EMPTY_CHECKSUM_INPUT = "{}"

#: Modules naming one page from which on they are split, and into how many parts at most.
HEAVY_PAGE, MOST_PARTS = 1000, 1024


def _split_pages(left: DataFrame, right: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join on. Where more than `heavy` modules name a page, they
    are dealt over parts, and the page is repeated for each part.

    Heavy pages are marked on both sides by the same set of bounded size; a page that it marks
    by mistake is split as well, which changes no result."""
    counts = left.groupBy("_url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return left, right, ["_url"]
    parts = min(MOST_PARTS, -(-most // heavy))
    pages = members(counts, "_url")
    part = F.pmod(F.xxhash64("site", "pos"), F.lit(parts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    left = marked(left, F.col("_url"), pages, "_heavy").withColumn("_part", F.when(F.col("_heavy"), part).otherwise(0))
    right = marked(right, F.col("_url"), pages, "_heavy").withColumn(
        "_part", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0))))
    )
    return left, right, ["_url", "_part"]


def pair_pages(declared: DataFrame, extracted: DataFrame, heavy: int = HEAVY_PAGE) -> DataFrame:
    """One row per module, repeats kept, with the extraction of its page.

    A module without a page URL, or whose page was not captured, gets no objects. NULL
    URLs are given a key of their own so they do not gather in one partition, and a page that
    more than `heavy` modules name is split over several. `declared` is read twice, so it had
    better be a table."""
    own = F.concat(F.lit("\u0000"), "site", F.lit("\u0000"), F.col("pos").cast("string"))
    left = declared.withColumn("_url", F.coalesce("page_url", own))
    right = extracted.select(
        F.col("url").alias("_url"),
        F.col("objects").alias("extracted"),
        F.col("first_keys").alias("extracted_keys"),
        F.col("checksum").alias("_extracted_checksum"),
        "extracted_ok",
    )
    none = F.array().cast("array<string>")
    left, right, on = _split_pages(left, right, heavy)
    return left.join(right, on, "left").select(
        "site",
        "pos",
        "page_url",
        F.col("objects").alias("declared"),
        F.coalesce("extracted", none).alias("extracted"),
        F.col("first_keys").alias("declared_keys"),
        "extracted_keys",
        F.col("checksum").alias("declared_calculated"),
        F.coalesce("_extracted_checksum", F.sha2(F.lit(EMPTY_CHECKSUM_INPUT), 256)).alias(
            "extracted_checksum"
        ),
        "declared_checksum",
        "checksum_valid",
        (F.col("status") == "success").alias("declared_ok"),
        F.coalesce("extracted_ok", F.lit(False)).alias("extracted_ok"),
        *[c if c in declared.columns else F.lit(None).cast("string").alias(c) for c in ("module_url", "error")],
    )


def errors_found(pages: DataFrame) -> DataFrame:
    """Error log rows (site, side, url, error, time_ms, seq) for what the comparison met: modules
    that cannot be used, and pages that were not captured or could not be read. They have no
    time; seq is the module's position."""
    module = F.when(F.col("error").isNotNull(), F.struct(F.lit("declared").alias("side"), F.col("module_url").alias("url"), "error"))
    unread = F.col("page_url").isNotNull() & ~F.col("extracted_ok")
    page = F.when(unread, F.struct(F.lit("extracted").alias("side"), F.col("page_url").alias("url"), F.lit(PAGE_UNREADABLE).alias("error")))
    rows = pages.select("site", F.col("pos").cast("bigint").alias("seq"), F.inline(F.array_compact(F.array(module, page))))
    return rows.select("site", "side", "url", "error", F.lit(None).cast("bigint").alias("time_ms"), "seq")


def objects_equal(declared: Column, extracted: Column) -> Column:
    """Same objects in the same order; the order of keys is not compared."""
    return J.array_text(declared) == J.array_text(extracted)


def shallow_key_diff(paired: DataFrame) -> DataFrame:
    """Add, where the sides differ, the top-level names each first object lacks."""
    none = F.array().cast("array<string>")
    declared = F.coalesce("declared_keys", none)
    extracted = F.coalesce("extracted_keys", none)
    differs = ~F.col("schemas_match")
    return paired.withColumns(
        {
            "missing_in_extracted": F.when(
                differs, F.filter(declared, lambda k: ~F.array_contains(extracted, k))
            ),
            "missing_in_declared": F.when(
                differs, F.filter(extracted, lambda k: ~F.array_contains(declared, k))
            ),
            "note": F.when(differs, SHALLOW_NOTE),
        }
    )


def compare_pages(paired: DataFrame) -> DataFrame:
    """Page comparison rows."""
    df = paired.withColumns(
        {
            "schemas_match": objects_equal(F.col("declared"), F.col("extracted")),
            "extracted_matches_declared": F.col("extracted_checksum") == F.col("declared_calculated"),
        }
    )
    return shallow_key_diff(df)


def site_summary(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Summary per ready site: page count, match flag, three roots, three flags.

    The count and the flag travel with the Merkle passes, so the page rows are shuffled
    once for all of them. `index` is `site_readiness` output."""
    roots = merkle_roots(
        pages,
        ["site"],
        "pos",
        {
            "merkle_root_declared": "declared_calculated",
            "merkle_root_extracted": "extracted_checksum",
        },
        folds={
            "total_pages": (F.count(F.lit(1)), "sum"),
            "all_match": (F.bool_and("schemas_match"), "bool_and"),
        },
    )
    ready = index.filter(F.col("error").isNull()).select("site", "merkle_root")
    df = ready.join(roots, "site", "left")
    declared = F.coalesce("merkle_root_declared", F.lit(""))
    extracted = F.coalesce("merkle_root_extracted", F.lit(""))
    declared_valid = F.coalesce(declared == F.col("merkle_root"), F.lit(False))
    extracted_valid = F.coalesce(extracted == F.col("merkle_root"), F.lit(False))
    all_match = F.coalesce("all_match", F.lit(True))
    return df.select(
        "site",
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        all_match.alias("all_match"),
        F.when(all_match, ALL_MATCH).otherwise(SOME_DIFFER).alias("details"),
        declared.alias("merkle_root_declared"),
        extracted.alias("merkle_root_extracted"),
        F.col("merkle_root").alias("merkle_root_index"),
        declared_valid.alias("declared_root_valid"),
        extracted_valid.alias("extracted_root_valid"),
        (declared_valid & extracted_valid).alias("roots_match"),
    )


def crawl_merkle(pages: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Root over page checksums of an extracted-only run, in `pos` order."""
    return merkle_roots(pages, by, pos, {"merkle_root": "checksum"}, dense=False)


def method_compare(runs: DataFrame) -> DataFrame:
    """Per URL: time, objects, trust and details of each method, and whether both sides
    hold the same objects (NULL unless both were run).

    `runs(url, method, start_ms, end_ms, objects_checksum, trust, details)`; a URL seen
    several times by one method keeps its latest run, whole: of runs with equal times the
    one with the largest objects, trust and details, in this order."""
    run = F.struct("start_ms", "end_ms", "objects_checksum", "trust", "details")
    methods = ("declared", "extracted")
    latest = runs.groupBy("url").agg(
        *[F.max(F.when(F.col("method") == m, run)).alias(m) for m in methods]
    )
    columns = []
    for m in methods:
        columns += [
            (F.col(f"{m}.end_ms") - F.col(f"{m}.start_ms")).alias(f"{m}_ms"),
            F.col(f"{m}.objects_checksum").alias(f"{m}_objects"),
            F.col(f"{m}.trust").alias(f"{m}_trust"),
            F.col(f"{m}.details").alias(f"{m}_details"),
        ]
    same = F.col("declared_objects") == F.col("extracted_objects")
    return latest.select("url", *columns).withColumn("schema_match", same)
