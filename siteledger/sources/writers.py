"""Result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import SparkSession, Window

from siteledger.functions import json as J
from siteledger.functions.urls import domain_of

#: A field that is for looking at a run, not for keeping.
RAW_FIELD = "rawJsonLd"


def _strip(value: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name != name]
        return F.when(
            value.isNotNull(),
            F.struct(*[_strip(value[f.name], f.dataType, name).alias(f.name) for f in kept]),
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _strip(v, kind.elementType, name))
    if isinstance(kind, T.MapType):
        values = F.transform_values(value, lambda _, v: _strip(v, kind.valueType, name))
        return F.map_filter(values, lambda k, _: k != name) if isinstance(kind.keyType, T.StringType) else values
    return value


def strip_field(df: DataFrame, name: str = RAW_FIELD) -> DataFrame:
    """Remove every field called `name`, at any depth, before writing."""
    kept = [f for f in df.schema.fields if f.name != name]
    return df.select(*[_strip(F.col(f.name), f.dataType, name).alias(f.name) for f in kept])


def _by_domain(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows laid out for one folder per domain. Range partitioning on the order lets a
    domain with very many rows be written by several tasks."""
    named = df.withColumn("domain", domain_of(F.col("site")))
    return named.repartitionByRange("domain", "site", *order).sortWithinPartitions(
        "domain", "site", *order
    )


def write_result_json(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in `path/domain=<host>/`, `rawJsonLd` fields left out."""
    _by_domain(strip_field(df), order).write.mode("overwrite").partitionBy("domain").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Markdown in `path/domain=<host>/`. The files of a folder, read in name order, are
    the report; only a report too long for one task has more than one."""
    laid_out = _by_domain(lines, ["section", "line"]).select("domain", "text")
    laid_out.write.mode("overwrite").partitionBy("domain").text(path)


# --- a whole run as one document per site ---------------------------------------------------

# Sections of a document: its head, one line per page, its foot.
HEAD, PAGE, FOOT = 0, 1, 2


def _objects(texts: str) -> Column:
    """A JSON array of canonical objects, without the field `RAW_FIELD` at any depth. Only texts
    that name it are taken apart."""
    named = F.exists(texts, lambda t: t.contains(f'"{RAW_FIELD}"'))
    cleaned = J.without_members_text(F.when(named, F.col(texts)), F.lit(RAW_FIELD))
    return J.array_text(F.coalesce(cleaned, F.col(texts)))


def run_fragments(pages: DataFrame, summary: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(site, section, pos, text): lines that, in this order, are one JSON document per site:
    {"site", "pages": [...], "summary": {...}, "metrics": {side: {...}}}. The inputs are those of
    an audit. Pages stay rows, so a site may have any number of them."""
    comparison = F.to_json(
        F.struct("schemas_match", "declared_calculated", "declared_checksum", "checksum_valid", "extracted_checksum", "extracted_matches_declared", "missing_in_extracted", "missing_in_declared", "note")
    )
    body = F.concat(
        F.lit('{"url":'), F.coalesce(J.quoted(F.col("page_url")), F.lit("null")), F.lit(',"declared":'), _objects("declared"),
        F.lit(',"extracted":'), _objects("extracted"), F.lit(',"comparison":'), comparison, F.lit("}"),
    )
    # Positions have no gaps, so the first page of a site is the one at 0.
    text = F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), body)
    rows = pages.select("site", F.lit(PAGE).alias("section"), F.col("pos").cast("bigint").alias("pos"), text.alias("text"))
    heads = summary.select("site", F.lit(HEAD).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit('{"site":'), J.quoted(F.col("site")), F.lit(',"pages":[')).alias("text"))
    feet = summary.select("site", F.to_json(F.struct(*[c for c in summary.columns if c != "site"])).alias("_summary"))
    measured = F.lit("{}")
    if metrics is not None:
        side = F.struct("side", F.to_json(F.struct(*[c for c in metrics.columns if c not in ("site", "side")])).alias("json"))
        sides = metrics.groupBy("site").agg(F.sort_array(F.collect_list(side)).alias("_sides"))
        feet = feet.join(sides, "site", "left")
        members = F.transform("_sides", lambda m: F.concat(J.quoted(m["side"]), F.lit(":"), m["json"]))
        measured = F.concat(F.lit("{"), F.coalesce(F.array_join(members, ","), F.lit("")), F.lit("}"))
    foot = F.concat(F.lit('],"summary":'), F.col("_summary"), F.lit(',"metrics":'), measured, F.lit("}"))
    feet = feet.select("site", F.lit(FOOT).alias("section"), F.lit(0).cast("bigint").alias("pos"), foot.alias("text"))
    return heads.unionByName(rows).unionByName(feet)


def write_run(pages: DataFrame, summary: DataFrame, path: str, metrics: DataFrame | None = None) -> None:
    """The documents of `run_fragments` in `path/domain=<host>/`, and `path/_manifest/`.

    Several tasks may write one document: the files of a folder, one after another in name
    order, are it (or one per site, where a domain has several). The manifest has a row per
    file: (domain, part, file, bytes, lines), part counting from 0."""
    spark = pages.sparkSession
    laid_out = _by_domain(run_fragments(pages, summary, metrics), ["section", "pos"]).select("domain", "text")
    laid_out.write.mode("overwrite").partitionBy("domain").text(path)
    files = spark.read.text(path).select("domain", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = files.groupBy("domain", "file", "bytes").agg(F.count(F.lit(1)).alias("lines"))
    part = F.row_number().over(Window.partitionBy("domain").orderBy("file")) - 1
    files.select("domain", part.alias("part"), "file", "bytes", "lines").write.mode("overwrite").json(f"{path}/_manifest")


MANIFEST = "domain string, part int, file string, bytes bigint, lines bigint"


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(domain, section, json) of what `write_run` wrote: one row per page, and one per site with
    its summary and metrics. Raises ValueError if files are missing, cut or not of this run."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/_manifest")
    lines = spark.read.text(path).select("domain", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value")
    there = lines.groupBy("domain", "file", "bytes").agg(F.count(F.lit(1)).alias("lines"))
    amiss = there.join(manifest, ["domain", "file", "bytes", "lines"], "full").filter("part IS NULL").unionByName(
        manifest.join(there, ["domain", "file", "bytes", "lines"], "left_anti"), allowMissingColumns=True
    )
    if wrong := amiss.select("domain", "file").first():
        raise ValueError(f"not as the manifest says: domain {wrong.domain}, file {wrong.file}")
    value = F.col("value")
    section = F.when(value.startswith("],"), FOOT).when(value.endswith('"pages":['), HEAD).otherwise(PAGE)
    json = F.when(section == FOOT, F.concat(F.lit("{"), F.substring(value, F.lit(3), F.length(value)))).otherwise(F.ltrim(value, F.lit(",")))
    return lines.select("domain", section.alias("section"), json.alias("json")).filter(F.col("section") != HEAD)
