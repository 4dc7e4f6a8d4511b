"""Captured inputs as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.operators.modules import parse_index

REQUEST_LOG = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("bytes_down", T.LongType()),
        T.StructField("bytes_up", T.LongType()),
        T.StructField("status", T.IntegerType()),
    ]
)
ERROR_LOG = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("time_ms", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)


def _whole_files(spark: SparkSession, path: str, text: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias(text))


def load_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(page_id, url, html): a parquet table, or a folder of HTML files, whose file URL
    then is both key and URL."""
    if format == "files":
        return _whole_files(spark, path, "html").select(F.col("url").alias("page_id"), "url", "html")
    return spark.read.format(format).load(path).select("page_id", "url", "html")


def load_site_index(source: DataFrame) -> DataFrame:
    """Parsed index documents of `source(site, raw)`."""
    return parse_index(source)


def load_modules(spark: SparkSession, path: str, format: str = "parquet", scheme: str = "https") -> DataFrame:
    """(site, module_url, raw) module documents as they were served.

    With `files`, `path/<host>/...` holds the documents of a site as files, laid out as it serves
    them: the module URL is the file's path below `path`. A file outside such a folder has
    no site, and its own URL."""
    if format == "files":
        files = _whole_files(spark, path, "raw")
        root = path.rstrip("/").split("://", 1)[-1].lstrip("/") + "/"
        below = F.element_at(F.split(F.col("url"), "/" + re.escape(root), 2), -1)
        inside = below.contains("/") & (below != F.col("url"))
        site = F.when(inside, F.concat(F.lit(f"{scheme}://"), F.substring_index(below, "/", 1)))
        module_url = F.when(inside, F.concat(F.lit(f"{scheme}://"), below)).otherwise(F.col("url"))
        return files.select(site.alias("site"), module_url.alias("module_url"), "raw")
    return spark.read.format(format).load(path).select("site", "module_url", "raw")


def load_request_log(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(REQUEST_LOG).format(format).load(path)


def load_error_log(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(ERROR_LOG).format(format).load(path)
