"""The two whole runs: a site audit and an extracted-only crawl."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.operators import compare as C
from siteledger.operators import extract as X
from siteledger.operators import metrics as H
from siteledger.operators import modules as MOD
from siteledger.operators.captures import latest_of
from siteledger.session import stored


class Audit(NamedTuple):
    """An audit's result. Sites can have any number of pages, so pages are rows, keyed by
    site and position, next to one summary row and two metric rows per site."""

    errors: DataFrame
    pages: DataFrame
    summary: DataFrame
    metrics: DataFrame | None


def page_comparison(index: DataFrame, modules: DataFrame, captures: DataFrame, max_pages: int | None = None) -> DataFrame:
    """`captures(url, html)` against the modules the sites list.

    The modules are read first and written once; of the captures only the latest of pages
    that a module names are then parsed, in the tasks that read them."""
    return _parsed_comparison(MOD.parse_index(index), modules, captures, max_pages)


def _parsed_comparison(parsed: DataFrame, modules: DataFrame, captures: DataFrame, max_pages: int | None) -> DataFrame:
    declared = stored(MOD.read_modules(MOD.locate_parsed(parsed, modules, max_pages)), "audit-declared")
    wanted = declared.select(F.col("page_url").alias("url")).filter("url IS NOT NULL")
    extracted = X.extract_page(latest_of(captures, wanted), key="url")
    return C.compare_pages(C.pair_pages(declared, extracted))


def all_errors(pages: DataFrame, log: DataFrame | None, errors: DataFrame | None, samples: DataFrame | None) -> DataFrame:
    """The given error log and what the comparison itself met. The latter counts for the sides of
    sites that a log names, as only these were measured; `compare.errors_found` has all."""
    given = [df.select("site", "side").distinct() for df in (log, errors, samples) if df is not None]
    measured = reduce(DataFrame.unionByName, given).distinct()
    found = C.errors_found(pages).join(measured, ["site", "side"], "left_semi")
    names = ["site", "side", "url", "error", "time_ms", "seq"]
    return found if errors is None else errors.select(*names).unionByName(found.select(*names))


def run_audit(
    index: DataFrame,
    modules: DataFrame,
    captures: DataFrame,
    log: DataFrame | None = None,
    errors: DataFrame | None = None,
    samples: DataFrame | None = None,
    max_pages: int | None = None,
) -> Audit:
    """Audit every site of `index(site, raw)`. With `max_pages`, only the first modules
    of each site take part; the default is all of them. `modules` and `captures` may hold
    several captures of a module or page, of which the latest counts. Each of the three logs
    may be missing; without any, there are no metrics.

    The page rows are written to the shared folder once: the summary, the report and
    the result files all read them, and none extracts the pages again."""
    # An index may list most of all modules, so it is taken apart once.
    readiness = stored(MOD.site_readiness(index).select("site", "modules", "merkle_root", "error"), "audit-index")
    pages = stored(_parsed_comparison(readiness, modules, captures, max_pages), "audit-pages")
    metrics = None
    if not (log is None and errors is None and samples is None):
        metrics = stored(H.metrics_summary(log, all_errors(pages, log, errors, samples), samples), "audit-metrics")
    failed = readiness.filter(F.col("error").isNotNull()).select("site", "error")
    summary = stored(C.site_summary(readiness, pages), "audit-summary")
    return Audit(failed, pages, summary, metrics)


def run_crawl(urls: DataFrame, captures: DataFrame, strict: bool = False) -> DataFrame:
    """(site, ord, url, objects, checksum, …) for discovered `urls(site, ord, url)`; a URL
    without a capture keeps its place as a page that could not be read. Of several captures
    of a page the latest counts; captures of other pages are not parsed."""
    urls = stored(urls, "crawl-urls")
    pages = X.extract_page(latest_of(captures, urls), key="url", strict=strict)
    found = urls.join(pages, "url", "left")
    none = F.array().cast("array<string>")
    return found.withColumns(
        {
            "objects": F.coalesce("objects", none),
            "checksum": F.coalesce("checksum", F.sha2(F.lit(C.EMPTY_CHECKSUM_INPUT), 256)),
            "bytes_downloaded": F.coalesce("bytes_downloaded", F.lit(0)),
            "details": F.coalesce("details", F.lit(X.PAGE_UNREADABLE)),
            "extracted_ok": F.coalesce("extracted_ok", F.lit(False)),
        }
    )
