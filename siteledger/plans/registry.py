"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.functions import formats as M
from siteledger.functions import json as J
from siteledger.functions import text as X
from siteledger.functions import urls as U
from siteledger.operators import captures as captured
from siteledger.operators import compare as C
from siteledger.operators import discover as D
from siteledger.operators import extract as E
from siteledger.operators import metrics as H
from siteledger.operators import modules as MOD
from siteledger.operators import report as R
from siteledger.operators.html import html_elements
from siteledger.operators import merkle
from siteledger.operators.merkle import merkle_roots
from siteledger.plans import audit as A
from siteledger.plans import bridges as B
from siteledger.session import shared_folder, stored
from siteledger.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _variants(df: DataFrame, *values: Column) -> DataFrame:
    """Each row once per value, as (…, variant, v)."""
    return df.select("*", F.posexplode(F.array(*values)).alias("variant", "v"))


def _text(array: str) -> Column:
    return J.array_text(F.col(array))


# --- sources and sinks -------------------------------------------------------------------


@query
def load_pages(spark, sf):
    pages = readers.load_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", X.utf8_bytes(F.col("html")).alias("bytes"), F.md5("html").alias("digest"))


@query
def load_site_index(spark, sf):
    return readers.load_site_index(B.site_index(spark, sf)).select(
        "site", "version", "strategy", "merkle_root",
        F.when(F.col("modules").isNotNull(), F.size("modules")).cast("bigint").alias("n_modules"),
        F.get("modules", F.lit(0)).alias("first_module"),
    )


def _folder(spark, name):
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def load_modules(spark, sf):
    """Module documents, written as they were served and read again."""
    path = _folder(spark, "modules")
    B.modules(spark, sf).write.parquet(path)
    return readers.load_modules(spark, path).select("site", "module_url", F.sha2("raw", 256).alias("digest"))


@query
def load_request_log(spark, sf):
    """The log as JSON lines, read again."""
    path = _folder(spark, "request-log")
    B.request_log(spark, sf).select(*[f.name for f in readers.REQUEST_LOG]).write.json(path)
    return readers.load_request_log(spark, path).select(
        "site", "side", "url", "method", "start_ms", "end_ms", "bytes_down", "bytes_up",
        F.col("status").cast("bigint").alias("status"),
    )


@query
def write_result_json(spark, sf):
    """The rows that `write_result_json` put into `domain=<host>/`, read again."""
    pages = _audit_pages(spark, sf).withColumn("rawJsonLd", F.lit("dropped"))
    path = _folder(spark, "result")
    writers.write_result_json(pages.select("site", "pos", "page_url", "schemas_match", "extracted_checksum", "rawJsonLd"), path, ["pos"])
    pos = F.get_json_object("value", "$.pos").cast("int")
    return spark.read.text(path).select("domain", pos.alias("pos"), F.col("value").alias("json"))


@query
def write_run(spark, sf):
    """The pages and summaries of a whole run, read again from the documents it wrote."""
    result = _audit(spark, sf)
    path = _folder(spark, "run")
    writers.write_run(result.pages, result.summary, path, result.metrics)
    rows = writers.read_run(spark, path)
    said = lambda member: F.get_json_object("json", f"$.{member}")
    return rows.select(
        "domain", F.col("section").cast("bigint").alias("section"), said("url").alias("url"), said("declared").alias("declared"), said("extracted").alias("extracted"),
        said("comparison.schemas_match").alias("schemas_match"), said("comparison.extracted_checksum").alias("extracted_checksum"),
        said("summary.total_pages").alias("total_pages"), said("summary.merkle_root_declared").alias("merkle_root_declared"),
        said("metrics.declared.requests.total").alias("requests"), said("metrics.extracted.errors.total").alias("errors"),
    )


@query
def write_report(spark, sf):
    """The lines as `write_report` puts them into `domain=<host>/`."""
    return _report(spark, sf).select(U.domain_of(F.col("site")).alias("domain"), "section", "line", "text")


@query
def strip_field(spark, sf):
    pages = B.table(spark, sf, "pages")
    inner = F.struct(F.col("page_id").alias("n"), F.col("html").alias("rawJsonLd"))
    nested = pages.select(
        "page_id",
        F.col("html").alias("rawJsonLd"),
        F.struct("url", F.array(inner, inner).alias("parts"), F.lit("x").alias("rawJsonLd")).alias("result"),
    )
    return writers.strip_field(nested).select("page_id", F.to_json("result").alias("json"))


# --- URL and text scalars --------------------------------------------------------------------


def _url_variants(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    u = F.col("url")
    return _variants(
        pages, u, F.concat(F.lit("data:text/plain,"), u), F.regexp_replace(u, "^https?", "ftp"),
        F.concat(F.lit("mailto:"), F.col("page_id").cast("string"), F.lit("@example.com")),
        F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("no url "), u), F.lit("https://"),
        F.concat(F.lit("  "), F.regexp_replace(u, "^https?", "HTTPS"), F.lit(" ")),
        F.concat(F.lit("file:///p/"), F.col("page_id").cast("string")),
    )


@query
def validate_url(spark, sf):
    return _url_variants(spark, sf).select(
        "page_id", F.col("variant").cast("bigint").alias("variant"), F.expr("v"),
        U.validate_url(F.col("v")).alias("r"),
    ).select("page_id", "variant", "r.is_valid", "r.error", "r.protocol")


@query
def validate_urls(spark, sf):
    pages = B.table(spark, sf, "pages")
    lists = pages.select("page_id", F.when(F.col("page_id") % 5 != 0, F.array("url", F.concat(F.lit("javascript:"), "url"), F.lit("http://"))).alias("urls"))
    checked = lists.select("page_id", U.validate_urls(F.col("urls")).alias("r"))
    return checked.select(
        "page_id", F.size("r").cast("bigint").alias("n"),
        F.size(F.filter("r", lambda x: x["is_valid"])).cast("bigint").alias("n_valid"),
        F.array_join(F.transform("r", lambda x: F.coalesce(x["error"], F.lit("-"))), "|").alias("errors"),
    )


@query
def domain_of(spark, sf):
    return _url_variants(spark, sf).select(
        "page_id", F.col("variant").cast("bigint").alias("variant"), U.domain_of(F.col("v")).alias("domain")
    )


@query
def resolve_url(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    refs = [
        "x/y", "../up", "?q=1", "#frag", "//other.example.org/p", "/a/b/../c", "./", "",
        "HTTP://EX.example.org:80/a/./b", "mailto:a@b.c", "http://", "/sp ace/é?ü=1",
    ]
    rows = _variants(pages, *map(F.lit, refs))
    return U.with_resolved_url(rows, "v", "url", "link").select(
        "page_id", F.col("variant").cast("bigint").alias("variant"), "link"
    )


@query
def is_internal(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    rows = _variants(
        pages.withColumn("root", root), F.col("url"), F.concat(root, F.lit(".evil/x")),
        F.regexp_replace("url", "^https?", "ftp"), root,
    )
    return rows.select(
        "page_id", F.col("variant").cast("bigint").alias("variant"),
        U.is_internal(F.col("v"), F.col("root")).alias("internal"),
    )


@query
def utf8_bytes(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", X.utf8_bytes(F.col("html")).alias("bytes"))


@query
def json_bytes(spark, sf):
    canonical = J.with_canonical_json(B.modules(spark, sf), "raw", "canon")
    return canonical.select("site", "pos", J.json_bytes(F.col("canon")).alias("bytes"))


@query
def context_is(spark, sf):
    name = F.col("p_name")
    rows = _variants(
        B.table(spark, sf, "part").select("p_partkey", "p_name"),
        F.lit('"https://schema.org"'), F.lit('"HTTP://SCHEMA.ORG/x"'),
        F.concat(F.lit('["'), name, F.lit('","https://schema.org"]')),
        F.lit('{"@vocab":"https://schema.org"}'), F.lit('"https://ogp.me/ns#"'), F.lit("5"),
        F.lit("null"), F.lit('[["https://schema.org"]]'), F.lit('["a",{"b":"schema.org"}]'),
        F.concat(F.lit('"'), name, F.lit('"')),
    )
    context = "try_parse_json(v)"
    return rows.select(
        "p_partkey", F.col("variant").cast("bigint").alias("variant"),
        J.context_text_is(context, E.SCHEMA_VOCABULARY).alias("is_schema"),
        J.context_text_is(context, E.OPEN_GRAPH_VOCABULARY).alias("is_open_graph"),
    )


@query
def local_name(spark, sf):
    rows = _variants(
        B.table(spark, sf, "part"), F.concat(F.lit("schema:"), "p_type"),
        F.concat(F.lit("https://schema.org/"), "p_type"), F.col("p_type"), F.lit("a:b:"),
    )
    return rows.select("p_partkey", F.col("variant").cast("bigint").alias("variant"), X.local_name(F.col("v")).alias("name"))


@query
def type_from_itemtype(spark, sf):
    rows = _variants(
        B.table(spark, sf, "part"), F.concat(F.lit("https://schema.org/"), "p_type"),
        F.concat(F.lit("x HTTP://WWW.Schema.org/"), "p_type", F.lit("#a")),
        F.concat(F.lit("https://example.org/"), "p_type"), F.lit("https://schema.org/"),
    )
    return rows.select("p_partkey", F.col("variant").cast("bigint").alias("variant"), X.type_from_itemtype(F.col("v")).alias("type"))


# --- discovery ----------------------------------------------------------------------------------


@query
def sitemap_locs(spark, sf):
    return D.sitemap_locs(B.sitemaps(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


def _sitemap_urls(spark, sf, every=False):
    return D.expand_sitemap_index(B.sitemap_roots(spark, sf), B.sitemaps(spark, sf), every)


@query
def expand_sitemap_index(spark, sf):
    """Every place of every page URL."""
    return _sitemap_urls(spark, sf, every=True).select(
        "site", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "loc"
    )


@query
def first_n_urls(spark, sf):
    return D.first_n_urls(_sitemap_urls(spark, sf), 10).select("site", F.col("ord").cast("bigint").alias("ord"), "url")


@query
def extract_links(spark, sf):
    pages = B.table(spark, sf, "pages").withColumn("site", F.regexp_extract("url", "^(https?://[^/]+)", 1))
    links = D.extract_links(pages)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return links.select("page_id", number.cast("bigint").alias("n"), "href", "link")


def _crawl_links(spark, sf):
    return D.crawl_links(B.crawl_pages(spark, sf))


@query
def crawl_frontier(spark, sf):
    return D.crawl_frontier(_crawl_links(spark, sf), B.crawl_seeds(spark, sf))


@query
def discover_urls(spark, sf):
    return D.discover_urls(B.sitemap_roots(spark, sf), B.sitemaps(spark, sf), _crawl_links(spark, sf))


@query
def limit_pages(spark, sf):
    urls = B.crawl_pages(spark, sf).select("site", "url", F.col("r").alias("ord"))
    return D.limit_pages(urls, 3).select("site", F.col("ord").cast("bigint").alias("ord"), "url")


# --- extraction -----------------------------------------------------------------------------------


@query
def html_elements_by_tag(spark, sf):
    elements = html_elements(B.table(spark, sf, "pages"), keep="all").filter("elem_id > 0")
    counted = {"n_links": "a", "n_scripts": "script", "n_paragraphs": "p", "n_items": "li", "n_headings": "h1"}
    return elements.groupBy("page_id").agg(
        *[F.count_if(F.col("tag") == tag).alias(name) for name, tag in counted.items()]
    )


def _objects(spark, sf, *methods, known_only=False):
    objects = E.extract_objects(B.captures(spark, sf), methods=methods or tuple(E.METHODS), known_only=known_only)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(*E.PLACE))
    return objects.withColumn("n", number.cast("bigint"))


def _numbered(objects):
    return objects.select("page_id", "n", "canon")


@query
def jsonld_blocks(spark, sf):
    return _numbered(_objects(spark, sf, "jsonld"))


@query
def inline_jsonld(spark, sf):
    return _numbered(_objects(spark, sf, "inline"))


@query
def microdata_items(spark, sf):
    return _numbered(_objects(spark, sf, "microdata"))


def _property_rows(spark, sf, candidates):
    elements = html_elements(B.captures(spark, sf))
    return elements.select("page_id", F.expr(f"inline({candidates()})")).filter(F.col("name").isNotNull())


@query
def microdata_value(spark, sf):
    return _property_rows(spark, sf, E.microdata_candidates).select("page_id", "name", "value")


@query
def collect_values(spark, sf):
    rows = _property_rows(spark, sf, E.microdata_candidates)
    gathered = rows.groupBy("page_id", "root", "name").agg(F.sort_array(F.collect_list(F.struct("elem", "value"))).alias("vs"))
    return gathered.select("page_id", "name", E.collect_values(F.transform("vs", lambda v: v["value"])).alias("json"))


@query
def item_type_context(spark, sf):
    items = _objects(spark, sf, "microdata", "rdfa").withColumn("v", F.try_parse_json("canon"))
    return items.select("page_id", "n", J.member(F.col("v"), "@type", "string").alias("type"), J.member(F.col("v"), "@context", "string").alias("context"))


@query
def rdfa_items(spark, sf):
    return _numbered(_objects(spark, sf, "rdfa"))


@query
def rdfa_own_property(spark, sf):
    rows = _property_rows(spark, sf, E.rdfa_candidates)
    return rows.filter("root = elem").select("page_id", "name", "value")


@query
def next_data_objects(spark, sf):
    return _numbered(_objects(spark, sf, "next_data"))


@query
def react_attr_objects(spark, sf):
    return _numbered(_objects(spark, sf, "react_attr"))


@query
def react_inline_objects(spark, sf):
    return _numbered(_objects(spark, sf, "react_inline"))


@query
def extract_all(spark, sf):
    objects = E.extract_all(B.captures(spark, sf))
    return objects.select("page_id", F.col("seq").cast("bigint").alias("seq"), F.col("method").cast("bigint").alias("method"), "canon")


@query
def known_context(spark, sf):
    return _numbered(_objects(spark, sf, "jsonld", known_only=True))


def _deduped(spark, sf, strict=False):
    return E.dedupe_objects(E.extract_objects(B.captures(spark, sf)), strict=strict)


def _renumbered(objects):
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(*E.PLACE))
    return objects.select("page_id", number.cast("bigint").alias("n"), "canon")


@query
def dedupe_objects(spark, sf):
    return _renumbered(_deduped(spark, sf))


@query
def dedupe_objects_strict(spark, sf):
    return _renumbered(_deduped(spark, sf, strict=True))


@query
def drop_checksum_field(spark, sf):
    return _renumbered(E.drop_checksum_field(_deduped(spark, sf)))


@query
def raw_jsonld_blocks(spark, sf):
    blocks = E.raw_jsonld_blocks(B.captures(spark, sf))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return blocks.select("page_id", number.cast("bigint").alias("n"), "raw")


@query
def latest_capture(spark, sf):
    """The latest of all captures of each page, chosen before any is parsed."""
    latest = captured.latest(B.recaptures(spark, sf), ["page_id", "url"], "html")
    return latest.select("page_id", "url", "captured_at", "capture_id", F.md5("html").alias("digest"))


@query
def latest_of_pages(spark, sf):
    """Of pages with structured data, the captures that pass the set of the latest ones; exact
    here, as the pages that pass by mistake are taken out."""
    pages = B.recaptures(spark, sf)
    wanted = B.captures(spark, sf).filter("kind <> 0").select("url")
    passed = captured.latest(captured.latest_of(pages, wanted), ["url"], "html").join(wanted, "url", "left_semi")
    return passed.select("page_id", "url", "capture_id", F.md5("html").alias("digest"))


@query
def extract_page(spark, sf):
    pages = E.extract_page(B.recaptures(spark, sf))
    return pages.select("page_id", _text("objects").alias("objects"), "checksum", "bytes_downloaded", "details")


# --- integrity ---------------------------------------------------------------------------------------


@query
def canonical_json(spark, sf):
    return J.with_canonical_json(B.modules(spark, sf), "raw", "canon").select("site", "pos", "canon")


@query
def module_checksum(spark, sf):
    facts = B.module_facts(spark, sf).withColumn("doc", F.concat(F.lit("["), "raw_data", F.lit("]")))
    items = J.with_json_items(facts, "doc", "items", keys=False)
    canons = F.transform("items.items", lambda i: i["canon"])
    return items.select("site", "pos", J.checksum_of(canons).alias("checksum"))


@query
def split_checksum_audit(spark, sf):
    split = MOD.split_checksum(B.all_modules(spark, sf))
    return split.select("site", "pos", "declared_checksum", F.size("data").cast("bigint").alias("n_data"))


@query
def split_checksum_trust(spark, sf):
    return MOD.validate_modules(B.all_modules(spark, sf)).select("site", "pos", "fetched", "checksum", "detail")


@query
def verify_checksum(spark, sf):
    listed = B.all_modules(spark, sf)
    audit = MOD.read_modules(listed).select("site", "pos", F.col("checksum_valid").alias("audit_valid"))
    trust = MOD.validate_modules(listed).select("site", "pos", F.col("checksum_valid").alias("trust_valid"))
    return audit.join(trust, ["site", "pos"])


@query
def merkle_root(spark, sf):
    return merkle_roots(B.module_facts(spark, sf), ["site"], "pos", {"root": "data_hash"})


@query
def merkle_root_brands(spark, sf):
    """Roots over a hash per part, by brand, where positions have gaps."""
    part = B.table(spark, sf, "part").select("p_brand", "p_partkey", F.sha2("p_name", 256).alias("leaf"))
    return merkle_roots(part, ["p_brand"], "p_partkey", {"root": "leaf"}, dense=False)


@query
def merkle_index(spark, sf):
    rows, roots = merkle.merkle_index(B.module_facts(spark, sf), ["site"], "path", "data_hash")
    ends = rows.groupBy("site").agg(F.min_by("path", "ord").alias("first_path"), F.max_by("path", "ord").alias("last_path"))
    return ends.join(roots, "site").select("site", "first_path", "last_path", "n", F.col("merkle_root").alias("root"))


@query
def merkle_index_rows(spark, sf):
    rows, _ = merkle.merkle_index(B.module_facts(spark, sf), ["site"], "path", "data_hash")
    return rows.select("site", F.col("ord").cast("bigint").alias("ord"), "path", "data_hash")


@query
def merkle_over_recomputed(spark, sf):
    return _summary(spark, sf).select("site", "merkle_root_declared", "merkle_root_extracted")


@query
def merkle_over_declared(spark, sf):
    return MOD.merkle_over_declared(MOD.validate_modules(B.all_modules(spark, sf)))


@query
def merkle_validity(spark, sf):
    return _summary(spark, sf).select("site", "declared_root_valid", "extracted_root_valid", "roots_match")


@query
def site_trust_report(spark, sf):
    report = MOD.site_trust_report(B.site_index(spark, sf), B.modules(spark, sf))
    return report.select(
        "site", F.col("pos").cast("bigint").alias("pos"), "path", "checksum", "calculated_checksum",
        "checksum_valid", "detail",
    )


@query
def site_trust_summary(spark, sf):
    index = B.site_index(spark, sf)
    validated = MOD.validate_modules(MOD.locate_listed(MOD.parse_index(index), B.modules(spark, sf)))
    return MOD.site_trust_summary(index, validated)


@query
def crawl_merkle(spark, sf):
    pages = B.captures(spark, sf)
    checksums = E.extract_page(pages.select("page_id", "html")).select("page_id", "checksum")
    placed = pages.select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site"))
    return C.crawl_merkle(placed.join(checksums, "page_id"), ["site"], "page_id")


@query
def run_crawl(spark, sf):
    """The extracted-only run: discovery, extraction in discovery order, page checksums."""
    captures = B.crawl_pages(spark, sf).select("url", "html")
    urls = D.discover_urls(B.sitemap_roots(spark, sf), B.sitemaps(spark, sf), _crawl_links(spark, sf))
    pages = A.run_crawl(urls, captures)
    return pages.select("site", "ord", "url", "checksum", "details")


# --- declared modules -----------------------------------------------------------------------------------


@query
def site_readiness(spark, sf):
    return MOD.site_readiness(B.site_index(spark, sf)).select("site", "error")


@query
def site_readiness_of_deep_indexes(spark, sf):
    """Indexes that no variant can hold: their members, and the last module each lists."""
    ready = MOD.site_readiness(B.deep_index(spark, sf))
    return ready.select(
        "site", "error", F.when(F.col("modules").isNotNull(), F.size("modules")).cast("bigint").alias("n_modules"),
        F.md5(F.element_at("modules", -1)).alias("last_module"), F.md5("merkle_root").alias("merkle_root"), "version", "strategy",
    )


@query
def module_status_of_deep_modules(spark, sf):
    read = MOD.read_modules(B.deep_modules(spark, sf))
    return read.select("pos", "status", "page_url", "declared_checksum", "checksum", F.size("objects").cast("bigint").alias("n_objects"))


@query
def split_checksum_of_deep_modules(spark, sf):
    """The trust rule where the closing object may be too deep for a variant."""
    return MOD.validate_modules(B.deep_modules(spark, sf)).select("pos", "fetched", "checksum", "calculated_checksum")


@query
def explode_modules(spark, sf):
    return MOD.explode_modules(MOD.parse_index(B.site_index(spark, sf))).withColumn("pos", F.col("pos").cast("bigint"))


@query
def classify_module(spark, sf):
    return MOD.classify_module(B.all_modules(spark, sf)).select("site", "pos", "shape")


def _read(spark, sf):
    return MOD.read_modules(B.all_modules(spark, sf))


@query
def objects_with_url(spark, sf):
    return _read(spark, sf).select("site", "pos", _text("objects").alias("objects"))


@query
def canonical_url(spark, sf):
    return _read(spark, sf).filter("status = 'success'").select("site", "pos", F.col("page_url").alias("canonical_url"))


@query
def single_url_rule(spark, sf):
    return _read(spark, sf).select("site", "pos", "single_url")


@query
def module_status(spark, sf):
    read = MOD.read_modules(MOD.locate_modules(B.site_index(spark, sf), B.modules_again(spark, sf)))
    return read.select("site", F.col("pos").cast("bigint").alias("pos"), "status", "page_url", "error", "checksum", "checksum_valid")


# --- comparison --------------------------------------------------------------------------------------------


def _audit_pages(spark, sf):
    return A.page_comparison(B.site_index(spark, sf), B.modules_again(spark, sf), B.audit_pages_again(spark, sf))


def _audit(spark, sf, with_logs=True):
    logs = (B.request_log(spark, sf), B.error_log(spark, sf), B.samples(spark, sf)) if with_logs else ()
    return A.run_audit(B.site_index(spark, sf), B.modules_again(spark, sf), B.audit_pages_again(spark, sf), *logs)


def _summary(spark, sf):
    return _audit(spark, sf, with_logs=False).summary


def _metrics(spark, sf):
    """Of the whole audit: the three logs, and the errors that it met itself."""
    return _audit(spark, sf).metrics


def _pos(df):
    return df.withColumn("pos", F.col("pos").cast("bigint"))


@query
def pair_pages(spark, sf):
    return _pos(_audit_pages(spark, sf)).select(
        "site", "pos", "page_url", _text("declared").alias("declared"), _text("extracted").alias("extracted"),
        "declared_ok", "extracted_ok",
    )


@query
def pair_pages_of_one_url(spark, sf):
    """Pairing where every second module of all sites names the page of one of them."""
    declared = stored(MOD.read_modules(B.all_modules(spark, sf)), "declared")
    one = F.concat(F.lit("https://hot.example.com/p/"), F.lit(2))
    declared = declared.withColumn("page_url", F.when(F.col("pos") % 2 == 0, one).otherwise(F.col("page_url")))
    extracted = E.extract_page(B.audit_pages_again(spark, sf), key="url")
    paired = C.pair_pages(declared, extracted, heavy=50)
    return _pos(paired).select("site", "pos", "page_url", _text("extracted").alias("extracted"), "extracted_ok")


@query
def errors_found(spark, sf):
    return C.errors_found(_audit_pages(spark, sf))


@query
def objects_equal(spark, sf):
    return _pos(_audit_pages(spark, sf)).select("site", "pos", "schemas_match")


@query
def checksum_compare(spark, sf):
    return _pos(_audit_pages(spark, sf)).select(
        "site", "pos", "declared_calculated", "declared_checksum", "checksum_valid", "extracted_checksum",
        "extracted_matches_declared",
    )


@query
def shallow_key_diff(spark, sf):
    differing = _pos(_audit_pages(spark, sf)).filter("NOT schemas_match")
    return differing.select(
        "site", "pos", F.array_join("missing_in_extracted", ",").alias("missing_in_extracted"),
        F.array_join("missing_in_declared", ",").alias("missing_in_declared"), "note",
    )


@query
def site_summary(spark, sf):
    return _summary(spark, sf)


@query
def strip_result_tail(spark, sf):
    part = B.table(spark, sf, "part")
    first = F.concat(F.lit('{"name":"'), "p_name", F.lit('"}'))
    items = (
        F.when(F.col("p_partkey") % 4 == 0, F.array(first, F.lit('{"checksum":"abc"}')))
        .when(F.col("p_partkey") % 4 == 1, F.array(first, F.lit('{"checksum":""}')))
        .when(F.col("p_partkey") % 4 == 2, F.array(first, F.lit('{"checksum":5,"name":"n"}')))
        .otherwise(F.array(first))
    )
    return part.withColumn("items", items).select("p_partkey", J.array_text(E.strip_result_tail(F.col("items"))).alias("items"))


@query
def method_compare(spark, sf):
    return C.method_compare(B.method_runs(spark, sf))


@query
def run_audit(spark, sf):
    """Summary and metrics of the whole audit, flattened, one row per site and side."""
    result = _audit(spark, sf)
    joined = result.summary.join(result.metrics, "site", "left")
    return joined.select(
        *result.summary.columns, "side", F.col("timing.duration_ms").alias("duration_ms"),
        F.col("requests.total").alias("requests"), F.col("errors.total").alias("errors"),
        F.col("concurrency.max").alias("max_concurrency"),
    )


# --- logs --------------------------------------------------------------------------------------------------------


@query
def request_totals(spark, sf):
    return H.request_totals(B.request_log(spark, sf))


@query
def status_histogram(spark, sf):
    histogram = H.status_histogram(B.request_log(spark, sf))
    return histogram.select("site", "side", M.fmt_status_codes(F.col("status_codes")).alias("status_codes"))


@query
def avg_request_time(spark, sf):
    return H.avg_request_time(B.request_log(spark, sf)).withColumn("avg_request_ms", F.round("avg_request_ms", 4))


@query
def duration_ms(spark, sf):
    log = B.request_log(spark, sf)
    start = F.when(F.col("seq") % 7 == 0, 0).otherwise(F.col("start_ms"))
    return log.select("seq", H.duration_ms(start, F.col("end_ms")).alias("duration_ms"))


@query
def rps(spark, sf):
    totals = B.request_log(spark, sf).groupBy("site", "side").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("a"), F.max("start_ms").alias("b")
    )
    return totals.select("site", "side", F.round(H.rps(F.col("n"), H.duration_ms(F.col("a"), F.col("b"))), 6).alias("rps"))


@query
def error_summary(spark, sf):
    return H.error_summary(B.error_log(spark, sf))


@query
def error_details(spark, sf):
    return H.error_details(B.error_log(spark, sf))


@query
def max_concurrency(spark, sf):
    return H.max_concurrency(B.request_log(spark, sf))


@query
def max_concurrency_of_samples(spark, sf):
    return H.max_concurrency_of_samples(B.samples(spark, sf)).withColumn("max_concurrency", F.col("max_concurrency").cast("bigint"))


@query
def disk_total(spark, sf):
    return H.disk_total(B.samples(spark, sf))


@query
def cpu_delta(spark, sf):
    return H.cpu_delta(B.samples(spark, sf))


@query
def peak_memory(spark, sf):
    return H.peak_memory(B.samples(spark, sf))


@query
def metrics_summary(spark, sf):
    return _metrics(spark, sf).select(
        "site", "side", "timing.duration_ms", "cpu.cpu_user_micros", "cpu.cpu_system_micros", "memory.peak_rss",
        F.col("requests.total").alias("requests"),
        M.fmt_status_codes(F.col("requests.status_codes")).alias("status_codes"),
        F.round("requests.avg_request_ms", 4).alias("avg_request_ms"), F.round("requests.rps", 6).alias("rps"),
        "requests.bytes_downloaded", "requests.bytes_uploaded", F.col("errors.total").alias("errors"),
        "disk.disk_bytes", F.col("concurrency.max").alias("max_concurrency"),
    )


# --- report ------------------------------------------------------------------------------------------------------


def _amounts(spark, sf):
    """Numbers of every size the formatters distinguish, one row per event."""
    value = F.col("value")
    return B.table(spark, sf, "events").select(
        "event_id", value.alias("x"), (F.col("event_id") % 50).alias("b"),
        F.floor(value * F.pow(F.lit(10.0), (F.col("event_id") % 9).cast("double"))).cast("bigint").alias("amount"),
    )


def _four(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.4f", F.round(x, 4)))


@query
def percent_diff(spark, sf):
    text = M.or_na(_four(M.percent_diff(F.col("x"), F.col("b"))))
    return _amounts(spark, sf).select("event_id", text.alias("percent"))


@query
def ratio(spark, sf):
    text = M.or_na(_four(M.ratio(F.col("b"), F.col("x"))))
    return _amounts(spark, sf).select("event_id", text.alias("ratio"))


@query
def fmt_comparisons(spark, sf):
    return _amounts(spark, sf).select(
        "event_id", M.fmt_percent(F.col("x") - 50, "data").alias("percent"),
        M.fmt_faster(F.col("x") - 50).alias("faster"), M.fmt_x(F.col("x"), "per request").alias("times"),
    )


@query
def fmt_number(spark, sf):
    return _amounts(spark, sf).select(
        "event_id", M.fmt_number(F.col("amount")).alias("whole"),
        M.fmt_number(F.when(F.col("b") != 0, F.col("x")), 1).alias("one"),
    )


@query
def fmt_rps(spark, sf):
    return _amounts(spark, sf).select("event_id", M.fmt_rps(F.when(F.col("b") != 0, F.col("x") * 100)).alias("rps"))


@query
def fmt_bytes(spark, sf):
    return _amounts(spark, sf).select("event_id", M.fmt_bytes(F.col("amount")).alias("size"))


@query
def fmt_filesize(spark, sf):
    return _amounts(spark, sf).select("event_id", M.fmt_filesize(F.col("amount")).alias("size"))


@query
def fmt_cpu_time(spark, sf):
    return _amounts(spark, sf).select("event_id", M.fmt_cpu_time(F.col("amount")).alias("cpu"))


@query
def fmt_duration(spark, sf):
    return _amounts(spark, sf).select("event_id", M.fmt_duration(F.when(F.col("b") != 0, F.col("amount"))).alias("duration"))


@query
def fmt_status_codes(spark, sf):
    by_user = H.status_histogram(B.request_log(spark, sf), ["user_id"])
    return by_user.select("user_id", M.fmt_status_codes(F.col("status_codes")).alias("status_codes"))


@query
def metrics_diff(spark, sf):
    return R.metrics_diff(R.sides_of(_metrics(spark, sf)))


@query
def metrics_formatted(spark, sf):
    formatted = R.metrics_formatted(R.sides_of(_metrics(spark, sf)))
    fields = [f.name for f in formatted.schema["declared"].dataType if f.name != "errors_raw"]
    return formatted.select(
        "site", *[F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in ("declared", "extracted") for f in fields]
    )


@query
def summary_table(spark, sf):
    result = _audit(spark, sf)
    table = R.summary_table(R.sides_of(result.metrics), result.summary)
    return table.withColumn("line", F.col("line").cast("bigint"))


@query
def page_checksum_table(spark, sf):
    return _pos(R.page_checksum_table(_audit_pages(spark, sf)))


@query
def merkle_block(spark, sf):
    return R.merkle_block(_summary(spark, sf))


def _report(spark, sf):
    result = _audit(spark, sf)
    return R.report_lines(R.sides_of(result.metrics), result.summary, result.pages)


@query
def render_report(spark, sf):
    return _report(spark, sf).select("site", F.col("section").cast("bigint").alias("section"), "line", "text")
