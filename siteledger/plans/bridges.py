"""Input tables for the registered queries, derived from the tables on disk.

The given tables hold no structured data, module documents or request logs, so these
views derive them row by row: modules from `part`, captured pages from `pages`, logs
from `events`. One site holds a third of the modules and of the log. Each definition is
SQL text that Spark and DuckDB both run, apart from the two functions of `Dialect`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.operators.merkle import merkle_roots
from siteledger.session import stored


@dataclass(frozen=True)
class Dialect:
    sha: Callable[[str], str]
    array: Callable[..., str]
    epoch_ms: Callable[[str], str]
    member: Callable[[str, str], str]


SPARK = Dialect(
    sha=lambda x: f"sha2({x}, 256)",
    array=lambda *xs: f"cast(array({', '.join(xs)}) as array<string>)",
    epoch_ms=lambda x: f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {x})",
    member=lambda x, k: f"get_json_object({x}, '$.{k}')",
)
DUCKDB = Dialect(
    sha=lambda x: f"sha256({x})",
    array=lambda *xs: f"CAST([{', '.join(xs)}] AS VARCHAR[])",
    epoch_ms=lambda x: f"(epoch_us({x}) // 1000)",
    member=lambda x, k: f"json_extract_string({x}, '$.{k}')",
)

CONTEXT = '"@context":"https://schema.org"'
MANY = 12


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def thing(i: int) -> str:
    return f"""'{{{CONTEXT},"@type":"Thing","n":{i},"url":"' || u || '"}}'"""


def thing_raw(i: int) -> str:
    return f"""'{{"url":"' || u || '","n":{i},"@type":"Thing",{CONTEXT}}}'"""


def keyed(elements: dict[int, str]) -> str:
    """Hash input of an element list: keys in text order."""
    names = sorted(elements, key=str)
    members = " || ',' || ".join(f"""'"{i}":' || {elements[i]}""" for i in names)
    return f"'{{' || {members} || '}}'" if members else "'{}'"


def modules_sql(d: Dialect, part: str) -> str:
    """One module per part: site, pos, path, texts, and what each rule should find."""
    j = f"({whole('k / 3')} * 2 + k % 3 - 1)"
    many = {i: thing(i) for i in range(MANY)}
    many_raw = " || ',' || ".join(thing_raw(i) for i in range(MANY))
    return f"""
SELECT b.*,
  CASE kind WHEN 'many' THEN {d.sha(keyed(many))}
    WHEN 'differ' THEN {d.sha(keyed({0: 'c0', 1: 'other'}))}
    WHEN 'nourl' THEN {d.sha(keyed({0: 'nameless'}))}
    WHEN 'nullelem' THEN {d.sha(keyed({0: "'null'", 1: 'c0'}))}
    WHEN 'og' THEN {d.sha(keyed({0: 'og'}))}
    WHEN 'single' THEN {d.sha(keyed({0: 'single'}))}
    WHEN 'text' THEN {d.sha(keyed({}))}
    ELSE {d.sha(keyed({0: 'c0'}))} END AS data_hash,
  CASE kind WHEN 'many' THEN {d.array(*many.values())}
    WHEN 'differ' THEN {d.array('c0', 'other')}
    WHEN 'nourl' THEN {d.array('nameless')}
    WHEN 'nullelem' THEN {d.array("'null'", 'c0')}
    WHEN 'og' THEN {d.array('og')}
    WHEN 'single' THEN {d.array('single')}
    WHEN 'text' THEN {d.array()}
    ELSE {d.array('c0')} END AS data,
  CASE kind WHEN 'many' THEN {many_raw}
    WHEN 'differ' THEN r0 || ', ' || other
    WHEN 'nourl' THEN nameless
    WHEN 'nullelem' THEN 'null, ' || r0
    WHEN 'og' THEN og
    WHEN 'single' THEN single
    WHEN 'text' THEN ''
    ELSE r0 END AS raw_data
FROM (
  SELECT a.*,
    '{{{CONTEXT},"@type":"Product","brand":"' || br || '","name":"' || nm || '","offers":{{"price":' || sz
      || ',"sku":"' || k || '"}},"url":"' || u || '"}}' AS c0,
    '{{ "url": "' || u || '", "name": "' || nm || '", "@type": "Product", {CONTEXT}, "offers": {{"sku": "' || k
      || '", "price": ' || sz || '.0}}, "brand": "' || br || '" }}' AS r0,
    '{{{CONTEXT},"@type":"Thing","url":"' || u || '/other"}}' AS other,
    '{{{CONTEXT},"@type":"Thing","name":"' || nm || '"}}' AS nameless,
    '{{"@context":"https://ogp.me/ns#","og:title":"' || nm || '","og:url":"' || u || '"}}' AS og,
    '{{{CONTEXT},"@type":"Thing","checksum":"c' || k || '","url":"' || u || '"}}' AS single
  FROM (
    SELECT k, nm, br, sz, site_no, pos, site, k % 10 = 0 AS bad,
      '/m/' || pos || '.json' AS path,
      site || '/m/' || pos || '.json' AS module_url,
      site || '/p/' || pos AS u,
      CASE WHEN k % 37 = 0 THEN 'missing' WHEN k % 19 = 0 THEN 'text' WHEN k % 23 = 0 THEN 'single'
        WHEN k % 29 = 0 THEN 'differ' WHEN k % 31 = 0 THEN 'nourl' WHEN k % 41 = 0 THEN 'nullelem'
        WHEN k % 17 = 0 THEN 'notail' WHEN k % 13 = 5 THEN 'many' WHEN k % 7 = 3 THEN 'og'
        ELSE 'plain' END AS kind
    FROM (
      SELECT p_partkey AS k, p_name AS nm, p_brand AS br, p_size AS sz, site_no, pos,
        CASE WHEN site_no = -1 THEN 'https://hot.example.com'
          ELSE 'https://s' || site_no || '.example.com' END AS site
      FROM (
        SELECT p_partkey, p_name, p_brand, p_size,
          CASE WHEN k % 3 = 0 THEN -1 ELSE {j} % 24 END AS site_no,
          CASE WHEN k % 3 = 0 THEN {whole('k / 3')} ELSE {whole(f'{j} / 24')} END AS pos
        FROM (SELECT *, p_partkey AS k FROM {part}) p
      ) q
    ) s
  ) a
) b"""


TAIL = """',{"checksum":"' || CASE WHEN bad THEN 'BAD' ELSE data_hash END || '"}]'"""
MODULE_RAW = f"""CASE kind WHEN 'text' THEN '"just text"' WHEN 'single' THEN raw_data
  WHEN 'notail' THEN '[' || raw_data || ']' ELSE '[' || raw_data || {TAIL} END"""

# What a site's two roots are over: the hash of a module's objects, that of none where it cannot be
# used or they name no page; and the checksum it declares, if it does so in a list.
CAPTURED = f"kind <> 'missing' AND ({MODULE_RAW}) IS NOT NULL"
AUDIT_LEAF = f"""CASE WHEN {CAPTURED} AND kind NOT IN ('text', 'differ', 'nourl', 'nullelem') THEN data_hash
  ELSE sha2('{{}}', 256) END"""
TRUST_LEAF = f"""CASE WHEN {CAPTURED} AND kind NOT IN ('text', 'single', 'notail')
  THEN CASE WHEN bad THEN 'BAD' ELSE data_hash END END"""


# One kind of markup per page; q is the page's part.
def page_markup(kind: str, name: str, brand: str, key: str, size: str) -> str:
    flat = f"""'{{{CONTEXT},"@type":"Product","name":"' || {name} || '","sku":"' || {key} || '"}}'"""
    reordered = (
        f"""'{{ "sku" : "' || {key} || '", "name" : "' || {name} || '",  "@type":"Product", {CONTEXT} }}'"""
    )
    return f"""CASE {kind}
  WHEN 0 THEN ''
  WHEN 1 THEN '<script type="application/ld+json">{{"size":' || {size} || '.0,"brand":{{"name":"' || {brand} || '"}},"@type":"Product",{CONTEXT}}}</script>'
  WHEN 2 THEN '<script type="application/ld+json">[' || {reordered} || ',"text",null,{{"@context":["https://schema.org"],"@type":"Brand","name":"' || {brand} || '"}},' || {flat} || ']</script>'
  WHEN 3 THEN '<script>window.data = ' || {reordered} || '; other({{"a":1}});</script><script src="x.js">' || {flat} || '</script>'
  WHEN 4 THEN '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name"> ' || {name} || ' </span><meta itemprop="sku" content="' || {key} || '"><p itemprop="tag"></p><p itemprop="tag">' || {brand} || '</p><p itemprop="tag">second</p><a itemprop="url" href="/p/' || {key} || '">Product <b>page</b></a><img itemprop="image" src="/i/' || {key} || '.png"><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price">' || {size} || '</span></div></div><div itemscope itemtype="https://other.example.org/Thing"><span itemprop="name">no</span></div>'
  WHEN 5 THEN '<section vocab="http://schema.org/" typeof="schema:Recipe"><meta property="yields" content="' || {size} || '"><h2 property="schema:title"> ' || {name} || '</h2><p typeof="Brand" property="maker"><em property="label">' || {brand} || '</em></p></section><p typeof="Offer" vocab="https://example.org/"><em property="label">no</em></p>'
  WHEN 6 THEN '<script id="__NEXT_DATA__" type="application/json">{{"props":{{"z":[{{"@type":"Product","name":"' || {name} || '",{CONTEXT},"inner":{{"@type":"Offer",{CONTEXT}}}}}],"a":{{"@context":"http://schema.org/","@type":"Brand","name":"' || {brand} || '"}}}},"page":{{"@context":"https://schema.org"}}}}</script>'
  WHEN 7 THEN '<script dangerouslySetInnerHTML="{{&quot;name&quot;:&quot;' || {name} || '&quot;,&quot;@type&quot;:&quot;Article&quot;,&quot;@context&quot;:&quot;https://schema.org&quot;}}"></script>'
  WHEN 8 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Thing","checksum":"x","name":"' || {name} || '"}}</script><script type="application/ld+json">{{"@context":"https://ogp.me/ns#","og:title":"' || {brand} || '"}}</script><script type="application/ld+json">{{"@context":"https://example.org","@type":"No"}}</script><script type="application/ld+json">{{"a":1}} trailing</script>'
  ELSE '<script type="application/ld+json">[{{{CONTEXT},"@type":"Product","brand":{{"label":"' || {name} || '"}}}},{{{CONTEXT},"@type":"Product","brand":{{"label":"' || {brand} || '"}}}}]</script>'
END"""


def captures_sql(part: str, pages: str, kind: str = "page_id % 10") -> str:
    markup = page_markup(kind, "p_name", "p_brand", "p_partkey", "p_size")
    return f"""
SELECT page_id, url, {kind} AS kind, p_name AS nm, p_brand AS br, p_partkey AS k, p_size AS sz,
  replace(html, '<body>', '<body>' || {markup}) AS html
FROM {pages} JOIN {part} ON p_partkey = page_id"""


# Further captures of a page, none of which is its latest: the days after the first of the year,
# the id, which pages have one, and how much further the kind of their markup is.
LATEST_DAY, LATEST_ID = 2, "m"
FURTHER = [(1, "z", "page_id % 3 = 0", 1), (2, "a", "page_id % 5 = 0", 2), (None, "z", "page_id % 4 = 0", 3)]


def captured_at(day: int | None) -> str:
    return "CAST(NULL AS TIMESTAMP)" if day is None else f"TIMESTAMP '2025-01-0{1 + day} 00:00:00'"


def recaptures_sql(part: str, pages: str) -> str:
    """Pages with several captures: older ones, one without a time, and one of equal time
    whose id is smaller. Some of them could not be read."""
    of = [(LATEST_DAY, LATEST_ID, "TRUE", 0), *FURTHER]
    return " UNION ALL ".join(
        f"SELECT page_id, url, {captured_at(day)} AS captured_at, '{name}' AS capture_id, "
        f"CASE WHEN {shift} = 0 OR page_id % 7 <> 0 THEN html END AS html FROM ({captures_sql(part, pages, f'(page_id + {shift}) % 10')}) x WHERE {which}"
        for day, name, which, shift in of
    )


def audit_pages_sql(modules: str, pages: str) -> str:
    """Captures of module pages: none, the module's data, altered data, or unreadable."""
    altered = (
        f"""'{{{CONTEXT},"@type":"Product","name":"' || nm || '","url":"' || u || '"}}'"""
    )
    return f"""
SELECT u AS url, page_id % 5 AS variant, k,
  CASE page_id % 5 WHEN 4 THEN NULL WHEN 0 THEN html
    WHEN 3 THEN replace(html, '<body>', '<body><script type="application/ld+json">' || {altered} || '</script>')
    ELSE replace(html, '<body>', '<body><script type="application/ld+json">[' || raw_data || ']</script>')
  END AS html
FROM {pages} JOIN {modules} ON k = page_id"""


def crawl_pages_sql(pages: str) -> str:
    """Captured pages of a few sites, each linking like a heap: page r to 2r+1 and 2r+2."""
    j = f"({whole('page_id / 3')} * 2 + page_id % 3 - 1)"
    return f"""
SELECT site_no, r, site, CASE WHEN r = 0 THEN site ELSE site || '/n/' || r END AS url,
  replace(replace(html, '<a href=', '<a data-href='), '<body>',
    '<body><a href="/n/' || (2 * r + 1) || '">a</a><a href="https://elsewhere.example.org/">x</a><a>none</a>'
    || '<a href="n/' || (2 * r + 2) || '">b</a><a href="mailto:a@b.c">m</a><a href="./">home</a>') AS html
FROM (
  SELECT site_no, r, html,
    CASE WHEN site_no = -1 THEN 'https://hot.example.com' ELSE 'https://c' || site_no || '.example.com' END AS site
  FROM (
    SELECT html, CASE WHEN page_id % 3 = 0 THEN -1 ELSE {j} % 6 END AS site_no,
      CASE WHEN page_id % 3 = 0 THEN {whole('page_id / 3')} ELSE {whole(f'{j} / 6')} END AS r
    FROM {pages}
  ) p
) q"""


def request_log_sql(d: Dialect, events: str) -> str:
    return f"""
SELECT event_id AS seq, user_id, event_type,
  CASE WHEN event_id % 3 = 0 THEN 'https://hot.example.com'
    ELSE 'https://s' || (user_id % 10) || '.example.com' END AS site,
  CASE WHEN event_id % 2 = 0 THEN 'declared' ELSE 'extracted' END AS side,
  'https://pages.example.com/' || user_id AS url, 'GET' AS method,
  start_ms, CASE WHEN event_type = 'signup' THEN NULL
    ELSE start_ms + {whole('value * 20000')} END AS end_ms,
  CASE WHEN event_type = 'view' THEN NULL ELSE k END AS bytes_down,
  CASE WHEN event_type = 'click' THEN NULL ELSE event_id % 5 END AS bytes_up,
  CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 304 WHEN 'error' THEN 500
    WHEN 'signup' THEN 201 ELSE NULL END AS status,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'timeout after ' || k END AS error,
  {whole('value * 1000000')} AS rss, event_id * 700 AS cpu_user, event_id * 300 AS cpu_system,
  k * 10 - 200 AS disk_bytes, k % 7 - 1 AS current
FROM (
  SELECT *, {d.epoch_ms('ts')} AS start_ms, CAST({d.member('props', 'k')} AS BIGINT) AS k FROM {events}
) e"""




# --- Spark side ------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that documents are derived from, in a task.
ROWS_A_TASK = 10_000


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """`df` dealt over tasks by its rows: documents derived from a row are a hundred times as large
    as it is, so files that are read by one task would be too much for one."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = f"siteledger_{name}"
    df = table(spark, sf_dir, name)
    (spread(spark, df) if name == "part" else df).createOrReplaceTempView(view)
    return view


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def built(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table once per session and input folder; queries then read captured
    tables from storage, as they would in use."""

    @wraps(fn)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _BUILT:
            df = fn(spark, sf_dir)
            # Input of fewer parts than cores (one row group, say) would leave all later
            # work to as few tasks; input of any size has more and is not moved.
            cores = spark.sparkContext.defaultParallelism
            if table(spark, sf_dir, "pages").rdd.getNumPartitions() < cores:
                df = df.repartition(cores)
            _BUILT[key] = stored(df, fn.__name__)
        return _BUILT[key]

    return once


@built
def module_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.sql(modules_sql(SPARK, _view(spark, sf_dir, "part")))
    return facts.select("k", "nm", "u", "site_no", "site", "pos", "path", "module_url", "kind", "bad", "raw_data", "data_hash")


@built
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, path, module_url, raw): captured module documents."""
    facts = module_facts(spark, sf_dir).filter("kind <> 'missing'")
    return facts.select("site", "pos", "path", "module_url", F.expr(MODULE_RAW).alias("raw"))


@built
def all_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like `modules`, with a NULL text for modules that were not captured."""
    raw = F.expr(f"CASE WHEN kind <> 'missing' THEN {MODULE_RAW} END").alias("raw")
    return module_facts(spark, sf_dir).select("site", "pos", "path", "module_url", raw)


@built
def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, raw): index documents. A third of the sites state the audit root, a third
    the trust root; one document per region is unusable in its own way."""
    facts = module_facts(spark, sf_dir)
    sites = facts.groupBy("site", "site_no").agg(F.count(F.lit(1)).alias("n"))
    # From what the documents were made of, not by the operators that will be held against them.
    leaves = facts.select("site", "pos", F.expr(AUDIT_LEAF).alias("audit"), F.expr(TRUST_LEAF).alias("trust"))
    audit = merkle_roots(leaves, ["site"], "pos", {"audit_root": "audit"})
    trust = merkle_roots(leaves, ["site"], "pos", {"calculated_root": "trust"}, dense=False)
    paths = F.expr("transform(sequence(0, n - 1), p -> '\"/m/' || p || '.json\"')")
    paths = F.when(F.col("site_no") % 5 == 4, F.concat(F.array(F.lit('"http://"')), paths)).otherwise(paths)
    stated = (
        F.when((F.col("site_no") == -1) | (F.col("site_no") % 3 == 0), F.col("audit_root"))
        .when(F.col("site_no") % 3 == 1, F.col("calculated_root"))
        .otherwise("BAD")
    )
    documents = (
        sites.join(audit, "site", "left")
        .join(trust, "site", "left")
        .select(
            "site",
            F.concat(
                F.lit('{"version":"1.0","modules":['),
                F.array_join(paths, ","),
                F.lit('],"verification":{"strategy":"merkle","merkleRoot":"'),
                stated,
                F.lit('","lastVerified":"2025-01-01"}}'),
            ).alias("raw"),
        )
    )
    unusable = spark.sql(UNUSABLE_INDEX.format(region=_view(spark, sf_dir, "region")))
    return documents.unionByName(unusable)


UNUSABLE_INDEX = """
SELECT 'https://x' || r_regionkey || '.example.com' AS site,
  CASE r_regionkey WHEN 0 THEN '{{"version":"1.0","modules":[],"verification":{{"merkleRoot":"abc"}}}}'
    WHEN 1 THEN '{{"version":"1.0"}}' WHEN 2 THEN NULL
    WHEN 3 THEN '{{"version":"1.0","modules":"none"}}' ELSE '{{"version":' END AS raw
FROM {region}"""


#: Levels that a deep document nests, more than a variant or a recursive parser takes.
DEEP = 3000
DEEP_VALUE = f"repeat('[', {DEEP}) || repeat(']', {DEEP})"


def deep_index_sql(nation: str) -> str:
    """Site indexes: with a deep member of no use, one of 17 million characters, members given
    twice, a deep module path, cut off within a deep member, and with a deep root."""
    root = '"verification":{{"merkleRoot":{}}}'
    return f"""
SELECT 'https://n' || n_nationkey || '.example.com' AS site, n_nationkey AS k,
  CASE WHEN n_nationkey = 1 THEN '{{"pad":"' || repeat('x', 17000000) || '","modules":["/a","/' || n_name || '"],{root.format('"r"')}}}'
    WHEN n_nationkey % 6 IN (0, 1) THEN '{{ "extra" : ' || {DEEP_VALUE} || ', "modules": ["/a" , "/' || n_name || '"],"version":"1.0",{root.format('"r"')}}}'
    WHEN n_nationkey % 6 = 2 THEN '{{"modules":["/old"],"modules":["/é\u00e9","/' || n_name || '"],"extra":' || {DEEP_VALUE} || ',"verification":{{"merkleRoot":"old","merkleRoot":""}}}}'
    WHEN n_nationkey % 6 = 3 THEN '{{"modules":["/a",' || {DEEP_VALUE} || '],{root.format('0.0')}}}'
    WHEN n_nationkey % 6 = 4 THEN '{{"modules":["/a"],"extra":' || substr({DEEP_VALUE}, 1, {2 * DEEP} - 1) || '}}'
    ELSE '{{"modules":["/a","/' || n_name || '"],"verification":{{"strategy":"merkle","merkleRoot":' || {DEEP_VALUE} || '}}}}' END AS raw
FROM {nation}"""


def deep_modules_sql(part: str) -> str:
    """A module per part, every tenth of them with objects that nest deeply."""
    deep = f"CASE WHEN p_partkey % 10 = 0 THEN {DEEP_VALUE} ELSE '[]' END"
    return f"""
SELECT k, u, CASE k % 4 WHEN 0 THEN '{{"url":"' || u || '","deep":' || d || ',"checksum":"c' || k || '"}}'
    WHEN 1 THEN '[{{"url":"' || u || '", "deep": ' || d || '}},{{"checksum":"c' || k || '"}}]'
    WHEN 2 THEN '[{{"og:url":"' || u || '","deep":' || d || ',"url":""}}, {{"deep":' || d || '}}]'
    ELSE '[{{"url":"' || u || '","deep":' || d || '}},{{"url":"' || u || '/other","deep":' || d || '}}]' END AS raw,
  CASE k % 4 WHEN 0 THEN '{{"checksum":"c' || k || '","deep":' || d || ',"url":"' || u || '"}}'
    WHEN 1 THEN '{{"deep":' || d || ',"url":"' || u || '"}}'
    WHEN 2 THEN '{{"deep":' || d || ',"og:url":"' || u || '","url":""}}' END AS kept
FROM (SELECT p_partkey AS k, 'https://deep.example.com/p/' || p_partkey AS u, {deep} AS d FROM {part}) x"""


@built
def deep_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(deep_index_sql(_view(spark, sf_dir, "nation")).replace("\\u00e9", "\\\\u00e9"))


@built
def deep_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, module_url, raw), as `all_modules`."""
    facts = spark.sql(deep_modules_sql(_view(spark, sf_dir, "part")))
    return facts.select(F.lit("https://deep.example.com").alias("site"), F.col("k").alias("pos"), F.concat("u", F.lit(".json")).alias("module_url"), F.concat(F.lit("/p/"), "k", F.lit(".json")).alias("path"), "raw")


@built
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(captures_sql(_view(spark, sf_dir, "part"), _view(spark, sf_dir, "pages")))


@built
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    module_facts(spark, sf_dir).createOrReplaceTempView("siteledger_module_facts")
    return spark.sql(audit_pages_sql("siteledger_module_facts", _view(spark, sf_dir, "pages")))


@built
def recaptures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(recaptures_sql(_view(spark, sf_dir, "part"), _view(spark, sf_dir, "pages")))


def _captured_again(latest: DataFrame, number: str, text: str, stale: str) -> DataFrame:
    """`latest` with further captures of its rows, whose `text` is `stale` or was not read."""
    def captured(rows, day, name):
        return rows.withColumns({"captured_at": F.expr(captured_at(day)), "capture_id": F.lit(name)})

    out = captured(latest, LATEST_DAY, LATEST_ID)
    for day, name, which, shift in FURTHER:
        old = F.when(F.col(number) % 7 != shift, F.expr(stale))
        out = out.unionByName(captured(latest.filter(which.replace("page_id", number)).withColumn(text, old), day, name))
    return out


@built
def modules_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`modules`, some of them captured several times."""
    return _captured_again(modules(spark, sf_dir), "pos", "raw", "concat('[{\"url\":\"', site, '/old\"}]')").drop("pos", "path")


@built
def audit_pages_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audit_pages`, some of them captured several times, and pages that no module names."""
    stale = """concat('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Thing","url":"', url, '"}</script>')"""
    again = _captured_again(audit_pages(spark, sf_dir), "k", "html", stale)
    others = captures(spark, sf_dir).select("url", F.expr(captured_at(LATEST_DAY)).alias("captured_at"), F.lit("x").alias("capture_id"), "html")
    return again.select(*others.columns).unionByName(others)


@built
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(crawl_pages_sql(_view(spark, sf_dir, "pages")))


def crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url): each site's root."""
    sites = crawl_pages(spark, sf_dir).select("site").distinct()
    return sites.withColumn("url", F.col("site"))


def sitemap_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = crawl_pages(spark, sf_dir).select("site").distinct()
    return sites.withColumn("url", F.concat("site", F.lit("/sitemap.xml")))


@built
def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, xml): for every second site an index over two index documents and leaf
    documents of three pages each; every fourth leaf sits one level deeper."""
    crawl_pages(spark, sf_dir).createOrReplaceTempView("siteledger_crawl")
    return spark.sql(
        SITEMAPS.format(
            crawl="siteledger_crawl",
            blocks="array_join(transform(sequence(0, ceil(n / 3) - 1), b -> "
            "'<sitemap><loc>' || site || '/sm/c' || b || '.xml</loc></sitemap>'), '')",
            three=whole("r / 3"),
        )
    )


SITEMAPS = """
WITH sites AS (SELECT site, site_no, count(*) AS n FROM {crawl} WHERE site_no >= 0 AND site_no % 2 = 0 GROUP BY site, site_no),
leaves AS (
  SELECT c.site, {three} AS b,
    '<urlset><url><loc>' || c.site || '/n/' || r || '</loc></url>'
    || CASE WHEN r + 1 < n THEN '<url><loc>' || c.site || '/n/' || (r + 1) || '</loc></url>' ELSE '' END
    || CASE WHEN r + 2 < n THEN '<url><loc>' || c.site || '/n/' || (r + 2) || '</loc></url>' ELSE '' END
    || '</urlset>' AS xml
  FROM {crawl} c JOIN sites s ON c.site = s.site WHERE r % 3 = 0
)
SELECT site || '/sitemap.xml' AS url,
  '<sitemapindex><sitemap><loc>' || site || '/sm/mid0.xml</loc></sitemap><sitemap><loc>' || site
  || '/sm/mid1.xml</loc></sitemap>' || {blocks} || '</sitemapindex>' AS xml FROM sites
UNION ALL SELECT site || '/sm/mid0.xml', '<sitemapindex><sitemap><loc>' || site || '/sm/c1.xml</loc><lastmod>x</lastmod></sitemap><sitemap><loc>'
  || site || '/sm/c0.xml</loc></sitemap></sitemapindex>' FROM sites
UNION ALL SELECT site || '/sm/mid1.xml', '<sitemapindex><sitemap><loc>' || site || '/sm/c3.xml</loc></sitemap></sitemapindex>' FROM sites
UNION ALL SELECT CASE WHEN b % 4 = 3 THEN site || '/sm/d' || b || '.xml' ELSE site || '/sm/c' || b || '.xml' END, xml FROM leaves
UNION ALL SELECT site || '/sm/c' || b || '.xml', '<sitemapindex><sitemap><loc>' || site || '/sm/d' || b || '.xml</loc></sitemap></sitemapindex>'
  FROM leaves WHERE b % 4 = 3"""


@built
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(request_log_sql(SPARK, _view(spark, sf_dir, "events")))


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).filter("event_type = 'error'")
    return log.select("site", "side", "url", "error", F.col("start_ms").alias("time_ms"), "seq")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select(
        "site", "side", F.col("start_ms").alias("ts_ms"), "seq", "rss", "cpu_user", "cpu_system",
        "disk_bytes", "current",
    )


def method_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select(
        "url",
        F.col("side").alias("method"),
        "start_ms",
        F.coalesce("end_ms", "start_ms").alias("end_ms"),
        F.expr("'h' || (user_id % CASE WHEN side = 'declared' THEN 3 ELSE 2 END)").alias("objects_checksum"),
        F.expr("current > 2").alias("trust"),
        F.col("event_type").alias("details"),
    )
