"""DuckDB SQL with the expected rows of the registered queries.

Expected rows are derived from the columns the bridge tables were built from, not by
parsing the documents those tables hold.
"""

from __future__ import annotations

import re

from siteledger.operators import compare as C
from siteledger.operators import modules as MOD
from siteledger.functions import urls as U
from siteledger.plans import bridges as B

D = B.DUCKDB
EMPTY = "sha256('{}')"
CTX = B.CONTEXT


def _root(source: str) -> str:
    """Merkle roots per site of a (site, pos, leaf) relation; two CTE bodies."""
    return f"""
  SELECT site, list(leaf ORDER BY pos) AS l FROM {source} GROUP BY site
  UNION ALL
  SELECT site, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], l[i + 1])))
  FROM {source}_lv WHERE len(l) > 1"""


def _joined(items: str) -> str:
    return f"'[' || array_to_string({items}, ',') || ']'"


def _hash_of(items: str) -> str:
    """Checksum input in text key order for a list of canonical objects."""
    keys = f"list_sort(list_transform(range(len({items})), lambda i: CAST(i AS VARCHAR)))"
    member = f"""lambda s: '"' || s || '":' || {items}[CAST(s AS BIGINT) + 1]"""
    return f"sha256('{{' || array_to_string(list_transform({keys}, {member}), ',') || '}}')"


def _text(template: str, **values: str) -> str:
    """SQL for a text with SQL values for the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


TAIL_CANON = """'{"checksum":"' || declared || '"}'"""
HAS_TAIL = "kind NOT IN ('missing', 'text', 'single', 'notail')"
NONE = "CAST([] AS VARCHAR[])"

CTES: dict[str, str] = {
    "m": B.modules_sql(D, "part"),
    # What each rule finds in a module.
    "f": f"""
  SELECT *, CASE WHEN {HAS_TAIL} THEN CASE WHEN bad THEN 'BAD' ELSE data_hash END
      WHEN kind = 'single' THEN 'c' || k END AS declared,
    CASE WHEN kind IN ('differ', 'nourl', 'nullelem', 'text', 'missing') THEN {NONE} ELSE data END AS kept,
    CASE WHEN kind IN ('differ', 'nullelem', 'text', 'missing') THEN 'error' ELSE 'success' END AS status,
    CASE kind WHEN 'missing' THEN '{MOD.MODULE_UNREADABLE}'
      WHEN 'text' THEN {_text(MOD.MALFORMED, url='module_url', kind="'string'")}
      WHEN 'nullelem' THEN {_text(MOD.NULL_ELEMENT)}
      WHEN 'differ' THEN {_text(MOD.DIFFERING, url='module_url')}
      END AS error,
    CASE WHEN kind IN ('differ', 'nullelem', 'text', 'missing') THEN module_url WHEN kind = 'nourl' THEN NULL ELSE u END AS page_url
  FROM m""",
    "a": f"""
  SELECT *, {_hash_of('kept')} AS calculated, CASE WHEN status = 'success' THEN declared END AS audit_declared FROM f""",
    "audit_leaf": "SELECT site, pos, calculated AS leaf FROM a",
    "audit_leaf_lv": _root("audit_leaf"),
    "audit_root": "SELECT site, l[1] AS root FROM audit_leaf_lv WHERE len(l) = 1",
    "trust_leaf": f"SELECT site, pos, declared AS leaf FROM f WHERE {HAS_TAIL}",
    "trust_leaf_lv": _root("trust_leaf"),
    "trust_root": "SELECT site, l[1] AS root FROM trust_leaf_lv WHERE len(l) = 1",
    "ix": """
  SELECT s.site, site_no, n, CASE WHEN site_no = -1 OR site_no % 3 = 0 THEN ar.root
      WHEN site_no % 3 = 1 THEN tr.root ELSE 'BAD' END AS stated,
    CASE WHEN site_no % 5 = 4 THEN 1 ELSE 0 END AS shift
  FROM (SELECT site, site_no, count(*) AS n FROM m GROUP BY site, site_no) s
  LEFT JOIN audit_root ar ON ar.site = s.site LEFT JOIN trust_root tr ON tr.site = s.site""",
    "ux": "SELECT 'https://x' || r_regionkey || '.example.com' AS site, r_regionkey AS r FROM region",
    # The audit, page by page.
    "pg": f"""
  SELECT a.*, p.page_id % 5 AS variant, p.page_id IS NOT NULL AND page_url = u AND p.page_id % 5 <> 4 AS extracted_ok,
    CASE WHEN p.page_id IS NULL OR page_url IS NULL OR page_url <> u OR p.page_id % 5 IN (0, 4) THEN {NONE}
      WHEN p.page_id % 5 = 3 THEN ['{{{CTX},"@type":"Product","name":"' || nm || '","url":"' || u || '"}}']
      WHEN kind = 'single' THEN ['{{{CTX},"@type":"Thing","url":"' || u || '"}}']
      ELSE list_filter(data, lambda x: x <> 'null') END AS ext
  FROM a LEFT JOIN pages p ON p.page_id = a.k""",
    "cmp": f"""
  SELECT *, {_joined('kept')} = {_joined('ext')} AS schemas_match, {_hash_of('ext')} AS ext_hash FROM pg""",
    "ext_leaf": "SELECT site, pos, ext_hash AS leaf FROM cmp",
    "ext_leaf_lv": _root("ext_leaf"),
    "ext_root": "SELECT site, l[1] AS root FROM ext_leaf_lv WHERE len(l) = 1",
    "sm": """
  SELECT ix.site, CAST(c.n AS BIGINT) AS total_pages, c.ok AS all_match,
    CASE WHEN c.ok THEN 'All schemas match.' ELSE 'Some schemas do not match.' END AS details,
    ar.root AS merkle_root_declared, er.root AS merkle_root_extracted, stated AS merkle_root_index,
    ar.root = stated AS declared_root_valid, er.root = stated AS extracted_root_valid,
    ar.root = stated AND er.root = stated AS roots_match
  FROM ix JOIN (SELECT site, count(*) AS n, bool_and(schemas_match) AS ok FROM cmp GROUP BY site) c ON c.site = ix.site
  JOIN audit_root ar ON ar.site = ix.site JOIN ext_root er ON er.site = ix.site""",
    # Captured pages with markup.
    "cap": B.captures_sql("part", "pages"),
    "again": B.recaptures_sql("part", "pages"),
    "ex": f"""
  SELECT page_id, kind, CASE kind
      WHEN 1 THEN ['{{{CTX},"@type":"Product","brand":{{"name":"' || br || '"}},"size":' || sz || '}}']
      WHEN 2 THEN [flat, brand_list, flat]
      WHEN 8 THEN [thing, og, '{{"@context":"https://example.org","@type":"No"}}']
      WHEN 9 THEN [label_nm, label_br] ELSE {NONE} END AS jsonld,
    CASE kind WHEN 3 THEN [flat] ELSE {NONE} END AS inline,
    CASE kind WHEN 4 THEN ['{{{CTX},"@type":"Product","image":"/i/' || k || '.png","name":"' || nm || '","sku":"' || k || '","tag":["' || br || '","second"],"url":"/p/' || k || '"}}'] ELSE {NONE} END AS microdata,
    CASE kind WHEN 5 THEN ['{{{CTX},"@type":"Recipe","label":"' || br || '","maker":"' || br || '","title":"' || nm || '","yields":"' || sz || '"}}',
      '{{{CTX},"@type":"Brand","label":"' || br || '","maker":"' || br || '"}}'] ELSE {NONE} END AS rdfa,
    CASE kind WHEN 6 THEN ['{{{CTX},"@type":"Product","inner":{{{CTX},"@type":"Offer"}},"name":"' || nm || '"}}',
      '{{"@context":"http://schema.org/","@type":"Brand","name":"' || br || '"}}'] ELSE {NONE} END AS next_data,
    CASE kind WHEN 7 THEN ['{{{CTX},"@type":"Article","name":"' || nm || '"}}'] ELSE {NONE} END AS react_attr,
    CASE kind WHEN 1 THEN ['{{{CTX},"@type":"Product","brand":{{"name":"' || br || '"}},"size":' || sz || '}}']
      WHEN 2 THEN [flat, brand_list, flat] WHEN 3 THEN [flat] WHEN 8 THEN [thing] ELSE {NONE} END AS react_inline,
    nm, br, k, sz, html
  FROM (SELECT *, '{{{CTX},"@type":"Product","name":"' || nm || '","sku":"' || k || '"}}' AS flat,
      '{{"@context":["https://schema.org"],"@type":"Brand","name":"' || br || '"}}' AS brand_list,
      '{{{CTX},"@type":"Thing","checksum":"x","name":"' || nm || '"}}' AS thing,
      '{{"@context":"https://ogp.me/ns#","og:title":"' || br || '"}}' AS og,
      '{{{CTX},"@type":"Product","brand":{{"label":"' || nm || '"}}}}' AS label_nm,
      '{{{CTX},"@type":"Product","brand":{{"label":"' || br || '"}}}}' AS label_br FROM cap) x""",
    "every": """
  SELECT page_id, html, kind, list_concat(list_filter(jsonld, lambda x: NOT contains(x, 'example.org')), inline, microdata, rdfa, next_data, react_attr, react_inline) AS objs,
    list_concat(list_transform(list_filter(jsonld, lambda x: NOT contains(x, 'example.org')), lambda x: 0), list_transform(inline, lambda x: 1), list_transform(microdata, lambda x: 2),
      list_transform(rdfa, lambda x: 3), list_transform(next_data, lambda x: 4), list_transform(react_attr, lambda x: 5), list_transform(react_inline, lambda x: 5)) AS methods
  FROM ex""",
    "uniq": """
  SELECT page_id, html, CASE WHEN kind = 9 THEN objs[1:1] ELSE list_filter(objs, lambda x, i: list_position(objs, x) = i) END AS objs FROM every""",
    "page": "SELECT page_id, html, list_transform(objs, lambda x: replace(x, '\"checksum\":\"x\",', '')) AS objs FROM uniq",
    "cr": B.crawl_pages_sql("pages"),
    "cs": "SELECT site, site_no, count(*) AS n FROM cr GROUP BY site, site_no",
    "walk": """
  SELECT site, site_no, CASE WHEN r <= 2 THEN r ELSE r + 1 END AS ord, CASE WHEN r = 0 THEN site ELSE site || '/n/' || r END AS url
  FROM (SELECT site, site_no, unnest(range(0, 2 * n + 1)) AS r FROM cs) x
  UNION ALL SELECT site, site_no, 3, site || '/' FROM cs""",
    "sml": """
  SELECT c.site, n, c.r // 3 AS b, c.r % 3 AS i, c.site || '/n/' || c.r AS loc FROM cr c JOIN cs ON c.site = cs.site
  WHERE c.site_no >= 0 AND c.site_no % 2 = 0""",
    "smp": """
  SELECT site, loc, CASE WHEN b % 4 = 3 THEN [2 + b, 0, i] ELSE [2 + b, i] END AS path FROM sml
  UNION ALL SELECT site, loc, [0, 1 - b, i] FROM sml WHERE b < 2
  UNION ALL SELECT site, loc, [1, 0, 0, i] FROM sml WHERE b = 3""",
    "smf": """
  SELECT site, loc AS url, row_number() OVER (PARTITION BY site ORDER BY min(path)) - 1 AS ord FROM smp GROUP BY site, loc""",
    "lg": B.request_log_sql(D, "events"),
    "er": "SELECT site, side, url, error, start_ms AS time_ms, seq FROM lg WHERE event_type = 'error'",
    "tot": """
  SELECT site, side, count(*) AS n, CAST(sum(coalesce(bytes_down, 0)) AS BIGINT) AS down, CAST(sum(coalesce(bytes_up, 0)) AS BIGINT) AS up,
    avg(end_ms - start_ms) AS avg_ms, min(start_ms) AS a, max(start_ms) AS b,
    max(ROW(start_ms, seq)) AS last_key, arg_max(cpu_user, ROW(start_ms, seq)) - arg_min(cpu_user, ROW(start_ms, seq)) AS cu,
    arg_max(cpu_system, ROW(start_ms, seq)) - arg_min(cpu_system, ROW(start_ms, seq)) AS cs,
    arg_min(rss, ROW(start_ms, seq)) AS start_rss, arg_max(rss, ROW(start_ms, seq)) AS end_rss, max(rss) AS peak_rss,
    CAST(sum(disk_bytes) AS BIGINT) AS disk, count(*) FILTER (WHERE event_type = 'error') AS errs, greatest(max(current), 0) AS cur
  FROM lg GROUP BY site, side""",
    "st": """
  SELECT site, side, string_agg(code || ': ' || c, ', ' ORDER BY coalesce(TRY_CAST(code AS BIGINT), 1099511627776)) AS codes
  FROM (SELECT site, side, coalesce(CAST(status AS VARCHAR), 'undefined') AS code, count(*) AS c FROM lg GROUP BY ALL) x GROUP BY site, side""",
    "ev": """
  SELECT site, side, start_ms AS t, 2 AS o, 1 AS d FROM lg WHERE end_ms IS NOT NULL
  UNION ALL SELECT site, side, end_ms, CASE WHEN end_ms = start_ms THEN 3 ELSE 1 END, -1 FROM lg WHERE end_ms IS NOT NULL""",
    "cc": """
  SELECT site, side, CAST(greatest(max(lv), 0) AS BIGINT) AS mc FROM (
    SELECT site, side, sum(d) OVER (PARTITION BY site, side ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS lv FROM ev) x GROUP BY site, side""",
    "trouble": f"""
  SELECT site, 'declared' AS side, module_url AS url, error, pos AS seq FROM pg WHERE status = 'error'
  UNION ALL SELECT site, 'extracted', page_url, '{C.PAGE_UNREADABLE}', pos FROM pg WHERE page_url IS NOT NULL AND NOT coalesce(extracted_ok, FALSE)""",
    "met": "SELECT site, side, count(*) AS met FROM trouble GROUP BY site, side",
    "ms": """
  SELECT tot.* REPLACE (errs + coalesce(met, 0) AS errs), b - a AS dur, n / ((b - a) / 1000.0) AS rps, codes, mc FROM tot LEFT JOIN st USING (site, side) LEFT JOIN cc USING (site, side)
  LEFT JOIN met USING (site, side)""",
}


def _dependencies(sql: str) -> list[str]:
    needed: list[str] = []

    def visit(text: str):
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text):
            if name in CTES and name not in needed:
                if not name.endswith("_lv"):
                    visit(CTES[name])
                else:
                    visit(CTES[name].split("UNION ALL")[0])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    return needed


def _sql(final: str) -> str:
    parts = [f"{name} AS ({CTES[name]}\n)" for name in _dependencies(final)]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final


# --- formats ---------------------------------------------------------------------------------


def fixed(x: str, digits: int) -> str:
    """Exact halves go up; printf takes them to the even neighbour."""
    x = f"CAST({x} AS DOUBLE)"
    half = f"regexp_matches(printf('%.25f', {x}), '\\.[0-9]{{{digits}}}50*$')"
    return f"printf('%.{digits}f', CASE WHEN {half} THEN {x} + {10 ** -(digits + 2)} ELSE {x} END)"


def grouped(x: str, digits: int) -> str:
    text = f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
    return f"format('{{:,.{digits}f}}', CAST(round(CAST({text} AS DECIMAL(38, 12)), {digits}) AS DOUBLE))"


def four(x: str) -> str:
    text = f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
    return f"printf('%.4f', CAST(round(CAST({text} AS DECIMAL(38, 18)), 4) AS DOUBLE))"


def short(x: str) -> str:
    return f"regexp_replace(regexp_replace({grouped(x, 2)}, '0+$', ''), '\\.$', '')"


def nearest(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def first_unit(ms: str) -> str:
    return f"""CASE WHEN {ms} < 3600000 THEN CAST(floor({ms} / 60000.0) AS BIGINT) || 'm' WHEN {ms} < 86400000 THEN CAST(floor({ms} / 3600000.0) AS BIGINT) || 'h'
    WHEN {ms} < 31536000000 THEN CAST(floor({ms} / 86400000.0) AS BIGINT) || 'd' ELSE CAST(floor({ms} / 31536000000.0) AS BIGINT) || 'y' END"""


def duration(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} < 1000 THEN {nearest(x)} || 'ms' WHEN {x} < 10000 THEN {fixed(f'{x} / 1000.0', 2)} || 's (' || {nearest(x)} || 'ms)'
    WHEN {x} < 60000 THEN {fixed(f'{x} / 1000.0', 2)} || 's' ELSE {first_unit(x)} END"""


def cpu_time(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} < 1000 THEN {x} || ' μs' WHEN {x} < 1000000 THEN {short(f'{x} / 1000.0')} || ' ms'
    WHEN {x} < 60000000 THEN {short(f'{x} / 1000000.0')} || ' s' ELSE {first_unit(f'({x} / 1000.0)')} END"""


def _power(x: str, base: int, units: int) -> str:
    cases = " ".join(f"WHEN {x} >= {base ** i} THEN {i}" for i in range(units - 1, 0, -1))
    return f"CASE {cases} ELSE 0 END"


def binary_size(x: str) -> str:
    power = _power(x, 1024, 5)
    return f"""CASE WHEN {x} = 0 THEN '0 B' ELSE regexp_replace({fixed(f'{x} / pow(1024.0, {power})', 1)}, '\\.0$', '') || ' ' || (['B','KB','MB','GB','TB'])[{power} + 1] END"""


def decimal_size(x: str) -> str:
    power = _power(x, 1000, 6)
    unrounded = f"({x} / pow(1000.0, {power}))"
    rounded = f"(CASE WHEN {power} = 0 THEN floor({unrounded} + 0.5) ELSE floor({unrounded} * 10 + 0.5) / 10.0 END)"
    units = "(['B','kB','MB','GB','TB','PB'])"
    return f"""CASE WHEN {rounded} = 1000 THEN '1 ' || {units}[{power} + 2] ELSE regexp_replace({fixed(rounded, 1)}, '\\.0$', '') || ' ' || {units}[{power} + 1] END"""


def less(x: str, context: str) -> str:
    return f"'**~' || abs({nearest(x)}) || '% less{context}**'"


def faster(x: str, context: str) -> str:
    return f"'**~' || abs({nearest(x)}) || '% faster{context}**'"


def times(x: str, context: str) -> str:
    return f"'**~' || {fixed(x, 1)} || 'x faster{context}**'"


CTES["side"] = """
  SELECT site, d, e FROM (SELECT site, d FROM (SELECT site, ms AS d FROM ms WHERE side = 'declared') x) JOIN
    (SELECT site AS site2, ms AS e FROM ms WHERE side = 'extracted') y ON site = site2"""
CTES["diff"] = f"""
  SELECT site, {times('e.dur / d.dur', '')} AS duration,
    {less('((e.cu + e.cs) - (d.cu + d.cs)) / (e.cu + e.cs) * 100.0', ' CPU used')} AS cpu,
    {less('(e.peak_rss - d.peak_rss) / e.peak_rss * 100.0', ' RAM used')} AS memory,
    {less('(e.down - d.down) / e.down * 100.0', ' data')} AS bytes,
    {faster('(e.avg_ms - d.avg_ms) / e.avg_ms * 100.0', ' per request')} AS avg_request_time,
    {times('d.rps / e.rps', '')} AS rps,
    CASE WHEN abs(d.n - e.n) <= 1 THEN 'Similar' WHEN d.n > e.n THEN '~' || (d.n - e.n) || ' more' ELSE '~' || (e.n - d.n) || ' less' END AS requests
  FROM side"""
_FORMATTED = {
    "duration": duration("S.dur"), "cpu_user": cpu_time("S.cu"), "cpu_system": cpu_time("S.cs"),
    "cpu": cpu_time("(S.cu + S.cs)"), "memory": decimal_size("S.peak_rss"), "requests": grouped("S.n", 0),
    "avg_request_time": duration("S.avg_ms"), "rps": grouped("S.rps", 2), "bytes": decimal_size("S.down"),
    "status_codes": "S.codes", "errors": grouped("S.errs", 0), "concurrency": grouped("S.mc", 0),
}
CTES["fmt"] = "SELECT site, d.errs AS d_errs, e.errs AS e_errs, " + ", ".join(
    f"{text.replace('S.', side + '.')} AS {name}_{field}"
    for name, side in (("declared", "d"), ("extracted", "e")) for field, text in _FORMATTED.items()
) + " FROM side"
_LINES = [
    ("⏱️ Total Duration", "declared_duration", "extracted_duration", "duration"),
    ("🧠 CPU Time (User+System)", "declared_cpu", "extracted_cpu", "cpu"),
    ("💾 Peak Memory (RSS)", "declared_memory", "extracted_memory", "memory"),
    ("🌐 Total Downloaded Data", "declared_bytes", "extracted_bytes", "bytes"),
    ("🌐 Requests Made", "declared_requests", "extracted_requests", "requests"),
    ("🚀 Avg Request Time", "declared_avg_request_time", "extracted_avg_request_time", "avg_request_time"),
    ("📦 Download RPS", "declared_rps || ' req/s'", "extracted_rps || ' req/s'", "rps"),
    ("🧵 Max Concurrency", "declared_concurrency", "extracted_concurrency",
     "CASE WHEN declared_concurrency = extracted_concurrency THEN 'Same' ELSE declared_concurrency || ' vs ' || extracted_concurrency END"),
    ("📊 Status Codes", "declared_status_codes", "extracted_status_codes", "'-'"),
    ("❌ Errors Encountered", "declared_errors", "extracted_errors",
     "CASE WHEN d_errs = 0 AND e_errs = 0 THEN '✅ Stable on both sides' ELSE 'See details' END"),
    ("✅ Schemas Match", "CASE WHEN all_match THEN '✅ All Match' ELSE '❌ Mismatch' END",
     "CASE WHEN all_match THEN '✅ All Match' ELSE '❌ Mismatch' END",
     "CASE WHEN all_match THEN '✅ Equivalent Accuracy' ELSE '❌' END"),
]
CTES["tab"] = " UNION ALL ".join(
    f"SELECT site, {i} AS line, '{name}' AS metric, {a} AS declared, {b} AS extracted, {c} AS diff FROM fmt JOIN diff USING (site) JOIN sm USING (site)"
    for i, (name, a, b, c) in enumerate(_LINES, 1)
)
CTES["pct"] = """
  SELECT site, pos, page_url, CASE WHEN schemas_match THEN '✅' ELSE '❌' END AS match, calculated AS declared_calculated, ext_hash AS extracted_checksum FROM cmp"""
CTES["rep"] = f"""
  SELECT site, section, line, text FROM (
    SELECT site, 0 AS section, unnest(range(0, 15)) AS line, unnest(['# 📊 Declared vs Extracted Report', '', '**Domain:** `' || site || '`  ', '**Total Pages Crawled:** `' || total_pages || '`  ',
      '**Schemas Match:** ' || CASE WHEN all_match THEN '✅ Yes' ELSE '❌ No' END || '  ', '**Merkle Roots Match:** ' || CASE WHEN roots_match THEN '✅ Yes' ELSE '❌ No' END || '  ',
      '**Declared Merkle Root Valid:** ' || CASE WHEN declared_root_valid THEN '✅' ELSE '❌' END || '  ', '**Extracted Merkle Root Valid:** ' || CASE WHEN extracted_root_valid THEN '✅' ELSE '❌' END,
      '', '---', '', '## 📈 Benchmark Summary Table', '', '| Metric | Declared | Extracted | Diff / Savings |', '|---|---|---|---|']) AS text
    FROM sm WHERE site IN (SELECT site FROM side)
    UNION ALL SELECT site, 1, line, '| ' || metric || ' | ' || declared || ' | ' || extracted || ' | ' || diff || ' |' FROM tab
    UNION ALL SELECT site, 2, unnest(range(0, 7)), unnest(['', '---', '', '## 🔍 Per-Page Checksums', '', '| Page URL | Checksum Match | Declared Checksum | Extracted Checksum |', '|---|---|---|---|']) FROM side
    UNION ALL SELECT site, 3, pos, '| [' || coalesce(page_url, '') || '](' || coalesce(page_url, '') || ') | ' || match || ' | `' || declared_calculated || '` | `' || extracted_checksum || '` |' FROM pct WHERE site IN (SELECT site FROM side)
    UNION ALL SELECT site, 4, unnest(range(0, 8)), unnest(['', '---', '', '## 🛡️ Merkle Roots Validation', '', '```json',
      '{{"Declared":"' || merkle_root_declared || '","Extracted":"' || merkle_root_extracted || '","Index":"' || merkle_root_index || '"}}', '```']) FROM sm WHERE site IN (SELECT site FROM side)
  ) x"""


# --- the queries -----------------------------------------------------------------------------------

ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
PATH = "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
BASE_QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1)"
DIRECTORY = f"regexp_replace({PATH}, '[^/]*$', '')"
URL_VARIANTS = """
  SELECT page_id, url, unnest(range(0, 10)) AS variant, unnest([url, 'data:', 'ftp', 'mailto', '', NULL, 'no url', 'https://', 'padded', 'file']) AS v FROM pages"""
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
SCHEME = "regexp_extract(url, '^(https?:)', 1)"


def _list_rows(column: str, where: str = "TRUE") -> str:
    return _sql(
        f"SELECT page_id, CAST(i AS BIGINT) AS n, {column}[i] AS canon FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS i FROM ex) x WHERE {where}"
    )


def _unnested(source: str) -> str:
    return _sql(f"SELECT page_id, CAST(i AS BIGINT) AS n, objs[i] AS canon FROM (SELECT *, unnest(range(1, len(objs) + 1)) AS i FROM {source}) x")


AMOUNTS = """(SELECT event_id, value AS x, event_id % 50 AS b, CAST(floor(value * pow(10.0, event_id % 9)) AS BIGINT) AS amount FROM events)"""
MICRO_VALUES = [
    ("name", "nm"), ("sku", "CAST(k AS VARCHAR)"), ("tag", "''"), ("tag", "br"), ("tag", "'second'"),
    ("url", "'/p/' || k"), ("image", "'/i/' || k || '.png'"), ("offers", "CAST(sz AS VARCHAR)"),
    ("price", "CAST(sz AS VARCHAR)"), ("name", "'no'"),
]

ORACLES: dict[str, str] = {
    "load_pages": "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS digest FROM pages",
    "load_site_index": _sql("""
SELECT site, '1.0' AS version, 'merkle' AS strategy, stated AS merkle_root, CAST(n + shift AS BIGINT) AS n_modules,
  CASE WHEN shift = 1 THEN 'http://' ELSE '/m/0.json' END AS first_module FROM ix
UNION ALL SELECT site, CASE WHEN r IN (0, 1, 3) THEN '1.0' END, NULL, CASE WHEN r = 0 THEN 'abc' END, CASE WHEN r = 0 THEN 0 END, NULL FROM ux"""),
    "load_modules": _sql(f"SELECT site, module_url, sha256({B.MODULE_RAW}) AS digest FROM m WHERE kind <> 'missing'"),
    "load_request_log": _sql("SELECT site, side, url, method, start_ms, end_ms, bytes_down, bytes_up, CAST(status AS BIGINT) AS status FROM lg"),
    "write_result_json": _sql("""
SELECT regexp_extract(site, '//(.*)$', 1) AS domain, pos, '{"site":"' || site || '","pos":' || pos || ',' || CASE WHEN page_url IS NULL THEN '' ELSE '"page_url":"' || page_url || '",' END
  || '"schemas_match":' || schemas_match || ',"extracted_checksum":"' || ext_hash || '"}' AS json FROM cmp"""),
    "write_run": _sql(f"""
SELECT regexp_extract(site, '//(.*)$', 1) AS domain, 1 AS section, page_url AS url, {_joined('kept')} AS declared, {_joined('ext')} AS extracted, CAST(schemas_match AS VARCHAR) AS schemas_match,
  ext_hash AS extracted_checksum, NULL AS total_pages, NULL AS merkle_root_declared, NULL AS requests, NULL AS errors FROM cmp
UNION ALL SELECT regexp_extract(sm.site, '//(.*)$', 1), 2, NULL, NULL, NULL, NULL, NULL, CAST(total_pages AS VARCHAR), merkle_root_declared, CAST(d.n AS VARCHAR), CAST(e.errs AS VARCHAR)
FROM sm LEFT JOIN (SELECT * FROM ms WHERE side = 'declared') d ON d.site = sm.site LEFT JOIN (SELECT * FROM ms WHERE side = 'extracted') e ON e.site = sm.site"""),
    "write_report": _sql("SELECT regexp_extract(site, '//(.*)$', 1) AS domain, CAST(section AS INTEGER) AS section, CAST(line AS BIGINT) AS line, text FROM rep"),
    "render_report": _sql("SELECT site, CAST(section AS BIGINT) AS section, CAST(line AS BIGINT) AS line, text FROM rep"),
    "strip_field": """SELECT page_id, '{"url":"' || url || '","parts":[{"n":' || page_id || '},{"n":' || page_id || '}]}' AS json FROM pages""",
    "validate_url": f"""
SELECT page_id, variant, variant IN (0, 8, 9) AS is_valid,
  CASE variant WHEN 1 THEN '{U.DATA_BLOCKED}' WHEN 2 THEN 'Protocol ''ftp:'' is not supported. Only HTTP, HTTPS, and file: URLs are allowed'
    WHEN 3 THEN 'Protocol ''mailto:'' is not supported. Only HTTP, HTTPS, and file: URLs are allowed'
    WHEN 4 THEN '{U.MUST_BE_TEXT}' WHEN 5 THEN '{U.MUST_BE_TEXT}' WHEN 6 THEN '{U.INVALID_FORMAT}' WHEN 7 THEN '{U.INVALID_FORMAT}' END AS error,
  CASE variant WHEN 0 THEN {SCHEME} WHEN 1 THEN 'data:' WHEN 2 THEN 'ftp:' WHEN 3 THEN 'mailto:' WHEN 8 THEN 'https:' WHEN 9 THEN 'file:' END AS protocol
FROM ({URL_VARIANTS}) x""",
    "validate_urls": f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 3 END AS n, CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS n_valid,
  CASE WHEN page_id % 5 = 0 THEN '{U.INPUT_MUST_BE_LIST}' ELSE '-|Protocol ''javascript:'' is not supported. Only HTTP, HTTPS, and file: URLs are allowed|{U.INVALID_FORMAT}' END AS errors FROM pages""",
    "domain_of": f"""
SELECT page_id, variant, CASE WHEN variant IN (0, 2, 8) THEN regexp_replace({HOST}, '^www\\.', '') WHEN variant IN (1, 3, 9) THEN '' ELSE 'output' END AS domain FROM ({URL_VARIANTS}) x""",
    "resolve_url": f"""
SELECT page_id, variant, CASE variant WHEN 0 THEN {ORIGIN} || {DIRECTORY} || 'x/y' WHEN 1 THEN {ORIGIN} || regexp_replace({DIRECTORY}, '[^/]+/$', '') || 'up'
  WHEN 2 THEN {ORIGIN} || {PATH} || '?q=1' WHEN 3 THEN {ORIGIN} || {PATH} || {BASE_QUERY} || '#frag' WHEN 4 THEN {SCHEME} || '//other.example.org/p'
  WHEN 5 THEN {ORIGIN} || '/a/c' WHEN 6 THEN {ORIGIN} || {DIRECTORY} WHEN 7 THEN {ORIGIN} || {PATH} || {BASE_QUERY}
  WHEN 8 THEN 'http://ex.example.org/a/b' WHEN 9 THEN 'mailto:a@b.c' WHEN 11 THEN {ORIGIN} || '/sp%20ace/%C3%A9?%C3%BC=1' END AS link
FROM (SELECT page_id, url, unnest(range(0, 12)) AS variant FROM pages) x""",
    "is_internal": "SELECT page_id, variant, variant <> 2 AS internal FROM (SELECT page_id, unnest(range(0, 4)) AS variant FROM pages) x",
    "utf8_bytes": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
    "json_bytes": None,
    "context_is": """
SELECT p_partkey, variant, variant IN (0, 1, 2, 7) AS is_schema, variant = 4 AS is_open_graph FROM (SELECT p_partkey, unnest(range(0, 10)) AS variant FROM part) x""",
    "local_name": """
SELECT p_partkey, variant, CASE variant WHEN 0 THEN p_type WHEN 1 THEN '//schema.org/' || p_type WHEN 2 THEN p_type ELSE '' END AS name FROM (SELECT p_partkey, p_type, unnest(range(0, 4)) AS variant FROM part) x""",
    "type_from_itemtype": "SELECT p_partkey, variant, CASE WHEN variant < 2 THEN p_type END AS type FROM (SELECT p_partkey, p_type, unnest(range(0, 4)) AS variant FROM part) x",
    "sitemap_locs": _sql("SELECT site || CASE WHEN b % 4 = 3 THEN '/sm/d' ELSE '/sm/c' END || b || '.xml' AS url, CAST(i AS BIGINT) AS pos, loc FROM sml"),
    "expand_sitemap_index": _sql("SELECT site, array_to_string(path, '.') AS path, loc FROM smp"),
    "first_n_urls": _sql("SELECT site, ord, url FROM smf WHERE ord < 10"),
    "extract_links": r"""
SELECT page_id, CAST(n AS BIGINT) AS n, h[n] AS href, root || array_to_string(list_transform(regexp_extract_all(h[n], '[\x21-\x7e]+|[^\x21-\x7e]+'),
  lambda r: CASE WHEN regexp_matches(r, '^[\x21-\x7e]') THEN r ELSE url_encode(r) END), '') AS link
FROM (SELECT page_id, h, root, unnest(range(1, len(h) + 1)) AS n FROM (
  SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS root, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS h FROM pages) y) x""",
    "crawl_frontier": _sql("SELECT site, CAST(ord AS BIGINT) AS ord, url FROM walk"),
    "discover_urls": _sql("""
SELECT site, ord, url FROM smf UNION ALL SELECT site, CAST(ord AS BIGINT), url FROM walk WHERE (site_no < 0 OR site_no % 2 <> 0)"""),
    "limit_pages": _sql("SELECT site, r AS ord, url FROM cr WHERE r < 3"),
    "html_elements_by_tag": r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<script[ >]')) AS BIGINT) AS n_scripts,
  CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS n_items,
  CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS n_headings FROM pages""",
    "jsonld_blocks": _list_rows("jsonld"),
    "inline_jsonld": _list_rows("inline"),
    "microdata_items": _list_rows("microdata"),
    "microdata_value": _sql(" UNION ALL ".join(f"SELECT page_id, '{n}' AS name, {v} AS value FROM cap WHERE kind = 4" for n, v in MICRO_VALUES)),
    "collect_values": _sql(" UNION ALL ".join(
        f"""SELECT page_id, '{n}' AS name, '"' || {v} || '"' AS json FROM cap WHERE kind = 4""" for n, v in MICRO_VALUES if n != "tag"
    ) + """ UNION ALL SELECT page_id, 'tag', '["' || br || '","second"]' FROM cap WHERE kind = 4"""),
    "item_type_context": _sql("""
SELECT page_id, CAST(1 AS BIGINT) AS n, CASE kind WHEN 4 THEN 'Product' ELSE 'Recipe' END AS type, 'https://schema.org' AS context FROM cap WHERE kind IN (4, 5)
UNION ALL SELECT page_id, 2, 'Brand', 'https://schema.org' FROM cap WHERE kind = 5"""),
    "rdfa_items": _list_rows("rdfa"),
    "rdfa_own_property": _sql("SELECT page_id, 'maker' AS name, br AS value FROM cap WHERE kind = 5"),
    "next_data_objects": _list_rows("next_data"),
    "react_attr_objects": _list_rows("react_attr"),
    "react_inline_objects": _list_rows("react_inline"),
    "extract_all": _sql("SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, CAST(methods[i] AS BIGINT) AS method, objs[i] AS canon FROM (SELECT *, unnest(range(1, len(objs) + 1)) AS i FROM every) x"),
    "known_context": _list_rows("jsonld", "NOT contains(jsonld[i], 'example.org')"),
    "dedupe_objects": _unnested("uniq"),
    "dedupe_objects_strict": _sql("""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, objs[i] AS canon
FROM (SELECT *, unnest(range(1, len(objs) + 1)) AS i FROM every) x WHERE list_position(objs, objs[i]) = i"""),
    "drop_checksum_field": _unnested("page"),
    "raw_jsonld_blocks": _sql(r"""
SELECT page_id, CAST(i AS BIGINT) AS n, h[i] AS raw FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<script type="application/ld\+json">(.*?)</script>', 1) AS h FROM cap) y) x"""),
    "site_readiness_of_deep_indexes": f"""
SELECT 'https://n' || k || '.example.com' AS site, CASE WHEN r = 4 THEN '{MOD.NO_MODULES}' END AS error, CASE WHEN r <> 4 THEN 2 END AS n_modules,
  md5(CASE WHEN r = 3 THEN {B.DEEP_VALUE} WHEN r <> 4 THEN '/' || n_name END) AS last_module,
  md5(CASE WHEN r IN (0, 1) THEN 'r' WHEN r = 5 THEN {B.DEEP_VALUE} END) AS merkle_root,
  CASE WHEN r IN (0, 1) AND k <> 1 THEN '1.0' END AS version, CASE WHEN r = 5 THEN 'merkle' END AS strategy
FROM (SELECT n_nationkey AS k, n_nationkey % 6 AS r, n_name FROM nation) x""",
    "module_status_of_deep_modules": f"""
SELECT k AS pos, CASE WHEN k % 4 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN k % 4 = 3 THEN u || '.json' ELSE u END AS page_url,
  CASE WHEN k % 4 < 2 THEN 'c' || k END AS declared_checksum, CASE WHEN k % 4 = 3 THEN sha256('{{}}') ELSE sha256('{{"0":' || kept || '}}') END AS checksum,
  CASE WHEN k % 4 = 3 THEN 0 ELSE 1 END AS n_objects FROM ({B.deep_modules_sql("part")}) x""",
    "split_checksum_of_deep_modules": f"""
SELECT k AS pos, k % 4 = 1 AS fetched, CASE WHEN k % 4 = 1 THEN 'c' || k END AS checksum,
  CASE WHEN k % 4 = 1 THEN sha256('{{"0":' || kept || '}}') END AS calculated_checksum FROM ({B.deep_modules_sql("part")}) x""",
    "latest_capture": _sql("""
SELECT page_id, url, captured_at, capture_id, md5(html) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY captured_at DESC NULLS LAST, capture_id DESC) AS n FROM again) x WHERE n = 1"""),
    "latest_of_pages": _sql("""
SELECT page_id, url, capture_id, md5(html) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY captured_at DESC NULLS LAST, capture_id DESC) AS n FROM again) x WHERE n = 1 AND page_id % 10 <> 0"""),
    "extract_page": _sql(f"SELECT page_id, {_joined('objs')} AS objects, {_hash_of('objs')} AS checksum, CAST(strlen(html) AS BIGINT) AS bytes_downloaded, 'Loaded from capture.' AS details FROM page"),
    "canonical_json": None,
    "module_checksum": _sql("SELECT site, pos, data_hash AS checksum FROM m"),
    "split_checksum_audit": _sql("SELECT site, pos, declared AS declared_checksum, CASE WHEN kind = 'missing' THEN 0 ELSE len(data) END AS n_data FROM f"),
    "split_checksum_trust": None,
    "verify_checksum": _sql(f"SELECT site, pos, audit_declared = calculated AS audit_valid, CASE WHEN {HAS_TAIL} THEN NOT bad END AS trust_valid FROM a"),
    "merkle_root": None,
    "merkle_root_brands": None,
    "merkle_index": None,
    "merkle_over_recomputed": _sql("SELECT site, merkle_root_declared, merkle_root_extracted FROM sm"),
    "merkle_over_declared": _sql("SELECT site, root AS calculated_root FROM trust_root"),
    "merkle_validity": _sql("SELECT site, declared_root_valid, extracted_root_valid, roots_match FROM sm"),
    "site_readiness": _sql(f"""
SELECT site, NULL AS error FROM ix UNION ALL SELECT site, CASE r WHEN 0 THEN '{MOD.EMPTY_MODULES}' WHEN 2 THEN '{MOD.INDEX_MISSING}' ELSE '{MOD.NO_MODULES}' END FROM ux"""),
    "explode_modules": _sql("SELECT site, pos, path, module_url FROM m"),
    "classify_module": _sql(f"SELECT site, pos, CASE WHEN {HAS_TAIL} THEN 'tailed' WHEN kind = 'notail' THEN 'array' WHEN kind = 'single' THEN 'object' WHEN kind = 'text' THEN 'malformed' ELSE 'missing' END AS shape FROM m"),
    "objects_with_url": _sql(f"SELECT site, pos, {_joined('kept')} AS objects FROM f"),
    "canonical_url": _sql("SELECT site, pos, page_url AS canonical_url FROM f WHERE status = 'success'"),
    "single_url_rule": _sql("SELECT site, pos, kind <> 'differ' AS single_url FROM m"),
    "module_status": _sql("SELECT site, pos, status, page_url, error, calculated AS checksum, audit_declared = calculated AS checksum_valid FROM a"),
    "pair_pages_of_one_url": _sql(f"""
SELECT m.site, m.pos, CASE WHEN m.pos % 2 = 0 THEN one.u ELSE m.page_url END AS page_url,
  CASE WHEN m.pos % 2 = 0 THEN {_joined('one.ext')} ELSE {_joined('m.ext')} END AS extracted,
  CASE WHEN m.pos % 2 = 0 THEN one.variant <> 4 ELSE coalesce(m.extracted_ok, FALSE) END AS extracted_ok
FROM pg m CROSS JOIN (SELECT * FROM pg WHERE u = 'https://hot.example.com/p/2') one"""),
    "pair_pages": _sql(f"SELECT site, pos, page_url, {_joined('kept')} AS declared, {_joined('ext')} AS extracted, status = 'success' AS declared_ok, coalesce(extracted_ok, FALSE) AS extracted_ok FROM pg"),
    "objects_equal": _sql("SELECT site, pos, schemas_match FROM cmp"),
    "checksum_compare": _sql("""
SELECT site, pos, calculated AS declared_calculated, audit_declared AS declared_checksum, audit_declared = calculated AS checksum_valid, ext_hash AS extracted_checksum, ext_hash = calculated AS extracted_matches_declared FROM cmp"""),
    "shallow_key_diff": None,
    "site_summary": _sql("SELECT * FROM sm"),
    "strip_result_tail": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN '[{"name":"' || p_name || '"},{"checksum":""}]' ELSE '[{"name":"' || p_name || '"}]' END AS items FROM part""",
    "method_compare": _sql(" ".join(["SELECT url,"] + [
        ", ".join(
            f"arg_max({value}, ROW(start_ms, e, h, current > 2, event_type)) FILTER (WHERE side = '{side}') AS {side}_{name}"
            for name, value in (("ms", "e - start_ms"), ("objects", "h"), ("trust", "current > 2"), ("details", "event_type"))
        ) + ("," if side == "declared" else "") for side in ("declared", "extracted")
    ]) + """, arg_max(h, ROW(start_ms, e, h)) FILTER (WHERE side = 'declared') = arg_max(h, ROW(start_ms, e, h)) FILTER (WHERE side = 'extracted') AS schema_match
FROM (SELECT *, coalesce(end_ms, start_ms) AS e, 'h' || (user_id % CASE WHEN side = 'declared' THEN 3 ELSE 2 END) AS h FROM lg) x GROUP BY url"""),
    "run_audit": _sql("""
SELECT sm.*, side, dur AS duration_ms, n AS requests, errs AS errors, coalesce(mc, CASE WHEN side IS NOT NULL THEN 0 END) AS max_concurrency FROM sm LEFT JOIN ms ON ms.site = sm.site"""),
    "request_totals": _sql("SELECT site, side, n AS requests, down AS bytes_downloaded, up AS bytes_uploaded FROM tot"),
    "status_histogram": _sql("SELECT site, side, codes AS status_codes FROM st"),
    "avg_request_time": _sql("SELECT site, side, round(avg_ms, 4) AS avg_request_ms FROM tot"),
    "duration_ms": _sql("SELECT seq, CASE WHEN seq % 7 <> 0 AND end_ms <> 0 THEN end_ms - start_ms END AS duration_ms FROM lg"),
    "rps": _sql("SELECT site, side, round(n / ((b - a) / 1000.0), 6) AS rps FROM tot"),
    "errors_found": _sql("SELECT site, side, url, error, CAST(NULL AS BIGINT) AS time_ms, CAST(seq AS BIGINT) AS seq FROM trouble"),
    "error_summary": _sql("SELECT site, side, count(*) AS errors FROM er GROUP BY site, side"),
    "error_details": _sql("SELECT site, side, url, coalesce(error, '') AS error, time_ms, seq FROM er"),
    "max_concurrency": _sql("SELECT site, side, mc AS max_concurrency FROM cc"),
    "max_concurrency_of_samples": _sql("SELECT site, side, cur AS max_concurrency FROM tot"),
    "disk_total": _sql("SELECT site, side, disk AS disk_bytes FROM tot"),
    "cpu_delta": _sql("SELECT site, side, cu AS cpu_user_micros, cs AS cpu_system_micros FROM tot"),
    "peak_memory": _sql("SELECT site, side, start_rss, end_rss, peak_rss FROM tot"),
    "metrics_summary": _sql("""
SELECT site, side, dur AS duration_ms, cu AS cpu_user_micros, cs AS cpu_system_micros, peak_rss, n AS requests, codes AS status_codes, round(avg_ms, 4) AS avg_request_ms,
  round(rps, 6) AS rps, down AS bytes_downloaded, up AS bytes_uploaded, errs AS errors, disk AS disk_bytes, coalesce(mc, 0) AS max_concurrency FROM ms"""),
    "percent_diff": f"SELECT event_id, CASE WHEN b = 0 THEN 'N/A' ELSE {four('(b - x) / b * 100.0')} END AS percent FROM {AMOUNTS}",
    "ratio": f"SELECT event_id, CASE WHEN b = 0 THEN 'N/A' ELSE {four('x / b')} END AS ratio FROM {AMOUNTS}",
    "fmt_comparisons": f"SELECT event_id, {less('(x - 50)', ' data')} AS percent, {faster('(x - 50)', '')} AS faster, {times('x', ' per request')} AS times FROM {AMOUNTS}",
    "fmt_number": f"SELECT event_id, {grouped('amount', 0)} AS whole, CASE WHEN b = 0 THEN 'N/A' ELSE {grouped('x', 1)} END AS one FROM {AMOUNTS}",
    "fmt_rps": f"SELECT event_id, CASE WHEN b = 0 THEN 'N/A' ELSE {grouped('x * 100', 2)} END AS rps FROM {AMOUNTS}",
    "fmt_bytes": f"SELECT event_id, {binary_size('amount')} AS size FROM {AMOUNTS}",
    "fmt_filesize": f"SELECT event_id, {decimal_size('amount')} AS size FROM {AMOUNTS}",
    "fmt_cpu_time": f"SELECT event_id, {cpu_time('amount')} AS cpu FROM {AMOUNTS}",
    "fmt_duration": f"SELECT event_id, CASE WHEN b = 0 THEN 'N/A' ELSE {duration('amount')} END AS duration FROM {AMOUNTS}",
    "fmt_status_codes": _sql("""
SELECT user_id, string_agg(code || ': ' || c, ', ' ORDER BY coalesce(TRY_CAST(code AS BIGINT), 1099511627776)) AS status_codes
FROM (SELECT user_id, coalesce(CAST(status AS VARCHAR), 'undefined') AS code, count(*) AS c FROM lg GROUP BY ALL) x GROUP BY user_id"""),
    "metrics_diff": _sql("SELECT * FROM diff"),
    "metrics_formatted": _sql("SELECT * EXCLUDE (d_errs, e_errs) FROM fmt"),
    "summary_table": _sql("SELECT site, CAST(line AS BIGINT) AS line, metric, declared, extracted, diff FROM tab"),
    "page_checksum_table": _sql("SELECT * FROM pct"),
    "merkle_block": _sql("""
SELECT site, '{"Declared":"' || merkle_root_declared || '","Extracted":"' || merkle_root_extracted || '","Index":"' || merkle_root_index || '"}' AS roots FROM sm"""),
}

CANON_DOC = f"""CASE kind WHEN 'text' THEN '"just text"' WHEN 'single' THEN single WHEN 'notail' THEN {_joined('data')}
  ELSE '[' || array_to_string(data, ',') || ',' || {TAIL_CANON} || ']' END"""
ORACLES["canonical_json"] = _sql(f"SELECT site, pos, {CANON_DOC} AS canon FROM f WHERE kind <> 'missing'")
ORACLES["json_bytes"] = _sql(f"SELECT site, pos, CAST(strlen({CANON_DOC}) AS BIGINT) AS bytes FROM f WHERE kind <> 'missing'")
TRUST_DETAIL = f"""CASE WHEN kind = 'missing' THEN {_text(MOD.TRUST_UNREADABLE, path='path')}
  WHEN kind IN ('text', 'single', 'notail') THEN {_text(MOD.TRUST_NOT_A_LIST, path='path')} WHEN bad THEN {_text(MOD.TRUST_MISMATCH, path='path')} END"""
ORACLES["split_checksum_trust"] = _sql(f"SELECT site, pos, {HAS_TAIL} AS fetched, CASE WHEN {HAS_TAIL} THEN declared END AS checksum, {TRUST_DETAIL} AS detail FROM f")


def _merkle(name: str, relation: str, by: str, pos: str, leaf: str, extra: str = "") -> str:
    CTES[f"{name}"] = f"SELECT {by} AS site, {pos} AS pos, {leaf} AS leaf FROM {relation}"
    CTES[f"{name}_lv"] = _root(name)
    CTES[f"{name}_root"] = f"SELECT site, l[1] AS root FROM {name}_lv WHERE len(l) = 1"
    return _sql(extra or f"SELECT site, root FROM {name}_root")


ORACLES["merkle_root"] = _merkle("every_leaf", "m", "site", "pos", "data_hash")
ORACLES["merkle_root_brands"] = _merkle(
    "brand_leaf", "part", "p_brand", "p_partkey", "sha256(p_name)", "SELECT site AS p_brand, root FROM brand_leaf_root"
)
ORACLES["merkle_index"] = _merkle(
    "path_leaf", "m", "site", "path", "data_hash",
    "SELECT r.site, first_path, last_path, n, root FROM path_leaf_root r JOIN (SELECT site, min(path) AS first_path, max(path) AS last_path, count(*) AS n FROM m GROUP BY site) x ON x.site = r.site",
)
ORACLES["merkle_index_rows"] = _sql("SELECT site, row_number() OVER (PARTITION BY site ORDER BY path, data_hash) - 1 AS ord, path, data_hash FROM m")
CTES["cap_leaf_src"] = f"SELECT page.page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, {_hash_of('objs')} AS h FROM page JOIN pages ON pages.page_id = page.page_id"
ORACLES["crawl_merkle"] = _merkle(
    "cap_leaf", "cap_leaf_src", "host", "page_id", "h", "SELECT site, root AS merkle_root FROM cap_leaf_root"
)
CTES["found"] = """
  SELECT site, ord, url FROM smf UNION ALL SELECT site, CAST(ord AS BIGINT), url FROM walk WHERE (site_no < 0 OR site_no % 2 <> 0)"""
ORACLES["run_crawl"] = _sql(f"""
SELECT found.site, ord, found.url, {EMPTY} AS checksum, CASE WHEN cr.url IS NULL THEN 'Failed to fetch page.' ELSE 'Loaded from capture.' END AS details
FROM found LEFT JOIN cr ON cr.url = found.url""")
CTES["tsum"] = f"""
  SELECT ix.site, CAST(fetched AS BIGINT) AS fetched, CAST(failures + shift AS BIGINT) AS failures, fetched = 1 AS single_module, stated AS merkle_root,
    coalesce(tr.root, '') AS calculated_root, coalesce(tr.root, '') = stated AS merkle_root_valid,
    CASE WHEN coalesce(tr.root, '') = stated THEN ' Merkle root valid.' ELSE ' Merkle root mismatch or invalid.' END || ' Fetched ' || fetched || ' modules.' AS closing_detail
  FROM ix JOIN (SELECT site, count(*) FILTER (WHERE {HAS_TAIL}) AS fetched, count({TRUST_DETAIL}) AS failures FROM f GROUP BY site) c ON c.site = ix.site
  LEFT JOIN trust_root tr ON tr.site = ix.site
  UNION ALL SELECT site, 0, 0, FALSE, CASE WHEN r = 0 THEN 'abc' END, NULL, FALSE, CASE WHEN r = 2 THEN '{MOD.TRUST_NO_INDEX}' ELSE '{MOD.TRUST_NO_MODULES}' END FROM ux"""
ORACLES["site_trust_summary"] = _sql("SELECT * FROM tsum")
ORACLES["site_trust_report"] = _sql(f"""
SELECT f.site, CAST(pos + shift AS BIGINT) AS pos, path, CASE WHEN {HAS_TAIL} THEN declared END AS checksum, CASE WHEN {HAS_TAIL} THEN data_hash END AS calculated_checksum,
  CASE WHEN {HAS_TAIL} THEN NOT bad END AS checksum_valid, {TRUST_DETAIL} AS detail FROM f JOIN ix ON ix.site = f.site
UNION ALL SELECT site, 0, 'http://', NULL, NULL, NULL, 'Error fetching module http://: {MOD.MODULE_UNREADABLE} ' FROM ix WHERE shift = 1
UNION ALL SELECT site, NULL, NULL, merkle_root, calculated_root, merkle_root_valid, closing_detail FROM tsum""")
# Names of the first object on each side, in source order.
KEYS = {
    "declared": """CASE WHEN len(kept) = 0 THEN [] WHEN kind = 'many' THEN ['url','n','@type','@context'] WHEN kind = 'og' THEN ['@context','og:title','og:url']
      WHEN kind = 'single' THEN ['@context','@type','checksum','url'] ELSE ['url','name','@type','@context','offers','brand'] END""",
    "extracted": """CASE WHEN len(ext) = 0 THEN [] WHEN variant = 3 THEN ['@context','@type','name','url'] WHEN kind = 'many' THEN ['url','n','@type','@context']
      WHEN kind = 'og' THEN ['@context','og:title','og:url'] WHEN kind = 'single' THEN ['@context','@type','url'] WHEN kind = 'nourl' THEN ['@context','@type','name']
      ELSE ['url','name','@type','@context','offers','brand'] END""",
}
ORACLES["shallow_key_diff"] = _sql(f"""
SELECT site, pos, array_to_string(list_filter(d, lambda x: NOT list_contains(e, x)), ',') AS missing_in_extracted, array_to_string(list_filter(e, lambda x: NOT list_contains(d, x)), ',') AS missing_in_declared,
  'This is a shallow diff. For deep diffs, use a JSON diff tool.' AS note
FROM (SELECT site, pos, {KEYS['declared']} AS d, {KEYS['extracted']} AS e FROM cmp WHERE NOT schemas_match) x""")
