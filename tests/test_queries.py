"""Registered queries against their DuckDB oracles at sf0.001.

The quick ones by default; SITELEDGER_ALL=1 runs every query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from siteledger.plans.oracles import ORACLES
from siteledger.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation part pages events".split()
QUICK = [
    "load_pages", "strip_field", "validate_url", "resolve_url", "sitemap_locs", "first_n_urls", "limit_pages",
    "microdata_value", "rdfa_own_property", "extract_page", "canonical_json", "module_checksum", "merkle_root",
    "module_status", "request_totals", "max_concurrency", "fmt_duration", "fmt_bytes", "metrics_diff", "site_summary",
]
NAMES = list(QUERIES) if os.environ.get("SITELEDGER_ALL") else QUICK


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([row[names.index(c)] for c in columns]) for row in cursor.fetchall())
    got = sorted(repr([row[c] for c in columns]) for row in df.collect())
    assert got == want
