"""How often documents are taken apart, and by how many Python workers of a task."""

import pytest
from pyspark.sql import functions as F

from siteledger.functions import urls as U
from siteledger.operators import modules as MOD
from siteledger.operators.merkle import merkle_roots
from siteledger.plans import audit
from siteledger.plans import bridges as B

MODULES = "site string, pos int, path string, module_url string, raw string"
SITE = "https://a.example"
RAWS = [
    '[{"url":"u","n":1},{"checksum":"c"}]', '{"og:url":"v","checksum":"d"}', "[null]", '"text"', None, "[]",
    '[{"url":"u"},{"checksum":""}]', '[{"url":"u","deep":' + "[" * 2000 + "]" * 2000 + '},{"checksum":"e"}]',
]


@pytest.fixture
def modules(spark):
    return spark.createDataFrame([(SITE, i, f"/{i}", f"{SITE}/{i}", raw) for i, raw in enumerate(RAWS)], MODULES)


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_reading_a_module_takes_two_python_workers(modules):
    read = MOD.read_modules(modules)
    assert python_steps(read) == 2
    found = [(r.status, r.page_url, r.declared_checksum, len(r.objects)) for r in read.orderBy("pos").collect()]
    failed = [("error", f"{SITE}/{i}", None, 0) for i in (2, 3, 4)]
    assert found == [("success", "u", "c", 1), ("success", "v", "d", 1), *failed, ("success", None, None, 0), ("success", "u", None, 1), ("success", "u", "e", 1)]
    shapes = MOD.classify_module(modules).orderBy("pos").collect()
    assert [r.declared_checksum for r in shapes] == ["c", "d", None, None, None, None, None, "e"]


def test_declared_checksums_are_read_once(modules):
    validated = MOD.validate_modules(modules)
    roots = MOD.merkle_over_declared(validated)
    assert python_steps(validated) > 0 and python_steps(roots) == 0
    want = merkle_roots(validated.filter("checksum IS NOT NULL"), ["site"], "pos", {"calculated_root": "checksum"}, dense=False)
    assert roots.collect() == want.collect()
    index = modules.sparkSession.createDataFrame([(SITE, '{"modules":["/0"]}')], "site string, raw string")
    summary = MOD.site_trust_summary(index, validated)
    assert python_steps(summary) == python_steps(MOD.parse_index(index))
    row = summary.first()
    assert (row.fetched, row.failures) == (2, 8) and row.calculated_root == roots.first().calculated_root


def test_an_audit_parses_the_indexes_once(spark, monkeypatch):
    seen = []
    parse = MOD.parse_index
    monkeypatch.setattr(MOD, "parse_index", lambda index: seen.append(1) or parse(index))
    index = spark.createDataFrame([(SITE, '{"modules":["/0"]}'), ("https://b.example", None)], "site string, raw string")
    modules = spark.createDataFrame([(SITE, f"{SITE}/0", "[]")], "site string, module_url string, raw string")
    pages = spark.createDataFrame([], "url string, html string")
    result = audit.run_audit(index, modules, pages)
    assert len(seen) == 1 and python_steps(result.summary) == python_steps(result.errors) == 0
    assert [r.site for r in result.errors.collect()] == ["https://b.example"] and result.summary.first().total_pages == 1


def test_plain_paths_resolve_as_all_others(spark):
    roots = ["https://a.example", "http://a-b.c1.example", "https://a.example:443", "HTTPS://A.example", "https://a.example/x", " https://a.example", "https://a..b", "ftp://a.example", "a.example", None]
    paths = ["/", "/m/1.json", "/a/", "/a/b~c_d-e", "/a//b", "//h/x", "/a/./b", "/a/../b", "/.", "/..a", "/a..b/c.", "/é", "/a b", "/%2e/x", "/a?b", "/a#b", "/a\n", "m", "", None]
    rows = spark.createDataFrame([(r, p) for r in roots for p in paths], "r string, p string").repartition(1)
    plain = (F.col("r").rlike(U.PLAIN_ROOT) & F.col("p").rlike(U.PLAIN_NAMES)).alias("plain")
    found = U.with_resolved_url(rows.select("r", "p", plain), "p", "r", "u").collect()
    assert {p for r, p, is_plain, _ in found if is_plain} == {"/", "/m/1.json", "/a/", "/a/b~c_d-e", "/a..b/c."}
    assert {r for r, _, is_plain, _ in found if is_plain} == {"https://a.example", "http://a-b.c1.example"}
    # A blank before a path is stripped, and keeps it from being plain.
    spaced = rows.filter("p NOT LIKE '%\\n'").withColumn("p", F.concat(F.lit(" "), "p"))
    general = {(r, p[1:]): u for r, p, u in U.with_resolved_url(spaced, "p", "r", "u").collect() if p is not None}
    assert len(general) > 150 and all(general[r, p] == u for r, p, _, u in found if (r, p) in general)


def test_indexes_state_the_roots_that_the_operators_find(spark, tmp_path):
    # Every kind of module, parts without a name, and one that stands twice.
    columns = ["id AS p_partkey", "IF(id % 11 <> 3, 'n ' || id, NULL) AS p_name", "'b' AS p_brand", "CAST(id % 9 AS INT) AS p_size"]
    rows = spark.range(1000).selectExpr("IF(id = 999, 5, id) AS id").selectExpr(*columns)
    rows.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 8, 1, 8).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(1).selectExpr("id AS r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    listed = B.all_modules(spark, str(tmp_path))
    assert listed.filter("raw IS NULL").count() > 50
    leaves = B.module_facts(spark, str(tmp_path)).select("site", "pos", F.expr(B.AUDIT_LEAF).alias("a"), F.expr(B.TRUST_LEAF).alias("t"))
    read = MOD.read_modules(listed).select("site", "pos", F.col("checksum").alias("a"))
    told = MOD.validate_modules(listed).select("site", "pos", F.col("checksum").alias("t"))
    key = lambda rows: sorted((r.site, r.pos, r[2] or "") for r in rows.collect())
    assert key(leaves.select("site", "pos", "a")) == key(read)
    assert key(leaves.select("site", "pos", "t")) == key(told)
