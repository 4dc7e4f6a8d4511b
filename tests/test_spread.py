import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions import json as J
from siteledger.functions.events import members_named
from siteledger.functions.leaf import value_text
from siteledger.functions.plan import of_some
from siteledger.operators import modules as MOD
from siteledger.plans import bridges as B
from siteledger.session import tasks


def test_documents_derived_from_one_file_are_made_by_many_tasks(spark, tmp_path):
    part = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, CAST(1 AS INT) AS p_size"
    spark.range(0, 400, 1, 1).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 8, 1, 8).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    for table in (B.deep_modules, B.all_modules):
        files = table(spark, str(tmp_path)).select(F.input_file_name()).distinct().count()
        assert files > 1


def test_members_of_a_deep_object(spark):
    deep = "[" * 3000 + "]" * 3000
    text = '{"deep":' + deep + ',"og:url":5,"url":"\\ud800é"}'
    assert members_named(text, ["url", "og:url", "none"]) == [{"json": '"\\ud800é"', "text": "?é"}, {"json": "5", "text": "5"}, None]
    value = {"b": [], "a": {}}
    for _ in range(3000):
        value = [value]
    assert value_text(value) == "[" * 3000 + '{"a":{},"b":[]}' + "]" * 3000


def test_listed_modules_are_read_by_many_tasks(spark):
    index = spark.createDataFrame([("https://a.example", '{"modules":["/1","/2"]}')], "site string, raw string")
    modules = spark.createDataFrame([("https://a.example", "https://a.example/1", "[]")], "site string, module_url string, raw string")
    parsed = MOD.parse_index(index)
    located = MOD.locate_modules(index, modules), MOD.locate_listed(parsed, modules), MOD.explode_modules(parsed)
    assert all(df.rdd.getNumPartitions() >= tasks(spark) for df in located)
    assert [(r.pos, r.raw) for r in located[0].orderBy("pos").collect()] == [(0, "[]"), (1, None)]


def test_rows_without_a_text_are_not_handed_on(spark):
    def one(text):
        return None if text == "none" else {"a": [text]}

    kind = T.StructType().add("a", T.ArrayType(T.StringType()))
    rows = spark.createDataFrame([(0, "x"), (1, None), (2, "none")], "id int, t string").repartition(1)
    some = rows.select("id", of_some(kind, one)(F.col("t")).alias("r")).orderBy("id").collect()
    assert [r.r and r.r.a for r in some] == [["x"], None, None]

    def never(text):
        raise ValueError(text)

    none = spark.range(3).select(of_some(kind, never)(F.lit(None).cast("string")).alias("r")).collect()
    assert [r.r for r in none] == [None] * 3


def test_members_of_elements_where_one_is_deep(spark):
    deep = '{"deep":' + "[" * 3000 + "]" * 3000 + ',"url":"u,\\"1"}'
    flat = '{"pad":"' + "x" * 2000 + '","url":"u2"}'
    rows = spark.createDataFrame([(0, ["null", deep, '{"url":"u0"}', flat]), (1, ["null", flat])], "id int, c array<string>")
    found = rows.select("id", J.beyond_members(F.col("c"), "url", "none").alias("m")).orderBy("id").collect()
    assert [e and [m and tuple(m) for m in e] for e in found[0].m] == [None, [('"u,\\"1"', 'u,"1'), None], None, None]
    assert found[1].m is None
    assert [r[0] for r in rows.filter("id = 0").select(F.explode("c").alias("c")).select(J.is_beyond(F.col("c"))).collect()] == [False, True, False, False]
    # Arrays are not handed to Python: that takes long even where they are NULL.
    plan = rows.select(J.beyond_members(F.col("c"), "url"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array('url'" not in plan and "[url]" not in plan


def test_numbers_that_need_exact_printing():
    needed = ["1e5", "[-2E3]", '{"a": 0.0000001}', "[12345678901234567]", '"\\u0001"', '"\\ud800"', "[1, 0.00000]", ":\n1.5e1"]
    plain = ["15", "[1.25]", '{"a":0.0001}', '"1e5 x"', "[1234567890]", '"\\u00e9"', '"a:b"']
    assert all(re.search(J.NEEDS_EXACT, t) for t in needed) and not any(re.search(J.NEEDS_EXACT, t) for t in plain)


def test_module_facts_hold_what_is_read_of_them(spark, tmp_path):
    part = "id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, CAST(1 AS INT) AS p_size"
    spark.range(40).selectExpr(*part.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 8, 1, 8).selectExpr("id AS page_id").write.parquet(f"{tmp_path}/pages.parquet")
    facts = B.module_facts(spark, str(tmp_path))
    assert not {"c0", "r0", "single", "data"} & set(facts.columns) and facts.count() == 40
