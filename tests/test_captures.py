"""Several captures of one thing, captures that nobody asked for, and pages that many modules name."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from siteledger.operators import captures as C
from siteledger.operators import compare, extract, membership
from siteledger.operators import modules as MOD
from siteledger.plans.audit import run_audit, run_crawl

SITE = "https://a.example.com"
DAY = [datetime(2025, 1, d) for d in range(1, 6)]
CAPTURES = "url string, captured_at timestamp, capture_id string, html string"


def thing(name, url=f"{SITE}/1"):
    return {"@context": "https://schema.org", "@type": "Thing", "name": name, "url": url}


def page(*objects):
    micro = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">micro</b></div>'
    return "<body>" + micro + "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objects)


def names(row):
    return [json.loads(o)["name"] for o in row.objects]


def test_latest_capture_of_a_page(spark):
    rows = [
        ("a", DAY[1], "x", page(thing("old"))), ("a", DAY[2], "x", page(thing("new"))), ("a", None, "z", page(thing("no time"))),
        ("b", DAY[1], "x", page(thing("by id"))), ("b", DAY[1], "w", page(thing("smaller id"))),
        ("c", DAY[1], "x", page(thing("readable"))), ("c", DAY[2], "x", None),
        ("d", DAY[1], "x", None), ("d", DAY[1], "x", page(thing("same id"))),
        ("e", None, None, page(thing("alone"))), ("e", None, None, page(thing("alone"))),
        ("f", DAY[1], "x", ""), (None, DAY[1], "x", page(thing("nowhere"))),
    ]
    df = spark.createDataFrame(rows, CAPTURES)
    found = {r.url: r for r in extract.extract_page(df, key="url").collect()}
    got = {u: names(r) for u, r in found.items()}
    assert got == {"a": ["new", "micro"], "b": ["by id", "micro"], "c": [], "d": ["same id", "micro"], "e": ["alone", "micro"], "f": [], None: ["nowhere", "micro"]}
    assert [found[u].n_captures for u in "abcdef"] == [3, 2, 2, 2, 2, 1] and not found["c"].extracted_ok
    kept = {r.url: r.html for r in C.latest(df, ["url"], "html").collect()}
    assert len(kept) == 7 and kept["c"] is None and "new" in kept["a"] and "same id" in kept["d"]
    assert extract.extract_page(df.limit(0), key="url").count() == 0


def test_captures_without_times(spark):
    df = spark.createDataFrame([("a", page(thing("one"))), ("a", page(thing("two"), thing("three"))), ("b", None)], "url string, html string")
    found = {r.url: r for r in extract.extract_page(df, key="url").collect()}
    assert found["a"].n_captures == 2 and names(found["a"]) in (["one", "micro"], ["two", "three", "micro"])
    # Whichever it is, it follows from the captures alone.
    again = {r.url: r for r in extract.extract_page(df.orderBy(F.desc("html")).coalesce(1), key="url").collect()}
    assert again["a"].objects == found["a"].objects


def test_pages_are_exchanged_once(spark):
    df = spark.createDataFrame([("a", DAY[0], "x", page(thing("n")))], CAPTURES)
    plan = extract.extract_page(df, key="url")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def index(spark, paths):
    return spark.createDataFrame([(SITE, json.dumps({"modules": paths, "verification": {"merkleRoot": "r"}}))], "site string, raw string")


MODULES = "site string, module_url string, captured_at timestamp, capture_id string, raw string"


def test_audit_of_repeated_captures(spark):
    modules = spark.createDataFrame(
        [(SITE, f"{SITE}/m/1", DAY[0], "a", json.dumps([thing("old")])), (SITE, f"{SITE}/m/1", DAY[1], "a", json.dumps([thing("now")])),
         (SITE, f"{SITE}/m/2", DAY[1], "a", json.dumps([thing("two", f"{SITE}/2")])), (SITE, f"{SITE}/m/2", DAY[2], "a", None)],
        MODULES,
    )
    plain = lambda o: f'<script type="application/ld+json">{json.dumps(o)}</script>'
    pages = spark.createDataFrame([(f"{SITE}/1", DAY[0], "a", plain(thing("old"))), (f"{SITE}/1", DAY[1], "a", plain(thing("now"))), (f"{SITE}/9", DAY[3], "a", plain(thing("nobody's")))], CAPTURES)
    result = run_audit(index(spark, ["/m/1", "/m/2"]), modules, pages)
    rows = {r.pos: r for r in result.pages.collect()}
    assert result.summary.first().total_pages == len(rows) == 2
    assert rows[0].schemas_match and len(rows[0].extracted) == 1 and not rows[1].declared_ok
    first = run_audit(index(spark, ["/m/1", "/m/2"]), modules, pages, max_pages=1)
    assert [r.pos for r in first.pages.collect()] == [0] and first.summary.first().total_pages == 1


def exchanged(df, column):
    """Whether an exchange of the plan carries a column of this name."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = text.split("\n\n")
    return any(f"{column}#" in b for b in blocks if "Exchange" in b.split("\n")[0] and "Broadcast" not in b.split("\n")[0])


def test_only_wanted_captures_are_parsed_and_no_document_moves(spark, tmp_path):
    rows = [(f"u{i}", DAY[i % 3], "x", page(thing(f"{i}"))) for i in range(300)] + [(f"u{i}", DAY[4], "x", page(thing("last"))) for i in range(0, 300, 3)]
    spark.createDataFrame(rows, CAPTURES).repartition(4).write.parquet(str(tmp_path / "captures"))
    df = spark.read.parquet(str(tmp_path / "captures"))
    urls = spark.createDataFrame([("s", i, f"u{i * 3}") for i in range(10)] + [("s", 10, "not captured")], "site string, ord long, url string")
    passed = C.latest_of(df, urls).collect()
    wanted = [r for r in passed if r.url in {f"u{i * 3}" for i in range(10)}]
    assert len(wanted) == 10 and all(r.captured_at == DAY[4] for r in wanted) and len(passed) <= 12
    crawl = run_crawl(urls, df)
    assert not exchanged(C.latest_of(df, urls), "html") and not exchanged(crawl, "html")
    assert exchanged(df.repartition("url"), "html")
    found = crawl.orderBy("ord").collect()
    assert [names(r) for r in found] == [["last", "micro"]] * 10 + [[]]


def test_a_set_never_misses_a_member(spark):
    keys = spark.range(0, 60_000, 3).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    for most in (membership.MOST, 1):
        of = membership.members(keys, "k", most)
        rows = spark.range(60_000).select(F.col("id"), F.col("id").cast("string").alias("k"), F.lit(1).alias("_bits"))
        found = membership.marked(rows, F.col("k"), of, "held")
        assert found.columns == ["id", "k", "_bits", "held"]
        counts = found.groupBy(F.col("id") % 3 == 0, "held").count().collect()
        held = {(r[0], r[1]): r[2] for r in counts}
        assert held[True, True] == 20_000 and (True, False) not in held
        if most > 1:
            assert held.get((False, True), 0) < 400
    assert membership.marked(spark.createDataFrame([(None,)], "k string"), F.col("k"), membership.members(keys, "k"), "held").first().held is False


def test_a_page_that_many_modules_name_is_split(spark):
    declared = spark.range(42_000).select(
        F.lit("s").alias("site"), F.col("id").cast("int").alias("pos"),
        F.when(F.col("id") < 40_000, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("u"), "id")).alias("page_url"),
        F.array(F.lit("{}")).alias("objects"), F.array(F.lit("k")).alias("first_keys"), F.lit("c").alias("checksum"), F.lit("c").alias("declared_checksum"),
        F.lit(True).alias("checksum_valid"), F.lit("success").alias("status"),
    )
    extracted = spark.createDataFrame([("hot", ["{}"], ["k"], "c", True), ("u41000", ["1"], ["k"], "d", True)], "url string, objects array<string>, first_keys array<string>, checksum string, extracted_ok boolean")
    left, right = declared.withColumn("_url", F.coalesce("page_url", F.lit("none"))), extracted.withColumnRenamed("url", "_url")
    left, right, on = compare._split_pages(left, right, 1000)
    sizes = [r["count"] for r in left.filter("page_url = 'hot'").groupBy(*on).count().collect()]
    assert on == ["_url", "_part"] and len(sizes) == 40 and max(sizes) < 1500
    assert right.filter("_url = 'hot'").count() == 40 and right.filter("_url <> 'hot'").count() in (1, 40)
    for heavy in (1000, 10**9):
        rows = compare.pair_pages(declared, extracted, heavy).groupBy("extracted_ok", "extracted_checksum").count().collect()
        assert {(r[0], r[1][0]): r[2] for r in rows} == {(True, "c"): 40_000, (True, "d"): 1, (False, "4"): 1_999}


def test_modules_of_a_site_without_captures(spark):
    found = MOD.locate_modules(index(spark, ["/m/1"]), spark.createDataFrame([], MODULES)).collect()
    assert [(r.pos, r.raw) for r in found] == [(0, None)]
