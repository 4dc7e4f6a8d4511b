import hashlib
import json

from siteledger.operators import modules as MOD
from siteledger.plans.audit import run_audit, run_crawl

SITE = "https://a.example.com"
OBJ = {"@context": "https://schema.org", "@type": "Article", "url": f"{SITE}/1", "offers": {"url": "nested"}}


def canon(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def checksum(objects):
    keyed = ",".join(f'"{i}":{canon(o)}' for i, o in enumerate(objects))
    return hashlib.sha256(("{" + keyed + "}").encode()).hexdigest()


def index(spark, paths, root="r", site=SITE):
    raw = json.dumps({"modules": paths, "verification": {"merkleRoot": root}})
    return spark.createDataFrame([(site, raw)], "site string, raw string")


def modules(spark, docs, site=SITE):
    rows = [(site, f"{site}/m/{name}", raw) for name, raw in docs.items()]
    return spark.createDataFrame(rows, "site string, module_url string, raw string")


def captures(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def page(*objects):
    return "<body>" + "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objects)


def test_happy_path(spark):
    want = checksum([OBJ])
    result = run_audit(
        index(spark, ["/m/1"], want), modules(spark, {"1": json.dumps([OBJ, {"checksum": want}])}),
        captures(spark, [(f"{SITE}/1", page(OBJ))]),
    )
    row, summary = result.pages.first(), result.summary.first()
    assert row.schemas_match and row.checksum_valid and row.extracted_matches_declared and row.note is None
    assert summary.merkle_root_declared == want and summary.roots_match and summary.all_match


def test_mismatch_and_errors(spark):
    other = {**OBJ, "url": f"{SITE}/2"}
    docs = {
        "1": json.dumps([OBJ, {"checksum": "bad"}]),
        "2": json.dumps([OBJ, other, {"checksum": "x"}]),
        "3": '"malformed string"',
        "4": "[null, {}]",
        "5": json.dumps({**OBJ, "checksum": "own"}),
        "6": json.dumps([{"@type": "NoUrl"}]),
    }
    result = run_audit(
        index(spark, ["/m/1", "http://", "/m/2", "/m/3", "/m/4", "/m/5", "/m/6", "/m/7"]), modules(spark, docs),
        captures(spark, [(f"{SITE}/1", page({**OBJ, "extra": 1}))]),
    )
    rows = {r.pos: r for r in result.pages.collect()}
    assert len(rows) == 7
    assert rows[0].checksum_valid is False and rows[0].missing_in_declared == ["extra"]
    assert [rows[i].declared_ok for i in range(7)] == [True, False, False, False, True, True, False]
    assert rows[1].page_url == f"{SITE}/m/2" and rows[1].schemas_match
    assert rows[4].declared_checksum == "own" and rows[4].checksum_valid is False
    assert rows[5].page_url is None and rows[5].declared == []
    assert result.summary.first().total_pages == 7 and not result.summary.first().all_match


def test_readiness(spark):
    rows = [("a", None), ("b", '{"version":1}'), ("c", '{"modules":[]}'), ("d", "<html>"), ("e", '{"modules":["/x"]}')]
    df = spark.createDataFrame(rows, "site string, raw string")
    got = {r.site: r.error for r in MOD.site_readiness(df).collect()}
    assert got == {"a": MOD.INDEX_MISSING, "b": MOD.NO_MODULES, "c": MOD.EMPTY_MODULES, "d": MOD.NO_MODULES, "e": None}


def test_trust_report(spark):
    good, bad = checksum([OBJ]), "0" * 64
    docs = {"1": json.dumps([OBJ, {"checksum": good}]), "2": json.dumps([OBJ, {"checksum": bad, "more": 1}]),
            "3": json.dumps([OBJ]), "4": json.dumps([OBJ, {"x": 1}])}
    root = hashlib.sha256((good + bad).encode()).hexdigest()
    report = MOD.site_trust_report(index(spark, [f"/m/{i}" for i in range(1, 6)], root), modules(spark, docs))
    rows = {r.pos: r for r in report.collect()}
    assert rows[0].checksum_valid and rows[0].detail is None
    assert rows[1].checksum_valid is False and rows[1].detail == "Checksum mismatch for /m/2. "
    assert "not a valid array" in rows[2].detail and "missing checksum" in rows[3].detail and "Error fetching" in rows[4].detail
    assert rows[None].checksum_valid and rows[None].detail == " Merkle root valid. Fetched 2 modules."


def test_run_crawl_keeps_unreadable_pages(spark):
    urls = spark.createDataFrame([("s", 0, "u0"), ("s", 1, "u1")], "site string, ord long, url string")
    rows = {r.ord: r for r in run_crawl(urls, captures(spark, [("u1", page(OBJ))])).collect()}
    assert rows[0].objects == [] and rows[0].details.startswith("Failed") and len(rows[1].objects) == 1
