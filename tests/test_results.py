"""What a run writes and reads again, the errors it counts, and modules and indexes from files."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from siteledger.operators import merkle, metrics
from siteledger.plans.audit import run_audit
from siteledger.sources import readers, writers

SITES = [f"https://{n}.example.com" for n in "ab"]


def thing(site, i, **more):
    return {"@context": "https://schema.org", "@type": "Thing", "name": f"n{i}", "url": f"{site}/{i}", **more}


def audit(spark, n=6):
    index = [(s, json.dumps({"modules": [f"/m/{i}" for i in range(n)]})) for s in SITES]
    modules = [(s, f"{s}/m/{i}", json.dumps([thing(s, i, rawJsonLd="x", inner={"rawJsonLd": 1, "k\"ey": [{"rawJsonLd": 2}]})])) for s in SITES for i in range(n - 2)]
    modules += [(s, f"{s}/m/{n - 2}", '"text"') for s in SITES]
    page = lambda o: f'<script type="application/ld+json">{json.dumps(o)}</script>'
    captures = [(f"{s}/{i}", page(thing(s, i)) if i else None) for s in SITES for i in range(n - 2)]
    log = [(SITES[0], side, 1000, 1000 + 500 * k, 10, 1, 200 + k % 2) for side in ("declared", "extracted") for k in range(4)]
    errors = [(SITES[0], "declared", "u", "timeout", 5, 1), (SITES[1], "extracted", "u", None, 5, 1)]
    return run_audit(
        spark.createDataFrame(index, "site string, raw string"), spark.createDataFrame(modules, "site string, module_url string, raw string"),
        spark.createDataFrame(captures, "url string, html string"),
        spark.createDataFrame(log, "site string, side string, start_ms long, end_ms long, bytes_down long, bytes_up long, status int"),
        spark.createDataFrame(errors, "site string, side string, url string, error string, time_ms long, seq long"),
    )


def test_a_run_is_one_document_per_site(spark, tmp_path):
    path = str(tmp_path / "run")
    result = audit(spark)
    writers.write_run(result.pages, result.summary, path, result.metrics)
    for site in SITES:
        folder = f"{path}/domain={site[8:]}"
        document = json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{folder}/*.txt"))))
        assert document["site"] == site and len(document["pages"]) == document["summary"]["total_pages"] == 6
        first, last = document["pages"][1], document["pages"][5]
        assert first["url"] == f"{site}/1" and first["declared"] == [thing(site, 1, inner={'k"ey': [{}]})]
        assert first["extracted"] == [thing(site, 1)] and first["comparison"]["schemas_match"] is False
        assert last["declared"] == [] and last["comparison"]["schemas_match"] is True
        # Errors: those of the log, and modules and pages that could not be used.
        errors = {side: m["errors"]["total"] for side, m in document["metrics"].items()}
        assert errors == ({"declared": 3, "extracted": 3} if site == SITES[0] else {"extracted": 4})
    pages = writers.read_run(spark, path)
    assert {(r.domain, r.section): r["count"] for r in pages.groupBy("domain", "section").count().collect()} == {(s[8:], k): n for s in SITES for k, n in ((1, 6), (2, 1))}
    assert all(json.loads(r.json) for r in pages.collect())
    writers.write_run(result.pages, result.summary, path)
    assert writers.read_run(spark, path).filter(F.get_json_object("json", "$.metrics.declared").isNotNull()).count() == 0


def test_a_run_that_is_not_whole_is_refused(spark, tmp_path):
    path = str(tmp_path / "run")
    result = audit(spark)
    writers.write_run(result.pages, result.summary, path, result.metrics)
    one = sorted(glob.glob(f"{path}/domain=a.example.com/*.txt"))[0]
    with open(one, "a") as f:
        f.write(",{}\n")
    crc = os.path.join(os.path.dirname(one), f".{os.path.basename(one)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(ValueError, match="a.example.com"):
        writers.read_run(spark, path)


def test_modules_from_files(spark, tmp_path):
    for name, text in (("a.example.com/m/1.json", "[1]"), ("a.example.com/m/deep/2.json", "[2]"), ("b.example.com/3.json", "{}"), ("loose.json", "0")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {(r.site, r.module_url.rsplit("/", 1)[1] if r.site is None else r.module_url, r.raw) for r in readers.load_modules(spark, str(tmp_path), "files").collect()}
    a, b = SITES
    assert found == {(a, f"{a}/m/1.json", "[1]"), (a, f"{a}/m/deep/2.json", "[2]"), (b, f"{b}/3.json", "{}"), (None, "loose.json", "0")}


def test_merkle_index(spark):
    rows = [("s", "/b", "h2"), ("s", "/a", "h1"), ("s", "/C", "h3"), ("t", "/x", "h9"), ("t", "/x", "h8")]
    ranked, roots = merkle.merkle_index(spark.createDataFrame(rows, "site string, path string, hash string"), ["site"], "path", "hash")
    assert [(r.site, r.ord, r.path, r.hash) for r in ranked.orderBy("site", "ord").collect()] == [
        ("s", 0, "/a", "h1"), ("s", 1, "/b", "h2"), ("s", 2, "/C", "h3"), ("t", 0, "/x", "h8"), ("t", 1, "/x", "h9"),
    ]
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.site: (r.n, r.merkle_root) for r in roots.collect()}
    assert got == {"s": (3, sha(sha("h1h2") + sha("h3h3"))), "t": (2, sha("h8h9"))}


def test_metrics_of_any_logs(spark):
    log = spark.createDataFrame([("s", "d", 0, 10, 5, None, 200), ("s", "d", 5, None, None, 2, None), ("s", "e", 1, 2, 1, 1, 404)], "site string, side string, start_ms long, end_ms long, bytes_down long, bytes_up long, status int")
    samples = spark.createDataFrame(
        [("s", "d", 100, 1, 7, 10, None, 3), ("s", "d", 200, 2, 5, 30, 4, None), ("s", "d", 100, 0, 9, None, 1, -1), ("t", "d", 50, 0, None, 1, 1, 0)],
        "site string, side string, ts_ms long, seq long, rss long, cpu_user long, cpu_system long, disk_bytes long",
    )
    errors = spark.createDataFrame([("u", "d", "x", "e", 1, 1), ("s", "d", "x", "e", 1, 1)], "site string, side string, url string, error string, time_ms long, seq long")
    rows = {(r.site, r.side): r for r in metrics.metrics_summary(log, errors, samples).collect()}
    assert set(rows) == {("s", "d"), ("s", "e"), ("t", "d"), ("u", "d")}
    r = rows["s", "d"]
    assert r.requests.total == 2 and r.requests.status_codes == {"200": 1, "undefined": 1} and r.requests.avg_request_ms == 10.0
    assert (r.requests.bytes_downloaded, r.requests.bytes_uploaded, r.errors.total, r.disk.disk_bytes, r.concurrency.max) == (5, 2, 1, 2, 1)
    assert (r.timing.start, r.timing.end, r.memory.start_rss, r.memory.end_rss, r.memory.peak_rss) == (100, 200, 9, 5, 9)
    assert (r.cpu.cpu_user_micros, r.cpu.cpu_system_micros) == (30, 3)
    assert rows["u", "d"].requests.status_codes == {} and rows["u", "d"].errors.total == 1 and rows["t", "d"].memory.peak_rss == 0
    plan = metrics.metrics_summary(log, errors, samples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") == 1
    assert metrics.metrics_summary(None, errors, None).count() == 2
