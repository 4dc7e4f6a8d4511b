import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from siteledger.functions import formats as M
from siteledger.functions.numbers import js_round, to_fixed
from siteledger.operators import metrics as H
from siteledger.operators import report as R
from siteledger.sources import readers, writers

LOG = "site string, side string, start_ms long, end_ms long, bytes_down long, bytes_up long, status int"


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def brute_peak(spans):
    moments = {t for s in spans for t in s}
    return max([sum(1 for a, b in spans if a <= t < b or a == b == t) for t in moments] or [0])


def test_concurrency_across_slices(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 1, 5, 40])) for a in (rng.randrange(200) for _ in range(300))]
    df = spark.createDataFrame([("s", "x", a, b, 0, 0, 200) for a, b in spans] + [("s", "x", 5, None, 0, 0, 1)], LOG)
    for slice_ms in (7, 600_000):
        assert H.max_concurrency(df, slice_ms=slice_ms).first().max_concurrency == brute_peak(spans)


def test_request_aggregates(spark):
    rows = [("s", "x", 10, 30, 5, None, 200), ("s", "x", None, 30, None, 7, None), ("s", "y", None, None, None, None, 404)]
    df = spark.createDataFrame(rows, LOG)
    totals = {r.side: r for r in H.request_totals(df).collect()}
    assert (totals["x"].requests, totals["x"].bytes_downloaded, totals["x"].bytes_uploaded) == (2, 5, 7)
    assert {r.side: r.avg_request_ms for r in H.avg_request_time(df).collect()} == {"x": 20.0, "y": None}
    codes = {r.side: r.status_codes for r in H.status_histogram(df).collect()}
    assert codes["x"] == {"200": 1, "undefined": 1}


def test_to_fixed_uses_the_exact_value(spark):
    rng = random.Random(1)
    xs = [1.005, 2.675, 0.125, 0.25, 9.995, -1.25, 999.95, 3e12 + 0.25, 0.005] + [rng.randrange(10**6) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", to_fixed(F.col("x"), 2).alias("t"))
    for row in df.collect():
        exact = abs(Decimal(row.x)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert row.t == ("-" if row.x < 0 else "") + str(exact)


def test_formats(spark):
    def check(fn, cases):
        for given, want in cases.items():
            assert value(spark, fn(F.lit(given))) == want, (fn.__name__, given)

    check(js_round, {-2.5: -2, 2.5: 3, 0.49999999999999994: 0})
    check(M.fmt_duration, {967: "967ms", 6521: "6.52s (6521ms)", 1000: "1.00s (1000ms)", 45000: "45.00s", 65000: "1m", 90000000: "1d"})
    check(M.fmt_cpu_time, {999: "999 μs", 45830: "45.83 ms", 1500000: "1.5 s", 120000000: "2m"})
    check(M.fmt_bytes, {0: "0 B", 1024: "1 KB", 1536: "1.5 KB", 2**50: "1 undefined"})
    check(M.fmt_filesize, {24600: "24.6 kB", 91200000: "91.2 MB", 999950: "1 MB", 0: "0 B"})
    check(M.fmt_number, {1234567: "1,234,567"})
    assert value(spark, M.fmt_rps(F.lit(1.005))) == "1.01"
    assert value(spark, M.fmt_x(F.lit(6521 / 967))) == "**~6.7x faster**"
    assert value(spark, M.fmt_percent(M.percent_diff(F.lit(24.6), F.lit(642.9)), "data")) == "**~96% less data**"
    assert value(spark, M.fmt_faster(M.percent_diff(F.lit(409), F.lit(2802)), "per request")) == "**~85% faster per request**"
    assert value(spark, M.percent_diff(F.lit(1), F.lit(0))) is None and value(spark, M.ratio(F.lit(0), F.lit(1))) is None
    assert value(spark, M.fmt_status_codes(F.expr("map('404', 1L, 'undefined', 2L, '200', 9L)"))) == "200: 9, 404: 1, undefined: 2"
    assert value(spark, M.fmt_duration(F.lit(None).cast("long"))) == "N/A"


def metrics(spark):
    log = [("s", "declared", 1000, 1400, 24600, 0, 200), ("s", "extracted", 1000, 3800, 642900, 0, 200)]
    samples = [("s", side, t, n, rss, cpu, 0, 0) for side, end, cpu in (("declared", 1967, 45830), ("extracted", 7521, 414470))
               for n, (t, rss, cpu) in enumerate([(1000, 50, 0), (end, 91, cpu)])]
    sample_frame = spark.createDataFrame(samples, "site string, side string, ts_ms long, seq long, rss long, cpu_user long, cpu_system long, disk_bytes long")
    errors = spark.createDataFrame([], "site string, side string, url string, error string, time_ms long, seq long")
    return H.metrics_summary(spark.createDataFrame(log, LOG), errors, sample_frame)


def test_report(spark, tmp_path):
    sides = R.sides_of(metrics(spark))
    diff = R.metrics_diff(sides).first()
    assert (diff.duration, diff.cpu, diff.bytes, diff.requests) == ("**~6.7x faster**", "**~89% less CPU used**", "**~96% less data**", "Similar")
    summary = spark.createDataFrame([("s", 1, True, "r", "r", None, False, False, False)],
        "site string, total_pages long, all_match boolean, merkle_root_declared string, merkle_root_extracted string, "
        "merkle_root_index string, declared_root_valid boolean, extracted_root_valid boolean, roots_match boolean")
    pages = spark.createDataFrame([("s", i, f"u{i}", True, "a", "b") for i in range(3)],
        "site string, pos int, page_url string, schemas_match boolean, declared_calculated string, extracted_checksum string")
    lines = R.report_lines(sides, summary, pages)
    text = [r.text for r in lines.orderBy("section", "line").collect()]
    assert "| ⏱️ Total Duration | 967ms | 6.52s (6521ms) | **~6.7x faster** |" in text
    assert [t for t in text if t.startswith("| [u")] == [f"| [u{i}](u{i}) | ✅ | `a` | `b` |" for i in range(3)]
    writers.write_report(lines, str(tmp_path / "report"))
    written = "\n".join(p.read_text() for p in sorted((tmp_path / "report" / "domain=output").glob("part-*")))
    assert written.rstrip("\n").split("\n") == "\n".join(text).split("\n")
    writers.write_result_json(pages.withColumn("rawJsonLd", F.lit("x")), str(tmp_path / "json"), ["pos"])
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == 3 and "rawJsonLd" not in back.columns


def test_readers(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é")
    page = readers.load_pages(spark, str(tmp_path), "files").first()
    assert page.html == "<p>é" and page.url.endswith("a.html")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text('{"site":"s","start_ms":5,"status":200}\n')
    assert readers.load_request_log(spark, str(tmp_path / "log")).first().start_ms == 5
