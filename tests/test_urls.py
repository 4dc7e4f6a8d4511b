from pyspark.sql import functions as F

from siteledger.functions import urls as U

LONG = "https://long.test/" + "z/" * 600
CHECKS = {
    "data:,x": (False, "data:"),
    "data:image/gif;base64," + "R" * 50_000: (False, "data:"),
    "https://shop.test/a?b=c": (True, "https:"),
    "HTTP://10.0.0.7:8080": (True, "http:"),
    "http:x.y": (True, "http:"),
    "file:///srv/pages/1.html": (True, "file:"),
    "ftp://mirror.test/x": (False, "ftp:"),
    "javascript:void 0": (False, "javascript:"),
    "mailto:desk@shop.test": (False, "mailto:"),
    "just words": (False, None),
    "http://": (False, None),
    "http://a b/": (False, None),
    "http://h:99999/": (False, None),
    "   ": (False, None),
    "": (False, None),
    LONG: (True, "https:"),
}


def test_validate_url(spark):
    df = spark.createDataFrame([(u,) for u in CHECKS], "u string")
    got = {r.u: (r.v.is_valid, r.v.protocol) for r in df.select("u", U.validate_url(F.col("u")).alias("v")).collect()}
    assert got == CHECKS
    assert spark.range(1).select(U.validate_url(F.lit(None).cast("string")).alias("v")).first().v.error == U.MUST_BE_TEXT


def test_validate_urls(spark):
    df = spark.createDataFrame([([],), (None,)], "u array<string>")
    empty, absent = [r.v for r in df.select(U.validate_urls(F.col("u")).alias("v")).collect()]
    assert empty == [] and absent[0].error == U.INPUT_MUST_BE_LIST


RESOLVED = {
    "/a b?x y#z w": "https://ex.com/a%20b?x%20y#z%20w",
    "//h.com/x": "https://h.com/x",
    "../d": "https://ex.com/d",
    "../../../d": "https://ex.com/d",
    "?q=1": "https://ex.com/dir/page?q=1",
    "#f": "https://ex.com/dir/page?b=1#f",
    "": "https://ex.com/dir/page?b=1",
    "./": "https://ex.com/dir/",
    "x/%2e%2e/y": "https://ex.com/dir/y",
    "/Ciónue,": "https://ex.com/Ci%C3%B3nue,",
    "/😀": "https://ex.com/%F0%9F%98%80",
    "\\x\\y": "https://ex.com/x/y",
    "https:rel": "https://ex.com/dir/rel",
    "http:x.y": "http://x.y/",
    "HTTP://EX.com:80": "http://ex.com/",
    "https://EX.com:8443/a/./b/../c": "https://ex.com:8443/a/c",
    "mailto:a@b": "mailto:a@b",
    "http://": None,
    "http://a b/": None,
}


def test_resolve_url(spark):
    df = spark.createDataFrame([(r, "https://ex.com/dir/page?b=1") for r in RESOLVED], "r string, b string")
    got = {r.r: r.out for r in U.with_resolved_url(df, "r", "b", "out").collect()}
    assert got == RESOLVED


def test_domain_of(spark):
    cases = {"https://www.Example.com/x": "example.com", "http://a.b:80": "a.b", "x": "output", None: "output"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.d for r in df.select("u", U.domain_of(F.col("u")).alias("d")).collect()} == cases


def test_resolvable_among_is_the_same_as_each(spark):
    paths = ["/m/1.json", "/", "//", "//a", "/\\a", "\\/a", "/ x", " /x", "/x\n", "/x y", "/é", "null", "", "http://", "http://[", "mailto:a", "a:b", "https:/x", "//b.example:x/", "/a:b?c#d", "\t//["]
    sites = ["https://a.example", "http://", "mailto:x", "none", "", None, "file:///x", "https://a.example:99999"]
    rows = spark.createDataFrame([(s, paths) for s in sites] + [("https://a.example", None), ("none", None)], "s string, p array<string>")
    each = F.filter("p", lambda m: U.is_resolvable(m, F.col("s")))
    found = rows.select(each.alias("each"), U.resolvable_among(F.col("p"), F.col("s")).alias("among")).collect()
    assert all(r.each == r.among for r in found) and any(r.among for r in found) and any(r.among == [] for r in found)
