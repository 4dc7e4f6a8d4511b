import hashlib

from pyspark.sql import functions as F

from siteledger.functions import json as J
from siteledger.functions.leaf import number_text
from siteledger.operators.merkle import merkle_roots
from siteledger.operators.ranking import rank_in_group

EMPTY = "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(leaves):
    while len(leaves) > 1:
        pairs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        leaves = [sha(p[0] + p[-1]) for p in pairs]
    return leaves[0]


CASES = {
    '{"b":1,"a":[1.0,{"d":1,"c":2}]}': '{"a":[1,{"c":2,"d":1}],"b":1}',
    '{"b": 1e2, "a": 1.50}': '{"a":1.5,"b":100}',
    "[1e21, 1e-7, 0.000001, -0, 123456789012345678901]": "[1e+21,1e-7,0.000001,0,123456789012345680000]",
    '{"a":1,"a":2}': '{"a":2}',
    '{"é":"ü/","😀":"\\u001b"}': '{"é":"ü/","😀":"\\u001b"}',
    '"text"': '"text"',
    " null ": "null",
    '{"a":1} trailing': None,
    '{"a":1}{"b":2}': None,
    '{"a":1}]': None,
    '{"a":1},{"b":2}': None,
    "{'a':1}": None,
    "": None,
}


def test_canonical_json(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r.t: r.c for r in J.with_canonical_json(df, "t", "c").collect()}
    assert got == CASES


def test_member_names_keep_source_order(spark):
    df = spark.createDataFrame([('{"b":1,"10":2,"2":3,"a":4}',)], "t string")
    item = J.with_json_items(df, "t", "i").first().i["items"][0]
    assert item["keys"] == ["2", "10", "b", "a"]


def test_number_text():
    assert [number_text(x) for x in (0.1, 1e21, 123e18, 5e-324, -1.5e-7, 100.0)] == [
        "0.1", "1e+21", "123000000000000000000", "5e-324", "-1.5e-7", "100",
    ]


def test_checksum_orders_keys_as_text(spark):
    items = [f'{{"n":{i}}}' for i in range(12)]
    df = spark.createDataFrame([(items,), ([],)], "items array<string>")
    for expression in (J.checksum_of(F.col("items")), J.checksum_of("items")):
        many, none = [r.c for r in df.select(expression.alias("c")).collect()]
        order = sorted(range(12), key=str)
        assert many == sha("{" + ",".join(f'"{i}":{items[i]}' for i in order) + "}")
        assert none == EMPTY


def test_merkle_roots(spark):
    sites = {"one": 1, "two": 2, "three": 3, "five": 5, "many": 37}
    leaves = {s: [sha(f"{s}{i}") for i in range(n)] for s, n in sites.items()}
    rows = [(s, 3 * i, i, leaf) for s, ls in leaves.items() for i, leaf in enumerate(ls)]
    df = spark.createDataFrame(rows, "site string, gap long, pos long, leaf string")
    want = {s: root(ls) for s, ls in leaves.items()}
    for levels in (1, 2, 12):
        dense = merkle_roots(df, ["site"], "pos", {"root": "leaf"}, levels=levels)
        gaps = merkle_roots(df, ["site"], "gap", {"root": "leaf"}, dense=False, levels=levels)
        assert {r.site: r.root for r in dense.collect()} == want
        assert {r.site: r.root for r in gaps.collect()} == want


def test_merkle_skips_missing_leaves(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "y")], "site string, pos long, leaf string")
    assert merkle_roots(df, ["site"], "pos", {"root": "leaf"}, dense=False).first().root == sha("xy")


def test_rank_in_group(spark):
    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [("b", 5), ("b", 3)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.v): r.n for r in rank_in_group(df, ["g"], [F.col("v")], "n").collect()}
    assert got == {**{("hot", i): i for i in range(1000)}, ("b", 3): 0, ("b", 5): 1}


def test_context_is_at_any_depth(spark):
    cases = {
        '"HTTPS://Schema.org/"': True,
        '[[["https://schema.org"]]]': True,
        '[1,[{"a":"schema.org"},[["x\\"{",["schema.org"]]]]]': True,
        '[{"@vocab":["schema.org"]},"y}"]': False,
        '{"@vocab":"schema.org"}': False,
        "null": False,
        "[]": False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").selectExpr("c", "parse_json(c) AS v")
    got = {r.c: r.hit for r in df.select("c", J.context_text_is("v", "schema.org").alias("hit")).collect()}
    assert got == cases
