"""JSON that no variant holds: the event reader, deep and large indexes and modules."""

import hashlib
import json
import random

import pytest

from siteledger.functions import events
from siteledger.functions.leaf import load
from siteledger.operators import modules as MOD
from siteledger.operators.extract import strip_result_tail

SITE = "https://a.example.com"
DEEP = "[" * 50_000 + "]" * 50_000


def value(r, level=0):
    x = r.random()
    if level > 4 or x < 0.3:
        return r.choice([None, True, False, 1, -2.5, 1e20, "", 'a"b\\', "é\n", 0])
    if x < 0.65:
        return [value(r, level + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b", "url", "modules"]): value(r, level + 1) for _ in range(r.randrange(4))}


def accepted(read):
    try:
        read()
    except ValueError:
        return False
    return True


def test_values_and_their_places():
    r = random.Random(2)
    for _ in range(500):
        whole = value(r)
        text = json.dumps(whole, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        found = list(events.values(text, 3))
        assert found[-1][0] == ()
        for path, start, end in found:
            part = whole
            for key in path:
                part = part[key]
            assert json.loads(text[start:end]) == part
        at = r.randrange(len(text))
        broken = text[:at] + r.choice(["", "}", "]", ",", '"', "x", "0", ":", "\\", "\t"]) + text[at + 1 :]
        assert accepted(lambda: load(broken)) == accepted(lambda: list(events.values(broken, 2)))


def test_depth_and_repeated_members():
    assert list(events.values(DEEP, 0)) == [((), 0, len(DEEP))]
    assert not accepted(lambda: list(events.values(DEEP[:-1], 0)))
    text = f'{{"x":{DEEP},"modules":["/1",2.0,null,{{"b":1,"a":2}},"\\ud800"],"modules":["/2"],"verification":{{"merkleRoot":0}},"modules":["/3",2.0,null,{{"b":1,"a":2}},"\\ud800"]}}'
    found = events.index_members(text)
    assert found["modules"] == ["/3", "2", "null", '{"a":2,"b":1}', "?"] and found["merkle_root"] is None
    assert events.index_members('["modules"]')["modules"] is None
    assert events.index_members('{"modules":{"0":"/a"}}')["modules"] is None
    assert events.index_members('{"modules":["/a"]') is None


@pytest.mark.parametrize("extra", [f'"unused":{DEEP},', '"unused":"' + "x" * 20_000_000 + '",'])
def test_index_with_an_unusual_member_is_ready(spark, extra):
    raw = f'{{{extra}"modules":["/m/1","http://","/m/2"],"verification":{{"merkleRoot":"r"}}}}'
    df = spark.createDataFrame([(SITE, raw), ("b", raw[:-1]), ("c", None)], "site string, raw string")
    found = {r.site: r for r in MOD.site_readiness(df).drop("raw").collect()}
    assert found[SITE].error is None and found[SITE].modules == ["/m/1", "http://", "/m/2"] and found[SITE].merkle_root == "r"
    assert found["b"].error == MOD.NO_MODULES and found["c"].error == MOD.INDEX_MISSING
    listed = MOD.explode_modules(MOD.parse_index(df)).orderBy("pos").collect()
    assert [(r.pos, r.module_url) for r in listed] == [(0, f"{SITE}/m/1"), (1, f"{SITE}/m/2")]


def test_index_of_a_million_modules(spark):
    raw = '{"modules":[' + ",".join(f'"/m/{i:020d}.json"' for i in range(1_000_000)) + "]}"
    df = spark.createDataFrame([(SITE, raw)], "site string, raw string")
    rows = MOD.explode_modules(MOD.parse_index(df))
    assert rows.count() == 1_000_000
    assert rows.filter("pos = 999999").first().module_url == f"{SITE}/m/{999999:020d}.json"


def checksum(*objects):
    return hashlib.sha256(("{" + ",".join(f'"{i}":{o}' for i, o in enumerate(objects)) + "}").encode()).hexdigest()


def test_modules_of_deep_objects(spark):
    one, og = f'{{"deep":{DEEP},"url":"u"}}', f'{{"deep":{DEEP},"og:url":"o","url":0}}'
    raws = {
        "single": f'{{"url":"u","checksum":"c","deep":{DEEP}}}', "tailed": f'[{one},{{"checksum":"c"}}]', "mixed": f'[{og}, {{"url":"o"}}, {{"deep":{DEEP}}}]',
        "differ": f'[{one},{og}]', "deep url": f'[{{"url":{DEEP}}}]', "long tail": f'[{one},{{"checksum":"c","deep":{DEEP}}}]',
    }
    rows = [(SITE, i, f"/{k}", f"{SITE}/{k}", raw) for i, (k, raw) in enumerate(raws.items())]
    df = spark.createDataFrame(rows, "site string, pos int, path string, module_url string, raw string")
    read = {r.path[1:]: r for r in MOD.read_modules(df).collect()}
    assert read["single"].declared_checksum == "c" and read["single"].page_url == "u"
    assert read["tailed"].checksum == checksum(one) and read["tailed"].declared_checksum == "c" and read["tailed"].page_url == "u"
    assert read["mixed"].page_url == "o" and read["mixed"].checksum == checksum(og, '{"url":"o"}')
    assert read["differ"].status == "error" and "differing" in read["differ"].error
    assert read["deep url"].page_url == DEEP and read["deep url"].status == "success"
    trust = {r.path[1:]: r for r in MOD.validate_modules(df).collect()}
    assert trust["long tail"].checksum == "c" and trust["long tail"].calculated_checksum == checksum(one)
    assert not trust["single"].fetched
    items = spark.createDataFrame([([one, f'{{"checksum":"c","deep":{DEEP}}}'],), ([one, one],)], "items array<string>")
    assert [len(r[0]) for r in items.select(strip_result_tail(items["items"])).collect()] == [1, 2]
