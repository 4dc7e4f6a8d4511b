"""The sample the learned operators are fitted on."""

from siteledger.llm import langid, sample


def test_texts_are_taken_whole(spark):
    # 6 is held out; 2 is longer than all that may be taken.
    texts = {1: "short text", 2: "long " * 3000, 3: "LONG " * 900, 4: None, 5: "x" * 5000, 6: "held out", 7: "", 8: "short text", 9: "é" * 2000}
    docs = spark.createDataFrame([*texts.items(), (5, "again"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in texts] + [(None, 1), (3, None)], "doc_id long, quality int")
    for per_class in (False, True):
        found = sample.labelled_sample(docs, labels, "quality", 10, 14_000, per_class).collect()
        assert {r.doc_id for r in found} <= {1, 3, 5, 7, 9} and len(found) == len({r.doc_id for r in found})
        assert all(r.label == r.doc_id % 3 and r.text in (texts[r.doc_id], "again") for r in found)
        assert sum(len(r.text.encode()) for r in found if r.label == 1 or not per_class) <= 14_000
        # Small ones fit behind a large one that did not.
        assert {1, 7} <= {r.doc_id for r in found}
    (only,) = sample.labelled_sample(docs.filter("doc_id = 2"), labels, "quality", 10, 14_000, False).collect()
    assert only.text == texts[2]
    assert sample.labelled_sample(docs.limit(0), labels, "quality", 10, 100, True).count() == 0


def test_fitting():
    assert sample.fitting([("a", 5), ("b", 9), ("c", 4), ("d", 1)], 10) == ["a", "c", "d"]
    assert sample.fitting([("a", 50), ("b", 20)], 10) == ["b"] and sample.fitting([], 10) == []


def test_language_samples_are_whole_rows(spark):
    rows = [(i, f"{lang} {i} " * (5 + i), lang) for lang in ("x", "y") for i in range(30)] + [(99, "z" * 9000, "z"), (98, "z" * 8000, "z"), (1, None, "x"), (2, "none", None)]
    found = langid.language_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 12, 1000)
    known = {t for _, t, _ in rows}
    assert set(found) == {"x", "y", "z"} and found["z"] == b"z" * 8000
    for lang in ("x", "y"):
        parts = found[lang].decode().split("\n")
        assert all(p in known for p in parts) and 2 < len(parts) <= 12 and sum(map(len, parts)) <= 1000
