"""The rows that the stages of the pipeline keep: without doc_id, and with a repeated one."""

from collections import Counter

import corpus_pipeline as pipeline

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
BODY = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abcdefg"}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SHAPE)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_jaccard_stage_keeps_a_row_of_each_group(spark):
    near = lambda name: BODY[name] + " end"
    rows = [(1, BODY["a"], "s"), (2, near("a"), "s"), (None, BODY["a"], "s")]
    # Only rows without doc_id, as near and as exact copies.
    rows += [(None, BODY["b"], "s"), (None, near("b"), "s"), (None, BODY["c"], "s"), (None, BODY["c"], "t")]
    # A doc_id with unlike texts, one of them a copy of a text with a smaller doc_id.
    rows += [(5, BODY["d"], "s"), (5, BODY["e"], "s"), (5, BODY["a"], "s"), (5, BODY["d"], "s")]
    rows += [(None, "", "s"), (None, "", "s"), (None, None, "s"), (8, "", "s"), (8, "", "s"), (9, "", "s")]
    found = pairs(pipeline.ngram_jaccard_join(spark, frame(spark, rows), ""))
    b = {(None, BODY["b"]), (None, near("b"))}
    assert sum(found.pop(k, 0) for k in b) == 1
    want = [(1, BODY["a"]), (None, BODY["c"]), (5, BODY["d"]), (5, BODY["e"])]
    want += [(None, ""), (None, ""), (None, None), (8, ""), (9, "")]
    assert found == Counter(want)


def test_dedup_stage_tells_rows_without_doc_id_apart(spark):
    head = " ".join(f"head{i}" for i in range(30))
    rows = [(None, head + " " + BODY["a"], "s"), (None, head + " " + BODY["b"], "s"), (None, "short", "s")]
    rows += [(3, BODY["c"] + " " + BODY["d"], "s"), (3, BODY["c"] + " " + BODY["e"], "s"), (3, "brief", "s")]
    found = [r.text for r in pipeline.substring_dedup(spark, frame(spark, rows), "").collect()]
    assert len(found) == len(rows)
    words = Counter(w for t in found for w in t.split())
    assert set(words.values()) == {1}
    assert set(words) == {w for _, t, _ in rows for w in t.split()}


def test_mix_stage_takes_rows_as_the_mix_says(spark):
    # One source and size: of 8 rows, 1.5 times as many are taken.
    rows = [(None, BODY[n], "s") for n in "abcg"] + [(7, BODY["d"], "s"), (7, BODY["e"], "s"), (None, BODY["f"], "s"), (None, BODY["f"], "s")]
    found = pairs(pipeline.mixing_to_weights(spark, frame(spark, rows), ""))
    assert set(found) == {(i, t) for i, t, _ in rows}
    assert sum(found.values()) == 12
    assert all(n <= (4 if t == BODY["f"] else 2) for (_, t), n in found.items())
