"""What of a row the quality classifier hands to Python."""

import numpy as np
import pyarrow as pa

from siteledger.llm import mil


def test_only_texts_go_to_python_and_scores_come_back(spark):
    texts = ["some words here", None, "", "12 34 ## !!", "x " * 500]
    rows = [(i, t, "en", "b" * 100) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, other string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for keep, names in ((True, docs.columns), (False, ["doc_id"])):
        scored = mil.classify_quality(docs, labels, keep=keep)
        assert scored.columns == [*names, "held_out", "score", "predicted"]
        plan = scored.filter("predicted = 1")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
        found = {r.doc_id: r for r in scored.collect()}
        want = mil.AttentionBag().score(pa.array([t for _, t, *_ in rows]))
        assert np.allclose([found[i].score for i, *_ in rows], want)
        assert all(found[i].predicted == (w >= mil.THRESHOLD) for (i, *_), w in zip(rows, want))
        assert not keep or [tuple(found[i][:4]) for i, *_ in rows] == rows
