"""What a Python worker holds at once does not follow the rows of its task."""

import os

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest

from siteledger.llm import jaccard, pieces, words
from siteledger.llm.common import Workspace, giving_back
from siteledger.llm.queries import PIECE_MODEL


def test_shingle_sets_are_given_out_piece_by_piece():
    texts = [" ".join(f"w{i * j % 9973}" for j in range(1500)) for i in range(1, 401)] + ["", None, "Two words"]
    total = sum(len(t or "") for t in texts)
    assert total > 4 * words.PIECE_BYTES
    ids = pa.array(range(len(texts)))
    out = list(jaccard._sets(5, 80)(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "row", "text"])])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == ids.to_pylist()
    assert max(sum(len(texts[i] or "") for i in b.column("row").to_pylist()) for b in out) <= words.PIECE_BYTES
    full = list(jaccard._full_sets(5)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["cls", "text"])])))
    assert len(full) == len(out) > 4
    rows = [(r["n"], r["k1"], r["prefix"]) for b in out for r in b.to_pylist()]
    sets = [(r["k1"], r["tokens"]) for b in full for r in b.to_pylist()]
    for text, (n, k1, prefix), (key, tokens) in zip(texts, rows, sets):
        had = (text or "").lower().split()
        want = {tuple(had[i : i + 5]) for i in range(max(1, len(had) - 4))} if had else set()
        assert n == len(tokens) == len(want) and k1 == key and prefix == tokens[: len(prefix)]
        assert (np.diff(np.array(tokens, np.int64).view(np.uint64).astype(object)) > 0).all()


def test_workers_get_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 10000) AS text").mapInArrow(sizes, "bytes long")
    found = [r.bytes for r in Workspace(spark).keep("sizes", rows, 1 << 18).collect()]
    assert sum(found) >= 4_000_000 and max(found) < 1 << 19
    assert spark.conf.get(name) == before


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary")
def test_pieces_take_one_worker_of_a_task(spark):
    rows = [(i, f"Some text {i}, ÄÖ 日本 " * (i % 5), "s") for i in range(40)] + [(None, None, "t"), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = pieces.encode_and_decode(docs, PIECE_MODEL, ["doc_id", "text", "source"])
    apart = pieces.decode_pieces(pieces.encode_pieces(docs, PIECE_MODEL), PIECE_MODEL)
    key = lambda r: (str(r.doc_id), str(r.text))
    assert both.columns == apart.columns and sorted(both.collect(), key=key) == sorted(apart.collect(), key=key)
    assert pieces.encode_and_decode(docs, PIECE_MODEL, ["doc_id"]).columns == ["doc_id", "ids", "decoded"]
    for found in (pipeline.sentencepiece(spark, docs.selectExpr("*", "'en' AS lang", "1L AS n_chars"), ""), both):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_a_worker_gives_back_what_it_freed():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        for n in batches:
            kept = [b"x" * (50_000 + i % 2) for i in range(n)]  # small enough to stay on the heap when freed
            yield len(kept)

    before, pin = held(), []
    for n in giving_back(run)(iter([4000])):
        pin.append(b"x" * 50_000)
        assert n == 4000 and held() > before + 100_000_000
    assert held() < before + 50_000_000
