"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded, a gated
attention weighs the passages of a document, and the weighted sum of their codes is
scored. Only documents have labels; which passages matter is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.names import free
from siteledger.functions.plan import settled
from siteledger.llm.common import giving_back, held_out
from siteledger.llm.sample import labelled_sample
from siteledger.llm.words import grams, pieces

PASSAGE_WORDS = 64
#: Bytes of text encoded at once; several numbers are held for each of them.
AT_ONCE = 1 << 18
#: Bounds of the labelled sample the network is fitted on: rows, and bytes of all of them. Texts
#: are taken whole or not at all.
SAMPLE_ROWS = 5000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.3
HIDDEN, GATE, STEPS, RATE, DECAY = 24, 12, 250, 0.02, 1e-4

_CLASSES = ["0123456789", "#", "*", "$", "%", "&", "|", "<>", "!", ".", ",", "?;:", "-_/\\", "\"'()[]{}", "\n"]
_LOWER, _UPPER, _HIGH, _OTHER = (len(_CLASSES) + i for i in range(4))
_BUCKETS = 16
_N_CLASSES = len(_CLASSES) + 4
FEATURES = _N_CLASSES + 6 + _BUCKETS

_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[128:] = _HIGH
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
for _i, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _i


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """TRUE where a value stands for the first time."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def passages(texts: pa.Array, words_each: int = PASSAGE_WORDS):
    """(row of each passage, features of each passage) per piece. A text without words is
    one passage whose features are 0."""
    for piece in pieces(texts, limit=AT_ONCE):
        n_docs = piece.last - piece.first
        n_words = np.diff(piece.words)
        count = np.maximum(1, -(-n_words // words_each))
        first = np.cumsum(count) - count
        doc = np.repeat(np.arange(n_docs), count)
        out = np.zeros((len(doc), FEATURES), np.float32)
        if len(piece.start):
            inner = np.arange(len(piece.start)) - piece.words[piece.doc]
            owner = first[piece.doc] + inner // words_each
            size = np.bincount(owner, minlength=len(doc)).astype(np.float32)
            per = 1 / np.maximum(size, 1)
            # Bytes belong to the passage of the last word that starts at or before them.
            word_of = np.cumsum(np.bincount(piece.start, minlength=len(piece.data))[: len(piece.data)]) - 1
            inside = (word_of >= 0) & (piece.doc[word_of] == np.searchsorted(piece.bounds, np.arange(len(piece.data)), "right") - 1)
            cell = owner[word_of[inside]] * _N_CLASSES + _CLASS[piece.data[inside]]
            out[:, :_N_CLASSES] = np.bincount(cell, minlength=len(doc) * _N_CLASSES).reshape(-1, _N_CLASSES)
            out[:, :_N_CLASSES] *= per[:, None] / 4
            hashes = piece.word_hashes()
            length = (piece.end - piece.start).astype(np.float64)
            mean = np.bincount(owner, length, len(doc)) * per
            at = _N_CLASSES
            out[:, at] = mean / 8
            out[:, at + 1] = np.sqrt(np.maximum(0, np.bincount(owner, length**2, len(doc)) * per - mean**2)) / 8
            fresh = _first_seen(hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            out[:, at + 2] = np.bincount(owner, fresh, len(doc)) * per
            same = np.zeros(len(hashes))
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            out[:, at + 3] = np.bincount(owner, same, len(doc)) * per
            if len(hashes) >= 3:
                runs = grams(hashes, 3)
                seen = ~_first_seen(runs ^ (piece.doc[: len(runs)].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
                out[:, at + 4] = np.bincount(owner[: len(runs)], seen, len(doc)) * per
            out[:, at + 5] = np.log1p(size) / 4
            bucket = owner * _BUCKETS + (hashes >> np.uint64(60)).astype(np.int64)
            out[:, at + 6 :] = np.bincount(bucket, minlength=len(doc) * _BUCKETS).reshape(-1, _BUCKETS) * per[:, None]
        yield piece.first + doc, out


class AttentionBag:
    """The network: tanh encoder, gated attention over the passages of a bag, logistic score."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "w": near(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": near(HIDDEN, GATE), "u": near(HIDDEN, GATE),
            "a": near(GATE), "c": near(HIDDEN), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, start: np.ndarray, bag: np.ndarray) -> dict:
        """`start` is where each bag begins in `x`, `bag` the bag of each row."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        weight = np.exp(e - np.maximum.reduceat(e, start)[bag])
        weight /= np.add.reduceat(weight, start)[bag]
        pooled = np.add.reduceat(h * weight[:, None], start)
        y = 1 / (1 + np.exp(-(pooled @ p["c"] + p["d"])))
        return {"z": z, "h": h, "t": t, "g": g, "weight": weight, "pooled": pooled, "y": y}

    def fit(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> None:
        """Gradient descent (Adam) on the log loss of the bags."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        start = np.searchsorted(bag, np.arange(len(labels)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            f, p = self.forward(x, start, bag), self.p
            dy = (f["y"] - labels) / len(labels)
            dpool = dy[:, None] * p["c"]
            dh = dpool[bag] * f["weight"][:, None]
            dw = (dpool[bag] * f["h"]).sum(1)
            de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, start)[bag])
            dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
            grads = {
                "w": f["z"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
                "a": (f["t"] * f["g"]).T @ de, "c": f["pooled"].T @ dy, "d": dy.sum(keepdims=True),
            }
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for row, x in passages(texts):
            own = row - row[0]
            start = np.searchsorted(own, np.arange(own[-1] + 1))
            out[row[0] : row[-1] + 1] = self.forward(x.astype(np.float64), start, own)["y"]
        return out


def _features(batches):
    for batch in batches:
        for row, x in passages(batch.column("text")):
            ids, labels = batch.column("doc_id").take(pa.array(row)), batch.column("label").take(pa.array(row))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([ids, labels, lists], names=["doc_id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> AttentionBag:
    """The network fitted on at most `rows` whole documents of at most `size` bytes together, so at
    most rows + size / 2 / PASSAGE_WORDS passages reach the driver."""
    model = AttentionBag()
    sample = labelled_sample(docs, labels, "quality", rows, size, per_class=False)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(giving_back(_features), f"doc_id {kind}, label int, x array<float>").toArrow()
    if not found.num_rows:
        return model
    ids = np.array(found.column("doc_id").to_pylist())
    x = found.column("x").combine_chunks()
    x = x.values.to_numpy(zero_copy_only=False)[x.offset * FEATURES :].reshape(-1, FEATURES).astype(np.float64)
    marks = np.array(found.column("label").to_pylist(), float)
    # The order of a document's passages doesn't matter to the network, but sums should not
    # depend on the order in which tasks end.
    order = np.lexsort((*x.T, ids))
    _, bag = np.unique(ids[order], return_inverse=True)
    start = np.searchsorted(bag, np.arange(bag[-1] + 1))
    model.fit(x[order], bag, marks[order][start])
    return model


def classify_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS, keep: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs(doc_id, text)`, or, with
    `keep`, all its columns and these, those of the same name replaced.

    Fitted on a bounded sample of the labelled rows that are not held out; scores use the
    whole text and nothing else. A null or empty text is one empty passage and gets the
    score of that. Without any labelled row the network stays as it was drawn. Rows may
    repeat; rows without doc_id are scored like others.
    """
    model = fit_quality(docs, labels, rows)
    added = ["held_out", "score", "predicted"]
    kept = [c for c in docs.columns if c.lower() not in added] if keep else ["doc_id"]
    text = free([*kept, *added], "_text")
    rows = docs.select(*kept, held_out().alias("held_out"), F.col("text").cast("string").alias(text))

    # Only texts go to the workers and only scores come back; the rows stay where they are.
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(lambda each: (pa.array(model.score(texts)) for texts in each))(batches)

    scored = settled(rows.withColumn("score", score(F.col(text))).drop(text), "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
