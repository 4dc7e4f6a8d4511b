"""Toxicity: a linear-chain conditional random field over tokens.

Labels mark documents; tokens are tagged from them: a token of a toxic document is tagged
if it, or its beginning, is far more frequent in toxic documents of the sample than in
others. The field learns these tags from a token, its beginnings and its neighbours, so it
also tags what only looks or stands like them. Forward-backward marginals give the spans;
summed up over a document, they give its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import held_out
from siteledger.llm.sample import labelled_sample
from siteledger.llm.words import grams, mix, pieces

# Tokens are runs of digits, letters and characters beyond ASCII.
_DELIMITERS = np.ones(256, dtype=bool)
_DELIMITERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bounds of the labelled sample of each class: rows, and bytes of all of them. Texts are taken whole
#: or not at all.
SAMPLE_ROWS = 1200
SAMPLE_BYTES = 6 << 20
#: A sign of toxicity is in this share of the toxic documents at least, and makes up this
#: many times as large a share of their tokens as of the others'.
MIN_SHARE, MIN_RATIO = 0.03, 10
THRESHOLD = 0.5
LINK = 128
BITS, STEPS, RATE, DECAY = 16, 60, 0.5, 1e-6
#: Bytes of the beginnings that are features.
HEADS = (4, 5, 6, 7, 8)
_KINDS = 3 + len(HEADS)


def token_hashes(piece) -> np.ndarray:
    """The hashes of each token of a piece: itself and its beginnings."""
    ranges = piece.byte_ranges()
    ends = [piece.end, *(np.minimum(piece.end, piece.start + n) for n in HEADS)]
    return np.stack([ranges.of(piece.start, end) for end in ends])


def token_features(piece, hashes: np.ndarray) -> np.ndarray:
    """Hashed features of each token: itself, its beginnings, the one before and the one
    after it in its text."""
    n = hashes.shape[1]
    beside = np.zeros((2, n), np.uint64)
    if n > 1:
        same = piece.doc[1:] == piece.doc[:-1]
        beside[0, 1:] = np.where(same, hashes[0, :-1], 0)
        beside[1, :-1] = np.where(same, hashes[0, 1:], 0)
    places = (np.concatenate([hashes, beside]) >> np.uint64(64 - BITS)).astype(np.int64)
    return places + (np.arange(_KINDS, dtype=np.int64) << BITS)[:, None]


class Chains:
    """The chains of texts, one each, in links of at most LINK tokens that are run side by side.

    Links are ordered by length, and only the first `active[t]` have a token t. `before` and
    `after` are a link's neighbours in its chain, -1 at its ends, `nth` its place there."""

    def __init__(self, words: np.ndarray):
        sizes = np.diff(words)
        links = -(-sizes // LINK)
        doc = np.repeat(np.arange(len(sizes)), links)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(links) - links, links)
        start = words[:-1][doc] + nth * LINK
        length = np.minimum(LINK, words[1:][doc] - start)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        along = np.arange(len(doc))
        self.before = np.where(nth > 0, place[np.maximum(along - 1, 0)], -1)[order]
        self.after = np.where(nth + 1 < links[doc], place[np.minimum(along + 1, len(doc) - 1)], -1)[order]
        self.start, self.length, self.nth = start[order], length[order], nth[order]
        self.left = (links[doc] - 1 - nth)[order]
        self.longest = int(self.length[0]) if len(order) else 0
        self.active = [int(np.searchsorted(-self.length, -(t + 1), "right")) for t in range(self.longest)]
        self.first = start[nth == 0]


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return high + np.log1p(np.exp(-np.abs(a - b)))


_NEVER = -1e30


def _forward(unary, pair, chains, f0, f1, out):
    """Run all links from the messages (f0, f1) of the tokens before them; `out` gets those of
    every token, and what the last one of each link says is returned."""
    starts = chains.before < 0
    f0, f1 = f0.copy(), f1.copy()
    for t in range(chains.longest):
        n = chains.active[t]
        at = chains.start[:n] + t
        g0 = _log_add(f0[:n] + pair[0, 0], f1[:n] + pair[1, 0])
        g1 = _log_add(f0[:n] + pair[0, 1], f1[:n] + pair[1, 1]) + unary[at]
        if not t:
            g0, g1 = np.where(starts, 0.0, g0), np.where(starts, unary[at], g1)
        f0[:n], f1[:n] = g0, g1
        if out is not None:
            out[0, at], out[1, at] = g0, g1
    return f0, f1


def _backward(unary, pair, chains, b0, b1, out):
    """The same from the right: (b0, b1) are the messages of the tokens after each link, with
    their own scores; returned are those of its first token, with its score."""
    ends = chains.after < 0
    b0, b1 = b0.copy(), b1.copy()
    last = chains.start + chains.length - 1
    # Links end side by side: step t is the token t before the last one.
    for t in range(chains.longest):
        n = chains.active[t]
        at = last[:n] - t
        g0 = _log_add(b0[:n] + pair[0, 0], b1[:n] + pair[0, 1])
        g1 = _log_add(b0[:n] + pair[1, 0], b1[:n] + pair[1, 1])
        if not t:
            g0, g1 = np.where(ends, 0.0, g0), np.where(ends, 0.0, g1)
        if out is not None:
            out[0, at], out[1, at] = g0, g1
        b0[:n], b1[:n] = g0, g1 + unary[at]
    return b0, b1


def _entering(run, unary, pair, chains, neighbour, nth):
    """The message that enters each link: links are run from either tag alone, which gives what
    they make of any message, and messages are handed on from link to link."""
    n = len(chains.start)
    m0, m1 = np.zeros(n), np.zeros(n)
    if not (neighbour >= 0).any():
        return m0, m1
    sure, never = np.zeros(n), np.full(n, _NEVER)
    (a00, a01), (a10, a11) = run(unary, pair, chains, sure, never, None), run(unary, pair, chains, never, sure, None)
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange(int(nth.max()) + 2))
    for k in range(1, len(bounds) - 1):
        links = order[bounds[k] : bounds[k + 1]]
        frm = neighbour[links]
        # A link at the end of a chain says the same whatever enters it.
        p0, p1 = (np.where(nth[frm] == 0, v, m[frm]) for v, m in ((0.0, m0), (_NEVER, m1)))
        m0[links] = _log_add(p0 + a00[frm], p1 + a10[frm])
        m1[links] = _log_add(p0 + a01[frm], p1 + a11[frm])
    return m0, m1


def marginals(unary: np.ndarray, pair: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """(probability that a token is tagged, expected counts of the four transitions).

    `unary` is the score of the tag over no tag, `pair[a, b]` that of tag b after a. A chain is
    the whole text; that it is run in links changes nothing but the time."""
    forward, backward = np.zeros((2, len(unary))), np.zeros((2, len(unary)))
    _forward(unary, pair, chains, *_entering(_forward, unary, pair, chains, chains.before, chains.nth), forward)
    _backward(unary, pair, chains, *_entering(_backward, unary, pair, chains, chains.after, chains.left), backward)
    both = forward + backward
    total = _log_add(both[0], both[1])
    tagged = np.exp(both[1] - total)
    moves = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[chains.first] = False
    at = np.nonzero(inner)[0]
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = np.exp(forward[a, at - 1] + pair[a, b] + b * unary[at] + backward[b, at] - total[at]).sum()
    return tagged, moves


class TagField:
    """The weights of the field."""

    def __init__(self):
        self.weights = np.zeros(_KINDS << BITS)
        self.bias = np.array([-4.0])
        self.pair = np.zeros((2, 2))
        #: Of a document's score: constant, highest marginal, log of their sum, their share.
        self.document = np.array([-3.0, 0.0, 0.0, 0.0])

    def unary(self, features: np.ndarray) -> np.ndarray:
        # Kind by kind: all at once would take eight numbers a token beside the sum.
        total = self.weights[features[0]]
        for row in features[1:]:
            total += self.weights[row]
        return total + self.bias[0]

    def _gathered_by_feature(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum of `values` over the tokens that have each feature, kind by kind."""
        total = np.zeros_like(self.weights)
        for row in features:
            total += np.bincount(row, values, len(self.weights))
        return total

    def fit(self, features: np.ndarray, tags: np.ndarray, words: np.ndarray) -> None:
        """Adagrad on the log likelihood of the tags, all chains at once."""
        chains = Chains(words)
        inner = np.ones(len(tags), bool)
        inner[chains.first] = False
        at = np.nonzero(inner)[0]
        seen = np.bincount(tags[at - 1] * 2 + tags[at], minlength=4).reshape(2, 2)
        squares = [np.full_like(self.weights, 1e-6), np.full(1, 1e-6), np.full((2, 2), 1e-6)]
        for _ in range(STEPS):
            tagged, moves = marginals(self.unary(features), self.pair, chains)
            wrong = tags - tagged
            steps = [
                self._gathered_by_feature(features, wrong) - DECAY * self.weights,
                np.array([wrong.sum()]),
                seen - moves,
            ]
            for value, step, square in zip((self.weights, self.bias, self.pair), steps, squares):
                square += step * step
                value += RATE * step / np.sqrt(square)

    @staticmethod
    def gathered(tagged: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """What a document's marginals come to, one row per document."""
        high, size = np.zeros(n), np.bincount(doc, minlength=n)
        np.maximum.at(high, doc, tagged)
        total = np.bincount(doc, tagged, n)
        return np.stack([np.ones(n), high, np.log1p(total), 100 * total / np.maximum(size, 20)], 1)

    def fit_document(self, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton steps, with a small ridge."""
        ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (toxic - p)) - ridge @ w
            w = w + np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, slope)
        self.document = w

    def run(self, texts: pa.Array):
        """(score, starts, ends) of each text: places, in code points, of the tokens that are
        tagged more likely than not."""
        n = len(texts)
        x, starts, ends = np.zeros((n, 4)), [[] for _ in range(n)], [[] for _ in range(n)]
        x[:, 0] = 1
        for piece in pieces(texts, lower=True, delimiters=_DELIMITERS):
            if not len(piece.start):
                continue
            features = token_features(piece, token_hashes(piece))
            tagged, _ = marginals(self.unary(features), self.pair, Chains(piece.words))
            x[piece.first : piece.last] = self.gathered(tagged, piece.doc, piece.last - piece.first)
            hits = np.nonzero(tagged >= THRESHOLD)[0]
            if len(hits):
                points = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
                base = points[piece.bounds[piece.doc[hits]]]
                for doc, a, b in zip(piece.doc[hits], points[piece.start[hits]] - base, points[piece.end[hits]] - base):
                    starts[piece.first + doc].append(int(a))
                    ends[piece.first + doc].append(int(b))
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30))), starts, ends


def _apart(found: pa.Table) -> pa.Table:
    """The rows whose text isn't a near copy of an earlier one: none of four min-hashes of
    its 3-word runs is taken. Words that copies share would pass for signs of toxicity."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for piece in pieces(found.column("text"), lower=True, delimiters=_DELIMITERS):
        words = piece.word_hashes()
        for d in range(piece.last - piece.first):
            runs = grams(words[piece.words[d] : piece.words[d + 1]], 3)
            marks = {(k, int(mix(runs ^ np.uint64(k + 1)).min())) for k in range(4)} if len(runs) else set()
            if not marks & seen:
                keep.append(piece.first + d)
            seen |= marks
    return found.take(pa.array(keep))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> TagField:
    """The field fitted on at most `rows` whole documents of each class, of at most `size` bytes
    together. Label 1 is toxic, every other is not."""
    field = TagField()
    found = labelled_sample(docs, labels, "toxic", rows, size, per_class=True).toArrow()
    if not found.num_rows:
        return field
    found = _apart(found.sort_by([("doc_id", "ascending"), ("text", "ascending")]))
    toxic = np.array(found.column("label").to_pylist()) == 1
    if toxic.all() or not toxic.any():
        return field
    hashes, docs_of, features, bounds, base = [], [], [], [np.zeros(1, np.int64)], 0
    for piece in pieces(found.column("text"), lower=True, delimiters=_DELIMITERS):
        hashes.append(token_hashes(piece))
        docs_of.append(piece.doc + piece.first)
        features.append(token_features(piece, hashes[-1]).astype(np.int32))
        bounds.append(piece.words[1:] + base)
        base += len(piece.start)
    hashes, docs_of = np.concatenate(hashes, 1), np.concatenate(docs_of)
    features, bounds = np.concatenate(features, 1), np.concatenate(bounds)
    bad = toxic[docs_of]
    signs = np.zeros(len(docs_of), bool)
    for row in hashes:
        _, code = np.unique(row, return_inverse=True)
        once = np.unique(code.astype(np.int64) * len(toxic) + docs_of)
        holders = np.bincount(once // len(toxic), toxic[once % len(toxic)], code.max() + 1)
        rate = np.bincount(code, bad) / max(1, bad.sum())
        rest = np.bincount(code, ~bad) / max(1, (~bad).sum())
        marked = (holders >= max(3, MIN_SHARE * toxic.sum())) & (rate >= MIN_RATIO * rest)
        signs |= marked[code]
    del hashes, code, once
    field.fit(features, (signs & bad).astype(np.int64), bounds)
    tagged, _ = marginals(field.unary(features), field.pair, Chains(bounds))
    # The sample holds as many toxic documents as others; weights restore their shares.
    counts = {r["toxic"]: r["n"] for r in labels.filter(~held_out()).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    others = sum(n for mark, n in counts.items() if mark is not None and mark != 1)
    share = others / max(1, counts.get(1, 0)) * toxic.sum() / (~toxic).sum()
    field.fit_document(field.gathered(tagged, docs_of, len(toxic)), toxic, np.where(toxic, 1.0, share))
    return field


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row of `docs(doc_id, text)`.

    Fitted on a bounded sample of the labelled rows that are not held out; scores use the
    whole text and nothing else. A null or empty text, or one without a token, has the score
    of no marginals, a low one, and no spans. Without labelled rows of both classes every
    score is low. Rows may repeat; other
    columns are ignored. Spans are offsets in code points, end excluded.
    """
    field = fit_toxicity(docs, labels, rows)

    def run(batches):
        for batch in batches:
            scores, starts, ends = field.run(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                ],
                names=["doc_id", "held_out", "score", "starts", "ends"],
            )

    rows_in = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows_in.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, starts array<int>, ends array<int>")
    return out.select(
        "doc_id",
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"),
    )
