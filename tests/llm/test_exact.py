"""Counts, marginals and sketches against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siteledger.llm import langid, mil, sketch, toxic


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh "])
def test_phrases_are_those_of_the_whole_text(alphabet):
    r = random.Random(alphabet)
    draw = lambda n: "".join(r.choice(alphabet) for _ in range(n)).encode()
    for _ in range(10):
        samples = {f"l{k}": draw(r.randrange(20, 400)) + alphabet.encode() for k in range(3)}
        parser = langid.CrossParser(samples)
        texts = [draw(r.choice([0, 1, 5, 50, 3000])) for _ in range(10)] + [alphabet[:2].encode() * 700, samples["l0"] * 4]
        bounds = np.cumsum([0, *map(len, texts)])
        want = [[phrases(t, samples[lang]) for lang in parser.languages] for t in texts]
        for block in (3, 64, langid.BLOCK_BYTES):
            assert parser.phrases(np.frombuffer(b"".join(texts), np.uint8), bounds, block).tolist() == want


def plain_marginals(unary, pair):
    n, add = len(unary), np.logaddexp
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = [0, unary[0]]
    for t in range(1, n):
        f[t] = [add(f[t - 1, 0] + pair[0, c], f[t - 1, 1] + pair[1, c]) + c * unary[t] for c in (0, 1)]
    for t in range(n - 2, -1, -1):
        b[t] = [add(pair[a, 0] + b[t + 1, 0], pair[a, 1] + b[t + 1, 1] + unary[t + 1]) for a in (0, 1)]
    total, moves = add(*f[-1]), np.zeros((2, 2))
    for t in range(1, n):
        for a in (0, 1):
            for c in (0, 1):
                moves[a, c] += np.exp(f[t - 1, a] + pair[a, c] + c * unary[t] + b[t, c] - total)
    return np.exp(f[:, 1] + b[:, 1] - total), moves


def test_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(3)
    for longest in (90, 129, 900):
        bounds = np.concatenate([[0], np.cumsum([0, *rng.integers(0, longest, 8), longest, 1, 128])])
        unary, pair = rng.normal(0, 3, bounds[-1]), rng.normal(0, 2, (2, 2))
        tagged, moves = toxic.marginals(unary, pair, toxic.Chains(bounds))
        want = [plain_marginals(unary[a:b], pair) for a, b in zip(bounds, bounds[1:]) if b > a]
        assert np.allclose(tagged, np.concatenate([w[0] for w in want])) and np.allclose(moves, sum(w[1] for w in want))


def test_attention_of_a_bag():
    rng = np.random.default_rng(4)
    model = mil.AttentionBag()
    model.mean, model.scale = rng.normal(0, 1, mil.FEATURES), rng.uniform(0.5, 2, mil.FEATURES)
    x, sizes = rng.normal(0, 1, (12, mil.FEATURES)), [1, 4, 7]
    bag = np.repeat(np.arange(3), sizes)
    got = model.forward(x, np.searchsorted(bag, np.arange(3)), bag)["y"]
    p, want = model.p, []
    for k in range(3):
        codes = [np.tanh((v - model.mean) / model.scale @ p["w"] + p["b"]) for v in x[bag == k]]
        marks = [np.exp(sum(a * np.tanh(h @ v) / (1 + np.exp(-(h @ u))) for a, v, u in zip(p["a"], p["v"].T, p["u"].T))) for h in codes]
        pooled = sum(m * h for m, h in zip(marks, codes)) / sum(marks)
        want.append(1 / (1 + np.exp(-(pooled @ p["c"] + p["d"][0]))))
    assert np.allclose(got, want)


def shingles(text, width=5):
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    out = set()
    for a in range(max(1, len(words) - width + 1) if words else 0):
        h = 42
        for w in words[a : a + width]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >= 1 << 63 else h)
    return out


def test_sketches_merge_and_estimate(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    texts = ["", "one two", " ".join(base), " ".join(base[:300] + ["new"] * 4 + base[300:]), " ".join(base[200:]), " ".join(base[:30])]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "i int, text string, part int")
    k = 64
    made = df.select("i", "part", sketch.bottom_k(F.col("text"), k).alias("s"))
    sets = [shingles(t) for t in texts]
    assert {r.i: r.s for r in made.collect()} == {i: sorted(s)[:k] for i, s in enumerate(sets)}
    merged = {r.part: r.s for r in sketch.merge_sketches(made, ["part"], "s", k).collect()}
    assert merged == {p: sorted(set().union(*(s for i, s in enumerate(sets) if i % 2 == p)))[:k] for p in (0, 1)}
    both = made.alias("a").crossJoin(made.alias("b")).select(
        F.col("a.i").alias("x"), F.col("b.i").alias("y"), sketch.resemblance(F.col("a.s"), F.col("b.s"), k).alias("near"),
        sketch.containment(F.col("a.s"), F.col("b.s"), k).alias("inside"), sketch.distinct_shingles(F.col("a.s"), k).alias("n"),
    )
    for row in both.collect():
        a, b = sets[row.x], sets[row.y]
        near = len(a & b) / len(a | b) if a | b else 1.0
        inside = len(a & b) / len(a) if a else 1.0
        exact = len(a | b) < k
        assert abs(row.near - near) <= (1e-9 if exact else 0.25) and abs(row.inside - inside) <= (1e-9 if exact else 0.35)
        assert abs(row.n - len(a)) <= (0 if len(a) < k else 0.5 * len(a))
