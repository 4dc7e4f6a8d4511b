"""The operators on a small table with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siteledger.llm import jaccard, langid, licenses, mil, mixing, phrases, pieces, rules, sketch, toxic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(400))


def rows():
    out = [(1, LONG), (2, LONG), (3, LONG.replace("w50x19", "other")), (4, None), (5, ""), (6, "Two words"), (6, "Two words")]
    out += [(7, "head " + " ".join(LONG.split()[100:160]) + " tail"), (8, "For " * 60), (None, "no id here"), (9, "é ü \x0b x")]
    out += [(20 + i, f"line {i} of a text with its own words {i * i} and no more {i * 7}") for i in range(12)]
    return [(i, t, "en", None if i in (4, 9) else f"s{(i or 0) % 3}", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_words int")


def words(text):
    return WORD.findall(text or "")


def test_remove_repeats(docs):
    seen, want = {}, {}
    ordered = sorted(((1 << 63) - 1 if i is None else i, t) for i, t in {(r[0], r[1] or "") for r in rows()})
    for i, text in ordered:
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            if seen.setdefault(tuple(w[a : a + 20]), (i, a)) != (i, a):
                gone[a : a + 20] = [True] * 20
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    found = phrases.remove_repeats(docs).collect()
    assert len(found) == len(rows())
    for r in found:
        assert (r.n_words, r.n_removed, r.kept) == want[(1 << 63) - 1 if r.doc_id is None else r.doc_id]


def test_jaccard_components(docs):
    sets = {}
    for i, text, *_ in rows():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + 4]) for a in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and a is not None and b is not None:
                    if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
    found = jaccard.jaccard_components(docs).collect()
    assert len(found) == len(rows())
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(s), label[i]) for i, s in sets.items()}


def test_mixing(docs):
    found = mixing.entropy_mix(docs, F.size(sketch.word_array(F.col("text")))).collect()
    assert len(found) == len(rows())
    taken, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(10, 0.05 * target[s]) for s in target)


def test_licenses(spark):
    texts = ["MIT license MIT license", "Released under the\nRELEASED under the MIT License.", None, "", "permit license", "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (found[0].n_base, found[0].first_word, found[0].last_word) == (2, 0, 2)
    assert found[1].labels == "mit" and found[2].n_words == found[3].n_words == 0
    assert found[4].labels == "" and found[5].labels == "cc-by-nc" and found[5].base_labels == ""


def test_rules(spark, docs):
    labels = spark.createDataFrame([(20 + i, i % 2) for i in range(12)], "doc_id long, quality int")
    found = rules.quality_rules(docs, labels).collect()
    assert len(found) == len(rows())
    for r in found:
        if r.doc_id == 8:
            assert r.n_repeat_words == 60 and r.base_failed and not r.kept


def test_fingerprints(docs):
    found = sketch.edited_fingerprints(docs.filter("doc_id >= 20")).orderBy("doc_id").collect()
    texts = [r[1] for r in rows() if r[0] and r[0] >= 20]
    for k, r in enumerate(found):
        cut = len(texts[k]) // 4
        edited = texts[k][: len(texts[k]) - cut] + texts[(k + 1) % len(texts)][:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sketch.edited_fingerprints(docs).count() == len(rows())


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_pieces(docs):
    both = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL).collect()
    assert all(r.decoded == r.text for r in both)
    vocab = pieces.Vocabulary.load(MODEL)
    import numpy as np
    import sentencepiece

    plain = pieces.Encoder(vocab, 0.0)
    texts = [r[1] for r in rows() if r[1]]
    known = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [np.frombuffer(p, np.int32).tolist() for p in plain.encode(texts, [""] * len(texts))] == [known.encode(t) for t in texts]


def test_learned_operators_take_odd_rows(spark, docs):
    labels = spark.createDataFrame([(20 + i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for table in (docs, docs.limit(0)):
        n = table.count()
        assert langid.identify_language(table).count() == n
        assert mil.classify_quality(table, labels).count() == n
        assert toxic.score_toxicity(table, labels).count() == n


def test_a_tag_field_gathers_kind_by_kind():
    import tracemalloc

    import numpy as np

    from siteledger.llm.toxic import _KINDS, BITS, TagField

    rng = np.random.default_rng(1)
    n = 200_000
    features = (rng.integers(0, 1 << BITS, (_KINDS, n)) + (np.arange(_KINDS) << BITS)[:, None]).astype(np.int32)
    field, values = TagField(), rng.normal(size=n)
    field.weights = rng.normal(size=len(field.weights))
    want = field.weights[features].sum(0) + field.bias[0]
    tracemalloc.start()
    assert (field.unary(features) == want).all()
    assert tracemalloc.get_traced_memory()[1] < 5 * 8 * n
    tracemalloc.stop()
    assert (field._gathered_by_feature(features, values) == np.bincount(features.ravel(), np.tile(values, _KINDS), len(field.weights))).all()
