"""Rows without doc_id, rows that repeat one with another text, columns of internal names, long texts
and empty tables, for substring dedup, the Jaccard join, piece encoding and the quality classifier."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteledger.llm import jaccard, mil, phrases, pieces
from siteledger.llm.queries import PIECE_MODEL

LAST = (1 << 63) - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vocabulary(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def plain_dedup(rows, width=20):
    first = {}
    for i, text in rows:
        w, i = words(text), LAST if i is None else i
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            first[key] = min(first.get(key, (i, a)), (i, a))
    out = Counter()
    for i, text in rows:
        w, place = words(text), LAST if i is None else i
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < (place, a):
                gone[a : a + width] = [True] * width
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def odd_rows():
    r = random.Random(8)
    shared = [vocabulary(f"p{k}x", 45) for k in range(4)]
    rows = [(5, vocabulary("long", 300) + " " + shared[0]), (5, "short " + shared[1]), (5, shared[0] + " tail"), (5, "brief")]
    rows += [(None, shared[0] + f" no id {k} " + shared[k % 4]) for k in range(6)] + [(None, shared[2])] * 3 + [(None, None), (None, ""), (7, None)]
    rows += [(i, " ".join(r.choice(shared).split()[r.randrange(10) :][: 20 + r.randrange(30)] + [f"w{r.randrange(9)}" for _ in range(r.randrange(40))])) for i in range(10, 40)]
    rows += [(3, "same " * 60), (3, "same " * 60), (90, vocabulary("big", 60_000) + " " + shared[3]), (91, "x" * 1_000_000 + " " + shared[3])]
    return rows


def test_dedup_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _SHARD string, _row int").withColumn("_doc", F.lit(2))
    for shard in (4 << 20, 3000):
        found = phrases.remove_repeats(df, shard_bytes=shard).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == plain_dedup(rows)
    assert [c for c in found[0].asDict()] == ["doc_id", "text", "_SHARD", "_row", "_doc", "n_words", "n_removed", "kept"]
    assert phrases.remove_repeats(df.limit(0)).count() == 0


def test_words_are_spelled_apart():
    for n in (1, 2, 300, 70_000):
        codes = np.concatenate([np.arange(n), [-1]])
        text = phrases.spelled(codes)
        assert len(text) == phrases.SPELLED * len(codes)
        spelt = [text[k : k + phrases.SPELLED] for k in range(0, len(text), phrases.SPELLED)]
        assert len(set(spelt)) == len(codes) and spelt[-1] == "\0" * phrases.SPELLED
        assert not {s[0] for s in spelt[:-1]} & {s[1] for s in spelt[:-1]}


def plain_components(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[a : a + width]) for a in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    changed = True
    near = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            ids[label[k]].append(i)
    return Counter((i, len(sets[k]), (min(ids[label[k]], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_links_through_rows_without_doc_id(spark):
    # A ~ N ~ B, but not A ~ B.
    chain = lambda name, k: " ".join(f"{name}{i}" for i in range(k, k + 103))
    rows = [(1, chain("a", 0)), (None, chain("a", 7)), (2, chain("a", 14)), (3, chain("b", 0)), (9, chain("b", 7)), (9, chain("b", 14)), (4, chain("b", 21))]
    rows += [(None, chain("c", 0)), (None, chain("c", 7)), (9, chain("d", 0)), (None, chain("d", 0)), (None, None), (12, ""), (None, "Few words"), (8, "few WORDS")]
    rows += [(100 + k, chain("e", 7 * k)) for k in range(12)] + [(90, chain("f", 0).upper()), (91, chain("f", 3)), (92, "one " * 500), (93, "one " * 900)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    found = jaccard.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_every_place_of_a_word_is_cut_by_its_own_draws(spark):
    vocab = pieces.Vocabulary.load(PIECE_MODEL)
    texts = [" the of and the of and" * 400, "nul \0 \0x ▁ a▁b  two \n\n line é́ 日本 😀 \U0010ffff", "word " * 30 + "x" * 500, "", None, "antidisestablishmentarianism " * 50]
    encoder, keys = pieces.Encoder(vocab, 0.2, remembered=1 << 18), [str(k) for k in range(len(texts))]
    outputs = vocab.outputs()
    for _ in range(2):
        flat, bounds = encoder.encode_flat(texts, keys)
        listed = [pieces._WORD.findall(" " + t) if t else [] for t in texts]
        codes = encoder._codes(keys, np.array([len(w) for w in listed]))
        want = []
        for word, code in zip([w for each in listed for w in each], codes.tolist()):
            plain = [vocab.bytes_at[b] for b in word.encode()] if word == "▁" else pieces.segment(word.replace(" ", "▁"), vocab, 0.2, code)
            want += plain
        assert flat.tolist() == want
        for k, text in enumerate(texts):
            assert b"".join(outputs[i] for i in flat[bounds[k] : bounds[k + 1]]).decode()[1:] == (text or "")
    # The agenda of one word alone, run often, gives many cuts.
    (cuts,) = [encoder.encode_flat([texts[0]], ["a"])[0].tolist()]
    pairs = Counter(zip(cuts, cuts[1:]))
    assert len(set(cuts)) > 8 and len(pairs) > 20


def test_columns_of_internal_names(spark):
    df = spark.createDataFrame([(1, "some words here", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, _text int, _KEY int, _digest int")
    both = pieces.decode_pieces(pieces.encode_pieces(df, PIECE_MODEL), PIECE_MODEL)
    assert both.columns == [*df.columns, "ids", "decoded"] and [r.decoded for r in both.orderBy(F.isnull("doc_id")).collect()] == ["some words here", None]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scored = mil.classify_quality(df, labels, keep=True)
    assert scored.columns == [*df.columns, "held_out", "score", "predicted"] and scored.count() == 2


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")], [(1, "a\0b ▁"), (1, "a\0b ▁"), (None, "  \n ")]])
def test_pieces_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = pieces.decode_pieces(pieces.encode_pieces(df, PIECE_MODEL), PIECE_MODEL)
    assert Counter((r.doc_id, r.text, r.decoded) for r in both.collect()) == Counter((i, t, t) for i, t in rows)
