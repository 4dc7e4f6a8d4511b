"""Language ID with more distinct bytes than one script has."""

import random

import numpy as np
import pyarrow as pa

from siteledger.llm import langid

#: First letter and number of letters of some scripts.
SCRIPTS = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 24), "hebrew": (0x5D0, 27), "arabic": (0x627, 36),
           "devanagari": (0x905, 50), "thai": (0xE01, 46), "hangul": (0xAC00, 4000), "han": (0x4E00, 4000)}


def samples(chars=1500):
    """A sample and another text of two languages of each script, with words of their own."""
    learned, other = {}, {}
    for script, (first, n) in SCRIPTS.items():
        for k in "ab":
            rng = random.Random(f"{script}-{k}")
            words = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(3, 7))) for _ in range(60)]
            text = lambda: " ".join(rng.choice(words) for _ in range(chars // 6))
            # The Latin languages have the most text, so their bytes are the most frequent ones.
            learned[f"{script}-{k}"] = text() * (8 if script == "latin" else 1)
            other[f"{script}-{k}"] = text()[:200]
    return learned, other


def phrases_of(text: bytes, sample: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_every_byte_of_the_samples_is_known():
    learned, other = samples()
    parser = langid.CrossParser({k: t.encode() for k, t in learned.items()})
    assert len({b for t in learned.values() for b in t.encode()}) > 100
    texts = [t.encode() for t in other.values()]
    bounds = np.cumsum([0, *map(len, texts)])
    found = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), bounds, 4096)
    for row, text in enumerate(texts):
        for column, lang in enumerate(parser.languages):
            sample = learned[lang].encode()
            # A symbol the sample lacks is a phrase that is counted with the one that it ends.
            if set(text) <= set(sample):
                assert found[row, column] == phrases_of(text, sample)
    best, _ = parser.predict(pa.array(other.values()))
    assert [parser.languages[i] for i in best] == list(other)


def test_rare_scripts_are_told_apart(spark):
    learned, other = samples()
    rows = [(i, t, lang) for lang, t in learned.items() for i in (1, 2, 3, 4)]
    rows += [(1000 + i, t, None) for i, t in enumerate(other.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify_language(docs).collect() if r.doc_id >= 1000}
    assert [found[1000 + i] for i in range(len(other))] == list(other)
