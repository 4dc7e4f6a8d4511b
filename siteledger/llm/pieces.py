"""SentencePiece encoding with seeded merge-dropout, and its decoding.

Merge-type encoding takes the best-ranked adjacent pair from an agenda until none is left.
With dropout, a candidate that comes up is skipped if its keyed hash says so, which gives
other segmentations of the same text. The hash covers the seed, the document, the word's place
in it and the candidate; the same input gives the same pieces. Decoding restores every text.

What an agenda has done is remembered as a tree per word: a node is a candidate that came up,
its two branches what came up next when it was merged and when it was skipped. Every place of
a known word walks the tree with hashes of its own, many places side by side; only where it
takes a branch not seen before is the agenda run, and the tree grows.
"""

from __future__ import annotations

import heapq
import re
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.names import free
from siteledger.llm.common import giving_back
from siteledger.llm.words import mix, spans, text_bytes

DROPOUT = 0.1
#: Bytes, by estimate, of the words and trees that a worker remembers before it starts anew.
REMEMBERED = 32 << 20
#: Of one word, besides its characters: its entry and its text.
_WORD_BYTES = 200
#: Characters up to which searching a list beats keeping a heap; both cut alike.
SHORT_WORD = 48
#: Bytes of text that are encoded at once.
ENCODED_AT_ONCE = 1 << 20
#: Pieces that are decoded at once.
DECODED_AT_ONCE = 1 << 18
#: Words whose agendas are run side by side.
AT_ONCE = 16384
_WIDTHS = np.array([2, 4, 8, 12, 16, 24, SHORT_WORD])
_NONE = float("-inf")
_SPACE = "▁"
# Words: spaces and what follows them; line ends stand alone, as no piece holds them, and so
# does the space sign itself where a text has it.
_WORD = re.compile(r" *[^ \n▁]+| +|\n|▁")


class Vocabulary:
    """Pieces of a merge-type model: text to id, rank by id, ids of the 256 bytes."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_at: list[int]):
        self.pieces, self.bytes_at = pieces, bytes_at
        special = set(bytes_at)
        self.ids = {p: i for i, p in enumerate(pieces) if p is not None and i not in special}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.digest = blake2b(repr((pieces, scores, bytes_at)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read on the driver; tasks get the tables."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        pieces = [model.id_to_piece(i) if ok else None for i, ok in enumerate(plain)]
        inner = re.compile(f"[^{_SPACE}]{_SPACE}|\n")
        at = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
        bytes_at = [at[f"<0x{b:02X}>"] for b in range(256)]
        if any(p and inner.search(p) for i, p in enumerate(pieces) if not model.is_byte(i)):
            raise ValueError("a piece of this model crosses words; only models without such pieces are supported")
        return cls(pieces, [model.get_score(i) for i in range(n)], bytes_at)

    def outputs(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [b"" if p is None else p.replace(_SPACE, " ").encode() for p in self.pieces]
        for value, i in enumerate(self.bytes_at):
            out[i] = bytes([value])
        return out


def _candidate(a, middle, stop):
    """A candidate merge of word[a:middle] and word[middle:stop] as 32 bits."""
    return (a * 0x9E3779B1 + middle * 0x85EBCA77 + stop * 0xC2B2AE3D) & 0xFFFFFFFF


def _drawn(code, candidate):
    """The keyed hash of a candidate, 32 bits; works on numbers and on 64-bit arrays."""
    h = (code + candidate) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    h = ((h ^ (h >> 12)) * 0x297A2D39) & 0xFFFFFFFF
    return h ^ (h >> 15)


def _skipped(code, a, middle, stop):
    return _drawn(code, _candidate(a, middle, stop))


def _cut_short(word: str, scores: dict[str, float], limit: int, code: int) -> list[str]:
    """Pieces of a short word: the agenda is a list, searched for its best entry."""
    parts, at = list(word), list(range(len(word) + 1))
    known = scores.get
    agenda = [known(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while agenda:
        best = max(agenda)
        if best == _NONE:
            break
        i = agenda.index(best)
        if limit and _skipped(code, at[i], at[i + 1], at[i + 2]) < limit:
            agenda[i] = _NONE
            continue
        parts[i] += parts[i + 1]
        del parts[i + 1], at[i + 1], agenda[i]
        if i < len(agenda):
            agenda[i] = known(parts[i] + parts[i + 1], _NONE)
        if i:
            agenda[i - 1] = known(parts[i - 1] + parts[i], _NONE)
    return parts


def _cut_long(word: str, scores: dict[str, float], limit: int, code: int) -> list[str]:
    """The same for a long word, with a heap as agenda."""
    n = len(word)
    end, left, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    agenda: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        middle = end[a]
        if middle < n:
            score = scores.get(word[a : end[middle]])
            if score is not None:
                heapq.heappush(agenda, (-score, a, middle, end[middle]))

    for a in range(n - 1):
        offer(a)
    while agenda:
        _, a, middle, stop = heapq.heappop(agenda)
        if not alive[a] or end[a] != middle or end[middle] != stop:
            continue
        if limit and _skipped(code, a, middle, stop) < limit:
            continue
        alive[middle] = False
        end[a], left[stop] = stop, a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    starts = [a for a in range(n) if alive[a]]
    return [word[a : end[a]] for a in starts]


def segment(word: str, vocab: Vocabulary, dropout: float, code: int) -> list[int]:
    """Ids of one word (spaces already as the space sign); `code` is the key of its hashes."""
    limit = int(dropout * 4294967296)
    out: list[int] = []
    cut = _cut_short if len(word) <= SHORT_WORD else _cut_long
    for part in cut(word, vocab.score, limit, code):
        found = vocab.ids.get(part)
        if found is not None:
            out.append(found)
        else:
            out.extend(vocab.bytes_at[b] for b in part.encode())
    return out


class _Merges:
    """All merges of a vocabulary as sorted arrays, to look up many pairs at once. A character
    without a piece has an id past all pieces."""

    def __init__(self, vocab: Vocabulary):
        self.n = len(vocab.pieces)
        self.base = self.n + 0x110000
        pairs = {}
        for piece, merged in vocab.ids.items():
            for cut in range(1, len(piece)):
                left, right = vocab.ids.get(piece[:cut]), vocab.ids.get(piece[cut:])
                if left is None and cut == 1:
                    left = self.n + ord(piece[0])
                if right is None and cut == len(piece) - 1:
                    right = self.n + ord(piece[-1])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = merged
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        score = np.full(self.n, _NONE, np.float32)
        for piece, i in vocab.ids.items():
            score[i] = vocab.score[piece]
        self.score = score[self.merged]
        self.single = np.arange(self.n, self.base, dtype=np.int32)
        for piece, i in vocab.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, merged id) of each pair; no score where there is no merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.score[at], np.float32(_NONE)), self.merged[at]

    def cut(self, ids: np.ndarray, codes: np.ndarray, limit: int, seen=None) -> np.ndarray:
        """Pieces of words, whose characters are the rows of `ids`, filled up with -1: the id of the
        piece that begins at each character, -1 where none does.

        One entry of every word's agenda is taken per round, for all words side by side; words
        that are done leave the tables once they are a third of them. `seen` is told (rows,
        candidate, skipped) of each round."""
        n, width = ids.shape
        out = np.zeros((n, width), np.int32)
        rows, ids = np.arange(n), ids.copy()
        # Of the piece that begins at a character: where it stops, and where the one before begins.
        stop = np.broadcast_to(np.arange(1, width + 1, dtype=np.int8), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int8), (n, width + 1)).copy()
        score = np.full((n, width), np.float32(_NONE))
        merged = np.zeros((n, width), np.int32)
        score[:, :-1], merged[:, :-1] = self.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            a = score.argmax(1)
            each = np.arange(len(rows))
            open_ones = score[each, a] > _NONE
            still = int(np.count_nonzero(open_ones))
            if not still or 3 * still < 2 * len(rows):
                out[rows[~open_ones]] = ids[~open_ones]
                rows, ids, codes, a = rows[open_ones], ids[open_ones], codes[open_ones], a[open_ones]
                stop, before, score, merged = stop[open_ones], before[open_ones], score[open_ones], merged[open_ones]
                each = np.arange(still)
            elif still < len(rows):
                each, a = each[open_ones], a[open_ones]
            if not len(rows):
                break
            middle = stop[each, a].astype(np.int64)
            end = stop[each, middle].astype(np.int64)
            candidate = _candidate(a, middle, end)
            if limit:
                skipped = _drawn(codes[each], candidate) < limit
            else:
                skipped = np.zeros(len(each), bool)
            if seen is not None:
                seen(rows[each], candidate, skipped)
            if limit:
                score[each[skipped], a[skipped]] = _NONE
                join = ~skipped
                each, a, middle, end = each[join], a[join], middle[join], end[join]
            ids[each, a], ids[each, middle] = merged[each, a], -1
            stop[each, a], before[each, end] = end, a
            score[each, middle] = score[each, a] = _NONE
            left = before[each, a].astype(np.int64)
            inner, first = end < width, left >= 0
            row = np.concatenate([each[inner], each[first]])
            at = np.concatenate([a[inner], left[first]])
            after = np.concatenate([end[inner], a[first]])
            score[row, at], merged[row, at] = self.look_up(ids[row, at], ids[row, after])
        return out


class _Growing:
    """An array that is appended to."""

    def __init__(self, kind, fill: int = 0, width: tuple = ()):
        self.fill, self.n = fill, 0
        self.data = np.full((1024, *width), fill, kind)

    def more(self, n: int) -> int:
        """Room for n entries; where they begin."""
        first = self.n
        self.n += n
        if self.n > len(self.data):
            bigger = np.full((max(self.n, 2 * len(self.data)), *self.data.shape[1:]), self.fill, self.data.dtype)
            bigger[:first] = self.data[:first]
            self.data = bigger
        return first


class _Trees:
    """What the agendas of words have done. A node has the candidate that came up and the nodes
    that follow when it is merged and when it is skipped (-1: not seen yet), or, at the end, a
    leaf: its pieces, `pieces[bounds[leaf]:bounds[leaf + 1]]`."""

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.candidate, self.leaf = _Growing(np.int64, -1), _Growing(np.int32, -1)
        self.next = _Growing(np.int32, -1, (2,))
        self.pieces, self.bounds = _Growing(np.int32), _Growing(np.int64)
        self.bounds.more(1)
        self.characters = 0
        #: The node of words too long to be remembered.
        self.long = int(self.nodes(1)[0])

    def size(self) -> int:
        arrays = (self.candidate, self.leaf, self.next, self.pieces, self.bounds)
        return self.characters + _WORD_BYTES * len(self.roots) + sum(x.data.nbytes for x in arrays)

    def nodes(self, n: int) -> np.ndarray:
        self.leaf.more(n)
        self.next.more(n)
        return np.arange(n) + self.candidate.more(n)

    def plant(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= SHORT_WORD]
        self.roots.update(zip(short, self.nodes(len(short)).tolist()))
        self.characters += 2 * sum(map(len, short))

    def ends(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New leaves with these pieces."""
        first = self.pieces.more(len(flat))
        self.pieces.data[first : first + len(flat)] = flat
        at = self.bounds.more(len(sizes))
        self.bounds.data[at : at + len(sizes)] = first + np.cumsum(sizes)
        return np.arange(len(sizes)) + at - 1

    def walk(self, node: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaf each place comes to, -1 where it takes a branch not seen before; and which
        branch of which node that is."""
        out, stuck = np.full(len(node), -1, np.int64), node * 2
        at = np.arange(len(node))
        while len(at):
            leaf = self.leaf.data[node]
            out[at] = leaf
            candidate = self.candidate.data[node]
            inner = (leaf < 0) & (candidate >= 0)
            at, node, candidate = at[inner], node[inner], candidate[inner]
            skip = _drawn(codes[at], candidate) < limit
            stuck[at] = node * 2 + skip
            node = self.next.data.reshape(-1)[stuck[at]]
            known = node >= 0
            at, node = at[known], node[known]
        return out, stuck


class Encoder:
    """Encodes texts, remembering what the agendas of the words it has met have done."""

    def __init__(self, vocab: Vocabulary, dropout: float = DROPOUT, seed: int = 11, remembered: int = REMEMBERED):
        self.vocab, self.dropout, self.seed, self.remembered = vocab, dropout, seed, remembered
        self.limit = int(dropout * 4294967296)
        self.merges, self.trees = _Merges(vocab), _Trees()

    def _codes(self, keys: list[str], counts: np.ndarray) -> np.ndarray:
        """A key for the hashes of each word's candidates, by document and place."""
        own = [int.from_bytes(blake2b(k.encode(), key=b"%d" % self.seed, digest_size=8).digest(), "little") for k in keys]
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return (mix(np.repeat(np.array(own, np.uint64), counts) + place.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def _grow(self, words: list[str], roots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Run the agendas of these words, none longer than SHORT_WORD and no two taking the same new
        branch, and add what they did to the trees; the leaf of each."""
        trees = self.trees
        leaves = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        classes = np.searchsorted(_WIDTHS, lengths)
        order = np.argsort(classes, kind="stable")
        # Words of about one length, in parts whose tables are not too large.
        new = np.ones(len(order), bool)
        new[1:] = np.diff(classes[order]) != 0
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        new |= (np.arange(len(order)) - first) % AT_ONCE == 0
        for group in np.split(order, np.nonzero(new)[0][1:]):
            shown = "".join([words[r] for r in group.tolist()])
            inside = np.arange(_WIDTHS[classes[group[0]]]) < lengths[group, None]
            chars = np.zeros(inside.shape, np.uint32)
            chars[inside] = np.frombuffer(shown.encode("utf-32-le"), np.uint32)
            ids = np.where(inside, self.merges.single[np.where(chars == ord(" "), ord(_SPACE), chars)], np.int32(-1))
            # The space sign itself, where a text has it, is a word: no piece may stand for it.
            ids[chars == ord(_SPACE)] = self.merges.n + ord(_SPACE)
            node = roots[group]

            def seen(rows, candidate, skipped):
                here = node[rows]
                trees.candidate.data[here] = candidate
                branch = here * 2 + skipped
                following = trees.next.data.reshape(-1)[branch]
                new = following < 0
                made = trees.nodes(int(np.count_nonzero(new)))
                trees.next.data.reshape(-1)[branch[new]] = made
                following[new] = made
                node[rows] = following

            cut = self.merges.cut(ids, codes[group], self.limit, seen)
            flat, sizes = cut[cut >= 0], np.count_nonzero(cut >= 0, axis=1)
            if (flat >= self.merges.n).any():
                flat, sizes = self._as_bytes(flat, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            leaves[group] = trees.leaf.data[node] = trees.ends(flat, sizes)
        return leaves

    def _as_bytes(self, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        out, rows = [], []
        for value, row in zip(flat.tolist(), owner.tolist()):
            found = [value] if value < self.merges.n else [self.vocab.bytes_at[b] for b in chr(value - self.merges.n).encode()]
            out.extend(found)
            rows.extend([row] * len(found))
        return np.array(out, np.int32), np.bincount(rows, minlength=n)

    def encode_flat(self, texts: list[str | None], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text); keys tell apart texts whose words may be cut
        differently."""
        trees = self.trees
        if trees.size() > self.remembered:
            self.trees = trees = _Trees()
        each = [_WORD.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(w) for w in each], np.int64)
        words = list(chain.from_iterable(each))
        codes = self._codes(keys, counts)
        get = trees.roots.get
        node = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        fresh = np.nonzero(node < 0)[0].tolist()
        trees.plant(list({words[r] for r in fresh}))
        node[fresh] = [get(words[r], trees.long) for r in fresh]
        leaf, stuck = trees.walk(node, codes, self.limit)
        missing = np.nonzero((leaf < 0) & (node != trees.long))[0]
        while len(missing):
            # Of the places that take the same new branch one goes first, and the others follow it.
            ahead = np.unique(stuck[missing], return_index=True)[1]
            rows = missing[ahead]
            leaf[rows] = self._grow([words[r] for r in rows.tolist()], node[rows], codes[rows])
            missing = np.delete(missing, ahead)
            leaf[missing], stuck[missing] = trees.walk(node[missing], codes[missing], self.limit)
            missing = missing[leaf[missing] < 0]
        rest = np.nonzero(node == trees.long)[0].tolist()
        if rest:
            cut = [segment(words[r].replace(" ", _SPACE), self.vocab, self.dropout, int(codes[r])) for r in rest]
            leaf[rest] = trees.ends(np.array(list(chain.from_iterable(cut)), np.int32), np.array([len(c) for c in cut]))
        start, stop = trees.bounds.data[leaf], trees.bounds.data[leaf + 1]
        ends = np.cumsum(stop - start)
        total = int(ends[-1]) if len(ends) else 0
        flat = trees.pieces.data[np.repeat(start - (ends - (stop - start)), stop - start) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: list[str | None], keys: list[str]) -> list[bytes | None]:
        """Packed ids of each text."""
        flat, bounds = self.encode_flat(texts, keys)
        return [None if t is None else flat[a:b].tobytes() for t, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist())]


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(vocab: Vocabulary, dropout: float, seed: int) -> Encoder:
    """The encoder of this Python worker, which later tasks of the worker use, too. What it
    remembers changes the time only."""
    key = (vocab.digest, dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab, dropout, seed)
    return _ENCODERS[key]


def encode_pieces(
    docs: DataFrame, model_path: str, dropout: float = DROPOUT, seed: int = 11, text: str = "text", out: str = "ids"
) -> DataFrame:
    """`docs` with `out`, the piece ids of `text`, replacing a column of that name.

    A null text has null ids, an empty one none. With dropout 0 the ids are those of the
    plain merge encoding. Rows with equal doc_id and text are cut alike; other columns pass
    through. `doc_id` only serves to vary the cuts, and may be null.
    """
    rows, kept, run = _encoding(docs, model_path, dropout, seed, text, out, docs.columns)
    return rows.mapInArrow(giving_back(run), docs.select(*kept).schema.add(out, T.ArrayType(T.IntegerType())))


def _encoding(docs: DataFrame, model_path: str, dropout: float, seed: int, text: str, out: str, keep: list[str]):
    """Rows, the columns of them that stay, and what a worker does to encode them."""
    vocab = Vocabulary.load(model_path)
    kept = [c for c in keep if c.lower() != out.lower()]
    # The text goes to the workers once: as the column that is kept, or beside it.
    sent = text in kept and docs.schema[text].dataType == T.StringType()
    shown, key = text if sent else free(docs.columns, "_text"), free(docs.columns, "_key")
    own = [] if sent else [F.col(text).cast("string").alias(shown)]
    rows = docs.select(*kept, *own, F.col("doc_id").cast("string").alias(key))

    def run(batches):
        encoder = worker_encoder(vocab, dropout, seed)
        for batch in batches:
            _, bounds = text_bytes(batch.column(shown))
            for first, last in spans(bounds, ENCODED_AT_ONCE):
                part = batch.slice(first, last - first)
                keys = [k or "" for k in part.column(key).to_pylist()]
                flat, ends = encoder.encode_flat(part.column(shown).to_pylist(), keys)
                nulls = part.column(shown).is_null() if part.column(shown).null_count else None
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=nulls)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], names=[*kept, out])
            pa.default_memory_pool().release_unused()

    return rows, kept, run


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with `out`, the text of the piece ids in `ids`; null for null ids."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    run = _decoding(model_path, kept, ids, out)
    return df.mapInArrow(giving_back(run), df.select(*kept).schema.add(out, "string"))


def encode_and_decode(
    docs: DataFrame, model_path: str, keep: list[str], dropout: float = DROPOUT, seed: int = 11, text: str = "text", ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """The columns `keep` of `docs`, with `ids` and `out` as `encode_pieces` and `decode_pieces` give
    them. One worker of a task does both."""
    keep = [c for c in keep if c.lower() != out.lower()]
    rows, kept, encoded = _encoding(docs, model_path, dropout, seed, text, ids, keep)
    decoded = _decoding(model_path, [*kept, ids], ids, out)
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType())).add(out, "string")
    return rows.mapInArrow(giving_back(lambda batches: decoded(encoded(batches))), schema)


def _decoding(model_path: str, kept: list[str], ids: str, out: str):
    outputs = Vocabulary.load(model_path).outputs()

    def run(batches):
        pool = pa.array(outputs, pa.large_binary())
        for batch in batches:
            bounds = batch.column(ids).offsets.to_numpy().astype(np.int64)
            for first, last in spans(bounds, DECODED_AT_ONCE):
                part = batch.slice(first, last - first)
                lists = part.column(ids)
                # The bytes of all pieces stand one after another; a text ends where its list does.
                pieces = pool.take(lists.flatten())
                _, starts, data = pieces.buffers()
                sizes = np.where(lists.is_valid(), np.diff(bounds[first : last + 1]), 0)
                ends = np.frombuffer(starts, np.int64, len(pieces) + 1)[np.concatenate([[0], np.cumsum(sizes)])]
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data])
                # The first space is the one that encoding puts before every text.
                texts = pc.utf8_slice_codeunits(texts.cast(pa.large_string()), 1).cast(pa.string())
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), texts], names=[*kept, out])
            pa.default_memory_pool().release_unused()

    return run
