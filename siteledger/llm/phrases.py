"""Substring dedup: words covered by a passage that also starts earlier are removed.

Passages are windows of `width` consecutive words. Each window belongs to its anchor, the
run of `anchor` words in it with the smallest hash (the leftmost of equals); the windows of
one anchor are neighbours, and together make its span. Equal windows have equal anchors at
equal places, so two windows can only be equal if their spans share the anchor.

Recurring passages are confirmed by the hashes of whole spans and whole windows. They are
then sent to the shards of documents that hold them, each shard compiles an Aho-Corasick
automaton over the words of its own passages, and all its documents are streamed through.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siteledger.functions.names import free
from siteledger.llm.common import Workspace, giving_back
from siteledger.llm.words import Ranges, grams, pieces, range_hashes

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
#: Bytes of text that one shard, and so one automaton, is meant to hold. A longer text has
#: a shard of its own.
SHARD_BYTES = 4 << 20

#: The place of rows without doc_id: after all others.
_LAST = (1 << 63) - 1


def _leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the place of its smallest, leftmost of equals."""
    n = len(hashes) - width + 1
    at = np.arange(len(hashes))
    size = 1
    # Doubling: `at[i]` is the answer for the run of `size` from i.
    while size * 2 <= width:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(hashes[b] < hashes[a], b, a)
        size *= 2
    a, b = at[:n], at[width - size : width - size + n]
    return np.where(hashes[b] < hashes[a], b, a)


def spans_of(texts: pa.Array, width: int, anchor: int):
    """(row, start, length, times, anchor hash, span hash) of the spans, as arrays per piece.

    Equal spans of a row are given once, at the first of their places."""
    for piece in pieces(texts):
        hashes = piece.word_hashes()
        runs = grams(hashes, anchor)
        per_window = width - anchor + 1
        if len(hashes) < width:
            continue
        best = _leftmost_minima(runs, per_window)
        window_doc = piece.doc[: len(best)]
        whole = window_doc == piece.doc[width - 1 :]
        starts = np.nonzero(whole)[0]
        if not len(starts):
            continue
        best, window_doc = best[starts], window_doc[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (best[1:] != best[:-1]) | (window_doc[1:] != window_doc[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(starts)) - 1
        begin, end = starts[first], starts[last] + width
        doc = window_doc[first]
        key = range_hashes(hashes, begin, end)
        pair = np.stack([key, doc.astype(np.uint64)], 1).ravel()
        even = np.arange(0, 2 * len(key), 2)
        # The earliest of equal spans of a row comes first and is the one np.unique keeps.
        _, keep, times = np.unique(range_hashes(pair, even, even + 2), return_index=True, return_counts=True)
        yield (
            piece.first + doc[keep],
            (begin - piece.words[doc])[keep].astype(np.int32),
            (end - begin)[keep].astype(np.int32),
            times.astype(np.int32),
            runs[best[first]][keep].view(np.int64),
            key[keep].view(np.int64),
        )


def _spans(width: int, anchor: int):
    keys = ["shard", "row", "doc_id"]

    def run(batches):
        for batch in batches:
            for row, *values in spans_of(batch.column("text"), width, anchor):
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in keys), *map(pa.array, values)],
                    names=[*keys, "start", "len", "times", "anchor", "span"],
                )

    return run


def _windows(width: int):
    """The windows of the spans listed in `places` of each row, by hash. A place whose span does
    not stand in the row belongs to another row with the same key."""
    keys = ["shard", "row", "doc_id"]

    def run(batches):
        for batch in batches:
            places = batch.column("places")
            bounds = places.offsets.to_numpy()
            anchors, starts, lengths, checks = (places.values.field(f).to_numpy() for f in ("anchor", "start", "len", "span"))
            for piece in pieces(batch.column("text")):
                hashes = piece.word_hashes()
                runs = grams(hashes, width)
                a, b = bounds[piece.first], bounds[piece.last]
                owner = np.repeat(np.arange(piece.last - piece.first), np.diff(bounds[piece.first : piece.last + 1]))
                begin = piece.words[owner] + starts[a:b]
                fits = begin + lengths[a:b] <= piece.words[owner + 1]
                fits[fits] = range_hashes(hashes, begin[fits], (begin + lengths[a:b])[fits]).view(np.int64) == checks[a:b][fits]
                counts = np.where(fits, lengths[a:b] - width + 1, 0)
                span = np.repeat(np.arange(b - a), counts)
                inner = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = pa.array(piece.first + owner[span])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchors[a:b][span]),
                        pa.array(runs[begin[span] + inner].view(np.int64)),
                        *(batch.column(k).take(rows) for k in keys),
                        pa.array((starts[a:b][span] + inner).astype(np.int32)),
                    ],
                    names=["anchor", "window", *keys, "start"],
                )

    return run


#: Characters a word is spelled with. A node of the automaton looks through its branches one by
#: one, so the alphabet is kept to a root of the number of words.
SPELLED = 2


def spelled(codes: np.ndarray) -> str:
    """Words as SPELLED characters each. `codes` are numbers of words, -1 stands for a word of no
    passage or the end of a row. The characters of each place in a word are its own, so no match
    begins inside one."""
    base = max(1, int(np.ceil((int(codes.max(initial=0)) + 1) ** (1 / SPELLED))))
    out = np.zeros((len(codes), SPELLED), "<u4")
    words, rest = codes >= 0, codes[codes >= 0]
    for place in range(SPELLED):
        at = 1 + place * base + rest % base
        # Past the surrogates.
        out[words, place] = np.where(at < 0xD800, at, at + 0x800)
        rest = rest // base
    return out.tobytes().decode("utf-32-le")


def occurrences(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, passage) of every place in the words `codes` where a passage stands. Passage k is the
    `size[k]` words from `begin[k]`; an automaton of all of them reads the words once."""
    inside = np.zeros(len(codes) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size, -1)
    # Only the words of passages are told apart.
    known = np.unique(codes[np.cumsum(inside)[:-1] > 0])
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    text = spelled(np.where(known[at] == codes, at, -1))
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, (a, b) in enumerate(zip((begin * SPELLED).tolist(), ((begin + size) * SPELLED).tolist())):
        found.add_word(text[a:b], k)
    found.make_automaton()
    pairs = np.array(list(found.iter(text)), np.int64).reshape(-1, 2)
    return (pairs[:, 0] + 1) // SPELLED, pairs[:, 1]


def _places_of(keys: np.ndarray, first: np.ndarray, hashes: np.ndarray, listed: pa.Table):
    """Where the listed passages stand in the words of a shard: (begin, size, index in the list).

    A passage is in a row of its key; of rows that share a key, in one where its hash is found."""
    key, start, size, check = (listed.column(c).to_numpy() for c in ("row", "start", "len", "check"))
    ranges = Ranges(hashes)
    order = np.argsort(keys, kind="stable")
    at = np.searchsorted(keys[order], key)
    begin, open_ones = np.full(len(key), -1), np.arange(len(key))
    while len(open_ones):
        inside = at[open_ones] < len(order)
        inside[inside] = keys[order[at[open_ones[inside]]]] == key[open_ones[inside]]
        open_ones = open_ones[inside]
        row = order[at[open_ones]]
        a = first[row] + start[open_ones]
        b = a + size[open_ones]
        fits = b <= first[row + 1]
        fits[fits] = ranges.of(a[fits], b[fits]).view(np.int64) == check[open_ones[fits]]
        begin[open_ones[fits]] = a[fits]
        open_ones = open_ones[~fits]
        at[open_ones] += 1
    known = np.nonzero(begin >= 0)[0]
    return begin[known], size[known].astype(np.int64), known


def _joined(piece, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of the words that stay, joined by one space."""
    start, end, doc = piece.start[stay], piece.end[stay], piece.doc[stay]
    size = end - start + 1
    stop = np.cumsum(size)
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for a in range(0, len(start), 1 << 18):
        b = min(a + (1 << 18), len(start))
        base = int(stop[a] - size[a])
        n = int(stop[b - 1]) - base
        from_ = np.repeat(start[a:b] - (stop[a:b] - size[a:b] - base), size[a:b]) + np.arange(n)
        out[base : base + n] = piece.data[np.minimum(from_, len(piece.data) - 1)]
    out[stop - 1] = 0x20
    keep = np.ones(len(out), bool)
    keep[stop[last] - 1] = False
    sizes = np.bincount(doc, size - last, piece.last - piece.first).astype(np.int64)
    return out[keep], sizes


def _remove(schema: pa.Schema, others: list[str], doc: str, row: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column(doc).fill_null(_LAST).to_numpy()
        parts = list(pieces(left.column("text").combine_chunks()))
        counts = np.concatenate([np.diff(p.words) for p in parts] or [np.zeros(0, np.int64)])
        first = np.concatenate([[0], np.cumsum(counts)])
        gone = np.zeros(first[-1], bool)
        if right.num_rows and first[-1]:
            hashes = np.concatenate([p.word_hashes() for p in parts])
            right = right.combine_chunks()
            begin, size, k = _places_of(left.column(row).to_numpy(), first, hashes, right)
            first_doc, first_start, check = (right.column(c).to_numpy()[k] for c in ("first_doc", "first_start", "check"))
            # Equal passages keep their earliest place.
            order = np.lexsort((first_start, first_doc, size, check))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(check[order]) != 0) | (np.diff(size[order]) != 0)
            begin, size, first_doc, first_start = (x[order[new]] for x in (begin, size, first_doc, first_start))
            # A row end stands after each row, so word w of row r is at w + r.
            owner = np.repeat(np.arange(len(counts)), counts)
            codes = np.full(first[-1] + len(counts), -1)
            codes[np.arange(first[-1]) + owner] = np.unique(hashes, return_inverse=True)[1]
            end, which = occurrences(codes, begin + owner[begin], size) if len(begin) else (begin, begin)
            start = end - size[which]
            at = np.searchsorted(first + np.arange(len(first)), start, "right") - 1
            inner = start - first[at] - at
            earlier = (first_doc[which] < ids[at]) | ((first_doc[which] == ids[at]) & (first_start[which] < inner))
            edge = np.bincount(start[earlier], minlength=len(codes) + 1) - np.bincount(end[earlier], minlength=len(codes) + 1)
            gone = (np.cumsum(edge)[:-1] > 0)[codes >= 0]
        removed = np.bincount(np.repeat(np.arange(len(counts)), counts), gone, len(counts)).astype(np.int64)
        kept, done = [], 0
        for p in parts:
            data, sizes = _joined(p, np.nonzero(~gone[done : done + len(p.start)])[0])
            done += len(p.start)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            kept.append(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(data)))
        columns = [left.column(c) for c in others]
        return pa.Table.from_arrays(
            [*columns, pa.array(counts, pa.int64()), pa.array(removed), pa.chunked_array(kept, pa.string()).cast(schema.field("kept").type)],
            schema=schema,
        )

    return run


def remove_repeats(
    docs: DataFrame, width: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """`docs` with n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if a window of `width` words covers it whose word sequence also starts
    earlier: at a smaller doc_id, or at the same doc_id and a smaller place. Windows are
    judged on the texts as given. Null and empty texts have no words and keep "". Texts
    shorter than a window keep all words. Rows that repeat a doc_id are places of one document,
    whether their texts are alike or not, and so are rows without doc_id, which come after all
    others; windows at equal places leave each other alone. Other columns pass through; columns
    named like a result are replaced.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    text = F.col("text").cast("string")
    # Rows are told apart by their text as well, as they may repeat a doc_id or have none.
    row = F.xxhash64(doc, text)
    shard = F.pmod(row, F.lit(shards)).cast("int")
    texts = docs.select(shard.alias("shard"), row.alias("row"), doc.alias("doc_id"), text.alias("text"))
    spans = work.keep(
        "spans",
        texts.mapInArrow(
            giving_back(_spans(width, anchor)), "shard int, row long, doc_id long, start int, len int, times int, anchor long, span long"
        ),
    )
    anchors = spans.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    recurring = work.keep("recurring", spans.join(anchors, "anchor"))
    work.drop(["spans"])
    place = F.struct("doc_id", "start", "row")
    firsts = work.keep(
        "firsts",
        recurring.groupBy("anchor", "span").agg(
            F.min(place).alias("first"), F.sum("times").alias("n"), F.max("len").alias("len")
        ),
    )
    again = F.expr("times > 1 OR doc_id <> first.doc_id OR start <> first.start")
    of_spans = (
        recurring.join(firsts.filter("n > 1").select("anchor", "span", "first"), ["anchor", "span"])
        .filter(again)
        .groupBy("shard", "anchor", "span")
        .agg(F.min(F.struct("row", "start", "len")).alias("here"), F.first("first").alias("first"))
        .select("shard", "here.*", "first", F.col("span").alias("check"))
    )
    # Different spans with one anchor may still share windows.
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("anchor")
    places = (
        firsts.join(several, "anchor")
        .groupBy(F.col("first.row").alias("row"))
        .agg(F.collect_list(F.struct("anchor", F.col("first.start").alias("start"), "len", "span")).alias("places"))
    )
    windows = work.keep(
        "windows",
        texts.join(places, "row")
        .select("shard", "row", "doc_id", "text", "places")
        .mapInArrow(giving_back(_windows(width)), "anchor long, window long, shard int, row long, doc_id long, start int"),
    )
    earliest = (
        windows.groupBy("anchor", "window")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    of_windows = (
        windows.join(earliest, ["anchor", "window"])
        .filter("doc_id <> first.doc_id OR start <> first.start")
        .groupBy("shard", "anchor", "window")
        .agg(F.min(F.struct("row", "start")).alias("here"), F.first("first").alias("first"))
        .select("shard", "here.*", F.lit(width).alias("len"), "first", F.col("window").alias("check"))
    )
    matches = work.keep(
        "matches",
        of_spans.unionByName(of_windows).select(
            "shard", "row", "start", "len", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"), "check"
        ),
    )
    work.drop(["recurring", "firsts", "windows"])
    others = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    names = [free(others, n) for n in ("_shard", "_doc", "_row")]
    left = docs.select(*others, shard.alias(names[0]), F.col("doc_id").cast("long").alias(names[1]), row.alias(names[2]))
    shape = T.StructType(
        [
            *(docs.schema[c] for c in others),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    schema = to_arrow_schema(shape)
    return (
        left.groupBy(names[0])
        .cogroup(matches.withColumnRenamed("shard", names[0]).groupBy(names[0]))
        .applyInArrow(_remove(schema, others, *names[1:]), shape)
    )
