"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language reads a text as a sequence of longest
matches. The language whose automaton needs the fewest phrases, each weighed by the bits
that name a place in its sample, wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import held_out
from siteledger.llm.words import LOWER, spans, text_bytes

#: Bounds of the labelled sample of each language: rows, and bytes of all of them. Rows are
#: taken whole or not at all.
SAMPLE_DOCS = 256
SAMPLE_BYTES = 128_000
#: Slots of the transition table that are tried for a state before the first ones are left.
TRIES = 32
#: Bytes of a text that are read side by side, and of all texts that are read at once.
BLOCK_BYTES = 512
AT_ONCE = 1 << 20


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the root."""
    edges, link, length = [{}], [-1], [0]
    last = 0
    for s in symbols:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in edges[at]:
            edges[at][s] = new
            at = link[at]
        if at >= 0:
            to = edges[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(edges)
                edges.append(dict(edges[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and edges[at].get(s) == to:
                    edges[at][s] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return edges


def interleaved(edges: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(table, base): the transitions of all states as one sparse table.

    Each state has a base of its own. The entry at base + symbol is the state's if its upper
    32 bits are the base; the lower ones then are the base of the next state."""
    base = np.zeros(len(edges), np.int64)
    used, based = bytearray(1024), bytearray(1024)
    first, width = 256, 0
    for state in sorted(range(len(edges)), key=lambda i: -len(edges[i])):
        symbols = sorted(edges[state])
        if len(symbols) != width:
            # States with fewer transitions fit into gaps that others left.
            width, first = len(symbols), 256
        low = symbols[0] if symbols else 0
        slots = used if symbols else based
        tries, at = 0, first - 1
        while True:
            at = slots.find(0, at + 1)
            if at < 0 or at + 512 > len(used):
                at = len(used) - 512 if at < 0 else at - 1
                used.extend(bytes(len(used)))
                based.extend(bytes(len(based)))
                continue
            if not tries:
                first = at
            tries += 1
            b = at - low
            if not based[b] and not any(used[b + s] for s in symbols):
                break
        if tries > TRIES:
            first = at
        base[state], based[b] = b, 1
        for s in symbols:
            used[b + s] = 1
    table = np.full(int(base.max(initial=0)) + 256, -1, np.int64)
    for state, some in enumerate(edges):
        b = int(base[state])
        for s, to in some.items():
            table[b + s] = b << 32 | int(base[to])
    return table, base


class CrossParser:
    """The automata of all languages, over all 256 bytes, in one table.

    A state is known by its base in the table. Where a state has no transition, a phrase ends
    before the symbol and the next one starts from the root."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        edges, roots, self.bits = [], [], []
        for lang in self.languages:
            symbols = LOWER[np.frombuffer(samples[lang], np.uint8)].tolist()
            roots.append(len(edges))
            edges += [{s: to + roots[-1] for s, to in some.items()} for some in suffix_automaton(symbols)]
            self.bits.append(np.log2(len(symbols) + 2))
        self.table, base = interleaved(edges)
        self.roots = base[roots]
        self.restart = np.repeat(self.roots[:, None], 256, 1)
        for row, root in enumerate(roots):
            for s, to in edges[root].items():
                self.restart[row, s] = base[to]

    def phrases(self, data: np.ndarray, bounds: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns).

        Blocks of a text are read side by side, each as if a phrase began with it. The phrase
        that is open where a block ends goes on into the next, phrase by phrase, until one
        begins where one of that block's own does; from there on both readings are the same,
        and what the block counted before it is left out."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // block)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[:-1][doc] + nth * block
        stop = np.minimum(start + block, bounds[1:][doc])
        order = np.argsort(start - stop, kind="stable")
        length = (stop - start)[order]
        symbols = LOWER[data]
        n_lang = len(self.languages)
        state = np.repeat(self.roots[:, None], len(doc), 1)
        begins = np.zeros((n_lang, len(symbols)), bool)
        active = np.searchsorted(-length, -np.arange(1, block + 1), "right")
        at = start[order]
        for t in range(int(length[0]) if len(length) else 0):
            n = active[t]
            here = at[:n] + t
            now, symbol = state[:, :n], symbols[here]
            entry = self.table[now + symbol]
            ends = entry >> 32 != now
            begins[:, here] = ends
            state[:, :n] = np.where(ends, self.restart[:, symbol], entry & 0xFFFFFFFF)
        out = np.zeros((n_lang, len(sizes)))
        if not len(doc):
            return out.T
        ended = np.empty_like(state)
        ended[:, order] = state
        begins[:, start] |= nth == 0
        for row in range(n_lang):
            own = begins[row]
            count = np.concatenate([[0], np.cumsum(own)])
            # Where the reading of each block that others follow meets theirs, and its phrases until then.
            place, open_ones = stop.copy(), np.nonzero(nth + 1 < blocks[doc])[0]
            now, extra, limit = ended[row].copy(), np.zeros(len(doc), np.int64), bounds[1:][doc]
            block_start = np.zeros(len(symbols) + 1, bool)
            block_start[start] = True
            while len(open_ones):
                p = place[open_ones]
                symbol = symbols[p]
                entry = self.table[now[open_ones] + symbol]
                ends = entry >> 32 != now[open_ones]
                now[open_ones] = np.where(ends, self.restart[row, symbol], entry & 0xFFFFFFFF)
                extra[open_ones] += ends
                met = ends & (own[p] | block_start[p])
                place[open_ones[~met]] += 1
                open_ones = open_ones[~met]
                open_ones = open_ones[place[open_ones] < limit[open_ones]]
            # From its first phrase that counts, a block counts all it has; met at `place`, in this block.
            last = nth + 1 == blocks[doc]
            target = np.searchsorted(start, place, "right") - 1
            target = np.where(last | (place >= limit), -1, target)
            total = np.zeros(len(sizes))
            if (target[~last] == np.nonzero(~last)[0] + 1).all():
                enter = np.where(nth == 0, start - 1, np.concatenate([[0], place[:-1]]))
                total = np.bincount(doc, count[stop] - count[enter + 1] + extra, len(sizes))
            else:
                for d in np.nonzero(sizes)[0].tolist():
                    k, enter = int(np.searchsorted(doc, d)), int(bounds[d]) - 1
                    while k >= 0:
                        total[d] += count[stop[k]] - count[enter + 1] + extra[k]
                        k, enter = int(target[k]), int(place[k])
            out[row] = total
        return out.T

    def predict(self, texts: pa.Array, block: int = BLOCK_BYTES):
        """(language index, score) of each text; the first language wins ties."""
        raw, every = text_bytes(texts)
        best, score = [], []
        for first, last in spans(every, AT_ONCE):
            bounds = every[first : last + 1] - every[first]
            cost = self.phrases(raw[every[first] : every[last]], bounds, block) * np.array(self.bits)
            winner = cost.argmin(1)
            least = cost[np.arange(len(cost)), winner]
            if cost.shape[1] > 1:
                second = np.partition(cost, 1, 1)[:, 1]
                score.append(np.divide(second, least + second, out=np.full(len(cost), 0.5), where=least + second > 0))
            else:
                score.append(np.ones(len(cost)))
            best.append(winner)
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def language_samples(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Labelled texts of each language, whole: those rows, of the `docs` that come first by a hash
    of their id, that fit into `size` bytes, taken in this order. A language whose first rows are
    all longer has its shortest of them."""
    pick = F.xxhash64("doc_id", F.lit(7))
    rows = labelled.filter("lang IS NOT NULL AND text <> ''").select(
        F.col("lang").cast("string").alias("lang"), pick.alias("pick"), F.octet_length("text").alias("size"), "text"
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", F.xxhash64("text"), "text"))
    # Spark keeps `docs` rows of a language per task before the shuffle.
    first = rows.withColumn("place", place).filter(F.col("place") <= docs)
    fits = F.aggregate(
        F.sort_array(F.collect_list(F.struct("place", "size"))),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("taken")),
        lambda so_far, row: F.when(so_far["sum"] + row["size"] <= size, F.struct((so_far["sum"] + row["size"]).alias("sum"), F.array_append(so_far["taken"], row["place"]).alias("taken"))).otherwise(so_far),
        lambda so_far: so_far["taken"],
    )
    shortest = F.array(F.min_by("place", F.struct("size", "place")))
    taken = first.groupBy("lang").agg(fits.alias("fits"), shortest.alias("one")).select("lang", F.explode(F.when(F.size("fits") > 0, F.col("fits")).otherwise(F.col("one"))).alias("place"))
    chosen = first.join(taken, ["lang", "place"]).select("lang", "place", "text").collect()
    parts: dict[str, list[str]] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["place"])):
        parts.setdefault(row["lang"], []).append(row["text"])
    return {lang: "\n".join(p).encode() for lang, p in parts.items()}


def identify_language(
    docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of `docs(doc_id, text, lang)`.

    Learned from rows that are not held out and have a language; predictions use the text
    alone, in whole. A null text or one without a letter is `und` with score 0, as is every
    text if no language was learned. Rows may repeat; other columns are ignored. The
    automata know all bytes of the samples; they have two states and three transitions per
    byte of sample at most, and their table 8 bytes per transition and for each gap.
    """
    samples = language_samples(docs.filter(~held_out()), docs_per_language, size)
    parser = CrossParser(samples)
    names = pa.array([*parser.languages, "und"])

    def run(batches):
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            if parser.languages:
                best, score = parser.predict(batch.column("text"))
            else:
                best, score, letters = np.zeros(len(letters), int), np.zeros(len(letters)), letters & False
            best = np.where(letters, best, len(parser.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(best)), pa.array(np.where(letters, score, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id", held_out().alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
