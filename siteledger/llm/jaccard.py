"""Exact Jaccard join on word shingles, by adaptive multi-match prefixes.

Every shingle is a 64-bit hash, and the hash order is the global order of tokens. Two
sets with Jaccard similarity of at least `threshold` share, for every m >= 1, at least m
tokens among the first `prefix(n, m)` of each, where prefix(n, m) = n - ceil(threshold * n)
+ m. A longer prefix asks for more shared tokens, so what merely shares a common line or
passage fails it. How far a document's prefix is lengthened follows from the cost of its
candidates, estimated from the counts of its prefix tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import Workspace, giving_back
from siteledger.llm.words import grams, mix, pieces, range_hashes

SHINGLE_WORDS = 4
THRESHOLD_PERCENT = 85
#: Shared tokens asked for, as a share of the set, at each level of lengthening (plus one).
LEVELS = (0, 40, 20)
#: Documents a prefix token may bring in before its document goes to the next level.
COST_STEP = 2.0
#: Centres each class is verified against before the completion.
STAR_TRIES = 2
#: Bytes of rows that a Python worker gets at once.
AT_ONCE = 1 << 22


def shingle_sets(texts: pa.Array, width: int):
    """Piece by piece: its first row, and the sorted distinct shingle hashes of each of its texts,
    A-Z in lower case.

    A text with fewer words than `width` has its whole word sequence as one shingle; one
    without words has none."""
    for piece in pieces(texts, lower=True):
        words = piece.word_hashes()
        runs = grams(words, width)
        sets = []
        for d in range(piece.last - piece.first):
            a, b = piece.words[d], piece.words[d + 1]
            if b - a >= width:
                found = np.unique(runs[a : b - width + 1])
            elif b > a:
                found = range_hashes(words[a:b], np.array([0]), np.array([b - a]))
            else:
                found = words[:0]
            sets.append(found)
        yield piece.first, sets


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set that do not depend on order; 0, 0 for the empty set."""
    one = mix(found).sum(dtype=np.uint64)
    two = mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    both = mix(np.array([one, two + np.uint64(len(found))], dtype=np.uint64)).view(np.int64)
    return (int(both[0]), int(both[1])) if len(found) else (0, 0)


def level_matches(n, level: int):
    """Tokens two sets must share at a level; works on numbers and on columns."""
    share = LEVELS[level]
    if not share:
        return 1 if isinstance(n, int) else F.lit(1)
    return 1 + n // share if isinstance(n, int) else F.lit(1) + (n / share).cast("int")


def prefix_base(n: int, percent: int) -> int:
    """Length of the prefix for one match, less that match."""
    return n - (n * percent + 99) // 100


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64), pa.int64()))


def _sets(width: int, percent: int):
    names = ["doc_id", "row", "n", "k1", "k2", "prefix"]

    def prefix(found):
        # The partner may be larger, and ask for more.
        matches = level_matches(len(found) * 100 // percent + 1, len(LEVELS) - 1)
        return found[: prefix_base(len(found), percent) + matches]

    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                keys = np.array([set_keys(found) for found in sets], dtype=np.int64)
                sizes = pa.array([len(found) for found in sets], pa.int32())
                own = [batch.column(c).slice(first, len(sets)) for c in ("doc_id", "row")]
                columns = [*own, sizes, pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists([prefix(found) for found in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                keys = pa.array([set_keys(found)[0] for found in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(first, len(sets)), keys, _lists(sets)], names=["cls", "k1", "tokens"])

    return run


def _linked(shared: Column, n1: Column, n2: Column, percent: int) -> Column:
    return shared * 100 >= (n1 + n2 - shared) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets are similar enough, by their whole sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_ta", "_tb"))
    return both.filter(_linked(shared, F.size("_ta"), F.size("_tb"), percent)).select("a", "b")


def _roots(work: Workspace, parents: DataFrame, name: str) -> DataFrame:
    """(cls, comp): the end of each chain of `parents(a, b)`, where b is the one parent of
    a, and chains do not close. Chains halve in each round."""
    step, rounds = parents.select("a", "b"), 0
    while True:
        up = step.select(F.col("a").alias("b"), F.col("b").alias("_bb"))
        jumped = step.join(up, "b", "left").select(
            "a", F.coalesce("_bb", "b").alias("b"), F.col("_bb").isNotNull().alias("_moved")
        )
        jumped = work.keep(f"{name}-{rounds}", jumped)
        if jumped.filter("_moved").isEmpty():
            return jumped.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
        step, rounds = jumped.select("a", "b"), rounds + 1


def merge_labels(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(old, new): the smallest node reachable over `edges(a, b)` from each node in them.

    Each round hooks every node to the smallest label among its neighbours and itself and
    then follows that label once; it ends when no label changes."""
    both = work.keep(
        f"{name}-edges",
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
    )
    labels, rounds = both.groupBy(F.col("a").alias("old")).agg(F.least(F.col("old"), F.min("b")).alias("new")), 0
    while True:
        labels = work.keep(f"{name}-labels-{rounds}", labels)
        near = both.join(labels.select(F.col("old").alias("b"), "new"), "b").groupBy(F.col("a").alias("old"))
        best = near.agg(F.min("new").alias("_near"))
        hooked = labels.join(best, "old").select("old", F.least("new", "_near").alias("_mid"), F.col("new").alias("_was"))
        far = labels.select(F.col("old").alias("_mid"), F.col("new").alias("_far"))
        after = hooked.join(far, "_mid", "left").select(
            "old", F.least("_mid", "_far").alias("new"), "_was"
        )
        after = work.keep(f"{name}-round-{rounds}", after)
        if after.filter("new <> _was").isEmpty():
            return after.select("old", "new")
        labels, rounds = after.select("old", "new"), rounds + 1


def jaccard_components(
    docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs(doc_id, text)`.

    Links join rows whose sets of distinct `width`-word shingles have a Jaccard similarity
    of at least `percent` / 100; component_id is the smallest doc_id reachable by links, null if
    no row reached has one. Null and empty texts have no shingles and no links. Rows with equal
    sets are one class from the start, whatever their number. Rows that repeat a doc_id or have
    none are judged by their own text, and link others like any row. Other columns of `docs` are
    ignored.

    1. Classes: rows with equal sets, by two 64-bit hashes of the set.
    2. Live tokens: those in prefixes of two classes or more. A class stays only if, at each
       level its candidate cost takes it to, it has as many live tokens as a partner must share.
    3. Held tokens: for the classes that stay the prefix is lengthened to the whole set. The
       tokens that another of them has too bound what a class can share with any other.
    4. Stars: each class is verified against those it meets most often as the least changed
       holder of its tokens. A few pairs per class, so a large group of near copies costs in
       proportion to its members, and becomes one component.
    5. Completion: by counts now known, the rarest tokens come first. Pairs across components
       whose prefixes share enough of the tokens that several components hold are verified.
       No link is lost, since a pair in one component needs none.
    """
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows may share a doc_id or have none; a class finds its text by a row of its own.
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    rows = work.keep(
        "rows",
        texts.mapInArrow(giving_back(_sets(width, percent)), "doc_id long, row long, n int, k1 long, k2 long, prefix array<long>"),
        AT_ONCE,
    )
    classes = work.keep(
        "classes",
        rows.filter("n > 0")
        .groupBy("k1", "k2", "n")
        .agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("prefix").alias("prefix"))
        .select(F.col("k1").alias("cls"), "k2", "n", "rep", "row", "prefix"),
    )
    live = work.keep("live", _live(classes, percent))
    sets = work.keep(
        "sets",
        texts.join(live.select("cls", "row"), "row")
        .select("cls", "text")
        .mapInArrow(giving_back(_full_sets(width)), "cls long, k1 long, tokens array<long>")
        .filter("cls = k1")
        .groupBy("cls")
        .agg(F.first("tokens").alias("tokens")),
        AT_ONCE,
    )
    held = work.keep("held", _held(sets, percent))
    meets = work.keep("meets", live.join(held, "cls").select("cls", "n", "held", F.inline("live")))
    parents = work.keep("stars", _verified(_stars(meets), sets, percent))
    roots = _roots(work, parents.groupBy("a").agg(F.min("b").alias("b")), "roots")
    across = work.keep("across", _verified(_across(work, sets, held, roots, percent), sets, percent))
    comps = held.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))
    if not across.isEmpty():
        ends = across.join(comps.withColumnsRenamed({"cls": "a", "comp": "_ca"}), "a").join(
            comps.withColumnsRenamed({"cls": "b", "comp": "_cb"}), "b"
        )
        merged = merge_labels(work, ends.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")), "merge")
        comps = comps.join(merged.withColumnsRenamed({"old": "comp"}), "comp", "left").select(
            "cls", F.coalesce("new", "comp").alias("comp")
        )
    labelled = classes.select("cls", "k2", "n", "rep").join(comps, "cls", "left")
    labelled = labelled.select("cls", "k2", "n", "rep", F.coalesce("comp", "cls").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = labelled.join(smallest, "comp").select(F.col("cls").alias("k1"), "k2", "n", "component_id")
    out = rows.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _base(percent: int) -> Column:
    return F.expr(f"n - CAST((n * {percent}L + 99) DIV 100 AS INT)")


def _live(classes: DataFrame, percent: int) -> DataFrame:
    """(cls, n, row, live): the classes that may have partners, with their live prefix tokens
    (token, pos)."""
    tokens = classes.select("cls", "n", "row", F.posexplode("prefix").alias("pos", "token"))
    shared = (
        tokens.groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter("df > 1")
    )
    per_class = (
        tokens.join(shared, "token")
        .groupBy("cls", "n", "row")
        .agg(
            F.collect_list(F.struct("token", "pos")).alias("live"),
            F.sum(F.when(F.col("pos") <= _base(percent), F.col("df") - 1).otherwise(0)).alias("_cost"),
        )
    )
    stays = F.lit(True)
    for level in range(len(LEVELS)):
        matches = level_matches(F.col("n"), level)
        enough = F.size(F.filter("live", lambda t, m=matches: t["pos"] < _base(percent) + m)) >= matches
        # A level is tried once the candidates that the shorter prefix lets in cost enough.
        stays = stays & (enough | (F.col("_cost") < (COST_STEP * level if level else 0)))
    return per_class.filter(stays).drop("_cost")


def _held(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, held): how many tokens of a class another class has too, where they are enough
    for a link."""
    tokens = sets.select("cls", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    counts = tokens.join(shared, "token").groupBy("cls").agg(F.count(F.lit(1)).alias("held"))
    sizes = sets.select("cls", F.size("tokens").alias("_n"))
    return counts.join(sizes, "cls").filter(F.col("held") * 100 >= F.col("_n") * percent).select("cls", "held")


def _stars(meets: DataFrame) -> DataFrame:
    """(a, b): each class with the STAR_TRIES classes it meets most often as the holder of a
    token that has the fewest tokens of its own. b comes before a in that order, always."""
    changed = F.struct((F.col("n") - F.col("held")).alias("own"), F.col("cls").alias("pivot"))
    centres = meets.groupBy("token").agg(F.min(changed).alias("centre"))
    tries = (
        meets.join(centres, "token")
        .filter("centre.pivot <> cls")
        .groupBy("cls", "centre")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("_n"), "centre"))
    best = tries.withColumn("_place", place).filter(F.col("_place") <= STAR_TRIES)
    return best.select(F.col("cls").alias("a"), F.col("centre.pivot").alias("b"))


def _across(work: Workspace, sets: DataFrame, held: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different components that share as many prefix tokens as their
    level asks for.

    The order of tokens is by count here, rarest first. Tokens that only one component
    holds cannot be shared across, and come before all others. A pair shares at least
    need = ceil(percent * (n1 + n2) / (100 + percent)) tokens, and so m of them within the
    first n - need + m of each, for every m. Pairs meet in the shortest prefix (m = 1)."""
    members = sets.join(held.select("cls"), "cls").join(roots, "cls", "left")
    members = members.select("cls", F.size("tokens").alias("n"), F.coalesce("comp", "cls").alias("comp"), "tokens")
    rows = members.select("cls", "n", "comp", F.explode("tokens").alias("token"))
    tokens = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")
    )
    several = tokens.filter("_lo <> _hi").select("token", "df")
    ranked = (
        rows.join(several, "token")
        .groupBy("cls", "n", "comp")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("live"))
        .filter(F.size("live") * 100 >= F.col("n") * percent)
    )
    base = _base(percent)
    free = F.col("n") - F.size("live")
    # Only the shortest prefix is taken apart: each of its tokens carries the longer one.
    shortest = F.slice("live", F.lit(1), F.greatest(F.lit(0), base + 1 - free))
    cost = F.aggregate(
        shortest,
        F.lit(0.0),
        lambda total, t: total + t["df"] - 1,
    )
    # A class whose shortest prefix brings in more than its size asks for more matches.
    level = F.when(cost > COST_STEP * F.col("n"), len(LEVELS) - 2).otherwise(0)
    longest = base + level_matches(F.floor(F.col("n") * 100 / percent) + 1, len(LEVELS) - 2)
    longer = F.transform(F.slice("live", F.lit(1), F.greatest(F.lit(0), longest - free)), lambda t: t["token"])
    prefix = ranked.select(
        "cls", "n", "comp", level.alias("level"), free.alias("free"), longer.alias("longer"), F.posexplode(F.transform(shortest, lambda t: t["token"])).alias("_at", "token")
    ).select("cls", "n", "comp", "level", "longer", (F.col("free") + F.col("_at")).alias("pos"), "token")
    prefix = work.keep("prefix", prefix)
    sides = [
        prefix.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("cls", "n", "comp", "level", "longer", "pos")))
        for i in (1, 2)
    ]
    matches = level_matches(F.greatest("n1", "n2"), len(LEVELS) - 2)
    need = F.expr(f"CAST(((n1 + n2) * {percent}L + {99 + percent}) DIV {100 + percent} AS INT)")
    near = (
        (F.col("cls1") < F.col("cls2"))
        & (F.col("comp1") != F.col("comp2"))
        & (F.col("pos1") <= F.col("n1") - need)
        & (F.col("pos2") <= F.col("n2") - need)
        # Of costly classes, the lengthened prefixes must share as many more.
        & ((F.greatest("level1", "level2") == 0) | (F.size(F.array_intersect("longer1", "longer2")) >= matches))
    )
    met = sides[0].join(sides[1], "token").filter(near)
    return met.select(F.col("cls1").alias("a"), F.col("cls2").alias("b")).distinct()
