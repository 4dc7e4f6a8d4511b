"""Merkle manifest of a dataset: a persistent tree with path copying.

Every row is a leaf; the leaves of a source, by doc_id, form a tree of 16 children a node, and
the roots of the sources form one more. A changed leaf makes a version of the tree of its own:
it copies its ancestors and shares every other node with the original.

Leaves meet in aligned blocks of 16^3. A first pass folds each block into its top node; the
tops, far fewer, are leaves of a tree that is folded the same way. Going back down, every block
learns what stands beside its ancestors, and a second pass over the blocks copies the paths of
all its versions up to the root. No task ever holds more than a block and its path.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import Workspace

FAN = 16
#: Levels that one block spans.
LEVELS = 3
#: One entry per level upwards: the digests, as hex text, left and right of a node in its run.
PATH = "array<struct<left: string, right: string>>"


def encoded(column: Column) -> Column:
    """A value with its length: `-` for null, else UTF-8 byte count, colon, value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)).cast("binary"), 256)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int, fan: int) -> int:
    """Levels above `n` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def fold(nodes: list[str], levels: int, fan: int) -> list[list[str]]:
    """The nodes and the `levels` levels above them; the last run of a level may be short."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_digest("".join(below[i : i + fan])) for i in range(0, len(below), fan)])
    return out


def beside(tree: list[list[str]], place: int, fan: int) -> list[tuple[str, str]]:
    """(left, right) siblings of a node and of its ancestors within a folded block."""
    out = []
    for level in tree[:-1]:
        first = place - place % fan
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + fan])))
        place //= fan
    return out


def copied(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version with another leaf has of its own, bottom up."""
    out = []
    for left, right in path:
        leaf = _digest(left + leaf + right)
        out.append(leaf)
    return out


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _tops(fan: int, levels: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        n, start = rows.column("n")[0].as_py(), rows.column("pos")[0].as_py()
        tree = fold(rows.column("node").to_pylist(), min(levels, levels_of(n, fan)), fan)
        block = start // fan**levels
        above = -(-n // fan**levels)
        return pa.table(
            {"tree": rows.column("tree").slice(0, 1), "pos": pa.array([block], pa.int64()), "n": pa.array([above], pa.int64()), "node": pa.array(tree[-1])}
        )

    return run


def _paths(fan: int, levels: int):
    """Nodes of a block with what stands beside them and their ancestors, up to the root."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        nodes = rows.column("node").to_pylist()
        tree = fold(nodes, min(levels, levels_of(rows.column("n")[0].as_py(), fan)), fan)
        rest = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
        paths = [[{"left": a, "right": b} for a, b in [*beside(tree, i, fan), *rest]] for i in range(len(nodes))]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": rows.column("tree"), "pos": rows.column("pos"), "root": pa.array([above.column("root")[0].as_py()] * len(nodes)), "path": pa.array(paths, kind)})

    return run


class Tree:
    """A forest of Merkle trees over `nodes(tree, pos, n, node)`: `pos` counts from 0 within a
    tree of `n` nodes."""

    def __init__(self, nodes: DataFrame, work: Workspace, fan: int = FAN, levels: int = LEVELS, name: str = "tree"):
        self.work, self.fan, self.levels, self.name = work, fan, levels, name
        block = fan**levels
        self.floors = [nodes]
        while True:
            below = self.floors[-1].withColumn("block", F.floor(F.col("pos") / block))
            tops = below.groupBy("tree", "block").applyInArrow(_tops(fan, levels), "tree string, pos long, n long, node string")
            self.floors.append(work.keep(f"{name}-{len(self.floors)}", tops))
            if not self.floors[-1].filter("n > 1").head(1):
                break

    def roots(self) -> DataFrame:
        """(tree, root)"""
        return self.floors[-1].select("tree", F.col("node").alias("root"))

    def paths(self, top: DataFrame | None = None) -> DataFrame:
        """(tree, pos, root, path) of the block tops: what stands beside them and their ancestors.
        `top(tree, path)` continues each tree beyond its root."""
        if top is None:
            top = self.roots().select("tree", F.expr(f"CAST(array() AS {PATH})").alias("path"))
        roots = self.roots().join(top, "tree")
        above = roots.select("tree", F.lit(0).cast("long").alias("pos"), "root", "path")
        for i in reversed(range(1, len(self.floors) - 1)):
            below = self.floors[i].withColumn("block", F.floor(F.col("pos") / self.fan**self.levels))
            held = above.select("tree", F.col("pos").alias("block"), "root", "path")
            found = below.groupBy("tree", "block").cogroup(held.groupBy("tree", "block"))
            above = found.applyInArrow(_paths(self.fan, self.levels), f"tree string, pos long, root string, path {PATH}")
            above = self.work.keep(f"{self.name}-path-{i}", above)
        return above


def _ranked(rows: DataFrame, by: list[str], order: list[str], work: Workspace, name: str) -> DataFrame:
    """`rows` with pos, the place within `by` under `order`, and n, the rows of `by`. No group
    is held by one task: places are counted within sorted ranges, and ranges added up."""
    keys = [*by, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = work.keep(name, sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n")
    )
    joined = placed.join(runs, [*by, "_part"])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), F.col("n"))


def _versions(fan: int, levels: int):
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        leaves, changed = rows.column("node").to_pylist(), rows.column("changed").to_pylist()
        n = rows.column("n")[0].as_py()
        tree = fold(leaves, min(levels, levels_of(n, fan)), fan)
        subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
        rest = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
        rest_proof = "".join(a + b for a, b in rest)
        proofs, folded, versions = [], [], []
        for i, (leaf, other) in enumerate(zip(leaves, changed)):
            path = beside(tree, i, fan)
            proofs.append(_digest("".join([a + b for a, b in path]) + rest_proof))
            own = copied(leaf if other is None else other, [*path, *rest])
            folded.append(own[-1] if own else leaf if other is None else other)
            versions.append(own if other is not None and other != leaf else None)
        same = lambda v: pa.array([v] * len(leaves))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "leaf": rows.column("node"), "subroot": same(subroot), "root": same(root),
                "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "copied": pa.array(versions, pa.list_(pa.string())),
            }
        )

    return run


def dataset_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, copied) of each row of
    `docs(doc_id, source, lang, n_chars, text)`.

    Leaf: digest of these five values. Leaves of a source ascend by doc_id (null first), rows
    that repeat one by leaf, so equal rows may change places without any effect. The sources
    ascend bytewise, null first; a null source is one. `proof_sha256` is the digest of all
    siblings on the way to the root.

    `changed` gives other expressions for some of the columns; where `when` holds (null: it
    does not), the row's leaf is made of them in a version of the tree that changes this
    leaf only. `folded_root` is the root of that version, `copied` the digests of the nodes it
    has of its own, from the leaf's parent to the root; it is null where the leaf stayed
    the same. Other columns are ignored. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    changed, when = changed or {}, F.lit(False) if when is None else when
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_digest(*(F.col(c) for c in names))
    other = F.when(when, leaf_digest(*(changed.get(c, F.col(c)) for c in names)))
    # Null first: no other key is empty.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf.alias("node"), other.alias("changed"))
    leaves = work.keep("leaves", _ranked(rows, ["tree"], ["doc_id", "node"], work, "sorted"))
    work.drop(["sorted"])
    trees = Tree(leaves.select("tree", "pos", "n", "node"), work, fan, levels, "source")
    tops = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    tops = work.keep("subroots", _ranked(tops, ["tree"], ["source"], work, "sorted-sources"))
    whole = Tree(tops.select("tree", "pos", "n", "node"), work, fan, levels, "whole")
    # The paths of the block tops of the upper tree, down to the sources.
    block = F.floor(F.col("pos") / fan**levels)
    held = whole.paths().select("tree", F.col("pos").alias("block"), "root", "path")
    found = tops.withColumn("block", block).groupBy("tree", "block").cogroup(held.groupBy("tree", "block"))
    found = found.applyInArrow(_paths(fan, levels), f"tree string, pos long, root string, path {PATH}")
    ends = work.keep("source-paths", found.join(tops, ["tree", "pos"]).select(F.col("source").alias("tree"), "root", "path"))
    above = trees.paths(ends.select("tree", "path")).withColumnRenamed("root", "subroot").join(ends.select("tree", "root"), "tree")
    above = above.withColumnRenamed("pos", "block")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    below = leaves.withColumn("block", block)
    return below.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_versions(fan, levels), shape)


def lower_ascii(text: Column) -> Column:
    letters = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, letters, letters.lower())


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, each fifth tampered with in a version of its own."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = dataset_manifest(docs, {"text": lower_ascii(F.col("text").cast("string"))}, fifth)
    return found.drop("copied").withColumn("verified", F.col("folded_root") == F.col("root"))
