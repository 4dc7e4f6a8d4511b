"""Conversation prefix trie from sorted conversations, by range minima over their LCPs.

Conversations are sorted by their turns. Those that share a prefix of d turns are neighbours:
an interval in which all LCPs (turns shared with the row before) are at least d. For every
prefix of every conversation, a binary search over a sparse table of LCP minima gives the left
and the right end of its interval, each on its own. A prefix is a node at the leftmost of
its members.

The sorted rows are cut into blocks, each with tables of its own. Where an interval reaches
the edge of a block, a sparse table over the minima of whole blocks continues it. Subtrees are
intervals, too, so sums over them are differences of running sums.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import Workspace

#: Turns that a block of sorted conversations is meant to hold; a longer conversation is a
#: block of its own.
BLOCK_TURNS = 1 << 17
#: Candidate prefixes searched side by side.
SIDE_BY_SIDE = 1 << 18
TOKEN_BYTES = 16
EVERY = 100
HEADS = 6
_FAR = np.iinfo(np.int64).max


class RangeMinimum:
    """Sparse table: minima of all stretches of a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.int64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minima of [start, stop); of an empty stretch, the largest number."""
        size = stop - start
        level = np.zeros(len(size), np.int64)
        for k in range(1, len(self.rows)):
            level += size >= 1 << k
        out = np.full(len(size), _FAR)
        for k, row in enumerate(self.rows):
            own = (level == k) & (size > 0)
            out[own] = np.minimum(row[start[own]], row[stop[own] - (1 << k)])
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest j with all of values[j + 1 : at + 1] >= least."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            start = at - (1 << k) + 1
            fits = start >= 1
            fits[fits] = self.rows[k][start[fits]] >= least[fits]
            at[fits] -= 1 << k
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest j with all of values[at + 1 : j + 1] >= least."""
        at = at.copy()
        n = len(self.rows[0])
        for k in reversed(range(len(self.rows))):
            fits = at + (1 << k) < n
            fits[fits] = self.rows[k][at[fits] + 1] >= least[fits]
            at[fits] += 1 << k
        return at


def _shared(one: np.ndarray, two: np.ndarray) -> int:
    """Turns that two conversations begin with in common."""
    n = min(len(one), len(two))
    unlike = (one[:n] != two[:n]).any(1)
    return int(unlike.argmax()) if unlike.any() else n


def _flat(tokens: pa.Array) -> np.ndarray:
    """Keys as two numbers each."""
    _, offsets, data = tokens.buffers()
    if not len(tokens):
        return np.zeros((0, 2), np.uint64)
    bounds = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].copy().view(np.uint64).reshape(-1, 2)


class Block:
    """Sorted rows of a block: conversation ids, and flat tokens and sizes of their turns."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("at").combine_chunks()
        self.conv = rows.column("conv_id").to_numpy()
        tokens, chars = rows.column("tokens").combine_chunks(), rows.column("chars").combine_chunks()
        self.first = np.asarray(tokens.offsets, np.int64)
        self.first = self.first - self.first[0]
        self.tokens = _flat(tokens.flatten())
        self.chars = np.asarray(chars.flatten(), np.int64)
        self.n, self.size = len(self.conv), np.diff(self.first)
        self.lcp = self._lcp()
        self.minima, self.lows = RangeMinimum(self.lcp), RangeMinimum(self.conv)

    def _lcp(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        out[1:] = np.minimum(self.size[1:], self.size[:-1])
        # All turns of all rows against those of the row before, at once.
        row = np.repeat(np.arange(1, self.n), out[1:])
        inner = np.arange(len(row)) - np.repeat(np.cumsum(out[1:]) - out[1:], out[1:])
        unlike = (self.tokens[self.first[row] + inner] != self.tokens[self.first[row - 1] + inner]).any(1)
        np.minimum.at(out, row[unlike], inner[unlike])
        return out

    def turns(self, row: int) -> np.ndarray:
        return self.tokens[self.first[row] : self.first[row + 1]]

    def edge(self, left: bool):
        """For each depth of the first (last) row's prefixes: how many rows from the edge on have
        it, their smallest conversation, and whether the innermost of them is longer."""
        row = 0 if left else self.n - 1
        depth = np.arange(self.size[row] + 1)
        at = np.full(len(depth), row)
        far = self.minima.right(at, depth) if left else self.minima.left(at, depth)
        low = self.lows.of(np.minimum(at, far), np.maximum(at, far) + 1)
        return np.abs(far - at) + 1, low, far


def _pack(row: np.ndarray) -> bytes:
    return np.ascontiguousarray(row).tobytes()


def _numbers(values) -> bytes:
    return np.asarray(values, np.int64).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


_EDGE = "block int, n long, low long, whole long, head binary, tail binary, head_run binary, head_low binary, head_longer binary, tail_run binary, tail_low binary"


def _edges(rows: pa.Table) -> pa.Table:
    b = Block(rows)
    head_run, head_low, far = b.edge(True)
    tail_run, tail_low, _ = b.edge(False)
    longer = b.size[far] > np.arange(len(far))
    whole = int(b.lcp[1:].min()) if b.n > 1 else _FAR
    return pa.table(
        {
            "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "n": [b.n], "low": [int(b.conv.min())], "whole": [whole],
            "head": [_pack(b.turns(0))], "tail": [_pack(b.turns(b.n - 1))],
            "head_run": [_numbers(head_run)], "head_low": [_numbers(head_low)], "head_longer": [_numbers(longer)],
            "tail_run": [_numbers(tail_run)], "tail_low": [_numbers(tail_low)],
        }
    )


_AROUND = (
    "block int, offset long, low_all long, left_start binary, left_low binary, right_end binary, right_low binary, right_longer binary, right_block binary"
)


def _around(rows: pa.Table) -> pa.Table:
    """What each block needs of the others: for every depth its edge prefixes share with a
    neighbour, where their intervals end, and the smallest conversation there."""
    rows = rows.sort_by("block")
    get = {c: rows.column(c).to_pylist() for c in rows.column_names}
    n = len(get["n"])
    ends = np.cumsum(get["n"])
    offsets = ends - get["n"]
    turns = {c: [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in get[c]] for c in ("head", "tail")}
    shared = [-1, *(_shared(turns["tail"][b - 1], turns["head"][b]) for b in range(1, n)), -1]
    # Block b stands at 2b + 1, and between b - 1 and b stands what they share.
    chain = np.full(2 * n + 1, -1, np.int64)
    chain[0::2], chain[1::2] = shared, get["whole"]
    minima, lows = RangeMinimum(chain), RangeMinimum(get["low"])
    out = {c: [] for c in ("left_start", "left_low", "right_end", "right_low", "right_longer", "right_block")}
    for b in range(n):
        depth = np.arange(shared[b] + 1)
        # An even place that is reached is a border: part of the block before it still belongs.
        far = minima.left(np.full(len(depth), 2 * b), depth) + 1
        whole = far // 2
        start, low = offsets[whole].copy(), lows.of(whole, np.full(len(depth), b))
        for d in np.nonzero(far % 2 == 0)[0].tolist():
            other = whole[d] - 1
            run, least = _unpack(get["tail_run"][other])[d], _unpack(get["tail_low"][other])[d]
            start[d], low[d] = ends[other] - run, min(low[d], least)
        out["left_start"].append(_numbers(start))
        out["left_low"].append(_numbers(low))
        depth = np.arange(shared[b + 1] + 1)
        far = minima.right(np.full(len(depth), 2 * b + 1), depth)
        # `whole` is the last block that belongs entirely, the one before a border that is reached.
        whole = (far - 1) // 2
        end, low = ends[whole] - 1, lows.of(np.full(len(depth), b + 1), whole + 1)
        longer, last = np.zeros(len(depth), np.int64), whole.copy()
        for d in range(len(depth)):
            if far[d] % 2 == 0:
                other = whole[d] + 1
                run, least = _unpack(get["head_run"][other])[d], _unpack(get["head_low"][other])[d]
                end[d], low[d], last[d] = offsets[other] + run - 1, min(low[d], least), other
                longer[d] = _unpack(get["head_longer"][other])[d]
            else:
                longer[d] = len(turns["tail"][whole[d]]) > d
        for name, values in (("right_end", end), ("right_low", low), ("right_longer", longer), ("right_block", last)):
            out[name].append(_numbers(values))
    low_all = min(get["low"])
    return pa.table({"block": rows.column("block"), "offset": offsets, "low_all": pa.array([low_all] * n, pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})


_NODE = (
    "kind string, start long, depth int, parent_start long, conv_id long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, block int, ids string, numbers binary"
)


def _empty(size: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(size, kind)


def _table(size: int, **columns) -> pa.Table:
    kinds = {
        "kind": pa.string(), "start": pa.int64(), "depth": pa.int32(), "parent_start": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
        "n_convs": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "block": pa.int32(), "ids": pa.string(), "numbers": pa.binary(),
    }
    arrays = [pa.array(columns[c], k) if c in columns else _empty(size, k) for c, k in kinds.items()]
    return pa.Table.from_arrays(arrays, names=list(kinds))


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


NO_ENDS = sha256(b"").hexdigest()


def _nodes(rows: pa.Table, around: pa.Table) -> pa.Table:
    """Nodes whose leftmost member is in this block.

    Kind `node`: complete. `open`: its subtree goes on in later blocks. `ends`: members of
    this block that end at a node which reaches over an edge. `sums`: running sums of the
    block, for the subtrees that reach into it."""
    b = Block(rows)
    block = rows.column("block")[0].as_py()
    here = {c: around.column(c)[0].as_py() for c in around.column_names}
    offset = here["offset"]
    left_start, left_low, right_end, right_low, right_longer = (_unpack(here[c]) for c in ("left_start", "left_low", "right_end", "right_low", "right_longer"))
    # Candidates: every prefix of every row, by row and depth, the empty one included.
    first = _running(b.size + 1)
    parts = []
    total = int(first[-1])
    row_of = np.repeat(np.arange(b.n), b.size + 1)
    depth_of = np.arange(total) - first[row_of]
    for a in range(0, total, SIDE_BY_SIDE):
        row, depth = row_of[a : a + SIDE_BY_SIDE], depth_of[a : a + SIDE_BY_SIDE]
        left, right = b.minima.left(row, depth), b.minima.right(row, depth)
        low = b.lows.of(left, right + 1)
        longer = (b.size[right] > depth).astype(np.int64)
        start, end = offset + left, offset + right
        over = (left == 0) & (depth < len(left_start))
        start[over] = left_start[depth[over]]
        low[over] = np.minimum(low[over], left_low[depth[over]])
        on = (right == b.n - 1) & (depth < len(right_end))
        end[on] = right_end[depth[on]]
        low[on] = np.minimum(low[on], right_low[depth[on]])
        longer[on] = right_longer[depth[on]]
        parts.append((start, end, low, longer, on, right))
    start, end, low, longer, on, right = (np.concatenate(x) for x in zip(*parts))
    owned = start == offset + row_of
    count = end - start + 1
    chars = np.zeros(total, np.int64)
    chars[depth_of > 0] = b.chars
    leaf = owned & (longer == 0)
    saved = np.where(owned, (count - 1) * chars, 0)
    # Below a node: its own row from its depth on, and all rows after it in its interval.
    leaves_to, saved_to = _running(leaf), _running(saved)
    after = first[right + 1]
    at = np.arange(total)
    n_leaves, n_saved = leaves_to[after] - leaves_to[at], saved_to[after] - saved_to[at]
    # Members that end at a prefix are neighbours at the beginning of its interval.
    whole = first[1:] - 1
    mine = np.arange(b.n)
    group = start[whole]
    new = np.ones(b.n, bool)
    new[1:] = (group[1:] != group[:-1]) | (b.size[1:] != b.size[:-1])
    heads = np.nonzero(new)[0]
    tails = np.append(heads[1:], b.n)
    names = b.conv.astype(str).tolist()
    ends = np.full(total, NO_ENDS, object)
    apart = []
    for h, t in zip(heads.tolist(), tails.tolist()):
        ids, place = ",".join(names[h:t]), whole[h]
        inside = owned[place] and not (t == b.n and on[place])
        if inside:
            ends[place] = sha256(ids.encode()).hexdigest()
        else:
            apart.append((int(group[h]), int(b.size[h]), ids))
            if owned[place]:
                ends[place] = None
    pick = np.nonzero(owned)[0]
    parent = pick - 1
    top = depth_of[pick] == 0
    out = _table(
        len(pick),
        kind=np.where(on[pick], "open", "node"), start=start[pick], depth=depth_of[pick].astype(np.int32),
        parent_start=pa.array(start[parent], mask=top), conv_id=low[pick], parent_conv_id=pa.array(low[parent], mask=top), n_convs=count[pick],
        n_leaves=n_leaves[pick], saved_tokens=n_saved[pick], ends_sha256=ends[pick].tolist(), block=np.full(len(pick), block, np.int32),
    )
    tables = [out]
    if apart:
        tables.append(
            _table(len(apart), kind=["ends"] * len(apart), start=[x[0] for x in apart], depth=[x[1] for x in apart], ids=[x[2] for x in apart], block=[block] * len(apart))
        )
    reach = first[b.edge(True)[2] + 1]
    sums = _numbers([leaves_to[-1], saved_to[-1], *leaves_to[reach], *saved_to[reach]])
    tables.append(_table(1, kind=["sums"], block=[block], numbers=[sums]))
    return pa.concat_tables(tables)


def _beyond(rows: pa.Table) -> pa.Table:
    """(block, depth, leaves, saved) of the rows after a block, for the prefixes that go on."""
    rows = rows.sort_by("block")
    numbers = [_unpack(x) for x in rows.column("numbers").to_pylist()]
    places = {v: i for i, v in enumerate(rows.column("block").to_pylist())}
    leaves, saved = _running([x[0] for x in numbers]), _running([x[1] for x in numbers])
    out = []
    for block, i in places.items():
        lasts, ends = (_unpack(rows.column(c)[i].as_py()) for c in ("right_block", "right_end"))
        for depth, (last, end) in enumerate(zip(lasts.tolist(), ends.tolist())):
            # Of the last block, the part up to where its first row's prefix of this depth ends.
            half = (len(numbers[last]) - 2) // 2
            l, s = numbers[last][2 + depth], numbers[last][2 + half + depth]  # noqa: E741
            out.append((block, depth, int(leaves[last] - leaves[i + 1] + l), int(saved[last] - saved[i + 1] + s)))
    names = ["block", "depth", "more_leaves", "more_saved"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate(zip(names, kinds))})


def _joined_ends(batches):
    """(start, depth, digest): rows come by node and block; ids go through the digest as they
    come, so a node that a third of all conversations end at takes no memory."""
    held, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([digest.hexdigest()])], names=["start", "depth", "joined_sha256"]
        )

    for batch in batches:
        for start, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("start", "depth", "ids"))):
            if held == (start, depth):
                digest.update(b",")
            else:
                if held is not None:
                    yield row()
                held, digest = (start, depth), sha256()
            digest.update(ids.encode())
    if held is not None:
        yield row()


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of `conversations(conv_id, tokens, chars)`: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    One row per conversation: `tokens` are 16-byte keys of its turns, equal for equal turns
    only, `chars` their sizes. A node is a distinct sequence of first turns, the empty one
    included; members are the conversations that begin with it. conv_id is the smallest member,
    saved_tokens what a cache of prefixes saves: over the node's subtree, the size of each
    node's last turn for every member but one. ends_sha256 is the digest of the ids, ascending
    and joined by commas, of the members that have no more turns. Conversations without turns
    are members of the root; without any conversation there is no node.
    """
    work = Workspace(conversations.sparkSession)
    rows = work.keep("rows", conversations.select("conv_id", "tokens", "chars"))
    turns = rows.agg(F.sum(F.size("tokens") + 1)).first()[0] or 0
    blocks = max(1, -(-turns // block_turns))
    keys = ["tokens", "conv_id"]
    placed = rows.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    placed = work.keep("sorted", placed.withColumns({"block": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    edges = work.keep("edges", placed.groupBy("block").applyInArrow(_edges, _EDGE))
    # A row per block, its arrays no longer than a conversation.
    around = work.keep("around", edges.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(_around, _AROUND))
    found = work.keep("found", placed.groupBy("block").cogroup(around.groupBy("block")).applyInArrow(_nodes, _NODE))
    work.drop(["rows", "sorted", "edges"])
    sums = found.filter("kind = 'sums'").select("block", "numbers").join(around.select("block", "right_block", "right_end"), "block")
    beyond = sums.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(_beyond, "block int, depth int, more_leaves long, more_saved long")
    nodes = found.filter("kind IN ('node', 'open')")
    apart = found.filter("kind = 'ends'").repartition("start", "depth").sortWithinPartitions("start", "depth", "block")
    joined = apart.select("start", "depth", "ids").mapInArrow(_joined_ends, "start long, depth int, joined_sha256 string")
    wide = (
        nodes.filter("kind = 'open'")
        .join(beyond, ["block", "depth"], "left")
        .withColumns({"n_leaves": F.expr("n_leaves + coalesce(more_leaves, 0)"), "saved_tokens": F.expr("saved_tokens + coalesce(more_saved, 0)")})
        .join(joined, ["start", "depth"], "left")
        .withColumn("ends_sha256", F.coalesce("joined_sha256", "ends_sha256"))
    )
    columns = ["start", "depth", "conv_id", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens", "ends_sha256"]
    every = nodes.filter("kind = 'node'").select(*columns).unionByName(wide.select(*columns))
    children = nodes.filter("parent_start IS NOT NULL").groupBy(F.col("parent_start").alias("start"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    return every.join(children, ["start", "depth"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"
    )


def turn_token(role: Column, text: Column) -> Column:
    """A 16-byte key of a turn, from the SHA-256 of its role and text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, TOKEN_BYTES)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, tokens, chars) of each conversation of `conversations(conv_id, turn, role, text)`
    as it would be had it begun like the hundredth at or before it: that one's first h turns,
    then its own after its first h; h is the crc32 of its id modulo 6.

    Turns go by turn (null first), ties by token; repeated rows are turns of their own. A null
    role or text is empty. Rows without conv_id are no conversation's and are left out."""
    empty = F.lit("")
    role, text = (F.coalesce(F.col(c).cast("string"), empty) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_token(role, text).alias("token"), F.length(text).cast("long").alias("chars")
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "token", "chars")))
    work = Workspace(conversations.sparkSession)
    own = work.keep("own", rows.groupBy("conv_id").agg(turns.alias("turns")))
    bases = own.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % EVERY, "h": taken}).join(bases, "base", "left")
    before = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    turns = F.concat(before, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.withColumn("turns", turns).select("conv_id", F.col("turns.token").alias("tokens"), F.col("turns.chars").alias("chars"))
