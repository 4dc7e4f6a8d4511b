"""Chat formatting: paths of reply trees, ranked, each formatted as one conversation.

A message answers its parent; a conversation is a path from a root to a leaf. Paths are
found by self-joins that double their reach: after k rounds every message knows the ancestor
2^k steps above it, so a thread of n messages takes log2(n) rounds and no row ever holds
a path. Only the chosen leaves are then expanded, by the same jumps in reverse.

Everything is a DataFrame operation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.llm.common import Workspace, let

# The template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
#: Strings that mean something to the template or to a tokenizer, and never stand in a text.
CONTROLS = ["<s>", CLOSE, OPEN, MIDDLE]
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_FIRST = "".join(re.escape(c) for c in sorted({c[0] for c in CONTROLS}))
#: The place after the first character of a control string, with backslashes there or not.
_PLACE = rf"(?<=[{_FIRST}])(?=\\*(?:{_REST}))"
_MARK = rf"(?<=[{_FIRST}])\\(?=\\*(?:{_REST}))"

LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """`text` with a backslash after the first character of each control string. A text that
    already has backslashes there gets one more, so `unescape` gives back every text."""
    return F.regexp_replace(text, _PLACE, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, "")


def _same_tree(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, score, place, id): the messages of the best `branches` paths of
    each tree, `place` counting from 0 at the root.

    `messages(tree, id, parent, score)`: ids are unique within their tree. A path's score is
    the mean of its messages' (null: 0); paths rank by it, equal ones by leaf id. A message
    without parent, or whose parent is not in its tree, is a root; a tree may have several.
    Of rows that repeat an id the one with the least (parent, score) counts, null first; a null
    id names a message like any other, but no parent. Messages on a ring of replies, and those
    below one, have no root and are in no path. A null tree is a tree.
    """
    work = Workspace(messages.sparkSession)
    least = F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    links = work.keep("links", messages.groupBy("tree", "id").agg(least.alias("m")).select("tree", "id", "m.*"))
    answered = links.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("id")).distinct()
    jump = (
        links.alias("a")
        .join(links.select("tree", "id").alias("b"), _same_tree("a", "b") & (F.col("a.parent") == F.col("b.id")), "left")
        .join(answered.alias("c"), F.col("a.tree").eqNullSafe(F.col("c.tree")) & (F.col("a.id") == F.col("c.id")), "left")
        .select("a.tree", "a.id", F.col("b.id").alias("up"), F.lit(1).cast("long").alias("n"), F.col("a.score").alias("total"), F.col("c.id").isNull().alias("leaf"))
    )
    # jump-k: the messages at least 2^k deep at its start, each with its ancestor 2^k above.
    jumps = [work.keep("jump-0", jump)]
    rooted = jumps[0].filter("up IS NULL")
    waiting = jumps[0].filter("up IS NOT NULL").count()
    while waiting:
        open_ones = jumps[-1].filter("up IS NOT NULL")
        jump = (
            open_ones.alias("a")
            .join(rooted.unionByName(open_ones).alias("b"), _same_tree("a", "b") & (F.col("a.up") == F.col("b.id")))
            .select("a.tree", "a.id", "b.up", (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.total") + F.col("b.total")).alias("total"), "a.leaf")
        )
        jumps.append(work.keep(f"jump-{len(jumps)}", jump))
        rooted = rooted.unionByName(jumps[-1].filter("up IS NULL"))
        still = jumps[-1].filter("up IS NOT NULL").count()
        if still == waiting:
            # The reach doubles each round, so whoever has a root comes nearer to it: these are rings.
            break
        waiting = still
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.asc("leaf"))
    chosen = (
        rooted.filter("leaf")
        .select("tree", F.col("id").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), "n")
        .withColumn("branch", F.row_number().over(best))
        .filter(F.col("branch") <= branches)
    )
    # `left` is how many messages stand above `id` on its path.
    rows = work.keep("paths-0", chosen.withColumns({"id": F.col("leaf"), "left": F.col("n") - 1}))
    for k in reversed(range(len(jumps) - 1)):
        above = (
            rows.filter(F.col("left") >= (1 << k))
            .alias("a")
            .join(jumps[k].filter("up IS NOT NULL").alias("b"), _same_tree("a", "b") & F.col("a.id").eqNullSafe(F.col("b.id")))
            .select("a.tree", "a.leaf", "a.score", "a.n", "a.branch", F.col("b.up").alias("id"), (F.col("a.left") - (1 << k)).alias("left"))
        )
        name = f"paths-{len(jumps) - 1 - k}"
        rows = work.keep(name, rows.unionByName(above))
        work.drop([f"paths-{len(jumps) - 2 - k}", f"jump-{k}"])
    return rows.select("tree", "leaf", "branch", "score", F.col("left").alias("place"), "id")


def format_chats(messages: DataFrame, branches: int = 1, learned: str = LEARNED_ROLE) -> DataFrame:
    """(tree, leaf, branch, score, formatted, loss): one row per chosen path of `reply_paths`.

    `messages` has role and text besides its columns; null ones are empty, and of rows that
    repeat an id the least (role, text) counts. `formatted` is the conversation in the template,
    control strings in roles and texts escaped. `loss` lists the (start, size) of the texts
    of the role `learned`, in UTF-8 bytes of `formatted` from 0: what a model is trained on.
    Other columns are ignored; an empty table gives no rows. A conversation is one row, so
    its text must fit in one.
    """
    empty = F.lit("")
    said = messages.select(
        "tree", "id", escape(F.coalesce(F.col("role").cast("string"), empty)).alias("role"), escape(F.coalesce(F.col("text").cast("string"), empty)).alias("text")
    )
    said = said.groupBy("tree", "id").agg(F.min(F.struct("role", "text")).alias("said"))
    head = F.concat(F.lit(OPEN), F.col("said.role"), F.lit(MIDDLE))
    rows = (
        reply_paths(messages, branches)
        .alias("a")
        .join(said.alias("b"), _same_tree("a", "b") & F.col("a.id").eqNullSafe(F.col("b.id")))
        .select("a.*", F.octet_length(head).alias("_head"), F.concat(head, F.col("said.text"), F.lit(CLOSE)).alias("_turn"), (F.col("said.role") == learned).alias("_learned"))
    )
    size = F.octet_length("_turn").cast("long")
    path = ["tree", "leaf", "branch", "score"]
    before = Window.partitionBy(*path).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col("_head"))
    span = F.struct(F.col("_start").alias("start"), (size - F.col("_head") - len(CLOSE)).alias("size"))
    turns = F.sort_array(F.collect_list(F.struct("place", "_turn")))
    spans = F.sort_array(F.collect_list(F.when(F.col("_learned"), span)))
    gathered = rows.groupBy(*path).agg(turns.alias("_turns"), spans.alias("loss"))
    return gathered.select(*path, F.array_join(F.col("_turns._turn"), "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation, as they were."""
    middle = re.escape(MIDDLE)
    # Each part but the last, which is empty, is a turn without its end.
    parts = F.split(formatted, re.escape(CLOSE))
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        sides = F.split(part, middle, 2)
        role = F.substring(F.get(sides, F.lit(0)), len(OPEN) + 1, (1 << 31) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.get(sides, F.lit(1))).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    def of(data: Column) -> Column:
        # Bytes are cut out without walking through what stands before them.
        cut = lambda s: unescape(F.substring(data, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string"))
        return F.array_join(F.transform(loss, cut), "")

    return let(formatted.cast("binary"), of)


def threads(conversations: DataFrame) -> DataFrame:
    """`conversations(conv_id, turn, role, text)` as reply trees of one branch: each turn answers
    the one before it, by turn (null first), ties by role and text. Repeated rows are turns
    of their own. A message's score is its length."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    rows = conversations.select("conv_id", "role", "text", place.alias("id"))
    return rows.select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score")
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    """What `format_chats` made of all conversations, read back from it: (conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A probe conversation -1, whose texts are control strings, is formatted besides. Rows
    without conv_id are one conversation."""
    spark = conversations.sparkSession
    probe = spark.sql(
        f"SELECT -1L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{CLOSE}{OPEN} ok {MIDDLE}' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    every = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    rows = threads(every.unionByName(probe))
    # Each turn is looked up again by its number, so the numbers must not change.
    work = Workspace(spark)
    chats = format_chats(work.keep("threads", rows)).select(
        F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("_turns"), read_loss(F.col("formatted"), F.col("loss")).alias("_loss")
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return chats.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("_turns", line), "")).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        digest(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
