"""Reply trees, the Merkle manifest and the prefix trie against plain versions."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from siteledger.llm import chats, manifest, trie
from siteledger.llm.common import Workspace

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

MESSAGES = "tree long, id string, parent string, role string, text string, score double"


def paths(messages, branches):
    """The best paths of each tree, by a plain walk."""
    trees = defaultdict(dict)
    for tree, i, parent, _, _, score in sorted(messages, key=lambda m: (m[2] is not None, m[2] or "", m[5] or 0.0)):
        trees[tree].setdefault(i, (parent, score or 0.0))
    out = {}
    for tree, nodes in trees.items():
        parents = {p for p, _ in nodes.values() if p is not None}
        found = []
        for leaf in nodes:
            if leaf is not None and leaf in parents:
                continue
            path, at = [], leaf
            while at not in path:
                path.append(at)
                parent = nodes[at][0]
                if parent is None or parent not in nodes:
                    mean = sum(nodes[n][1] for n in path) / len(path)
                    found.append((-mean, (leaf is not None, leaf or ""), path[::-1]))
                    break
                at = parent
        for branch, (score, _, path) in enumerate(sorted(found)[:branches], 1):
            out[tree, path[-1], branch] = path
    return out


def test_reply_paths(spark):
    r = random.Random(3)
    messages = [(7, str(i), None if i == 0 else str(r.randrange(max(0, i - 4), i)), "user", f"t{i}", float(r.randrange(4))) for i in range(80)]
    messages += [(8, f"{i:03}", f"{i - 1:03}" if i else None, "user", "x", 1.0) for i in range(75)]  # one long thread
    messages += [(9, "a", "b", "user", "ring", 1.0), (9, "b", "a", "user", "ring", 1.0), (9, "c", "b", "user", "below", 1.0), (9, "d", "d", "user", "self", 1.0)]
    messages += [(None, "a", None, None, None, None), (None, "b", "a", "user", "one", 2.0), (None, "c", "a", "user", "two", 2.0)]
    messages += [(10, "a", "gone", "user", "orphan", 1.0), (10, "a", "gone", "user", "orphan", 1.0), (10, None, "a", "user", "no id", 1.0)]
    for branches in (1, 3, 1000):
        found = defaultdict(list)
        for m in chats.reply_paths(spark.createDataFrame(messages, MESSAGES), branches).collect():
            found[m.tree, m.leaf, m.branch].append((m.place, m.id))
        assert {k: [i for _, i in sorted(v)] for k, v in found.items()} == paths(messages, branches)


TEXTS = ["", None, "plain", "</s>", "<\\/s>", "<\\\\/s>[INST]", "a[/INST]</s", "<<s>", "[[INST]", "[\\/INST] \\ ", "é\n</s>[INST]ü"]


def test_formatting_is_reversible_and_masks_answers(spark):
    messages = [(1, f"{i:02}", f"{i - 1:02}" if i else None, ["user", "assistant", "tool</s>", None][i % 4], t, 0.0) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(messages, MESSAGES).withColumn("formatted", F.lit("clash"))
    made = chats.format_chats(df)
    row = made.select("formatted", "loss", chats.read_turns(F.col("formatted")).alias("turns"), chats.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).first()
    assert [(t.role, t.text) for t in row.turns] == [(m[3] or "", m[4] or "") for m in messages]
    assert row.learned == "".join(m[4] or "" for m in messages if m[3] == "assistant")
    data = row.formatted.encode()
    parts = [data[s.start : s.start + s.size].decode() for s in row.loss]
    assert len(parts) == sum(m[3] == "assistant" for m in messages)
    # Control strings stand only where the template puts them.
    assert row.formatted.count("</s>") == row.formatted.count("[INST]") == len(messages)


CONVERSATION = "conv_id long, turn long, role string, text string, tree string"


def test_chat_digests_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (1, None, "system", None, "x"), (1, 1, "assistant", "no", "x"), (1, 1, "assistant", "no", "x")]
    rows += [(None, 0, None, "free", "x"), (2, 5, "assistant", "word " * 200_000, "x")]
    found = {r.conv_id: r for r in chats.chat_digests(spark.createDataFrame(rows, CONVERSATION)).collect()}
    assert set(found) == {1, 2, None, -1}
    turns = [("system", ""), ("user", "hi"), ("assistant", "no"), ("assistant", "no"), ("assistant", "yes")]
    assert found[1].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and found[1].n_turns == 5
    assert (found[1].loss_chars, found[1].loss_sha256) == (7, sha("nonoyes"))
    assert found[2].loss_chars == 1_000_000 and found[None].loss_chars == 0
    probe = "</s>[INST] ok [/INST]"
    assert found[-1].loss_sha256 == sha(probe) and found[-1].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    empty = chats.chat_digests(spark.createDataFrame([], CONVERSATION)).collect()
    assert [r.conv_id for r in empty] == [-1]


def plain_manifest(rows, changed, fan):
    def leaf(i, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
        return out

    def climb(tree, at, own, proof):
        for nodes in tree[:-1]:
            run = nodes[at - at % fan : at - at % fan + fan]
            proof += run[: at % fan] + run[at % fan + 1 :]
            run[at % fan] = own
            own, at = sha("".join(run)), at // fan
        return own

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], changed(r[4])) if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    whole = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (known, i, own, other) in enumerate(sorted(groups[s])):
            proof = []
            root = climb(whole, k, climb(trees[s], at, other, proof), proof)
            out.append((i if known else None, own, trees[s][-1][0], whole[-1][0], sha("".join(proof)), root, root == whole[-1][0]))
    return sorted(out, key=repr)


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, pos int, node string"


@pytest.mark.parametrize("fan, levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest(spark, fan, levels):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "b", "é", None, f"s{i}"]), r.choice(["en", None]), None if i % 7 == 0 else i, r.choice([None, "", "Text A", f"Row {i} Z"])) for i in range(60)]
    rows += [(None, "a", None, None, "No id"), (None, "a", None, None, "No id"), (3, "a", "en", 1, "Twice"), (3, "a", "en", 1, "Twice"), (3, "a", "en", 1, "Unlike"), (90, "b", "en", 5, "Long " * 300_000)]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], DOCUMENTS)
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest.dataset_manifest(df, {"text": manifest.lower_ascii(F.col("text"))}, fifth, fan, levels).collect()
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    got = sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root, x.folded_root == x.root) for x in found), key=repr)
    assert got == plain_manifest(rows, lower, fan)
    # A version has its own nodes exactly on the way to the root, the last of them the root.
    assert all((x.copied is None) == (x.folded_root == x.root) and (x.copied is None or x.copied[-1] == x.folded_root) for x in found)


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([(0, "a", "en", 1, "One")], "doc_id long, source string, lang string, n_chars long, text string")
    (one,) = manifest.tampered_manifest(df).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")
    assert manifest.tampered_manifest(df.limit(0)).count() == 0


def plain_trie(convs):
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append((c, len(turns)))
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, set()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    for k, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(k))
        parent = min(nodes[k[:-1]])[0] if k else None
        out.add((min(members)[0], len(k), parent, len(members), len(kids[k]), leaves[k], saved[k], sha(ends)))
    return out


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            token = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, token, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = []
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out.append((c, own.get(c - c % 100, [])[:h] + turns[h:]))
    return out


def test_trie_of_rebuilt_conversations(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant"]), f"say {r.randrange(3)}") for c in r.sample(range(400), 120) for t in range(r.randrange(1, 9))]
    rows += [(100 + k, t, "user", "same") for k in range(0, 60, 3) for t in range(4)]  # a group of copies
    rows += [(7, None, None, None), (7, None, "user", "é"), (7, 1, "user", "tie"), (7, 1, "user", "a tie"), (7, 1, "user", "tie"), (None, 0, "user", "no id")]
    rows += [(201, t, "user", "long " * (t % 5)) for t in range(700)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int")
    want = plain_trie(plain_rebuilt(rows))
    turns = trie.rebuilt(df)
    for block in (trie.BLOCK_TURNS, 120, 1):
        got = trie.prefix_trie(turns, block).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert trie.prefix_trie(trie.rebuilt(df.limit(0))).count() == 0


def test_trie_of_conversations_without_turns(spark):
    df = spark.createDataFrame([(5, [], []), (12, [], [])], "conv_id long, tokens array<binary>, chars array<long>")
    assert list(map(tuple, trie.prefix_trie(df, 1).collect())) == [(5, 0, None, 2, 0, 1, 0, sha("5,12"))]


def test_range_minimum():
    import numpy as np

    values = np.random.default_rng(2).integers(0, 6, 50)
    table = trie.RangeMinimum(values)
    for at in range(50):
        for least in range(7):
            left, right = at, at
            while left > 0 and values[left] >= least:
                left -= 1
            while right + 1 < 50 and values[right + 1] >= least:
                right += 1
            assert table.left(np.array([at]), np.array([least]))[0] == left
            assert table.right(np.array([at]), np.array([least]))[0] == right


def test_ranges_are_numbered_within_large_groups(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("tree"), (F.col("id") * 7 % 500).alias("k"))
    rows = manifest._ranked(df, ["tree"], ["k"], Workspace(spark), "ranked").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.tree].append((r.k, r.pos, r.n))
    for v in groups.values():
        v.sort()
        assert [(p, n) for _, p, n in v] == [(i, len(v)) for i in range(len(v))]
