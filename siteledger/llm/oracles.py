"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

import re

from siteledger.llm import chats, manifest

#: crc32 of a text, for the ids that the contracts choose by it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


def _crc32(text: str) -> str:
    """Of a text of ASCII characters, next to the one row of a table `crc(t)`."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "xor(list_extract(t, 1 + (xor(c, b) & 255)), c >> 8)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


def _chats() -> str:
    rest = "|".join(re.escape(c[1:]) for c in chats.CONTROLS)
    first = "".join(re.escape(c) for c in sorted({c[0] for c in chats.CONTROLS}))
    # A match ends with a control string, which holds no beginning of another one.
    escaped = lambda c: f"regexp_replace({c}, '([{first}])(\\\\*(?:{rest}))', '\\1\\\\\\2', 'g')"
    fixed = len(chats.OPEN + chats.MIDDLE + chats.CLOSE)
    probe = f"{chats.CLOSE}{chats.OPEN} ok {chats.MIDDLE}"
    said = f"string_agg(text, '' ORDER BY place) FILTER (role = '{chats.LEARNED_ROLE}')"
    return f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')
), rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM every
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chats.LEARNED_ROLE}'), 0)::BIGINT AS loss_chars, sha256(coalesce({said}, '')) AS loss_sha256,
  sum({fixed} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


#: Levels of 16 children that the oracle of the manifest folds; more than its tables need.
_FLOORS = 6


def _folded(name: str, by: str) -> str:
    """Tables `name`0 to `name`_FLOORS of (by, pos, h): the levels of a tree, whose leaves stand in `name`0."""
    out = []
    for k in range(_FLOORS):
        digest = "CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END"
        out.append(
            f"{name}{k + 1} AS (SELECT {by}, pos // {manifest.FAN} AS pos, {digest} AS h FROM "
            f"(SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {name}{k}) GROUP BY {by}, pos // {manifest.FAN})"
        )
    return ",\n".join(out)


def _climb(rows: str, name: str, by: str, out: str, kept: list[str]) -> str:
    """`rows` (r, by, at, proof, own) carried up through the levels of a tree, as table `out`."""
    steps, last = [], rows
    for k in range(_FLOORS):
        to = out if k == _FLOORS - 1 else f"{out}{k}"
        steps.append(f"""{to} AS (
  SELECT {", ".join(f"any_value(x.{c}) AS {c}" for c in [by, *kept])}, r, any_value(spot) // {manifest.FAN} AS spot,
    any_value(proof) || coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos <> spot), '') AS proof,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(CASE WHEN pos = spot THEN own ELSE h END, '' ORDER BY pos)) ELSE any_value(own) END AS own
  FROM {last} x JOIN (SELECT {by} AS y, pos, h, count(*) OVER (PARTITION BY {by}) AS n FROM {name}{k}) l
    ON x.{by} = l.y AND l.pos // {manifest.FAN} = x.spot // {manifest.FAN}
  GROUP BY r)""")
        last = to
    return ",\n".join(steps)


def _manifest() -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    upper = "".join(map(chr, range(65, 91)))
    leaf = lambda text: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, {leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS other
  FROM documents CROSS JOIN crc
), p AS (
  SELECT *, row_number() OVER (ORDER BY src, doc_id NULLS FIRST, leaf) AS r,
    row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM d
), a0 AS (SELECT src, spot AS pos, leaf AS h FROM p),
{_folded("a", "src")},
s AS (SELECT src, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS place, 1 AS one FROM a{_FLOORS}),
b0 AS (SELECT one, place AS pos, subroot AS h FROM s),
{_folded("b", "one")},
x AS (SELECT r, src, doc_id, leaf, spot, '' AS proof, other AS own FROM p),
{_climb("x", "a", "src", "xs", ["doc_id", "leaf"])},
z AS (SELECT r, 1 AS one, doc_id, leaf, subroot, place AS spot, proof, own FROM xs JOIN s USING (src)),
{_climb("z", "b", "one", "zs", ["doc_id", "leaf", "subroot"])}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = h AS verified
FROM zs JOIN b{_FLOORS} USING (one)"""


def _trie() -> str:
    return f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (SELECT *, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM own CROSS JOIN crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
), members AS (
  SELECT conv_id, n, depth, CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS chars, turns[1:depth]::VARCHAR AS long_key, turns
  FROM prefixes
), keyed AS (
  SELECT *, sha256(long_key) AS key, CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR) END AS parent FROM members
), nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(n) AS longest,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth
), below AS (
  SELECT a.key, a.depth, count(*) FILTER (x.longest = x.depth) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM (SELECT DISTINCT k.key, k.depth, m.key AS low, m.depth AS deep FROM keyed k JOIN keyed m ON m.conv_id = k.conv_id AND m.depth >= k.depth) a
  JOIN nodes x ON x.key = a.low AND x.depth = a.deep GROUP BY a.key, a.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes c WHERE c.parent = n.key AND c.depth = n.depth + 1) AS n_children,
  b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.key = n.key AND b.depth = n.depth LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1"""


ORACLES = {"op11_chat_formatting": _chats(), "op12_merkle_manifest": _manifest(), "op13_prefix_trie": _trie()}
