"""Canonical JSON, hashing input and JSON truthiness as column expressions.

Documents are parsed by Spark's variant functions. A row leaves that path only when
its text holds something the variant printer writes differently from JavaScript
(exponents, more digits than a double keeps, escaped control characters, lone
surrogates) or when the parser rejects it (duplicate keys, malformed text). Those rows
alone go through `exact_items`, an Arrow UDF; every other row hands it a NULL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.events import FALSY, read_members
from siteledger.functions.leaf import as_item, kind_of, load, value_text
from siteledger.functions.plan import let, of_some, settled

ITEM_TYPE = T.StructType().add("canon", "string").add("keys", T.ArrayType(T.StringType()))
ITEMS_TYPE = T.StructType().add("kind", "string").add("items", T.ArrayType(ITEM_TYPE))
TEXT_TYPE = T.StringType()

# JSON white space, and what String.prototype.trim removes.
JSON_SPACE = " \t\n\r"
TRIM_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Text that must not be printed by the variant functions.
_NUMBER_START = r"(?:^|[:,\[])[ \t\n\r]*-?"
NEEDS_EXACT = "|".join(
    [
        r"\\u(?:00[01]|[dD][89a-fA-F])",
        # One search for the start of a number, not one for each of its endings.
        _NUMBER_START + r"(?:[0-9][0-9.]*[eE]|[0-9][0-9.]{15,}|0\.0{5,})",
    ]
)

def items_of(text: str) -> dict:
    try:
        value = load(text)
    except ValueError:
        return {"kind": "invalid", "items": None}
    return {"kind": kind_of(value), "items": [as_item(v) for v in (value if isinstance(value, list) else [value])]}


def limited_to_top_names(canon: str) -> str:
    """Text of an object keeping, at every level, only names its top level has."""
    value = load(canon)
    return value_text(value, set(value))


def without_checksum(canon: str) -> str:
    value = load(canon)
    value.pop("checksum", None)
    return value_text(value)


def identity_of(canon: str) -> str:
    """Text of an object's `@context` and `@type` alone."""
    value = load(canon)
    return value_text({k: value[k] for k in ("@context", "@type") if k in value})


exact_items = of_some(ITEMS_TYPE, items_of)
allow_list_text = of_some(TEXT_TYPE, limited_to_top_names)
without_checksum_text = of_some(TEXT_TYPE, without_checksum)
identity_text = of_some(TEXT_TYPE, identity_of)


@F.arrow_udf(T.ArrayType(TEXT_TYPE))
def without_members_text(canons: pa.Array, name: pa.Array) -> pa.Array:
    """Texts without the members of this name, at any depth."""
    cleaned = lambda texts, but: None if texts is None else [value_text(load(t), but=but) for t in texts]
    return pa.array([cleaned(texts.as_py(), but.as_py()) for texts, but in zip(canons, name)], pa.list_(pa.string()))


# --- column expressions ------------------------------------------------------------------


def is_truthy(value: Column) -> Column:
    """JavaScript truth of a variant; absent counts as false."""
    return is_truthy_text(F.to_json(value))


def is_truthy_text(json: Column) -> Column:
    """The same of a value in canonical form."""
    return F.coalesce(~json.isin(*FALSY), F.lit(False))


#: Characters of a canonical text that always fits a variant: the parser takes 1000 levels and
#: numbers of 1000 digits.
ALWAYS_PLAIN = 1000


def is_beyond(canon: Column) -> Column:
    """Whether an object is too deep or too large for a variant. Short ones are not parsed for it."""
    large = (F.length(canon) > ALWAYS_PLAIN) & F.startswith(canon, F.lit("{"))
    return F.coalesce(large & F.try_parse_json(canon).isNull(), F.lit(False))


def beyond_members(canons: Column, *names: str) -> Column:
    """Per text of an array of canonical texts, the (json, text) of the named members of objects
    that no variant can hold; NULL for all others. Arrays without such an object, nearly all,
    are not handed to Python."""
    texts = F.transform(canons, lambda c: F.when(is_beyond(c), c))
    # As one text: arrays take long to hand over, even if they are NULL.
    def listed(found):
        return array_text(F.transform(found, lambda t: F.coalesce(t, F.lit("null"))))

    some = let(texts, lambda found: F.when(F.exists(found, lambda t: t.isNotNull()), listed(found)))
    return read_members(*names)(some)


def member_of(canon: Column, name: str) -> Column:
    """(json, text) of a member of an object in canonical form, of any size and depth."""
    plain = let(member(F.try_parse_json(canon), name), stated)
    return F.when(is_beyond(canon), F.get(F.get(beyond_members(F.array(canon), name), F.lit(0)), F.lit(0))).otherwise(plain)


def stated(variant: Column) -> Column:
    """(json, text) of a variant."""
    return F.struct(F.to_json(variant).alias("json"), F.try_variant_get(variant, "$", "string").alias("text"))


def member(variant: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(variant, f"$['{name}']", as_type)


def quoted(text: Column) -> Column:
    """JSON string literal."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def with_json_items(df: DataFrame, text: str, out: str, keys: bool = True) -> DataFrame:
    """Add `out`: the kind of the JSON document in `text` and its items.

    An array gives one item per element, anything else a single item. An item has its
    canonical text and, for objects, its member names in source order. Text that is
    not exactly one JSON value has kind `invalid` and NULL items.

    The parser stops at the end of the first value, so the text is parsed as the first
    element of an array closed by a hash of the text; more or fewer than two elements
    means that something follows the value.
    """
    mark = f"cast(xxhash64({text}) AS string)"
    pair = f"try_parse_json(concat('[', {text}, ',', {mark}, ']'))"
    plain = (
        f"size(_pair) = 2 AND to_json(get(_pair, 1)) = {mark} AND NOT ({text} RLIKE r'{NEEDS_EXACT}')"
    )
    df = df.selectExpr("*", f"cast({pair} AS array<variant>) AS _pair")
    df = df.selectExpr("*", f"CASE WHEN {plain} THEN get(_pair, 0) END AS _doc")
    df = df.withColumn("_exact", exact_items(F.expr(f"CASE WHEN _doc IS NULL THEN {text} END")))
    first = f"left(ltrim('{JSON_SPACE}', {text}), 1)"
    names = "cast(NULL AS array<array<string>>)"
    if keys:
        names = (
            f"CASE WHEN {first} = '[' THEN transform(from_json({text}, 'array<string>'),"
            f" e -> json_object_keys(e)) ELSE array(json_object_keys({text})) END"
        )
    df = df.selectExpr(
        "*",
        f"CASE WHEN _doc IS NULL THEN NULL"
        f" WHEN {first} = '[' THEN transform(cast(_doc AS array<variant>), v -> to_json(v))"
        f" ELSE array(to_json(_doc)) END AS _canons",
        f"CASE WHEN _doc IS NOT NULL THEN {names} END AS _names",
        f"CASE {first} WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string'"
        f" WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null'"
        f" ELSE 'number' END AS _kind",
    )
    item = (
        "named_struct('canon', c, 'keys', CASE WHEN startswith(c, '{') THEN "
        + enumeration_order("get(_names, i)")
        + " END)"
    )
    df = df.selectExpr(
        "*",
        f"CASE WHEN _doc IS NOT NULL"
        f" THEN named_struct('kind', _kind, 'items', transform(_canons, (c, i) -> {item}))"
        f" WHEN _exact.kind IS NOT NULL THEN _exact END AS {out}",
    )
    return settled(df.drop("_pair", "_doc", "_exact", "_canons", "_names", "_kind"), out)


def enumeration_order(keys: str) -> str:
    """SQL for source-order names with array indexes moved to the front."""
    index = "r'^(?:0|[1-9][0-9]{0,9})$'"
    first = (
        f"transform(array_sort(transform(filter({keys}, k -> k RLIKE {index}),"
        f" k -> struct(cast(k AS bigint) AS n, k AS k))), s -> s.k)"
    )
    return (
        f"CASE WHEN exists({keys}, k -> k RLIKE {index})"
        f" THEN concat({first}, filter({keys}, k -> NOT k RLIKE {index})) ELSE {keys} END"
    )


def array_text(canons: Column) -> Column:
    """Canonical text of an array from the texts of its elements."""
    return F.concat(F.lit("["), F.array_join(canons, ","), F.lit("]"))


def canonical_of(items: Column) -> Column:
    """Canonical text of a document from its `with_json_items` value; NULL if invalid."""
    canons = F.transform(items["items"], lambda i: i["canon"])
    return F.when(items["kind"] == "array", array_text(canons)).otherwise(F.get(canons, F.lit(0)))


def canonical_flat(text: Column) -> Column:
    """Canonical text of an object known to hold only strings and arrays of strings.

    Nothing but the hex digits of escaped control characters has to be adjusted, so no
    Python is needed and the partitioning of the rows survives."""
    canon = F.to_json(F.try_parse_json(text))
    fixed = canon
    for code in [f"000{d}" for d in "BEF"] + [f"001{d}" for d in "ABCDEF"]:
        pattern = rf"(?<!\\)((?:\\\\)*)\\u{code}"
        fixed = F.regexp_replace(fixed, pattern, rf"$1\\u{code.lower()}")
    return F.when(canon.contains("\\u00"), fixed).otherwise(canon)


def with_canonical_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: `text` with keys sorted at every level and no white space."""
    df = with_json_items(df, text, "_items", keys=False)
    return df.withColumn(out, canonical_of(F.col("_items"))).drop("_items")


def json_bytes(canonical: Column) -> Column:
    """Bytes of the compact document; key order does not change the length."""
    return F.octet_length(canonical).cast("bigint")


def checksum_of(canons: Column | str) -> Column:
    """SHA-256 over the elements viewed as an object with keys "0", "1", ….

    Keys sort as text, so "10" comes before "2". No elements hash as `{}`."""
    if isinstance(canons, str):
        keyed = f"transform({canons}, (c, i) -> struct(cast(i AS string) AS k, c AS c))"
        members = f"transform(array_sort({keyed}), s -> concat('\"', s.k, '\":', s.c))"
        return F.expr(f"sha2(concat('{{', array_join({members}, ','), '}}'), 256)")
    keyed = F.transform(canons, lambda c, i: F.struct(i.cast("string").alias("k"), c.alias("c")))
    members = F.transform(
        F.array_sort(keyed), lambda s: F.concat(F.lit('"'), s["k"], F.lit('":'), s["c"])
    )
    return F.sha2(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), 256)


def context_text_is(context: str, vocabulary: str) -> Column:
    """Case-insensitive substring test on a context (SQL for a variant) taken as text.

    An array reads as its elements joined by commas, at any depth, an object as a fixed
    text that never matches: of the document's strings and braces in order, a string
    counts where no brace is open."""
    parts = rf"""regexp_extract_all(to_json({context}), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{{}}]', 0)"""
    step = (
        "named_struct('open', s.open + CASE t WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END,"
        f" 'hit', s.hit OR (s.open = 0 AND contains(lower(t), '{vocabulary}')))"
    )
    start = "named_struct('open', 0, 'hit', false)"
    return F.expr(f"coalesce(aggregate({parts}, {start}, (s, t) -> {step}, s -> s.hit), false)")
