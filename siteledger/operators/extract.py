"""Structured-data extraction from element rows.

Each method turns an element row into candidate rows (`*_candidates`, array columns).
A candidate carries either a JSON text still to be parsed or one property value of an
item. `extract_objects` evaluates all methods in one pass over the elements, then
partitions the candidates by page once; building items, removing duplicates and
assembling the page all use that partitioning. A page's candidates never exceed what
the page itself holds, so no group is larger than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from siteledger.functions import json as J
from siteledger.functions import text as X
from siteledger.functions.leaf import schema_objects_in
from siteledger.functions.plan import of_some
from siteledger.operators.captures import when_captured
from siteledger.operators.html import html_elements

# Method ranks fix the order of a page's objects.
DOCUMENT, JSONLD, INLINE, MICRODATA, RDFA, NEXT_DATA, REACT = -1, 0, 1, 2, 3, 4, 5
ITEM_METHODS = (MICRODATA, RDFA)

CANDIDATES = (
    "array<struct<method:int,root:int,sub:int,elem:int,name:string,value:string,text:string>>"
)

# Fixed values.
JSONLD_TYPE = "application/ld+json"
NEXT_DATA_ID = "__NEXT_DATA__"
SCHEMA_CONTEXT = "https://schema.org"
SCHEMA_VOCABULARY = "schema.org"
OPEN_GRAPH_VOCABULARY = "ogp.me/ns#"
PAGE_READ = "Loaded from capture."
PAGE_UNREADABLE = "Failed to fetch page."

# The shortest run from a `{` over a quoted context to the next `}`. Atomic groups and
# the anchor at the previous match keep the search linear in the script's length.
INLINE_OBJECT = (
    r'(?i)\G[^{]*(\{(?>[\s\S]*?"@context")(?>[\s\S]*?:)'
    r'(?>[\s\S]*?"https?://schema\.org")(?>[\s\S]*?\}))'
)


def _attr(name: str) -> str:
    return f"attrs['{name}']"


def _has(name: str) -> str:
    return f"coalesce(map_contains_key(attrs, '{name}'), false)"


def _filled(value: str) -> str:
    return f"coalesce({value} <> '', false)"


def _trimmed(value: str) -> str:
    return f"btrim({value}, '{J.TRIM_SPACE}')"


def _candidate(method, root, sub, elem, name="NULL", value="NULL", text="NULL") -> str:
    return (
        f"named_struct('method', cast({method} AS int), 'root', cast({root} AS int),"
        f" 'sub', cast({sub} AS int), 'elem', cast({elem} AS int), 'name', cast({name} AS string),"
        f" 'value', cast({value} AS string), 'text', cast({text} AS string))"
    )


def _only(condition: str, candidates: str) -> str:
    return f"CASE WHEN {condition} THEN {candidates} ELSE cast(array() AS {CANDIDATES}) END"


IS_SCRIPT = "tag = 'script'"
IS_JSONLD = f"({IS_SCRIPT} AND coalesce(lower({_attr('type')}) = '{JSONLD_TYPE}', false))"
# The literal tests are cheap and spare the search in ordinary scripts.
INLINE_MATCHES = (
    """CASE WHEN coalesce(contains(lower(raw), '"@context"') AND contains(lower(raw), '://schema.org"'), false)"""
    f" THEN regexp_extract_all(raw, r'{INLINE_OBJECT}', 1) ELSE cast(array() AS array<string>) END"
)


def jsonld_candidates() -> str:
    block = _candidate(JSONLD, "elem_id", 0, "elem_id", text="raw")
    return _only(f"{IS_JSONLD} AND {_filled(_trimmed('raw'))}", f"array({block})")


def inline_candidates() -> str:
    plain = (
        f"NOT coalesce({_attr('type')} = '{JSONLD_TYPE}', false) AND NOT {_filled(_attr('src'))}"
    )
    match = _candidate(INLINE, "elem_id", "i", "elem_id", text="m")
    return _only(f"{IS_SCRIPT} AND {plain}", f"transform({INLINE_MATCHES}, (m, i) -> {match})")


def microdata_value() -> str:
    """Property value: link target, image source, `content`, else trimmed text."""
    return (
        f"CASE WHEN tag IN ('a', 'link') AND {_filled(_attr('href'))} THEN {_attr('href')}"
        f" WHEN tag = 'img' AND {_filled(_attr('src'))} THEN {_attr('src')}"
        f" WHEN {_filled(_attr('content'))} THEN {_attr('content')}"
        f" ELSE {_trimmed(TEXT)} END"
    )


TEXT = "coalesce(text, '')"


def microdata_candidates() -> str:
    root = f"{_has('itemscope')} AND NOT {_has('itemprop')}"
    typed = f"coalesce({_attr('itemtype')} RLIKE r'{X.SCHEMA_URL}', false)"
    type_name = f"nullif(regexp_extract({_attr('itemtype')}, r'{X.SCHEMA_TYPE_URL}', 2), '')"
    marker = _candidate(MICRODATA, "elem_id", 0, "elem_id", value=type_name)
    prop = _candidate(
        MICRODATA, "scope_id", 0, "elem_id", name=_attr("itemprop"), value=microdata_value()
    )
    return (
        f"concat({_only(f'{root} AND {typed}', f'array({marker})')}, "
        + _only(f"{_has('itemprop')} AND scope_id IS NOT NULL", f"array({prop})")
        + ")"
    )


def rdfa_value() -> str:
    content = _attr("content")
    return f"CASE WHEN {_filled(content)} THEN {content} ELSE {_trimmed(TEXT)} END"


def rdfa_candidates() -> str:
    def mentions(value: str) -> str:
        return f"coalesce(contains(lower({value}), '{SCHEMA_VOCABULARY}'), false)"

    def local(value: str) -> str:
        return f"substring_index({value}, ':', -1)"

    typed = f"{_has('typeof')} AND ({mentions(_attr('typeof'))} OR {mentions('vocab')})"
    name, value = local(_attr("property")), rdfa_value()
    marker = _candidate(RDFA, "elem_id", 0, "elem_id", value=local(_attr("typeof")))
    own = _candidate(RDFA, "elem_id", 0, "elem_id", name=name, value=value)
    inside = _candidate(RDFA, "t", 0, "elem_id", name=name, value=value)
    owners = "coalesce(typed_ids, cast(array() AS array<int>))"
    parts = [
        _only(typed, f"array({marker})"),
        _only(f"{typed} AND {_filled(_attr('property'))}", f"array({own})"),
        _only(_has("property"), f"transform({owners}, t -> {inside})"),
    ]
    return f"concat({', '.join(parts)})"


def next_data_candidates() -> str:
    first = f"coalesce({_attr('id')} = '{NEXT_DATA_ID}', false) AND id_first"
    content = "coalesce(raw, text)"
    document = _candidate(NEXT_DATA, "elem_id", 0, "elem_id", text=content)
    return _only(f"{first} AND {_filled(content)}", f"array({document})")


def react_attr_candidates() -> str:
    value = _attr("dangerouslysetinnerhtml")
    candidate = _candidate(REACT, "elem_id", 0, "elem_id", text=value)
    return _only(f"{IS_SCRIPT} AND NOT {_has('src')} AND {_filled(value)}", f"array({candidate})")


def react_inline_candidates() -> str:
    match = _candidate(REACT, "elem_id", "i + 1", "elem_id", text="m")
    return _only(
        f"{IS_SCRIPT} AND NOT {_has('src')}", f"transform({INLINE_MATCHES}, (m, i) -> {match})"
    )


METHODS = {
    "jsonld": jsonld_candidates,
    "inline": inline_candidates,
    "microdata": microdata_candidates,
    "rdfa": rdfa_candidates,
    "next_data": next_data_candidates,
    "react_attr": react_attr_candidates,
    "react_inline": react_inline_candidates,
}


#: Schema objects anywhere in a JSON document, depth first, not below a hit. JSON nests without
#: limit, which no built-in expression can follow.
nested_schema_objects = of_some(T.ArrayType(J.ITEM_TYPE), schema_objects_in)


def _parsed(rows: DataFrame) -> DataFrame:
    """One row per JSON object in `text`; rows without text pass through."""
    walked = F.col("method") == NEXT_DATA
    rows = rows.withColumns(
        {
            "_text": F.when(~walked, F.col("text")),
            "_nested": nested_schema_objects(F.when(walked, F.col("text"))),
        }
    )
    rows = J.with_json_items(rows, "_text", "_items")
    rows = rows.withColumn("_all", F.coalesce("_nested", "_items.items"))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("_text", "_nested", "_items", "_all", "text")],
        F.posexplode_outer("_all").alias("idx", "item"),
        F.col("text").isNotNull().alias("_is_json"),
    )
    rows = rows.withColumns({"canon": F.col("item.canon"), "keys": F.col("item.keys")}).drop("item")
    return rows.filter(~F.col("_is_json") | F.col("keys").isNotNull())


def _kept(rows: DataFrame, known_only: bool) -> DataFrame:
    """Apply each method's own test and, with `known_only`, the vocabulary test."""
    rows = rows.withColumn("_v", F.when(F.col("canon").isNotNull(), F.try_parse_json("canon")))
    # An object too deep or too large for a variant is judged by the two members tested here.
    beyond = F.col("_v").isNull() & F.startswith("canon", F.lit("{"))
    rows = rows.withColumn("_v", F.coalesce("_v", F.try_parse_json(J.identity_text(F.when(beyond, F.col("canon"))))))
    context_sql = "try_variant_get(_v, '$[\\'@context\\']', 'variant')"
    context = F.expr(context_sql)
    typed = J.is_truthy(J.member(F.col("_v"), "@type"))
    schema = J.context_text_is(context_sql, SCHEMA_VOCABULARY)
    test = (
        F.when(F.col("canon").isNull(), True)
        .when(F.col("method") == INLINE, schema)
        .when((F.col("method") == REACT) & (F.col("sub") == 0), schema & typed)
        .when(F.col("method") == REACT, J.is_truthy(context) & typed)
        .otherwise(True)
    )
    if known_only:
        known = schema | J.context_text_is(context_sql, OPEN_GRAPH_VOCABULARY)
        test = test & F.when(F.col("canon").isNull(), True).otherwise(known)
    return rows.filter(test).drop("_v")


def _with_derived_texts(rows: DataFrame) -> DataFrame:
    """Add `allowed`, the object's text limited at every level to the names of its top
    level, and `clean`, its text without a top-level `checksum`. Objects without nested
    objects, or without that member, are not handed to Python and keep NULL."""
    nested = F.expr("contains(substring(canon, 2), '{')")
    holds = F.array_contains("keys", "checksum")
    return rows.withColumns(
        {
            "allowed": J.allow_list_text(F.when(nested, F.col("canon"))),
            "clean": J.without_checksum_text(F.when(holds, F.col("canon"))),
        }
    )


def collect_values(values: Column) -> Column:
    """JSON for the values of one name, in document order.

    A later value overwrites an earlier empty one; from the first filled value on they
    form an array, unless there is only one."""
    filled = F.array_position(F.transform(values, lambda v: v != ""), F.lit(True)).cast("int")
    rest = F.when(filled == 0, F.slice(values, F.lit(-1), F.lit(1))).otherwise(
        F.slice(values, F.greatest(filled, F.lit(1)), F.size(values))
    )
    return F.when(F.size(rest) == 1, J.quoted(F.get(rest, F.lit(0)))).otherwise(
        J.array_text(F.transform(rest, J.quoted))
    )


TEXTS = ("canon", "keys", "allowed", "clean")


def _assembled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gather item properties; JSON objects are groups of one row."""
    place = [*keys, "method", "root", "sub", "idx"]
    named = rows.groupBy(*place, "name").agg(
        F.sort_array(F.collect_list(F.struct("elem", "value"))).alias("_values"),
        F.min("elem").alias("_at"),
        *[F.first(c).alias(c) for c in TEXTS],
        *[F.first(c).alias(c) for c in rows.columns if c.startswith("carry_")],
    )
    values = F.transform("_values", lambda s: s["value"])
    is_marker = F.col("name").isNull() & F.col("method").isin(*ITEM_METHODS)
    items = named.groupBy(*place).agg(
        F.max(F.when(is_marker, F.get(values, F.lit(0)))).alias("_type"),
        F.bool_or(is_marker).alias("_has_root"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("name").isNotNull(),
                    F.struct("_at", "name", collect_values(values).alias("json"), values.alias("vs")),
                )
            )
        ).alias("_props"),
        *[F.first(c, ignorenulls=True).alias(c) for c in TEXTS],
        *[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c.startswith("carry_")],
    )
    is_item = F.col("method").isin(*ITEM_METHODS)
    micro = F.col("method") == MICRODATA
    own_type = F.get(F.filter("_props", lambda p: p["name"] == "@type"), F.lit(0))
    # Microdata: an itemprop may set @type itself; RDFa: a property of that name is
    # appended to the type. @context is always the fixed one.
    type_json = F.when(
        micro, F.when(own_type["json"].isNotNull() & (own_type["json"] != '""'), own_type["json"])
        .otherwise(J.quoted(F.col("_type")))
    ).otherwise(
        F.when(
            own_type["vs"].isNotNull(),
            collect_values(F.concat(F.array("_type"), own_type["vs"])),
        ).otherwise(J.quoted(F.col("_type")))
    )
    others = F.filter("_props", lambda p: ~p["name"].isin("@type", "@context"))
    names = F.transform(others, lambda p: p["name"])
    context_name, type_name = F.array(F.lit("@context")), F.array(F.lit("@type"))
    head = F.concat(F.lit(f'"@context":"{SCHEMA_CONTEXT}","@type":'), F.col("_type_json"))

    def object_of(props: Column) -> Column:
        members = F.transform(props, lambda p: F.concat(J.quoted(p["name"]), F.lit(":"), p["json"]))
        text = F.array_join(F.concat(F.array(head), members), ",")
        return F.when(is_item, J.canonical_flat(F.concat(F.lit("{"), text, F.lit("}"))))

    items = items.withColumn("_type_json", F.when(is_item, type_json))
    typed = F.coalesce(~F.col("_type_json").isin('""', "null"), F.lit(False))
    items = items.filter(~is_item | (F.col("_has_root") & typed))
    items = items.withColumns(
        {
            "canon": F.coalesce("canon", object_of(others)),
            "clean": F.coalesce(
                "clean",
                F.when(
                    F.array_contains(names, "checksum"),
                    object_of(F.filter(others, lambda p: p["name"] != "checksum")),
                ),
            ),
            "keys": F.when(
                is_item,
                F.when(micro, F.concat(names, context_name, type_name)).otherwise(
                    F.concat(type_name, names, context_name)
                ),
            ).otherwise(F.col("keys")),
        }
    )
    carried = [c for c in rows.columns if c.startswith("carry_")]
    return items.select(*place, *TEXTS, *carried)


def extract_objects(
    pages: DataFrame,
    key: str = "page_id",
    methods: tuple[str, ...] = tuple(METHODS),
    known_only: bool = True,
    carry: tuple[str, ...] = (),
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Objects of each page by the chosen methods, partitioned by `key`.

    A key that several rows share needs more columns, named in `also`, that tell these apart.

    Columns: key, method, root, sub, idx (together the order), canon, keys, and the texts
    for comparing (`allowed`) and handing out (`clean`) where they differ from canon. With
    `carry`, each page keeps a row of method -1 holding those columns, prefixed `carry_`.
    """
    named = {f"carry_{c}": F.col(c) for c in carry}
    source = pages.withColumns(named) if named else pages
    elements = html_elements(source, key, "marked", tuple(named), also=also)
    return objects_from_elements(elements, key, methods, known_only, also)


def objects_from_elements(
    elements: DataFrame,
    key: str = "page_id",
    methods: tuple[str, ...] = tuple(METHODS),
    known_only: bool = True,
    also: tuple[str, ...] = (),
) -> DataFrame:
    carried = [c for c in elements.columns if c.startswith("carry_")]
    document = _only("tag = '#document'", f"array({_candidate(DOCUMENT, 0, 0, 0)})")
    parts = ([document] if carried else []) + [METHODS[m]() for m in methods]
    # The outer form: the plain one makes Spark test the candidates' number first, and so
    # compute them twice.
    rows = elements.selectExpr(key, *also, *carried, f"inline_outer(concat({', '.join(parts)}))")
    rows = rows.filter(F.col("method").isNotNull())
    # What needs Python is done before the shuffle: a Python stage forgets how the rows
    # are partitioned, and everything below relies on it.
    rows = _with_derived_texts(_kept(_parsed(rows), known_only))
    return _assembled(rows.repartition(key), [key, *also])


PLACE = ("method", "root", "sub", "idx")


def dedupe_objects(df: DataFrame, key: str = "page_id", strict: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Keep the first object of each key on a page: its text limited to the names of its
    top level, or with `strict` its whole text."""
    whole = F.col("canon") if strict else F.coalesce("allowed", "canon")
    df = df.withColumn("dedupe_key", whole)
    first = Window.partitionBy(key, *also, "dedupe_key").orderBy(*PLACE)
    is_object = F.col("canon").isNotNull()
    return (
        df.withColumn("_nth", F.row_number().over(first))
        .filter(~is_object | (F.col("_nth") == 1))
        .drop("_nth", "dedupe_key")
    )


def drop_checksum_field(df: DataFrame) -> DataFrame:
    """Remove a top-level `checksum` member from each object."""
    return df.withColumns(
        {
            "canon": F.coalesce("clean", "canon"),
            "keys": F.array_remove("keys", F.lit("checksum")),
        }
    )


def extract_all(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Every method's objects with a known context, numbered per page, duplicates kept."""
    objects = extract_objects(pages, key)
    number = F.row_number().over(Window.partitionBy(key).orderBy(*PLACE)) - 1
    return objects.withColumn("seq", number)


def extract_page(pages: DataFrame, key: str = "page_id", strict: bool = False) -> DataFrame:
    """The page job: objects, closing checksum, bytes, details, one row per page.

    A page whose html is NULL could not be read: no objects, 0 bytes. `pages` may hold several
    captures of a page; each is read by itself, and the page's row is that of its latest (see
    `captures`; last, the one with the greatest checksum). `n_captures` counts them."""
    times = when_captured(pages)
    source = pages.withColumns(
        {
            "bytes": F.coalesce(X.utf8_bytes(F.col("html")), F.lit(0)),
            "readable": F.col("html").isNotNull(),
            "order": F.struct(*times),
            "_capture": F.monotonically_increasing_id(),
        }
    )
    also = ("_capture",)
    objects = extract_objects(source, key, carry=("bytes", "readable", "order"), also=also)
    objects = drop_checksum_field(dedupe_objects(objects, key, strict, also))
    gathered = objects.groupBy(key, *also).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("canon").isNotNull(), F.struct(*PLACE, "canon", "keys")))
        ).alias("_objects"),
        F.max("carry_bytes").alias("bytes_downloaded"),
        F.max("carry_readable").alias("readable"),
        F.max("carry_order").alias("order"),
    )
    canons = F.transform("_objects", lambda o: o["canon"])
    captured = gathered.select(
        key,
        "order",
        canons.alias("objects"),
        F.get(F.transform("_objects", lambda o: o["keys"]), F.lit(0)).alias("first_keys"),
        J.checksum_of(canons).alias("checksum"),
        "bytes_downloaded",
        F.when(F.col("readable"), PAGE_READ).otherwise(PAGE_UNREADABLE).alias("details"),
        F.col("readable").alias("extracted_ok"),
    )
    # The captures of a page are already in one partition.
    found = ["objects", "first_keys", "checksum", "bytes_downloaded", "details", "extracted_ok"]
    last = F.max_by(F.struct(*found), F.struct("order", "extracted_ok", "checksum", "bytes_downloaded"))
    one = captured.groupBy(key).agg(last.alias("_last"), F.count(F.lit(1)).alias("n_captures"))
    return one.select(key, "_last.*", "n_captures")


def raw_jsonld_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Verbatim ld+json text, one row per block, in page order."""
    return (
        html_elements(pages, key, "scripts")
        .filter(IS_JSONLD)
        .select(key, F.col("elem_id").alias("pos"), F.coalesce("raw", F.lit("")).alias("raw"))
    )


def strip_result_tail(items: Column) -> Column:
    """Drop the last object of a result if it has a truthy `checksum`."""
    stated = J.member_of(F.try_element_at(items, F.lit(-1)), "checksum")
    return F.when(J.is_truthy_text(stated["json"]), F.slice(items, F.lit(1), F.size(items) - 1)).otherwise(items)
