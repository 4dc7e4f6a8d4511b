"""The declared side: site indexes, JSON modules, checksums and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import json as J
from siteledger.functions import urls as U
from siteledger.functions.events import MEMBER_TYPE, read_index
from siteledger.functions.plan import let, settled
from siteledger.functions.text import filled
from siteledger.operators.captures import latest
from siteledger.operators.merkle import merkle_roots
from siteledger.session import stored, tasks

# Outcome texts.
INDEX_MISSING = "This website is not ready: site index not found."
NO_MODULES = "This website is not ready: no modules found in the site index."
EMPTY_MODULES = "The modules array in the site index is empty. Merkle root cannot be confirmed."
MODULE_UNREADABLE = "Module could not be read."
NULL_ELEMENT = "Cannot read properties of null (reading 'url')"
MALFORMED = "Malformed schema object for module {url}: expected array or object, got {kind}"
DIFFERING = (
    "Schema array for module {url} contains objects with differing 'url' fields."
    " All schemas in a module must have the same url."
)
TRUST_UNREADABLE = f"Error fetching module {{path}}: {MODULE_UNREADABLE} "
TRUST_NOT_A_LIST = "Module {path} is not a valid array with checksum."
TRUST_NO_CHECKSUM = "Module {path} missing checksum object."
TRUST_MISMATCH = "Checksum mismatch for {path}. "
TRUST_NO_MODULES = "No modules found in the site index."
TRUST_NO_INDEX = "Could not fetch the site index."


URL_MEMBERS = ("url", "og:url")


# --- site index -----------------------------------------------------------------------


#: Characters of an index up to which it is worth parsing as a variant.
PLAIN_INDEX = 4 << 20


def parse_index(index: DataFrame) -> DataFrame:
    """`index(site, raw)` plus `modules` (NULL unless an array) and `merkle_root`.

    A module path that is not text is written as text; a falsy root counts as none. Documents
    that are too large or too deep for a variant are read value by value."""
    df = index.withColumn("_plain", F.when(F.length("raw") <= PLAIN_INDEX, F.col("raw")))
    df = J.with_canonical_json(df, "_plain", "_canon").drop("_plain")
    df = settled(df.withColumn("_v", F.try_parse_json("_canon")).drop("_canon"), "_v")
    beyond = F.col("_v").isNull()
    df = settled(df.withColumn("_read", read_index(F.when(beyond, F.col("raw")))), "_read")
    modules = J.member(F.col("_v"), "modules", "array<variant>")
    root = F.try_variant_get("_v", "$.verification.merkleRoot", "variant")
    stated = {
        "modules": F.transform(
            modules, lambda m: F.coalesce(F.try_variant_get(m, "$", "string"), F.lit("null"))
        ),
        "version": J.member(F.col("_v"), "version", "string"),
        "strategy": F.try_variant_get("_v", "$.verification.strategy", "string"),
        "last_verified": F.try_variant_get("_v", "$.verification.lastVerified", "string"),
        "merkle_root": F.when(J.is_truthy(root), F.try_variant_get(root, "$", "string")),
    }
    return df.withColumns({c: F.when(beyond, F.col(f"_read.{c}")).otherwise(v) for c, v in stated.items()}).drop("_v", "_read")


def site_readiness(index: DataFrame) -> DataFrame:
    """Add `error`: NULL when the site is ready, else one of three fixed texts."""
    return parse_index(index).withColumn(
        "error",
        F.when(F.col("raw").isNull(), INDEX_MISSING)
        .when(F.col("modules").isNull(), NO_MODULES)
        .when(F.size("modules") == 0, EMPTY_MODULES),
    )


def explode_modules(parsed: DataFrame, keep_unresolved: bool = False, max_pages: int | None = None) -> DataFrame:
    """(site, pos, path, module_url) per module. Paths that do not resolve against the
    site root are dropped inside the row, so positions have no gaps; the trust check
    keeps them, with a NULL URL, as modules that cannot be read. With `max_pages`, only the
    first of each site."""
    paths = F.col("modules")
    if not keep_unresolved:
        paths = U.resolvable_among(paths, F.col("site"))
    if max_pages is not None:
        paths = F.slice(paths, 1, max_pages)
    # The outer form: the plain one makes Spark test the number of paths first, and so
    # find them twice.
    rows = parsed.select("site", F.posexplode_outer(paths).alias("pos", "path")).filter("pos IS NOT NULL")
    # One index document can list most of all modules; its rows leave its task here.
    rows = rows.repartition(tasks(rows.sparkSession), "site", "pos")
    return U.with_resolved_url(rows, "path", "site", "module_url")


# --- modules ---------------------------------------------------------------------------


def _urls(canon: Column, deep: Column) -> Column:
    """The page URL an object names: `url`, else `og:url`, as JSON text and as string. `deep`
    has both members of an object that no variant can hold."""
    def one(v: Column, i: int) -> Column:
        plain = let(J.member(v, URL_MEMBERS[i]), J.stated)
        return F.when(deep.isNotNull(), F.get(deep, F.lit(i))).otherwise(plain)

    def first(v: Column, i: int = 0) -> Column:
        """The first that is truthy; those after it are not looked up."""
        if i == len(URL_MEMBERS):
            return F.lit(None).cast(MEMBER_TYPE)
        return let(one(v, i), lambda u: F.when(J.is_truthy_text(u["json"]), u).otherwise(first(v, i + 1)))

    return let(F.when(deep.isNull(), F.try_parse_json(canon)), lambda v: first(v))


def classify_module(modules: DataFrame) -> DataFrame:
    """Parse `raw` and split off a declared checksum by the audit rule.

    shape: `tailed` (array of two or more whose last object has `checksum` as its only
    member), `array`, `object`, `malformed`, or `missing` when there is no capture."""
    return _with_declared(settled(_shaped(modules), "_stated"))


def _shaped(modules: DataFrame) -> DataFrame:
    """`classify_module` but for the declared checksum: that member of the object that may hold
    it is `_stated`, not yet settled."""
    df = J.with_json_items(modules, "raw", "_items")
    items, kind = F.col("_items.items"), F.col("_items.kind")
    last = F.try_element_at(items, F.lit(-1))
    tail = (F.size(items) > 1) & F.coalesce(
        last["keys"] == F.array(F.lit("checksum")), F.lit(False)
    )
    df = df.withColumn(
        "shape",
        F.when(F.col("raw").isNull(), "missing")
        .when((kind == "array") & tail, "tailed")
        .when(kind == "array", "array")
        .when(kind == "object", "object")
        .otherwise("malformed"),
    )
    holder = F.when(F.col("shape") == "tailed", last["canon"]).when(
        F.col("shape") == "object", F.get(items, F.lit(0))["canon"]
    )
    return df.withColumns(
        {
            "_stated": J.member_of(holder, "checksum"),
            "json_kind": F.when(kind.isin("invalid"), "string")
            .when(kind == "null", "object")
            .otherwise(kind),
            "elements": F.when(F.col("shape") == "tailed", F.slice(items, 1, F.size(items) - 1))
            .when(F.col("shape").isin("array", "object"), items)
            .otherwise(F.array().cast(items_type())),
        }
    ).drop("_items")


def _with_declared(df: DataFrame) -> DataFrame:
    declared = F.when(J.is_truthy_text(F.col("_stated.json")), F.col("_stated.text"))
    return df.withColumn("declared_checksum", declared).drop("_stated")


def items_type():
    return J.ITEMS_TYPE["items"].dataType


def split_checksum(modules: DataFrame) -> DataFrame:
    """Audit rule only: declared checksum and the data elements as canonical texts."""
    return classify_module(modules).select(
        "site",
        "pos",
        "path",
        "shape",
        "declared_checksum",
        F.transform("elements", lambda e: e["canon"]).alias("data"),
    )


def read_modules(modules: DataFrame) -> DataFrame:
    """The audit's view of each module, one row each, nothing shuffled.

    Objects without a page URL are left out; the page is the first element's, taken
    before that; all kept objects must name the same page. A module that cannot be used
    has status `error`, keeps no objects and stands for its own URL."""
    df = _shaped(modules)
    deep = J.beyond_members(F.transform("elements", lambda e: e["canon"]), *URL_MEMBERS)
    # Settled together, so what both look up in Python takes one worker of a task, not two.
    df = _with_declared(settled(df.withColumn("_deep", deep), "_stated", "_deep"))
    df = df.withColumn(
        "_located",
        F.transform("elements", lambda e, i: F.struct(e.alias("item"), _urls(e["canon"], F.get("_deep", i)).alias("url"))),
    )
    kept = F.filter("_located", lambda e: e["url"]["json"].isNotNull())
    df = df.withColumns({"_kept": kept, "_first_url": F.get("_located", F.lit(0))["url"]["text"]})
    urls = F.transform("_kept", lambda e: e["url"]["json"])
    has_null = F.exists("elements", lambda e: e["canon"] == "null") & F.col("shape").isin(
        "tailed", "array"
    )
    single_url = F.size(F.array_distinct(urls)) <= 1
    df = df.withColumns(
        {
            "single_url": single_url,
            "error": F.when(F.col("shape") == "missing", MODULE_UNREADABLE)
            .when(
                F.col("shape") == "malformed",
                filled(MALFORMED, url=F.col("module_url"), kind=F.col("json_kind")),
            )
            .when(has_null, NULL_ELEMENT)
            .when(
                ~single_url,
                filled(DIFFERING, url=F.col("module_url")),
            ),
        }
    )
    usable = F.col("error").isNull()
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "status": F.when(usable, "success").otherwise("error"),
            "objects": F.when(usable, F.transform("_kept", lambda e: e["item"]["canon"])).otherwise(none),
            "first_keys": F.when(usable, F.get("_kept", F.lit(0))["item"]["keys"]),
            "page_url": F.when(usable, F.col("_first_url")).otherwise(F.col("module_url")),
            "declared_checksum": F.when(usable, F.col("declared_checksum")),
        }
    )
    df = df.withColumn("checksum", J.checksum_of("objects"))
    return df.withColumn("checksum_valid", verify_checksum()).drop("_located", "_kept", "_first_url", "_deep", "elements")


def verify_checksum(
    declared: str = "declared_checksum", calculated: str = "checksum"
) -> Column:
    """Whether the declared checksum holds; NULL when none is declared."""
    return F.when(F.col(declared).isNotNull(), F.col(declared) == F.col(calculated))


def _captured(modules: DataFrame) -> DataFrame:
    """The latest capture of each module. It and the join that follows share one exchange."""
    names = ["site", "module_url", "raw"]
    kept = [c for c in modules.columns if c in (*names, "captured_at", "capture_id")]
    return latest(_dealt(modules.select(*kept)), ["site", "module_url"], "raw").select(*names)


def _dealt(rows: DataFrame) -> DataFrame:
    """What is joined on the module URL, over as many tasks as reading the documents takes."""
    return rows.repartition(tasks(rows.sparkSession), "site", "module_url")


def locate_modules(index: DataFrame, modules: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Modules of the ready sites with their captured text, NULL where not captured. Sites
    that are not ready list no modules and so drop out by themselves.

    `modules(site, module_url, raw)` joins on the module URL as well as the site, so a
    site with most of the modules still spreads over all partitions. Of several captures of
    a module the latest counts (see `captures`)."""
    return locate_parsed(parse_index(index), modules, max_pages)


def locate_parsed(parsed: DataFrame, modules: DataFrame, max_pages: int | None = None) -> DataFrame:
    """`locate_modules` of indexes that `parse_index` has read."""
    listed = explode_modules(parsed, max_pages=max_pages)
    return _dealt(listed).join(_captured(modules), ["site", "module_url"], "left")


def locate_listed(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """Every listed path of the parsed indexes with its captured text, for the trust check."""
    listed = explode_modules(parsed, keep_unresolved=True)
    return _dealt(listed).join(_captured(modules), ["site", "module_url"], "left")


# --- trust check -------------------------------------------------------------------------


def validate_modules(located: DataFrame) -> DataFrame:
    """The trust rule: an array of two or more whose last element has a truthy
    `checksum`; the hash covers every other element. A mismatch keeps the module."""
    df = J.with_json_items(located, "raw", "_items", keys=False)
    items = F.col("_items.items")
    canons = F.transform(items, lambda i: i["canon"])
    is_list = (F.col("_items.kind") == "array") & (F.size(items) >= 2)
    df = settled(df.withColumn("_stated", J.member_of(F.try_element_at(canons, F.lit(-1)), "checksum")), "_stated")
    df = df.withColumns(
        {
            "_list": F.coalesce(is_list, F.lit(False)),
            "checksum": F.when(is_list & J.is_truthy_text(F.col("_stated.json")), F.col("_stated.text")),
            "_canons": canons,
        }
    )
    df = df.withColumn(
        "calculated_checksum",
        F.when(
            F.col("checksum").isNotNull(),
            J.checksum_of(F.slice("_canons", F.lit(1), F.size("_canons") - 1)),
        ),
    )
    df = df.withColumn("checksum_valid", F.col("checksum") == F.col("calculated_checksum"))
    return df.withColumns(
        {
            "detail": F.when(F.col("raw").isNull(), filled(TRUST_UNREADABLE))
            .when(~F.col("_list"), filled(TRUST_NOT_A_LIST))
            .when(F.col("checksum").isNull(), filled(TRUST_NO_CHECKSUM))
            .when(~F.col("checksum_valid"), filled(TRUST_MISMATCH)),
            "fetched": F.col("checksum").isNotNull(),
            "module": F.when(F.col("checksum").isNotNull(), J.array_text(F.col("_canons"))),
        }
    ).drop("_items", "_list", "_canons", "_stated")


def merkle_over_declared(validated: DataFrame) -> DataFrame:
    """Root per site over the declared checksums of the modules that could be used. The modules
    are read once, and their checksums written."""
    return _declared_roots(stored(validated.select("site", "pos", "checksum"), "declared-checksums"))


def _declared_roots(leaves: DataFrame) -> DataFrame:
    """`leaves(site, pos, checksum)` is read twice, so it had better be a table."""
    return merkle_roots(leaves, ["site"], "pos", {"calculated_root": "checksum"}, dense=False)


def site_trust_summary(index: DataFrame, validated: DataFrame) -> DataFrame:
    """One row per site: module count, roots, validity and the closing detail text.

    Module documents, trust records and the texts before the closing one are rows of
    `validated` (one per module, ordered by pos), which is where a site of any size can
    hold them; `single_module` marks sites whose only module is handed out bare."""
    sites = parse_index(index)
    # What is read of the modules, three times: their documents are not taken apart for each.
    failed = F.col("detail").isNotNull().alias("failed")
    facts = stored(validated.select("site", "pos", "checksum", "fetched", failed), "trust-facts")
    counts = facts.groupBy("site").agg(F.count_if("fetched").alias("fetched"), F.count_if("failed").alias("failures"))
    df = (
        sites.select("site", "raw", "modules", "merkle_root")
        .join(counts, "site", "left")
        .join(_declared_roots(facts), "site", "left")
    )
    listed = F.coalesce(F.size("modules") > 0, F.lit(False))
    calculated = F.when(listed, F.coalesce("calculated_root", F.lit("")))
    valid = F.coalesce(calculated == F.col("merkle_root"), F.lit(False))
    fetched = F.coalesce("fetched", F.lit(0))
    closing = F.concat(
        F.when(valid, " Merkle root valid.").otherwise(" Merkle root mismatch or invalid."),
        F.lit(" Fetched "),
        fetched.cast("string"),
        F.lit(" modules."),
    )
    return df.select(
        "site",
        fetched.alias("fetched"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
        (fetched == 1).alias("single_module"),
        "merkle_root",
        calculated.alias("calculated_root"),
        valid.alias("merkle_root_valid"),
        F.when(F.col("raw").isNull(), TRUST_NO_INDEX)
        .when(~listed, TRUST_NO_MODULES)
        .otherwise(closing)
        .alias("closing_detail"),
    )


def site_trust_report(index: DataFrame, modules: DataFrame) -> DataFrame:
    """The trust check as one table: per site a row per module and a closing row, in
    `pos` order (the closing row has pos NULL and comes last)."""
    parsed = parse_index(index)
    validated = stored(validate_modules(locate_listed(parsed, modules)), "validated")
    rows = validated.select(
        "site", "pos", "path", "checksum", "calculated_checksum", "checksum_valid", "module",
        "detail",
    )
    closing = site_trust_summary(index, validated).select(
        "site",
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("string").alias("path"),
        F.col("merkle_root").alias("checksum"),
        F.col("calculated_root").alias("calculated_checksum"),
        F.col("merkle_root_valid").alias("checksum_valid"),
        F.lit(None).cast("string").alias("module"),
        F.col("closing_detail").alias("detail"),
    )
    return rows.unionByName(closing)
