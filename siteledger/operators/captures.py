"""Tables of captures, which may hold a page, module or index several times.

Of the captures of one thing the latest counts: the one with the largest `captured_at` (none:
before all others), of equal times the largest `capture_id`, then one that could be read
before one that could not, then the greatest text. Both columns may be missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.operators.membership import marked, members
from siteledger.session import stored

CAPTURED_AT, CAPTURE_ID = "captured_at", "capture_id"


def when_captured(df: DataFrame) -> list[Column]:
    """What orders the captures of a thing, before their content does."""
    present = {c.lower() for c in df.columns}
    return [F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in (CAPTURED_AT, CAPTURE_ID)]


def latest(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """The latest capture per `keys`, whole. Rows are exchanged by the keys, so a join on them
    that follows needs no exchange of its own."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*when_captured(df), F.col(content).isNotNull(), F.col(content))
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_latest"))
    return one.select(*[c if c in keys else F.col(f"_latest.{c}") for c in df.columns])


def latest_of(captures: DataFrame, wanted: DataFrame, key: str = "url") -> DataFrame:
    """The rows of `captures` that can be the latest capture of a page in `wanted(key)`, where
    they were read.

    Which ones those are is found from keys and times alone; the documents are then tested
    against a set of bounded size and never exchanged. Few other rows pass, but some may: what
    is made of the documents must still be reduced to the latest per page, as `extract_page`
    does, and joined with the pages that are wanted."""
    present = {c.lower() for c in captures.columns}
    names = [key, *(c for c in (CAPTURED_AT, CAPTURE_ID) if c in present)]
    pages = wanted.select(key).distinct()
    seen = captures.select(*names).join(pages, key, "left_semi")
    newest = seen.groupBy(key).agg(F.max(F.struct(*names[1:])).alias("_last")).select(key, "_last.*") if names[1:] else seen.distinct()
    # Nulls are told apart from other values, as a capture may have no time.
    mark = F.xxhash64(*(c for n in names for c in (F.isnull(n), F.col(n))))
    known = stored(newest.select(mark.alias("mark")), "wanted-captures")
    return marked(captures, mark, members(known, "mark"), "_wanted").filter("_wanted").drop("_wanted")
