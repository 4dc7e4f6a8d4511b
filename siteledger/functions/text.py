"""Small text expressions used by the extractors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that recognise the vocabulary.
SCHEMA_TYPE_URL = r"(?i)https?://(www\.)?schema\.org/([^/?#]+)"
SCHEMA_URL = r"(?i)https?://(www\.)?schema\.org/"


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def local_name(prefixed: Column) -> Column:
    """Text after the last colon, the whole text if there is none."""
    return F.substring_index(prefixed, ":", -1)


def type_from_itemtype(itemtype: Column) -> Column:
    """Type name in the first schema.org URL of an itemtype, NULL if there is none."""
    return F.nullif(F.regexp_extract(itemtype, SCHEMA_TYPE_URL, 2), F.lit(""))


def filled(template: str, **values: Column) -> Column:
    """A text with columns for the names in braces: those given, or those of the table."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values.get(p, F.col(p)).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
