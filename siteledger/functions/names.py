"""Names for columns that must not meet those of a table."""

from __future__ import annotations

from collections.abc import Iterable


def free(columns: Iterable[str], name: str) -> str:
    """`name`, lengthened until no column is called so (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
