"""Sets of keys as bitmaps of bounded size, to test rows where they are read.

A key belongs to one of `buckets` bitmaps of 2^15 bits and sets a few bits there. The test is
a look-up in a table of at most MOST bitmaps, which can always be broadcast: no row of the
tested table moves. It never misses a member; of other keys it lets some pass, the more the
fuller the bitmaps are, so what follows must not depend on it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.names import free

BITS = 1 << 15
#: Bits set per key.
PROBES = 4
#: Bits that a member is given while the table may grow.
ROOM = 16
#: Bitmaps of 4 KB each, 16 MB in all.
MOST = 1 << 12


class Members(NamedTuple):
    """`table(bucket, bits)`, over `buckets` buckets."""

    table: DataFrame
    buckets: int


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(buckets)).cast("int")


def _positions(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit(2))
    return [F.shiftrightunsigned(spread, 15 * i).bitwiseAND(BITS - 1) for i in range(PROBES)]


def members(keys: DataFrame, key: str, most: int = MOST) -> Members:
    """The set of the values of `key`; a null is no member."""
    known = keys.select(F.col(key).alias("key")).filter("key IS NOT NULL")
    buckets = min(most, max(1, -(-known.count() * ROOM // BITS)))
    bits = known.select(
        _bucket(F.col("key"), buckets).alias("bucket"), F.explode(F.array(*_positions(F.col("key")))).alias("at")
    )
    return Members(bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), buckets)


def marked(df: DataFrame, key: Column, of: Members, out: str) -> DataFrame:
    """`df` with `out`: FALSE where `key` is surely no member, TRUE for every member. No row of
    `df` is exchanged."""
    names = {c: free(df.columns, f"_{c}") for c in ("bucket", "bits", "key")}
    table = of.table.select(F.col("bucket").alias(names["bucket"]), F.col("bits").alias(names["bits"]))
    rows = df.withColumn(names["key"], key).withColumn(names["bucket"], _bucket(F.col(names["key"]), of.buckets))
    joined = rows.join(F.broadcast(table), names["bucket"], "left")
    held = F.lit(True)
    for at in _positions(F.col(names["key"])):
        byte = F.conv(F.hex(F.substring(F.col(names["bits"]), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = held & (F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1)
    known = F.col(names["bits"]).isNotNull() & F.col(names["key"]).isNotNull()
    return joined.withColumn(out, F.when(known, held).otherwise(False)).drop(*names.values())
