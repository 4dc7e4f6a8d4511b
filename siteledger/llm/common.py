"""What the operators share: tables, the held-out rule, and intermediate tables of a run."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.session import shared_folder

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_AT_ONCE = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """TRUE for the rows no model learns from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run(batches)` of a Python worker, which gives what it has freed back to the system when the
    rows of a task end. Workers are used again, and would keep it while they wait."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return trimmed


class Workspace:
    """The intermediate tables of one run, written to the folder all executors share.

    A written table ends the lineage, so a lost executor costs no recomputation before it,
    and the shuffle files that led to it go at once. `drop` deletes tables no later step
    reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame, at_once: int | None = None) -> DataFrame:
        """`df` as a written table; `at_once`, if given, limits the bytes of a batch that its Python
        workers get."""
        path = f"{self.root}/{name}"
        held = {_CLEAN_UP: "true"}
        if at_once is not None:
            held[_AT_ONCE] = str(at_once)
        before = {k: self.spark.conf.get(k, None) for k in held}
        for k, v in held.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, names: Iterable[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
