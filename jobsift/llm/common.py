"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.session import checkpoint_path

# Words of a text: runs of anything but the ASCII blanks (bytes.split() agrees).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder of ``spark.checkpoint.dir`` and read
    it back: the lineage ends there, so a lost executor costs a read, and the
    plans that follow know its true size (a checkpoint keeps the estimate of
    the plan behind it, which loops of joins multiply out of all bounds).  The
    shuffle files of the write go with its end, not with the driver's garbage."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"llm-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SCOPES: list[list[str]] = []


def with_scratch(build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, whose materialised tables are removed once the returned
    DataFrame object is garbage.  Only for callers that write it out while they
    hold it: frames derived from it do not keep the tables."""
    _SCOPES.append([])
    try:
        df = build()
    finally:
        paths = _SCOPES.pop()
    weakref.finalize(df, _remove, df.sparkSession, paths).atexit = False
    return df


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def row_key(*cols) -> Column:
    """64-bit key of a row's values; equal rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) if isinstance(c, str) else c
                        for c in cols])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """Broadcast hint only when the counted rows fit the limit."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
