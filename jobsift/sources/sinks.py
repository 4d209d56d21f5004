"""Table writes: append, versioned replace, CSV export.

Paths are on shared storage (the folder named by ``spark.checkpoint.dir``
or a caller-given warehouse path); nothing is written to a machine-local
folder by the library.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobsift.session import checkpoint_path

CURRENT = "current"  # pointers: (version, path), the largest version is live


def append_jobs(batch: DataFrame, table_path: str, partition_col: str = "search_date",
                replace_dates: bool = False) -> None:
    """Append a nightly batch, partitioned by run date (so a date filter
    prunes whole folders).  ``replace_dates``: a date of the batch that the
    table has is replaced, so a repeated run does not double its rows."""
    writer = batch.write.partitionBy(partition_col)
    if replace_dates:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table_path)
    else:
        writer.mode("append").parquet(table_path)


def write_version(df: DataFrame, base: str) -> str:
    """Write ``df`` as a new version folder under ``base`` and append it to
    the table's pointers.  No folder and no pointer that a reader may be using
    is ever overwritten: a reader takes the newest pointer, which appears
    whole when its file is committed."""
    spark, root = df.sparkSession, base.rstrip("/")
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    last = 0
    try:
        last = spark.read.parquet(f"{root}/{CURRENT}").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        pass  # the first version
    spark.createDataFrame([(last + 1, path)], "version bigint, path string").coalesce(1) \
        .write.mode("append").parquet(f"{root}/{CURRENT}")
    return path


def read_current(spark: SparkSession, base: str) -> DataFrame:
    # two writers at once may take one version number: every reader then takes the same of their folders
    path = spark.read.parquet(f"{base.rstrip('/')}/{CURRENT}").agg(F.max(F.struct("version", "path"))["path"]).first()[0]
    return spark.read.parquet(path)


def export_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as written to a sheet-like export: every value a string,
    NULL -> ''."""
    cols = columns or df.columns
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])


def export_csv(df: DataFrame, path: str) -> None:
    """Full-refresh export of one tab: header row + rows, replacing the
    previous export."""
    export_rows(df).write.mode("overwrite").option("header", True).csv(path)


def export_tabs(tabs: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Export several tabs; a failing tab is reported and does not stop the
    others.  Returns {tab: 'ok' | error text}."""
    status = {}
    for name, df in tabs.items():
        try:
            export_csv(df, f"{base.rstrip('/')}/{name}")
            status[name] = "ok"
        except Exception as e:  # reported per tab, like the original upload
            status[name] = f"{type(e).__name__}: {e}"
    return status


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists", **metrics: Column) -> dict:
    """Write ``df`` and return its row count (``rows``) and other aggregates,
    observed by the write itself: no second pass and no count job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]).write.mode(mode).parquet(path)
    return seen.get


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_table(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back: for
    tables that a job uses more than once.  Lineage ends there, so a lost
    executor costs a read, and the plans after it know the table's true size.
    The shuffle files of the write go with its end, not with the driver's garbage."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of ``scratch_table``s that nothing reads any more."""
    for t in tables:
        try:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        except AttributeError:
            return  # no JVM exposed (Spark Connect): the files stay, as before
        p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        p.getFileSystem(conf).delete(p, True)
