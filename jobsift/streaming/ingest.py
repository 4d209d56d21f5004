"""Nightly ingest as a Structured Streaming query.

New daily batch files land in a source folder; ``run_ingest`` picks up
what is new (``trigger(availableNow=True)``: process everything available,
then stop - the nightly cadence) and appends each micro-batch to the jobs
table.  Each micro-batch is written to its own ``batch=<epoch>`` folder with
overwrite, so a retried epoch replaces its own output instead of appending
twice (exactly-once with the checkpoint's offset log).  Dedup is applied
when the table is read (``live_jobs``), so the result is the same as the
batch job over all files, whatever the micro-batch boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from jobsift.operators.dedup import dedup_latest


def run_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, table_dir: str,
               checkpoint_dir: str, max_files_per_trigger: int = 1) -> None:
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/batch={epoch_id}")

    run_batches(spark, source_dir, schema, checkpoint_dir, max_files_per_trigger, write_batch)


def run_batches(spark: SparkSession, source_dir: str, schema: T.StructType, checkpoint_dir: str,
                max_files_per_trigger: int, apply) -> None:
    """Micro-batches of the new files of a folder through ``apply(batch, epoch)``."""
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream
         .foreachBatch(apply)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def read_table(spark: SparkSession, table_dir: str, columns: list[str]) -> DataFrame:
    """All appended rows (the batch folder column dropped)."""
    return spark.read.option("basePath", table_dir).parquet(table_dir).select(*columns)


def live_jobs(spark: SparkSession, table_dir: str, columns: list[str]) -> DataFrame:
    return dedup_latest(read_table(spark, table_dir, columns))


def split_by_day(df: DataFrame, out_dir: str, day_col: str = "search_date") -> None:
    """Write one folder per day (the daily files the stream consumes)."""
    df.repartition(day_col).write.mode("overwrite").partitionBy(day_col).parquet(out_dir)


def stream_schema(df: DataFrame, day_col: str = "search_date") -> T.StructType:
    """Schema of the daily files: data columns, then the day partition."""
    fields = [f for f in df.schema.fields if f.name != day_col]
    fields.append(df.schema[day_col])
    return T.StructType(fields)

