"""Live jobs and skill pairs, maintained micro-batch by micro-batch.

``apply_batch`` is the batch function of the stream (or a nightly call).  It
keeps keyed state between batches instead of deduping the whole table again:

    raw/batch=N/      the batch's rows
    state/epoch=N/    url -> its latest seq, the batch that holds it and the
                      hash of its description: only urls that the batch changed
    live/epoch=N/     rows that became live (+1) or stopped being so (-1)
    skills/epoch=N/   (url, skill) pairs of those rows (+1, -1)
    snapshots/        pointers: epoch -> folder with the three merged tables

A row is live as in ``dedup.dedup_latest``: the latest of its url, and of
those the latest of its description.  A batch can change that only for
descriptions that a changed url had or has, so only the groups of those are
looked at again - a row that another one hid becomes live when that one's url
moves on.  Late rows (an older seq of a url) and repeated rows change nothing.
Texts are matched once, when their row becomes live; pairs of rows that go are
taken from the pairs table.

Every table of an epoch is written with overwrite and read by epochs, so a
retried epoch replaces its own output and sees the state before it.  After
``compact_every`` epochs the logs are merged into a snapshot; readers take the
newest snapshot and the logs after it.  Epochs must come in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.operators.dedup import DESC, SEQ, URL, description_key
from jobsift.operators.skills import skill_pairs
from jobsift.sources.sinks import scratch_table
from jobsift.streaming import ingest

SMALL_ROWS = 100_000  # changed rows of a batch that are broadcast (narrow: under 32 MB)
STATE = "url string, seq bigint, batch bigint, dkey string"
LIVE = "seq bigint, batch bigint, url string, op int"
PAIRS = "url string, skill string, op int"


def _table(spark: SparkSession, base: str, name: str, schema: str, before: int) -> DataFrame:
    """Snapshot and logs of a table, of epochs under ``before``, with ``epoch``."""
    since, parts = -1, []
    found = newest_snapshot(spark, base, before)
    if found:
        since = found[0]
        parts.append(spark.read.schema(schema).parquet(f"{found[1]}/{name}").withColumn("epoch", F.lit(since)))
    try:
        log = spark.read.schema(f"{schema}, epoch int").option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
        parts.append(log.where((F.col("epoch") > since) & (F.col("epoch") < before)))
    except AnalysisException:
        pass  # before the first epoch
    if not parts:
        return spark.createDataFrame([], f"{schema}, epoch int")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def newest_snapshot(spark: SparkSession, base: str, before: int) -> tuple[int, str] | None:
    try:
        row = (spark.read.parquet(f"{base}/snapshots").where(F.col("epoch") < before)
               .agg(F.max(F.struct("epoch", "path")).alias("s")).first()["s"])
    except AnalysisException:
        return None
    return (row["epoch"], row["path"]) if row else None


def read_state(spark: SparkSession, base: str, before: int = 1 << 30) -> DataFrame:
    """url, seq, batch, dkey: the latest row of each url."""
    rows = _table(spark, base, "state", STATE, before)
    return rows.groupBy(URL).agg(F.max(F.struct(SEQ, "batch", "dkey")).alias("s")).select(URL, "s.*")


def read_live(spark: SparkSession, base: str, before: int = 1 << 30) -> DataFrame:
    """seq, batch, url of the live rows."""
    rows = _table(spark, base, "live", LIVE, before)
    return rows.groupBy(SEQ, "batch", URL).agg(F.sum("op").alias("op")).where("op > 0").drop("op")


def read_skills(spark: SparkSession, base: str, before: int = 1 << 30) -> DataFrame:
    """Distinct (url, skill) pairs of the live rows."""
    rows = _table(spark, base, "skills", PAIRS, before)
    return rows.groupBy(URL, "skill").agg(F.sum("op").alias("op")).where("op > 0").drop("op")


def read_raw(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("basePath", f"{base}/raw").parquet(f"{base}/raw")


def live_jobs(spark: SparkSession, base: str) -> DataFrame:
    """The live rows in the columns of the batches."""
    raw = read_raw(spark, base)
    keys = read_live(spark, base).select(SEQ, F.col("batch").cast("int").alias("batch"))
    return raw.withColumn("batch", F.col("batch").cast("int")).join(keys, [SEQ, "batch"], "left_semi").drop("batch")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table that its count proves small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _group(dkey="dkey", seq=SEQ):
    """Rows of one description; a NULL description is a group of its own row."""
    return F.coalesce(F.col(dkey), F.concat(F.lit("seq "), F.col(seq).cast("string")))


def _live_of(state: DataFrame, groups: DataFrame) -> DataFrame:
    """seq, batch, url: the latest row of each of these description groups."""
    of = state.withColumn("g", _group()).join(groups, "g", "left_semi")
    return of.groupBy("g").agg(F.max(F.struct(SEQ, "batch", URL)).alias("r")).select("r.*")


def apply_batch(spark: SparkSession, base: str, batch: DataFrame, epoch: int, skills, compact_every: int = 16) -> None:
    """Merge one batch of job rows (seq, url, description_text, ...) into the tables at ``base``."""
    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")

    batch.dropDuplicates([SEQ]).write.mode("overwrite").parquet(f"{base}/raw/batch={epoch}")
    rows = spark.read.parquet(f"{base}/raw/batch={epoch}")
    new = (rows.select(URL, F.struct(SEQ, F.lit(epoch).cast("bigint").alias("batch"), description_key(F.col(DESC)).alias("dkey")).alias("s"))
           .groupBy(URL).agg(F.max("s").alias("s")).select(F.col(URL).alias("u"), "s.*"))
    new = scratch_table(new, "live")
    state = read_state(spark, base, epoch)
    old = scratch_table(state.join(_few(new.select("u")), F.col(URL).eqNullSafe(F.col("u")), "left_semi"), "live")
    prior = old.select(F.col(URL).alias("v"), F.col(SEQ).alias("old_seq"), F.col("dkey").alias("old_dkey"))
    changed = scratch_table(
        new.join(prior, F.col("u").eqNullSafe(F.col("v")), "left").where(F.col("old_seq").isNull() | (F.col(SEQ) > F.col("old_seq")))
        .select(F.col("u").alias(URL), SEQ, "batch", "dkey", "old_seq", "old_dkey"), "live")
    put(changed.select(URL, SEQ, "batch", "dkey"), "state")

    groups = (changed.select(_group().alias("g"))
              .unionByName(changed.where("old_seq is not null").select(_group("old_dkey", "old_seq").alias("g"))).distinct())
    groups = _few(scratch_table(groups, "live"))
    before = _live_of(state, groups)
    after = _live_of(read_state(spark, base, epoch + 1), groups)
    moved = (before.withColumn("op", F.lit(-1)).unionByName(after.withColumn("op", F.lit(1)))
             .groupBy(SEQ, "batch", URL).agg(F.sum("op").cast("int").alias("op")).where("op <> 0"))
    put(moved, "live")
    moved = spark.read.schema(LIVE).parquet(f"{base}/live/epoch={epoch}")
    come, go = (_few(moved.where(f"op = {op}").select(SEQ, F.col("batch").cast("int").alias("batch"), URL)) for op in (1, -1))
    texts = read_raw(spark, base).select(SEQ, F.col("batch").cast("int").alias("batch"), URL, DESC)
    added = skill_pairs(texts.join(come.drop(URL), [SEQ, "batch"], "left_semi"), [URL], DESC, skills)
    gone = read_skills(spark, base, epoch).join(go.select(URL), URL, "left_semi")
    put(added.distinct().withColumn("op", F.lit(1)).unionByName(gone.withColumn("op", F.lit(-1))), "skills")
    if compact_every and (epoch + 1) % compact_every == 0:
        compact(spark, base, epoch)


def compact(spark: SparkSession, base: str, epoch: int) -> None:
    """Merge everything up to ``epoch`` into a snapshot; the pointer is written last."""
    path = f"{base}/merged/epoch={epoch}"
    read_state(spark, base, epoch + 1).write.mode("overwrite").parquet(f"{path}/state")
    for read, name in ((read_live, "live"), (read_skills, "skills")):
        read(spark, base, epoch + 1).withColumn("op", F.lit(1)).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(epoch, path)], "epoch int, path string").coalesce(1).write.mode("append").parquet(f"{base}/snapshots")


def run_stream(spark: SparkSession, source_dir: str, schema, base: str, checkpoint_dir: str, skills,
               max_files_per_trigger: int = 1, compact_every: int = 16,
               apply: Callable = apply_batch) -> None:
    """All files that are new in ``source_dir``, as micro-batches of ``apply_batch``."""
    ingest.run_batches(spark, source_dir, schema, checkpoint_dir, max_files_per_trigger,
                       lambda batch, epoch: apply(batch.sparkSession, base, batch, epoch, skills, compact_every))
