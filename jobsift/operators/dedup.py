"""Keep-latest dedup of the jobs table.

``seq`` is the ingest order and is unique.  Which rows stay is decided on a
narrow table (seq, url, description hash) - a key that holds a third of all
rows collapses to one row a task before its shuffle, and no text enters an
exchange - and then one semi join on ``seq``, whose partitions are even
however skewed URLs or descriptions are, takes the wide rows.

Descriptions are compared by ``sha2(description, 256)``; a NULL description
keeps a NULL key, so all NULLs form one group as in SQL.  No window is
partitioned by URL or description (a hot key would put a third of the table
into one sorted task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ = "seq"
URL = "url"
DESC = "description_text"


def description_key(col: Column) -> Column:
    return F.sha2(col, 256)


def latest_seq_per_url(jobs: DataFrame) -> DataFrame:
    """MAX(seq) GROUP BY url (NULL urls form one group)."""
    return jobs.groupBy(URL).agg(F.max(SEQ).alias("max_seq"))


def keep_latest_url(jobs: DataFrame) -> DataFrame:
    """Rows whose seq is the largest of their url."""
    return _take(jobs, latest_seq_per_url(jobs).select(F.col("max_seq").alias(SEQ)))


def _take(jobs: DataFrame, seqs: DataFrame) -> DataFrame:
    return jobs.join(seqs, SEQ, "left_semi")


def narrow(jobs: DataFrame) -> DataFrame:
    return jobs.select(SEQ, URL, description_key(F.col(DESC)).alias("dkey"))


def description_groups(jobs: DataFrame) -> DataFrame:
    """Per description key: copies, first and last seq."""
    return (jobs.select(SEQ, description_key(F.col(DESC)).alias("dkey"))
            .groupBy("dkey")
            .agg(F.count(F.lit(1)).alias("copies"), F.min(SEQ).alias("first_seq"),
                 F.max(SEQ).alias("last_seq")))


def dedup_strict(jobs: DataFrame) -> DataFrame:
    """What the original SQL does: latest row per url AND
    ``description NOT IN (descriptions that occur more than once)``, with
    SQL's NULL rules: if any description (NULL included) repeats, rows with
    a NULL description go; if NULL itself repeats, every row goes.

    Rewritten without the null-aware anti join (which Spark can only run
    broadcast): two scalar flags from one small aggregate, and a left join
    on seq marking rows whose description occurs once."""
    groups = description_groups(jobs)
    flags = groups.select(F.struct(
        F.coalesce(F.max(F.col("copies") > 1), F.lit(False)).alias("any_dup"),
        F.coalesce(F.max(F.col("dkey").isNull() & (F.col("copies") > 1)), F.lit(False)).alias("null_dup"),
    )).scalar()
    single = (groups.where(F.col("dkey").isNotNull() & (F.col("copies") == 1))
              .select(F.col("last_seq").alias(SEQ), F.lit(True).alias("__single")))
    latest = latest_seq_per_url(jobs).select(F.col("max_seq").alias(SEQ))
    keep = (~flags["any_dup"]) | (F.coalesce(F.col("__single"), F.lit(False)) & ~flags["null_dup"])
    return _take(jobs, latest.join(single, SEQ, "left").where(keep).select(SEQ))


def dedup_latest(jobs: DataFrame) -> DataFrame:
    """The documented intent: latest row per url, then among those the
    latest row per description; rows with a NULL description are all kept.

    Two aggregates on the narrow table: the latest row of a url brings its
    description's hash along; a NULL hash becomes a key of its own."""
    latest = narrow(jobs).groupBy(URL).agg(F.max(F.struct(SEQ, "dkey")).alias("r")).select("r.*")
    key = F.coalesce("dkey", F.concat(F.lit("seq "), F.col(SEQ).cast("string")))
    return _take(jobs, latest.groupBy(key.alias("k")).agg(F.max(SEQ).alias(SEQ)).select(SEQ))


def repost_copies(jobs: DataFrame) -> DataFrame:
    """Every row that is not the last of its description group
    (``seq NOT IN (SELECT MAX(seq) ... GROUP BY description)``)."""
    last = description_groups(jobs).select(F.col("last_seq").alias(SEQ))
    return jobs.join(last, SEQ, "left_anti")


def duplicate_descriptions(jobs: DataFrame) -> DataFrame:
    """Descriptions that occur more than once (NULL counts as one value),
    with copies and first/last seq; the text is fetched from the last row
    by a join on seq."""
    dup = (description_groups(jobs).where(F.col("copies") > 1)
           .select("copies", "first_seq", F.col("last_seq").alias(SEQ)))
    return (jobs.select(SEQ, DESC).join(dup, SEQ)
            .select(DESC, "copies", "first_seq", F.col(SEQ).alias("last_seq")))
