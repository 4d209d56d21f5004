"""Dedup queries over the jobs view (and its NULL-description variant)."""

from __future__ import annotations

from jobsift.operators import dedup as DD
from jobsift.plans.catalog import register
from jobsift.plans.sqlkit import build
from jobsift.sources.fixtures import jobs_fx

NULL_EVERY = 97

# The rule in words: a row stays if it is the last of its url and no other
# row has its description.  Once any description repeats, a row without one
# cannot be told apart and goes; once the missing description itself
# repeats, no row can be.
STRICT_SQL = """
SELECT * FROM (WITH marked AS (
  SELECT {t}.*, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS from_last,
         count(*) OVER (PARTITION BY description_text) AS same_text FROM {t}),
flags AS (
  SELECT coalesce(bool_or(same_text > 1), false) AS some_repeat,
         coalesce(bool_or(same_text > 1 AND description_text IS NULL), false) AS missing_repeats FROM marked)
SELECT m.* EXCLUDE (from_last, same_text) FROM marked m, flags f
WHERE m.from_last = 1
  AND (NOT f.some_repeat
       OR (NOT f.missing_repeats AND m.description_text IS NOT NULL AND m.same_text = 1)))
"""

LATEST_SQL = """
SELECT * FROM (SELECT * FROM {t} WHERE seq IN (SELECT MAX(seq) FROM {t} GROUP BY url)) s
WHERE s.description_text IS NULL
   OR s.seq IN (SELECT MAX(seq) FROM {t} WHERE seq IN (SELECT MAX(seq) FROM {t} GROUP BY url)
                  AND description_text IS NOT NULL GROUP BY description_text)
"""


def _jobs(spark, sf):
    return jobs_fx(spark, sf)


def _jobs_null(spark, sf):
    return jobs_fx(spark, sf, null_every=NULL_EVERY)


register("latest_seq_per_url",
         lambda: build("SELECT url, MAX(seq) AS max_seq FROM jobs GROUP BY url", ("jobs",)))(
    lambda spark, sf: DD.latest_seq_per_url(_jobs(spark, sf)))

register("keep_latest_url",
         lambda: build("SELECT * FROM jobs WHERE seq IN (SELECT MAX(seq) FROM jobs GROUP BY url)",
                       ("jobs",)))(
    lambda spark, sf: DD.keep_latest_url(_jobs(spark, sf)))

register("dedup_strict", lambda: build(STRICT_SQL.format(t="jobs"), ("jobs",)))(
    lambda spark, sf: DD.dedup_strict(_jobs(spark, sf)))

register("dedup_strict_nulls", lambda: build(STRICT_SQL.format(t="jobs_null"), ("jobs_null",)))(
    lambda spark, sf: DD.dedup_strict(_jobs_null(spark, sf)))

register("dedup_latest", lambda: build(LATEST_SQL.format(t="jobs"), ("jobs",)))(
    lambda spark, sf: DD.dedup_latest(_jobs(spark, sf)))

register("dedup_latest_nulls", lambda: build(LATEST_SQL.format(t="jobs_null"), ("jobs_null",)))(
    lambda spark, sf: DD.dedup_latest(_jobs_null(spark, sf)))

register("repost_copies",
         lambda: build("SELECT * FROM jobs_null WHERE seq NOT IN "
                       "(SELECT MAX(seq) FROM jobs_null GROUP BY description_text)", ("jobs_null",)))(
    lambda spark, sf: DD.repost_copies(_jobs_null(spark, sf)))

register("duplicate_descriptions",
         lambda: build("SELECT description_text, COUNT(*) AS copies, MIN(seq) AS first_seq, "
                       "MAX(seq) AS last_seq FROM jobs_null GROUP BY description_text "
                       "HAVING COUNT(*) > 1", ("jobs_null",)))(
    lambda spark, sf: DD.duplicate_descriptions(_jobs_null(spark, sf)))
