"""Mixing sources to target weights by pivotal dependent rounding.

``source_targets`` turns weights into a target size per source (a water
level: no source above ``max_repeat`` times its size, the excess reshared by
weight).  ``mix`` gives each document a whole number of copies whose
expectation is target / source size: the whole part at once, the fraction by
pivotal rounding.  Two documents with open fractions are paired and mass is
moved between them at random, in words, so that the sum of words stays as it
is and each keeps its expectation, until one of them is whole; the other goes
on to the next pair.  Every bucket of a source ends with one open document;
these residuals are rounded the same way in a tree (FAN_IN to one) until one
is left per source, which goes to the nearer whole number.  So the words of a
source miss its target by half of one document at most.

Randomness comes from hashes of (seed, doc_id, size), and buckets are formed by
that hash and counts alone, so reruns and other file splits agree.

Defined cases: a null text has size 0 and gets the whole part of its copies
(no words either way); null sources form one source; repeated rows are
documents of their own; an empty table gives an empty mix; a source whose
sizes are all 0 has target 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import WORD, broadcast_if_small, materialise

BUCKET = 4096  # documents of one rounding task's group, on average
FAN_IN = 1024  # residuals rounded together in one step of the tree


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, max_repeat: float) -> DataFrame:
    """sizes(source, source_size, weight) -> the same with ``target``.

    Sources over their cap are fixed at it and the rest reshared by weight,
    until no source is over; each round is one small aggregate.
    """
    cap = F.col("source_size") * F.lit(float(max_repeat))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    goal, level, capped = total * share, math.inf, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level) if math.isfinite(level) else F.lit(False)
        row = sizes.agg(F.count(F.when(full, 1)).alias("n"),
                        F.sum(F.when(full, cap).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], max(0.0, goal - row["fixed"]) / row["open"]
    target = F.least(cap, F.col("weight") * F.lit(level)) if math.isfinite(level) else F.lit(0.0)
    return sizes.withColumn("target", target.cast("double"))


def _uniforms(keys: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes."""
    return (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p in order; returns them and the index still open (-1: none).

    p*size summed over all stays the same at every step.
    """
    p, eps, cur = p.copy(), 1e-9, -1
    for j in range(len(p)):
        if p[j] < eps or p[j] > 1 - eps:
            p[j] = round(p[j])
            continue
        if cur < 0:
            cur = j
            continue
        si, sj = size[cur], size[j]
        up = min((1 - p[cur]) * si, p[j] * sj)      # words that can go from j to cur
        down = min(p[cur] * si, (1 - p[j]) * sj)    # and from cur to j
        move = up if u[j] * (up + down) < down else -down  # mean 0
        p[cur] += move / si
        p[j] -= move / sj
        open_ = [i for i in (cur, j) if eps <= p[i] <= 1 - eps]
        for i in (cur, j):
            if i not in open_:
                p[i] = round(p[i])
        cur = open_[0] if open_ else -1
    return p, cur


def _round_group(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values(["rank", "row"], kind="stable", ignore_index=True)
    p, cur = pivotal(df["p"].to_numpy(float), df["size"].to_numpy(float), _uniforms(df["rank"].to_numpy()))
    return df.assign(p=p, open=np.arange(len(df)) == cur)


def _round_level(df: DataFrame) -> DataFrame:
    """One step of the tree: every group rounds its documents."""
    cols = ["row", "source", "size", "p", "rank", "bucket"]
    return (df.select(*cols).groupBy("source", "bucket")
            .applyInPandas(_round_group, "row long, source string, size long, p double, rank long, "
                                         "bucket long, open boolean"))


def mix(docs: DataFrame, weights, share: float = 1.5, max_repeat: float = 2.0, seed: int = 1) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target,
    copies (long), taken (long).  ``weights`` maps the table of sources
    (source, source_size) to the same table with ``weight``."""
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    base = materialise(base.withColumn("row", F.monotonically_increasing_id()))
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sized = materialise(weights(per_source))
    targets = source_targets(sized, share, max_repeat)
    n_sources = sized.count()
    # documents of the same hash are copies of each other: any of them may take the other's part
    rank = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"))
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target",
                       F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("_buckets"))
    docs_x = (base.join(broadcast_if_small(t, n_sources, 200), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("whole", F.floor(x + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), x - F.col("whole")))
              .withColumn("rank", rank).withColumn("bucket", F.pmod(F.col("rank"), F.col("_buckets"))))
    # level 0: every document with an open fraction, in its bucket
    level = materialise(_round_level(docs_x.where("size > 0 and p > 1e-9")))
    rounded = level.where("not open").select("row", "p")
    open_ = level.where("open")
    width = (sized.agg(F.max(F.ceil(F.col("n") / BUCKET))).first()[0]) or 1
    while width > 1:  # residuals, FAN_IN buckets together
        width = -(-width // FAN_IN)
        up = open_.drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level = materialise(_round_level(up))
        rounded = rounded.unionByName(level.where("not open").select("row", "p"))
        open_ = level.where("open")
    rounded = rounded.unionByName(open_.select("row", F.round("p").alias("p")))  # one per source
    p = rounded.select("row", F.col("p").cast("long").alias("extra"))
    return (docs_x.join(p, "row", "left")
            .withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
