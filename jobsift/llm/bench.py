"""Benchmark decontamination by SimHash windows (DataFrame functions only).

``find_leaks(docs, bench)`` returns the (document, item) pairs in which an
item-sized window of the document has a weighted shingle similarity of
``THRESHOLD`` or more with the item.

1. Anchors.  Words are runs of letters and digits, lower-cased; shingles are
   five words.  A window that is similar enough shares more than the weight
   left out of an item's prefix, so it holds a shingle of that prefix (the
   shortest with more than 1 - THRESHOLD of the item's weight).  Document
   shingles that hit a prefix shingle at offset q place a window of the
   item's size q words before; nothing else can be similar.
2. SimHash.  Every distinct window content and every item gets a 64-bit
   fingerprint of its weighted shingles.
3. Multi-index Hamming blocks.  Fingerprints are cut in BLOCKS; two within
   RADIUS differ by RADIUS // BLOCKS bits at most in one block at least, and
   the items are indexed under all such variants of each block, so the join
   by (size, block, value) misses no pair within RADIUS.  RADIUS is over
   three standard deviations beyond the distance expected at THRESHOLD.
4. Exact weighted Jaccard of the shingles decides.

Equal windows (a passage that many documents share) are one content, so a hot
passage is fingerprinted and compared once.  The benchmark side is broadcast
only while counted small; beyond that the same joins shuffle.

Defined cases: null or empty texts hold no window; items of under five words
have no shingle and never match; items with the same text are each reported;
repeated rows are reported once; empty tables give no pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import fresh, broadcast_if_small, materialise, row_key

N = 5             # words of a shingle
THRESHOLD = 0.8
BITS = 64
BLOCKS = 8
RADIUS = 21
SCALE = 1000      # weights are whole thousandths, so that sums are exact


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _shingles(words_: str) -> Column:
    """array of the N-word groups at each position (the last N - 1 are cut by ``is not null``)."""
    parts = [F.col(words_)] + [F.slice(F.col(words_), i + 1, F.greatest(F.size(words_), F.lit(0))) for i in range(1, N)]
    return F.arrays_zip(*[p.alias(str(i)) for i, p in enumerate(parts)])


def shingle_rows(df: DataFrame, words_: str, *keep) -> DataFrame:
    """A row for each shingle: keep..., at (0-based position), s (64-bit hash)."""
    rows = df.where(F.size(words_) >= N).select(*keep, F.posexplode(_shingles(words_)).alias("at", "_w"))
    parts = [F.col(f"_w.{i}") for i in range(N)]
    return rows.where(parts[-1].isNotNull()).select(*keep, "at", F.xxhash64(*parts).alias("s"))


def fingerprint(weight: Column, s: Column) -> list[Column]:
    """One sum for each bit, named b0..b63: weights of shingles with it minus those without."""
    return [F.sum(F.when(F.shiftright(s, j).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)).alias(f"b{j}")
            for j in range(BITS)]


def fold_bits() -> Column:
    one = F.lit(1).cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b),
                  [F.when(F.col(f"b{j}") > 0, F.shiftleft(one, j)).otherwise(F.lit(0).cast("long")) for j in range(BITS)])


def _block(fp: Column, i: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))


def _near_masks() -> list[int]:
    """All block differences of RADIUS // BLOCKS bits at most."""
    width = BITS // BLOCKS
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), k)]


def hamming_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(l, fp), right(r, fp) with ``size`` each -> pairs (l, r) of the
    same size within RADIUS, all of them."""
    def blocks(fp):
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(fp, i).alias("v")) for i in range(BLOCKS)]))
    a = left.select("l", "size", F.col("fp").alias("fl"), blocks(F.col("fp")).alias("x")).select("l", "size", "fl", "x.*")
    masks = F.array(*[F.lit(m).cast("long") for m in _near_masks()])
    b = (right.select("r", "size", F.col("fp").alias("fr"), blocks(F.col("fp")).alias("x"))
         .select("r", "size", "fr", "x.i", "x.v", F.explode(masks).alias("m"))
         .select("r", "size", "fr", "i", F.col("v").bitwiseXOR(F.col("m")).alias("v")))
    near = F.bit_count(F.col("fl").bitwiseXOR(F.col("fr"))) <= RADIUS
    return a.join(b, ["size", "i", "v"]).where(near).select("l", "r").distinct()


def find_leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), bench(item_id, text) -> doc_id, _key, item_id,
    similarity (the best window's), start (its first word), n_windows."""
    items = bench.select(row_key("item_id", "text").alias("item"), "item_id",
                         F.filter(words(F.col("text")), lambda w: w != "").alias("_w"))
    items = items.where(F.size("_w") >= N).withColumn("size", F.size("_w")).dropDuplicates(["item"])
    n_items = items.count()
    item_s = shingle_rows(items, "_w", "item", "size")
    df = item_s.select("item", "s").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    n_log = F.lit(float(n_items + 1))
    idf = lambda d: F.round((1 + F.log(n_log / (d + 1))) * SCALE).cast("long")
    item_w = materialise(item_s.join(df, "s").select("item", "size", "at", "s", idf(F.col("df")).alias("w")))
    n_shingles = item_w.count()
    small = lambda d: broadcast_if_small(d, n_shingles, 64)
    from pyspark.sql import Window
    by_item = Window.partitionBy("item")
    before = F.sum("w").over(by_item.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    prefix = (item_w.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("w").over(by_item)})
              .where(F.col("before") <= (1 - threshold) * F.col("total") + 1e-6)
              .select("s", F.col("at").alias("q"), "size").distinct())
    text = docs.select("doc_id", row_key("doc_id", "text").alias("_key"),
                       F.filter(words(F.col("text")), lambda w: w != "").alias("_w"))
    hits = (shingle_rows(text, "_w", "_key").join(small(prefix), "s")
            .select("_key", F.greatest(F.col("at") - F.col("q"), F.lit(0)).alias("start"), "size").distinct())
    starts = materialise(hits.groupBy("_key").agg(F.collect_set(F.struct("start", "size")).alias("_windows")))
    n_docs = starts.count()
    # second look at the documents that have windows: the windows' words
    windows = (text.join(broadcast_if_small(starts, n_docs, 512), "_key")
               .select("doc_id", "_key", "_w", F.explode("_windows").alias("x"))
               .select("doc_id", "_key", "x.start", "x.size", F.slice("_w", F.col("x.start") + 1, F.col("x.size")).alias("_w")))
    windows = materialise(windows.dropDuplicates(["_key", "start", "size"]).withColumn("content", F.xxhash64("_w")))
    contents = windows.select("content", "size", "_w").dropDuplicates(["content", "size"])
    w_known = item_w.groupBy("s").agg(F.max("w").alias("w"))
    content_w = materialise(shingle_rows(contents, "_w", "content", "size").join(small(w_known), "s", "left")
                            .withColumn("w", F.coalesce("w", idf(F.lit(0)))))
    prints = content_w.groupBy("content", "size").agg(*fingerprint(F.col("w"), F.col("s")), F.sum("w").alias("total"))
    prints = materialise(prints.select(F.col("content").alias("l"), "size", fold_bits().alias("fp"), "total"))
    item_prints = item_w.groupBy("item", "size").agg(*fingerprint(F.col("w"), F.col("s")), F.sum("w").alias("total"))
    # tables of their own: the sums of 64 bits would be planned anew, twice, with each step of what follows
    item_prints = materialise(item_prints.select(F.col("item").alias("r"), "size", fold_bits().alias("fp"), "total"))
    pairs = materialise(hamming_candidates(prints, item_prints))
    # exact weighted Jaccard: sum of the least weights over sum of the greatest
    left = content_w.groupBy(F.col("content").alias("l"), "s").agg(F.sum("w").alias("wl"))
    right = item_w.groupBy(F.col("item").alias("r"), "s").agg(F.sum("w").alias("wr"))
    common = (pairs.join(left, "l").join(right, ["r", "s"])
              .groupBy("l", "r").agg(F.sum(F.least("wl", "wr")).alias("common")))
    sim = F.col("common") / (F.col("tl") + F.col("tr") - F.col("common"))
    found = (common.join(prints.select("l", "size", F.col("total").alias("tl")), "l")
             .join(item_prints.select("r", "size", F.col("total").alias("tr")), ["r", "size"])
             .withColumn("similarity", sim).where(F.col("similarity") >= threshold - 1e-9)
             .join(items.select(F.col("item").alias("r"), "item_id"), "r")
             .select(F.col("l").alias("content"), "size", "item_id", "similarity"))
    return (windows.join(found, ["content", "size"])
            .groupBy("doc_id", "_key", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"),
                 F.count(F.lit(1)).alias("n_windows"))
            .select("doc_id", "_key", "item_id", F.col("best.similarity").alias("similarity"),
                    (-F.col("best.at")).alias("start"), "n_windows"))


def decontaminate(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, in the columns of ``docs``."""
    key = fresh(docs, "_key")
    leaks = find_leaks(docs, bench, threshold).select(F.col("_key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(leaks, key, "left_anti").select(*docs.columns)
