"""Dictionaries as tables: matching and keyword classification by joins.

``terms.match_terms`` writes the dictionary into the plan, which suits some
thousands of entries.  Here the dictionary stays a DataFrame of any size.  A
lower-cased text is split once into alternating runs of word and other
characters; an entry hits where it equals a window of whole runs, so the text's
distinct windows, of the run counts that the dictionary has, are joined to the
entries by equality.  Entries that begin or end with other characters (``c++``)
follow ``\\b``, too: such an edge must have a word run beside it.  The entries
are broadcast if their counted size is under the bound; beyond it a broadcast
bitmap of their hashes drops the windows that no entry equals, the join of the
others is dealt by window, and AQE splits hot ones.

Defined cases: NULL and empty texts have no hits; NULL and empty entries are
left out; entries that differ by case only are hits of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions.terms import RUN_PATTERN
from jobsift.sources.sinks import scratch_table

MAX_BROADCAST_BYTES = 64 << 20
ENTRY_BITS = 16    # bits of the bitmap for each entry: about one in 17 other windows passes
MAX_BITS = 1 << 28  # 32 MB; beyond 16 million entries more of the others pass
BLOCK_BITS = 15     # a row of the bitmap has 2^15 bits


def entry_table(terms: DataFrame) -> DataFrame:
    """First column of ``terms`` -> entry, gram (lower case), n (runs), word_first."""
    entry = F.col(terms.columns[0])
    low = F.lower("entry")
    return (terms.select(entry.alias("entry")).where("entry is not null and entry <> ''").distinct()
            .select("entry", low.alias("gram"), F.size(F.regexp_extract_all(low, F.lit(RUN_PATTERN), 0)).alias("n"),
                    low.rlike(r"^(?U)\w").alias("word_first")))


def small(df: DataFrame, *text_cols: str, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table is under the broadcast bound, by its counted rows and text lengths."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_cols), F.lit(0))
    return (df.agg(F.sum(size + 64)).first()[0] or 0) <= limit


def windows(text: Column, shapes: list[tuple[int, bool]]) -> Column:
    """Distinct windows of ``n`` runs of the lower-cased text, for each shape
    (n, begins with a word run), whose other-character edges lie inside the text."""
    runs = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(RUN_PATTERN), 0), F.array().cast("array<string>"))

    def body(r):
        word_at_0 = F.get(r, 0).rlike(r"^(?U)\w")
        parts = [F.array().cast("array<string>")]
        for n, word_first in shapes:
            first = F.when(word_at_0, 0).otherwise(1) if word_first else F.when(word_at_0, 1).otherwise(2)
            word_last = word_first == (n % 2 == 1)
            last = F.size(r) - n - (0 if word_last else 1)
            wins = F.transform(F.sequence(first, last, F.lit(2)), lambda i: F.concat(*[F.get(r, i + j) for j in range(n)]))  # noqa: B023
            parts.append(F.when(last >= first, wins).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.concat(*parts))
    return F.get(F.transform(F.array(runs), body), 0)


def possible(cand: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``cand`` whose ``gram`` may be one of ``entries``: all that
    are, and a few others (the join that follows is exact)."""
    bits, wanted = 1 << BLOCK_BITS, min(ENTRY_BITS * entries.count(), MAX_BITS)
    while bits < wanted:
        bits *= 2
    place = F.xxhash64("gram").bitwiseAND(F.lit(bits - 1))
    block = lambda p: F.shiftright(p, BLOCK_BITS)
    word = lambda p: F.shiftright(p, 6).bitwiseAND((1 << BLOCK_BITS - 6) - 1).cast("int")
    marks = entries.select(place.alias("p")).select(block("p").alias("block"), word("p").alias("word"),
                                                    F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask"))
    empty = entries.sparkSession.range(bits // 64).select((F.col("id") * 64).alias("p")).select(
        block("p").alias("block"), word("p").alias("word"), F.lit(0).cast("long").alias("mask"))
    rows = marks.union(empty).groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    rows = rows.groupBy(F.col("block").alias("__block")).agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("__words"))
    rows = rows.select("__block", F.transform("__words", lambda x: x["mask"]).alias("__words"))
    there = F.getbit(F.get("__words", word("__at")), F.col("__at").bitwiseAND(63).cast("int")) == 1
    return (cand.withColumn("__at", place).join(F.broadcast(rows), block("__at") == F.col("__block"))
            .where(there).select(*cand.columns))


def hit_rows(df: DataFrame, key_cols: list[str], text_col: str, terms: DataFrame,
             max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key_cols + entry (as written): one row per input row and entry that it holds."""
    entries = entry_table(terms)
    shapes = sorted(tuple(r) for r in entries.select("n", "word_first").distinct().collect())  # run counts, not entries
    table = entries.select("gram", "entry")
    cand = df.select(*key_cols, F.explode(windows(F.col(text_col), shapes)).alias("gram"))
    if small(table, "gram", "entry", limit=max_broadcast_bytes):
        table = F.broadcast(table)
    else:
        table = scratch_table(table, "entries")  # counted, marked and joined
        cand = possible(cand, table)
    return cand.join(table, "gram").select(*key_cols, "entry")


def skill_sets(df: DataFrame, key: str, text_col: str, terms: DataFrame, **kw) -> DataFrame:
    """key, skills: the sorted distinct lower-case entries of each row that has any."""
    hits = hit_rows(df, [key], text_col, terms, **kw).select(key, F.lower("entry").alias("entry"))
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("entry")).alias("skills"))


KEPT_POS = ["NOUN", "PROPN", "ADJ"]  # fixed values: parts of speech that carry the most signal


def lemma_keywords(df: DataFrame, key: str, text_col: str, lemmas: DataFrame, stop_words: DataFrame, min_len: int = 3,
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key, keywords: the sorted distinct lemmas of each row's word tokens.

    ``lemmas`` (surface, lemma, pos) is a table of any size: tokens, once a row,
    are joined to it by surface.  A token without an entry is its own lemma and
    stays; an entry stays if its part of speech is NULL or in KEPT_POS.  Lemmas
    of fewer than ``min_len`` characters and those of ``stop_words`` (first
    column) go.  Rows without keywords have an empty array; ``key`` is unique."""
    stop = stop_words.select(F.col(stop_words.columns[0]).alias("lemma")).where("lemma is not null").distinct()
    table = (lemmas.where("surface is not null and lemma is not null")
             .select("surface", "lemma", (F.col("pos").isNull() | F.col("pos").isin(KEPT_POS)).alias("kept")).distinct())
    near = lambda t, *cols: F.broadcast(t) if small(t, *cols, limit=max_broadcast_bytes) else t
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)\w+"), 0))
    tokens = df.select(key, F.explode(found).alias("surface"))
    of = (tokens.join(near(table, "surface", "lemma"), "surface", "left").where(F.coalesce("kept", F.lit(True)))
          .select(key, F.coalesce("lemma", "surface").alias("lemma")).where(F.length("lemma") >= min_len)
          .join(near(stop, "lemma"), "lemma", "left_anti"))
    sets = of.groupBy(key).agg(F.array_sort(F.collect_set("lemma")).alias("keywords"))
    return df.select(key).join(sets, key, "left").select(
        key, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def load_keywords(spark: SparkSession, path: str) -> DataFrame:
    """main, sub (empty: the main's own), keyword: a CSV with that header."""
    rows = spark.read.option("header", True).csv(path).select("main", "sub", "keyword")
    return rows.withColumn("sub", F.when(F.col("sub") != "", F.col("sub")))


def keyword_table(spark: SparkSession, rows=None) -> DataFrame:
    """The default keyword table, by rule from the taxonomy."""
    return spark.createDataFrame(rows or D.taxonomy_keyword_rows(), "main string, sub string, keyword string")


def category_keywords(df: DataFrame, id_col: str, title_col: str, text_col: str, keywords: DataFrame,
                      title_weight: int = 3, text_weight: int = 1,
                      max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """id_col, main_category, sub_category: ``classify.category_keywords`` with
    the keywords as a table (main, sub, keyword) of any size.

    Title and text are one scan: their windows are joined to the keywords
    once, with the weight of the column that they come from."""
    keys = (keywords.where("keyword is not null and keyword <> ''")
            .select("main", "sub", F.lower("keyword").alias("gram")).distinct())
    entries = entry_table(keys.select("gram").distinct())
    shapes = sorted(tuple(r) for r in entries.select("n", "word_first").distinct().collect())
    place = {m: i for i, (m, _) in enumerate(D.TAXONOMY)}
    sub_place = {ms: i for i, ms in enumerate(D.TAXONOMY_ROWS)}
    spark = df.sparkSession
    mains = F.broadcast(spark.createDataFrame(list(place.items()), "main string, _m int"))
    subs = F.broadcast(spark.createDataFrame([(*ms, i) for ms, i in sub_place.items()], "main string, sub string, _s int"))
    order = F.coalesce("_m", F.lit(999)) * 1000 + F.when(F.col("sub").isNull(), 0).otherwise(F.coalesce("_s", F.lit(999)))
    table = keys.join(mains, "main", "left").join(subs, ["main", "sub"], "left").select("gram", "main", "sub", order.alias("order"))
    near = small(table, "gram", "main", "sub", limit=max_broadcast_bytes)
    if not near:
        table = scratch_table(table, "keywords")
    weighed = F.concat(*[F.transform(windows(F.col(c), shapes), lambda g: F.struct(g.alias("gram"), F.lit(w).alias("w")))  # noqa: B023
                         for c, w in ((title_col, title_weight), (text_col, text_weight))])
    cand = df.select(id_col, F.explode(weighed).alias("x")).select(id_col, "x.gram", "x.w")
    hits = cand.join(F.broadcast(table), "gram") if near else possible(cand, table).join(table, "gram")
    scope = hits.groupBy(id_col, "main", "sub", "order").agg(F.sum("w").alias("own"))
    # a sub adds its main's own weight
    of_main = F.coalesce(F.max(F.when(F.col("sub").isNull(), F.col("own"))).over(Window.partitionBy(id_col, "main")), F.lit(0))
    score = F.col("own") + F.when(F.col("sub").isNull(), 0).otherwise(of_main)
    best = scope.select(id_col, "main", "sub", "order", score.alias("score")).groupBy(id_col).agg(
        F.max(F.struct("score", (-F.col("order")).alias("o"), "main", F.coalesce("sub", F.lit("Other")).alias("sub"))).alias("b"))
    return df.select(id_col).join(best, id_col, "left").select(
        id_col, F.coalesce("b.main", F.lit(D.JOB_DEFAULT["main_category"])).alias("main_category"),
        F.coalesce("b.sub", F.lit(D.JOB_DEFAULT["sub_category"])).alias("sub_category"))
