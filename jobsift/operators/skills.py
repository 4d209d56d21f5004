"""Skill extraction: dictionary hits per text, (job, skill) pairs, token
keywords and the per-pair skill overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.functions.terms import (MAX_LITERAL_TERMS, RUN_PATTERN, TermDictionary, match_terms,
                                     original_terms)
from jobsift.operators import termtable


MAX_TERMS = 1_000_000  # entries of a dictionary given as a table (it is read to the driver)


def as_dictionary(terms, edge: str = "word") -> TermDictionary:
    """A dictionary from a list, or from the first column of a DataFrame
    (``dictionaries.load_term_list``) of at most MAX_TERMS rows."""
    if isinstance(terms, TermDictionary):
        return terms
    if isinstance(terms, DataFrame):
        rows = terms.select(terms.columns[0]).limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValueError(f"a dictionary of over {MAX_TERMS} entries; join it as a table instead")
        terms = [r[0] for r in rows]
    return TermDictionary(list(terms), edge=edge)


def with_skills(df: DataFrame, text_col: str, terms, out_col: str = "skills",
                edge: str = "word") -> DataFrame:
    """Add ``out_col``: sorted distinct lower-case dictionary hits of
    ``text_col`` (canonical form used for scoring).  NULL text -> [].  For
    dictionaries that do not fit a plan there is ``termtable.skill_sets``."""
    dic = as_dictionary(terms, edge)
    return df.withColumn(out_col, match_terms(F.col(text_col), dic))


def skill_pairs(df: DataFrame, key_cols: list[str], text_col: str, terms,
                edge: str = "word", strategy: str = "auto",
                max_broadcast_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """One row per (input row, original-case dictionary entry) hit:
    ``key_cols + [skill]``.  Entries that differ only by case give one row
    each, as in the original.

    ``strategy``: "literal" matches inside the projection against the
    dictionary as a literal (fast, for dictionaries up to a few thousand
    entries); "join" explodes each text's candidate n-grams and joins them
    to the dictionary as a table (for large dictionaries); "auto" picks by
    dictionary size.  A large dictionary given as a DataFrame stays one
    (``termtable.hit_rows``)."""
    if isinstance(terms, DataFrame) and edge == "word" and strategy != "literal" and terms.count() > MAX_LITERAL_TERMS:
        return termtable.hit_rows(df, key_cols, text_col, terms, max_broadcast_bytes).withColumnRenamed("entry", "skill")
    dic = as_dictionary(terms, edge)
    n_gram_entries = sum(len(v) for v in dic.ngram_terms.values())
    if strategy == "join" or (strategy == "auto" and n_gram_entries > MAX_LITERAL_TERMS):
        return skill_pairs_join(df, key_cols, text_col, dic, max_broadcast_bytes)
    hits = with_skills(df.select(*key_cols, text_col), text_col, dic, "__hits")
    return hits.select(*key_cols, F.explode(original_terms(F.col("__hits"), dic)).alias("skill"))


def candidate_grams(text: Column, run_counts: list[int]) -> Column:
    """Distinct windows of n consecutive word / non-word runs of
    lower(text) that start and end on a word run, for each n (odd).  The
    runs array is bound once as a lambda variable."""
    runs = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(RUN_PATTERN), 0),
                      F.array().cast("array<string>"))

    def body(r):
        first = F.when(F.get(r, 0).rlike(r"^(?U)\w"), F.lit(0)).otherwise(F.lit(1))
        parts = []
        for n in run_counts:
            starts = F.sequence(first, F.size(r) - n, F.lit(2))
            wins = F.transform(starts, lambda i: F.concat(*[F.get(r, i + j) for j in range(n)]))
            parts.append(F.when(F.size(r) - n >= first, wins).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(parts[0] if len(parts) == 1 else F.concat(*parts))

    return F.get(F.transform(F.array(runs), body), 0)


def skill_pairs_join(df: DataFrame, key_cols: list[str], text_col: str, dic: TermDictionary,
                     max_broadcast_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Dictionary as a table: candidate n-grams of every text are exploded
    (distinct per row) and equi-joined to (gram, skill).  The dictionary is
    broadcast when its size - known on the driver - is under the bound,
    so the texts are never shuffled; above it the join shuffles on the gram
    and AQE's skew join splits hot grams."""
    spark = df.sparkSession
    rows = [(low, orig) for n in dic.ngram_terms for low in dic.ngram_terms[n] for orig in dic.by_lower[low]]
    parts = []
    if rows:
        table = spark.createDataFrame(rows, "gram string, skill string")
        est = sum(len(a.encode()) + len(b.encode()) + 48 for a, b in rows)
        right = F.broadcast(table) if est <= max_broadcast_bytes else table
        cand = df.select(*key_cols, F.explode(candidate_grams(F.col(text_col), sorted(dic.ngram_terms)))
                         .alias("gram"))
        parts.append(cand.join(right, "gram").select(*key_cols, "skill"))
    if dic.regex_terms:
        only_regex = TermDictionary([o for low in dic.regex_terms for o in dic.by_lower[low]], edge=dic.edge)
        hits = with_skills(df.select(*key_cols, text_col), text_col, only_regex, "__hits")
        parts.append(hits.select(*key_cols, F.explode(original_terms(F.col("__hits"), only_regex))
                                 .alias("skill")))
    if not parts:
        return df.select(*key_cols, F.lit(None).cast("string").alias("skill")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def live_skill_pairs(pairs: DataFrame, live_jobs: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct (url, skill) pairs of jobs still in the table: repeats and
    pairs of removed jobs do not accumulate.  Both steps shuffle on url
    only; the semi join key is the job url."""
    live = live_jobs.select(url_col)
    return pairs.select(url_col, "skill").distinct().join(live, url_col, "left_semi")


def token_keywords(df: DataFrame, text_col: str, stop_words, out_col: str = "keywords",
                   min_len: int = 3) -> DataFrame:
    """Token keywords of a text: lower-cased ``\\w+`` tokens, stop words
    removed, length >= min_len, distinct and sorted.  No part-of-speech
    filter and no lemmatiser (the original used an NLP library for both);
    tokens are their own lemma."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))]) if stop_words else \
        F.array().cast("array<string>")
    toks = F.coalesce(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)\w+"), 0),
                      F.array().cast("array<string>"))
    kept = F.filter(F.array_except(toks, stop), lambda t: F.length(t) >= min_len)
    return df.withColumn(out_col, F.array_sort(F.array_distinct(kept)))


def token_skills(df: DataFrame, keywords_col: str, terms, out_col: str = "token_skills") -> DataFrame:
    """Skills as the original app computed them: keyword tokens that are
    dictionary entries exactly as written (case-sensitive), so multi-word
    and upper-case entries never match."""
    dic = as_dictionary(terms)
    lit = F.array(*[F.lit(t) for t in dic.terms])
    return df.withColumn(out_col, F.array_sort(F.array_intersect(F.col(keywords_col), lit)))
