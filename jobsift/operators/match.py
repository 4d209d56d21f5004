"""CV x job matching: score every CV against the jobs of its main category
and keep the top K per CV.

Plan (one job for N CVs x M jobs; the original scores one CV at a time):

* Both sides are reduced first to the columns the score needs (ids,
  category, level index, vector + its norm, skill set as 64-bit masks over
  the dictionary); descriptions and the matched / missing skill names are
  produced only for the K survivors.
* Candidate rule as an equi-join: a CV's key is ``'=' || main``; a CV whose
  main category is 'Other' (bypass) gets key ``'*'``.  Each job carries two
  keys, ``'=' || main`` and ``'*'``.  So the bypass needs no cross join and
  no OR-condition nested loop.
* The CV side is broadcast when its estimated size is under a bound (the
  size comes from a count + vector width, measured before the join); the
  job side then streams with no shuffle at all, whatever the skew of its
  categories.  If only the job side is under the bound, it is broadcast
  instead.  Above the bound on both sides they are salted: jobs get
  ``pmod(xxhash64(seq), S)``, CVs are replicated over the S salts, and the
  join key is (key, salt) - a hot category is split S ways.
* Top-K per CV is ``row_number() <= K`` over (cv_id ORDER BY match_score
  DESC, url, seq); Catalyst inserts a partial WindowGroupLimit before the
  shuffle, so at most K rows per (CV, task) ever leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions import scores as S

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_SALT_BUCKETS = 64
MAX_PAIRS = 32_000_000  # CVs x jobs that are scored one by one
ALL_KEY = "*"


def _sql_lit(t: str) -> str:
    return "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"


def skill_ids(skills: Column, terms: list[str]) -> Column:
    """Dictionary positions of a skill array; case does not count (the terms
    are lower-case names).  Entries outside the dictionary have no position."""
    index = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))])
    return F.filter(F.transform(skill_names(skills), lambda t: F.try_element_at(index, t)), lambda i: i.isNotNull())


def skill_names(skills: Column) -> Column:
    """A skill array as a set of lower-case names (NULL: empty)."""
    return F.array_distinct(F.transform(F.coalesce(skills, F.array().cast("array<string>")), F.lower))


def skill_masks(ids_col: str, n_words: int, prefix: str) -> list[Column]:
    """A skill set as 64-bit masks over the dictionary (bit i = entry i),
    computed once per row, so the per-pair overlap is
    ``bit_count(cv_mask & job_mask)`` - no per-pair hash sets."""
    return [F.expr(f"aggregate({ids_col}, 0L, (acc, i) -> IF(i >= {64 * w} AND i < {64 * w + 64}, "
                   f"acc | shiftleft(1L, i - {64 * w}), acc))").alias(f"{prefix}{w}")
            for w in range(n_words)]


def decode_mask(words: list[str], terms: list[str]) -> Column:
    """Sorted entry names of the set bits of mask columns ``words``."""
    arr = "array(" + ", ".join(words) + ")"
    names = "array(" + ", ".join(_sql_lit(t) for t in terms) + ")"
    return F.expr(f"array_sort(filter({names}, (e, i) -> "
                  f"(shiftright(get({arr}, CAST(i div 64 AS INT)), i % 64) & 1L) = 1L))")


def prepare_cvs(cvs: DataFrame, terms: list[str], bypass: bool = True,
                dims: int | None = None) -> DataFrame:
    """cvs: cv_id, main_category, sub_category, level, vector, skills."""
    main = F.col("main_category")
    key = F.concat(F.lit("="), main)
    if bypass:
        key = F.when(main == F.lit(D.BYPASS_CATEGORY), F.lit(ALL_KEY)).otherwise(key)
    return cvs.select(
        F.col("cv_id"),
        key.alias("jkey"),
        main.alias("cv_main"),
        F.col("sub_category").alias("cv_sub"),
        S.level_index(F.col("level"), case_sensitive=True).alias("cv_level_idx"),
        F.col("vector").alias("cv_vec"),
        S.norm("vector", dims).alias("cv_norm"),
        skill_ids(F.col("skills"), terms).alias("__ids"),
    ).select("*", *skill_masks("__ids", _n_words(terms), "cv_m")).drop("__ids")


def prepare_jobs(jobs: DataFrame, terms: list[str], bypass: bool = True,
                 dims: int | None = None) -> DataFrame:
    """jobs: seq, url, main_category, sub_category, level, bert_vector, skills."""
    keys = [F.concat(F.lit("="), F.col("main_category"))]
    if bypass:
        keys.append(F.lit(ALL_KEY))
    return jobs.select(
        F.col("seq"), F.col("url"),
        F.explode(F.array(*keys)).alias("jkey"),
        F.col("main_category").alias("job_main"),
        F.col("sub_category").alias("job_sub"),
        S.level_index(F.col("level"), case_sensitive=False).alias("job_level_idx"),
        F.col("bert_vector").alias("job_vec"),
        S.norm("bert_vector", dims).alias("job_norm"),
        F.size(skill_names(F.col("skills"))).alias("job_nreq"),
        skill_ids(F.col("skills"), terms).alias("__ids"),
    ).select("*", *skill_masks("__ids", _n_words(terms), "job_m")).drop("__ids")


def estimate_cv_bytes(cvs: DataFrame, n_words: int = 1) -> tuple[int, int, int]:
    """(rows, estimated bytes, vector width) of the prepared CV side: one
    small aggregate over the CV input (only the vector column is read)."""
    row = cvs.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()
    n, dims = int(row["n"]), int(row["dims"])
    per_row = 96 + 4 * max(dims, 0) + 8 * n_words
    return n, n * per_row, dims


def estimate_job_bytes(jobs: DataFrame, n_words: int = 1) -> int:
    """Estimated bytes of the prepared job side (two keys per job)."""
    row = jobs.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.max(F.size("bert_vector")), F.lit(0)).alias("dims")).first()
    return 2 * int(row["n"]) * (96 + 4 * int(row["dims"]) + 8 * n_words)


def score_pairs(cvs_p: DataFrame, jobs_p: DataFrame, broadcast_cvs: bool, n_words: int,
                salt_buckets: int = DEFAULT_SALT_BUCKETS, dims: int | None = None,
                broadcast_jobs: bool = False) -> DataFrame:
    """All candidate (CV, job) pairs with the score components; skill sets
    stay as masks (decode with ``decode_mask`` after top-K).  The smaller
    side is broadcast when it is under the bound; otherwise salted."""
    if broadcast_cvs:
        pairs = jobs_p.join(F.broadcast(cvs_p), "jkey")
    elif broadcast_jobs:
        pairs = cvs_p.join(F.broadcast(jobs_p), "jkey")
    else:
        salted_jobs = jobs_p.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salt_buckets)))
        salted_cvs = cvs_p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        pairs = salted_jobs.join(salted_cvs, ["jkey", "salt"]).drop("salt")
    n_matched = None
    for w in range(n_words):
        c = F.bit_count(F.col(f"cv_m{w}").bitwiseAND(F.col(f"job_m{w}")))
        n_matched = c if n_matched is None else n_matched + c
    cat = S.category_score(F.col("cv_main"), F.col("cv_sub"), F.col("job_main"), F.col("job_sub"))
    sen = S.seniority_score(F.col("cv_level_idx"), F.col("job_level_idx"))
    sem = S.semantic_score("cv_vec", "job_vec", "cv_norm", "job_norm", dims)
    masks = [f"cv_m{w}" for w in range(n_words)] + [f"job_m{w}" for w in range(n_words)]
    keep = ["cv_id", "seq", "url", "cv_main", "cv_level_idx", "job_main", "job_level_idx", "job_nreq", *masks]
    # two projections (not a chain of withColumn): each step re-analyses
    # the plan, and the unrolled dot product makes it large
    parts = pairs.select(*keep, n_matched.alias("n_matched"), cat.alias("cat"), sen.alias("sen"),
                         sem.alias("sem"))
    return parts.select(
        *keep[:7], "n_matched", "job_nreq", *masks,
        S.match_score(S.combined_score(F.col("cat"), S.skill_score(F.col("n_matched"), F.col("job_nreq")),
                                       F.col("sen"), F.col("sem"))).alias("match_score"),
        F.round("cat", 1).alias("score_category"),
        F.round(S.skill_score(F.col("n_matched"), F.col("job_nreq")), 1).alias("score_skills"),
        F.round("sen", 1).alias("score_seniority"),
        F.round("sem", 1).alias("score_semantic"))


def with_skill_names(pairs: DataFrame, terms: list[str], n_words: int) -> DataFrame:
    """matched = cv & job, missing = job & ~cv, as sorted name arrays."""
    matched = [f"(cv_m{w} & job_m{w})" for w in range(n_words)]
    missing = [f"(job_m{w} & ~cv_m{w})" for w in range(n_words)]
    return (pairs.withColumn("matched_skills", decode_mask(matched, terms))
                 .withColumn("missing_skills", decode_mask(missing, terms)))


def _n_words(terms: list[str]) -> int:
    return max(1, (len(terms) + 63) // 64)


def _terms(terms) -> list[str]:
    """Canonical lower-case dictionary in first-seen order."""
    out: dict[str, None] = {}
    for t in terms:
        if t:
            out.setdefault(t.lower(), None)
    return list(out)


def all_pair_scores(cvs: DataFrame, jobs: DataFrame, terms, bypass: bool = True,
                    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Every candidate pair with its components and matched / required
    skill counts (for aggregates over the score distribution; never
    collected).  Names can be added with ``with_skill_names``."""
    terms = _terms(terms)
    n_words = _n_words(terms)
    _, est, dims = estimate_cv_bytes(cvs, n_words)
    return score_pairs(prepare_cvs(cvs, terms, bypass, dims), prepare_jobs(jobs, terms, bypass, dims),
                       est <= max_broadcast_bytes, n_words, dims=dims)


def category_level_counts(cvs: DataFrame, jobs: DataFrame, bypass: bool = True) -> DataFrame:
    """How many candidate pairs have each combination of category score and
    levels: (score_category, cv_level_idx, job_level_idx, score_seniority,
    pairs).  The scores depend on categories and levels alone, so both sides
    are counted by them first and the small tables of counts are joined - no
    pair is made."""
    key = F.concat(F.lit("="), F.col("main_category"))
    cv_key = F.when(F.col("main_category") == D.BYPASS_CATEGORY, F.lit(ALL_KEY)).otherwise(key) if bypass else key
    c = cvs.groupBy(cv_key.alias("jkey"), F.col("main_category").alias("cv_main"), F.col("sub_category").alias("cv_sub"),
                    S.level_index(F.col("level"), case_sensitive=True).alias("cv_level_idx")).agg(F.count(F.lit(1)).alias("nc"))
    j = jobs.groupBy(F.col("main_category").alias("job_main"), F.col("sub_category").alias("job_sub"),
                     S.level_index(F.col("level"), case_sensitive=False).alias("job_level_idx")).agg(F.count(F.lit(1)).alias("nj"))
    keys = [F.concat(F.lit("="), F.col("job_main"))] + ([F.lit(ALL_KEY)] if bypass else [])
    pairs = c.join(j.withColumn("jkey", F.explode(F.array(*keys))), "jkey")
    cat = S.category_score(F.col("cv_main"), F.col("cv_sub"), F.col("job_main"), F.col("job_sub"))
    sen = S.seniority_score(F.col("cv_level_idx"), F.col("job_level_idx"))
    return (pairs.groupBy(F.round(cat, 1).alias("score_category"), "cv_level_idx", "job_level_idx",
                          F.round(sen, 1).alias("score_seniority"))
            .agg(F.sum(F.col("nc") * F.col("nj")).alias("pairs")))


def top_k(pairs: DataFrame, k: int = D.TOP_K) -> DataFrame:
    w = Window.partitionBy("cv_id").orderBy(F.col("match_score").desc(), F.col("url"), F.col("seq"))
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def attach_job_details(top: DataFrame, jobs_display: DataFrame, top_bytes: int,
                       max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Join the display columns (title, company, location, date,
    description) back by seq, after top-K.  The top-K side has at most
    n_cv * K rows; it is broadcast when that bound (in bytes) is small, so
    the jobs table is scanned once more without a shuffle; otherwise both
    sides shuffle on seq (a job in many CVs' top-K repeats at most n_cv
    times)."""
    right = F.broadcast(top) if top_bytes <= max_broadcast_bytes else top
    return jobs_display.join(right, "seq")


SCORE_RECORD = ["cv_id", "rank", "seq", "job_title", "company", "url", "date", "description",
                "match_score", "score_category", "score_skills", "score_seniority",
                "score_semantic", "matched_skills", "missing_skills", "location",
                "search_date", "main_category"]


def match_topk(cvs: DataFrame, jobs: DataFrame, terms, k: int = D.TOP_K, bypass: bool = True,
               max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Top-K jobs per CV with the full score record.

    cvs:  cv_id, main_category, sub_category, level, vector, skills
    jobs: seq, url, job_title, company_name, location, search_date,
          description_text, main_category, sub_category, level,
          bert_vector, skills
    ``terms``: the skill dictionary the ``skills`` arrays were built with.
    Above MAX_PAIRS pairs, or if neither side is under the broadcast bound,
    ``blockmatch`` does the work: the top K of pairs that stream sorts them
    all, and what does not fit the memory of a task goes to disk.
    """
    terms = _terms(terms)
    n_words = max(1, (len(terms) + 63) // 64)
    n_cv, est, dims = estimate_cv_bytes(cvs, n_words)
    bc_cvs = est <= max_broadcast_bytes
    # only when the CV side is too big: is the job side small enough instead?
    bc_jobs = not bc_cvs and estimate_job_bytes(jobs, n_words) <= max_broadcast_bytes
    if not (bc_cvs or bc_jobs) or n_cv * jobs.count() > MAX_PAIRS:
        from jobsift.operators import blockmatch  # which uses this module's parts
        return blockmatch.match_topk(cvs, jobs, k, bypass, max_broadcast_bytes, True)
    pairs = score_pairs(prepare_cvs(cvs, terms, bypass, dims), prepare_jobs(jobs, terms, bypass, dims),
                        broadcast_cvs=bc_cvs, n_words=n_words, dims=dims, broadcast_jobs=bc_jobs)
    top = with_skill_names(top_k(pairs, k), terms, n_words).select(
        "cv_id", "rank", "seq", "match_score", "score_category", "score_skills",
        "score_seniority", "score_semantic", "matched_skills", "missing_skills")
    display = jobs.select(
        "seq", "job_title", F.col("company_name").alias("company"), "url",
        F.col("search_date").alias("date"), F.col("description_text").alias("description"),
        "location", "search_date", "main_category")
    top_bytes = n_cv * k * (128 + 24 * min(len(terms), 64))
    return attach_job_details(top, display, top_bytes, max_broadcast_bytes).select(*SCORE_RECORD)


def single_cv_top(cv: DataFrame, jobs: DataFrame, terms, k: int = D.TOP_K, **kw) -> DataFrame:
    """The original page flow for one CV: score its candidates, sort by
    score (ties: url, seq) and keep the first K (TakeOrderedAndProject)."""
    return match_topk(cv, jobs, terms, k=k, **kw).orderBy(
        F.col("match_score").desc(), F.col("url"), F.col("seq")).limit(k)


def match_cards(top: DataFrame) -> DataFrame:
    """Result cards: integer score, colour band, breakdown, at most five
    missing skills joined by ', ', and the description split into the
    first 800 characters and the rest."""
    desc = F.coalesce(F.col("description"), F.lit(""))
    return top.select(
        "cv_id", "rank", "seq", "url", "job_title", "company", "location", "search_date",
        "main_category",
        F.col("match_score").cast("int").alias("score_pct"),
        S.score_band(F.col("match_score")).alias("band"),
        F.format_string("Category: %s%% | Skills: %s%% | Seniority: %s%% | Semantic: %s%%",
                        F.col("score_category").cast("string"), F.col("score_skills").cast("string"),
                        F.col("score_seniority").cast("string"),
                        F.col("score_semantic").cast("string")).alias("breakdown"),
        F.array_join(F.slice(F.col("missing_skills"), 1, D.MISSING_SHOWN), ", ").alias("missing_shown"),
        F.substring(desc, 1, D.PREVIEW_CHARS).alias("preview"),
        F.when(F.length(desc) > D.PREVIEW_CHARS, F.substring(desc, D.PREVIEW_CHARS + 1, 1 << 30))
         .otherwise(F.lit("")).alias("rest"),
    )
