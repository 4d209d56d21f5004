"""Classification: title rules, merging of classification responses,
fixed-size request batches and rule-based classifiers that stand in for the
hosted model (its labels are not reproducible; responses can also come in
as a table and be parsed with ``parse_responses``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import dictionaries as D
from jobsift.functions.text import requirements_section
from jobsift.operators.skills import with_skills

RESPONSE_SCHEMA = T.StructType([
    T.StructField("job_list", T.ArrayType(T.StructType([
        T.StructField("URL", T.StringType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("level", T.StringType()),
    ]))),
])


def _rx(pattern: str) -> str:
    return "(?U)" + pattern


def title_masks(title: Column) -> dict[str, Column]:
    """The title rule masks on lower(title) (NULL title -> '')."""
    t = F.lower(F.coalesce(title, F.lit("")))
    lead = t.rlike(_rx(D.LEAD_PATTERNS[0])) | t.rlike(_rx(D.LEAD_PATTERNS[1]))
    manager = t.rlike(_rx(D.MANAGER_PATTERN)) & ~t.rlike(_rx(D.MANAGER_EXCLUDE_PATTERN))
    senior = t.rlike(_rx(D.SENIOR_PATTERN)) | manager
    intern = t.rlike(_rx(D.INTERN_PATTERN))
    professional = t.rlike(_rx(D.PROFESSIONAL_PATTERN))
    return {"lead": lead, "senior": senior, "intern": intern, "professional": professional}


def level_override(df: DataFrame, title_col: str = "job_title", level_col: str = "level") -> DataFrame:
    """lead > senior > intern by title; otherwise the level is kept."""
    m = title_masks(F.col(title_col))
    new = (F.when(m["lead"], F.lit("lead")).when(m["senior"], F.lit("senior"))
            .when(m["intern"], F.lit("intern")).otherwise(F.col(level_col)))
    return df.withColumn(level_col, new)


def category_override(df: DataFrame, title_col: str = "job_title") -> DataFrame:
    """A professional title tagged Blue Collar becomes General / Other."""
    m = title_masks(F.col(title_col))
    bad = F.coalesce(F.col("sub_category") == F.lit(D.BLUE_COLLAR_SUB), F.lit(False)) & m["professional"]
    return (df.withColumn("__bad_bc", bad)
              .withColumn("sub_category", F.when(F.col("__bad_bc"), F.lit("Other")).otherwise(F.col("sub_category")))
              .withColumn("main_category", F.when(F.col("__bad_bc"), F.lit("General")).otherwise(F.col("main_category")))
              .drop("__bad_bc"))


def validate(df: DataFrame, title_col: str = "job_title") -> DataFrame:
    """Post-processing of any classification: level then category rules."""
    return category_override(level_override(df, title_col), title_col)


def override_metrics(df: DataFrame, title_col: str = "job_title") -> DataFrame:
    """One row: rule hits (lead, senior-not-lead, intern-only), their sum,
    and Blue Collar overrides - computed before the overrides are applied."""
    m = title_masks(F.col(title_col))
    lead = m["lead"]
    senior = m["senior"] & ~lead
    intern = m["intern"] & ~lead & ~m["senior"]
    bc = F.coalesce(F.col("sub_category") == F.lit(D.BLUE_COLLAR_SUB), F.lit(False)) & m["professional"]
    return df.agg(F.count_if(lead).alias("lead_fixed"), F.count_if(senior).alias("senior_fixed"),
                  F.count_if(intern).alias("intern_fixed"), F.count_if(bc).alias("blue_collar_fixed")) \
             .withColumn("level_fixed", F.col("lead_fixed") + F.col("senior_fixed") + F.col("intern_fixed"))


def merge_fanout(jobs: DataFrame, responses: DataFrame, url_col: str = "url") -> DataFrame:
    """Left join on URL (a URL answered twice gives two rows), then NULL ->
    default per column (a NULL answer value is replaced too)."""
    r = responses.select(F.col("URL").alias(url_col), F.col("main_category").alias("__m"),
                         F.col("sub_category").alias("__s"), F.col("level").alias("__l"))
    j = jobs.drop("main_category", "sub_category", "level")
    out = j.join(r, url_col, "left")
    return (out.withColumn("main_category", F.coalesce("__m", F.lit(D.JOB_DEFAULT["main_category"])))
               .withColumn("sub_category", F.coalesce("__s", F.lit(D.JOB_DEFAULT["sub_category"])))
               .withColumn("level", F.coalesce("__l", F.lit(D.JOB_DEFAULT["level"])))
               .drop("__m", "__s", "__l"))


def last_answer_per_url(responses: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The last answer per URL (largest ord): a partial aggregate, so a URL
    answered many times collapses map-side."""
    return (responses.groupBy("URL")
            .agg(F.max_by(F.struct("main_category", "sub_category", "level"), F.col(ord_col)).alias("a"))
            .select("URL", "a.main_category", "a.sub_category", "a.level"))


def merge_last_wins(jobs: DataFrame, responses: DataFrame, url_col: str = "url",
                    ord_col: str = "ord", default: dict | None = None) -> DataFrame:
    """Lookup join: one answer per URL (last wins); a job whose URL has no
    answer gets the whole default record; an answer present with a NULL
    value keeps the NULL."""
    default = default or D.JOB_DEFAULT
    r = last_answer_per_url(responses, ord_col).select(
        F.col("URL").alias(url_col), F.lit(True).alias("__hit"),
        F.col("main_category").alias("__m"), F.col("sub_category").alias("__s"), F.col("level").alias("__l"))
    out = jobs.drop("main_category", "sub_category", "level").join(r, url_col, "left")
    hit = F.col("__hit").isNotNull()
    return (out.withColumn("main_category", F.when(hit, F.col("__m")).otherwise(F.lit(default["main_category"])))
               .withColumn("sub_category", F.when(hit, F.col("__s")).otherwise(F.lit(default["sub_category"])))
               .withColumn("level", F.when(hit, F.col("__l")).otherwise(F.lit(default["level"])))
               .drop("__hit", "__m", "__s", "__l"))


def category_counts(df: DataFrame, col: str = "main_category", n: int = 10) -> DataFrame:
    """Top n values by frequency (NULLs excluded); ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)).limit(n))


# ---------------------------------------------------------------------------
# Fixed-size batches in row order
# ---------------------------------------------------------------------------

def quantile_range(df: DataFrame, order_col: str, buckets: int) -> Column:
    """Number of the range that a row's value lies in: ``buckets`` ranges of
    about equally many rows, cut at approximate quantiles (one aggregate, whose
    sketches combine before the shuffle; at most a cut a range comes to the
    driver).  The cuts are searched by halves."""
    share = [i / buckets for i in range(1, buckets)] or [1.0]
    cuts = sorted(set(df.agg(F.percentile_approx(order_col, share, 10 * buckets)).first()[0] or []))
    if not cuts:
        return F.lit(0).cast("bigint")
    kind = dict(df.dtypes)[order_col]

    def search(lo: int, hi: int) -> str:  # how many cuts lie under the value, as a tree of comparisons
        if lo == hi:
            return f"{lo}L"
        mid = (lo + hi) // 2
        return f"CASE WHEN `{order_col}` <= CAST('{cuts[mid]}' AS {kind}) THEN {search(lo, mid)} ELSE {search(mid + 1, hi)} END"
    return F.expr(search(0, len(cuts)))


def global_row_number(df: DataFrame, order_col: str = "seq", buckets: int = 256,
                      rows_per_bucket: int = 1_000_000) -> DataFrame:
    """1-based position of each row in ``order_col`` order (values unique),
    without a single-partition window and without relying on partition ids:
    values are cut into ranges of about equally many rows - at least
    ``buckets``, and enough for ``rows_per_bucket`` rows each - however sparse
    or clumped they are; rows are numbered inside their range (one shuffle on
    the range id), and per-range counts (one row per range) are prefix-summed
    and broadcast as offsets."""
    n_buckets = max(buckets, -(-df.count() // rows_per_bucket))
    b = df.withColumn("__b", quantile_range(df, order_col, n_buckets))
    local = b.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(order_col)))
    counts = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (local.join(F.broadcast(offsets), "__b")
            .withColumn("row_number", (F.col("__off") + F.col("__r")).cast("bigint"))
            .drop("__b", "__r", "__off"))


def chunk_ids(df: DataFrame, size: int = D.CHUNK_SIZE, order_col: str = "seq") -> DataFrame:
    """chunk = floor((position - 1) / size), positions in order_col order."""
    return (global_row_number(df, order_col)
            .withColumn("chunk", F.expr(f"(row_number - 1) div {size}"))
            .drop("row_number"))


def classify_batches(jobs: DataFrame, size: int = D.CHUNK_SIZE, trim: bool = True) -> DataFrame:
    """One request per chunk of ``size`` jobs in seq order: a JSON array of
    {URL, job_title, description_text} (description cut to its requirements
    section when ``trim``), NULL fields written as null."""
    desc = requirements_section(F.col("description_text")) if trim else F.col("description_text")
    # trimmed before the rows are numbered: whole texts enter no exchange
    rows = chunk_ids(jobs.select("seq", "url", "job_title", desc.alias("description_text")), size).select(
        "chunk", "seq", F.struct(F.col("url").alias("URL"), "job_title", "description_text").alias("item"))
    return (rows.groupBy("chunk")
            .agg(F.count(F.lit(1)).alias("n_jobs"), F.min("seq").alias("first_seq"),
                 F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("items"))
            .select("chunk", "n_jobs", "first_seq",
                    F.to_json(F.transform("items", lambda x: x["item"]),
                              {"ignoreNullFields": "false"}).alias("payload")))


def render_prompt(batches: DataFrame, template: str, placeholder: str = "{jobs_json}") -> DataFrame:
    """Render each batch into a prompt template (text before and after the
    placeholder are literals)."""
    head, _, tail = template.partition(placeholder)
    return batches.withColumn("prompt", F.concat(F.lit(head), F.col("payload"), F.lit(tail)))


def batch_sizes(prompts: DataFrame, col: str = "prompt") -> DataFrame:
    """Size estimate per batch: ceil(chars / 4) tokens."""
    est = F.ceil(F.length(F.col(col)) / D.CHARS_PER_TOKEN).cast("bigint")
    return prompts.select("chunk", F.length(F.col(col)).cast("bigint").alias("chars"), est.alias("est_tokens"))


def batch_totals(prompts: DataFrame, col: str = "prompt") -> DataFrame:
    """The run's report: a row per batch (chunk, batches = 1, n_jobs, chars,
    est_tokens) and, with chunk NULL, the totals over all batches; both from
    one aggregate (``rollup``).  Without batches there is no row."""
    sizes = prompts.select("chunk", "n_jobs", F.length(F.col(col)).cast("bigint").alias("chars"),
                           F.ceil(F.length(F.col(col)) / D.CHARS_PER_TOKEN).cast("bigint").alias("est_tokens"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    return sizes.rollup("chunk").agg(F.count("n_jobs").alias("batches"), total("n_jobs"), total("chars"), total("est_tokens"))


def parse_responses(responses: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Parse model answers: keep only those with a job_list; malformed or
    missing answers give no rows.  One row per classified job, with its
    position ``pos`` in the answer's list."""
    parsed = responses.withColumn("__r", F.from_json(F.col(payload_col), RESPONSE_SCHEMA))
    keep = [c for c in responses.columns if c != payload_col]
    return (parsed.select(*keep, F.posexplode(F.col("__r.job_list")).alias("pos", "j"))
            .select(*keep, F.col("pos").cast("bigint").alias("pos"),
                    "j.URL", "j.main_category", "j.sub_category", "j.level"))


# ---------------------------------------------------------------------------
# Rule-based classifiers (stand-ins for the hosted model)
# ---------------------------------------------------------------------------

def _contains_any(col: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.coalesce(col.contains(p), F.lit(False))
    return out


def seniority_rules(df: DataFrame, title_col: str = "job_title", desc_col: str = "description_text",
                    out_col: str = "level") -> DataFrame:
    """The prompt's ordered seniority rules over lower-cased title and
    description, first match wins, default junior."""
    t = F.lower(F.coalesce(F.col(title_col), F.lit("")))
    d = F.lower(F.coalesce(F.col(desc_col), F.lit("")))
    expr = F.lit(D.SENIORITY_DEFAULT)
    for scope, phrases, level in reversed(D.SENIORITY_RULES):
        if scope == "any":
            cond = _contains_any(t, phrases) | _contains_any(d, phrases)
        elif scope == "title":
            cond = _contains_any(t, phrases)
        elif scope == "desc":
            cond = _contains_any(d, phrases)
        elif scope == "title_suffix":
            cond = F.lit(False)
            for p in phrases:
                cond = cond | t.endswith(p)
        elif scope == "title_manager":
            cond = _contains_any(t, phrases) & ~_contains_any(t, ["junior", "assistant"])
        else:
            raise ValueError(scope)
        expr = F.when(cond, F.lit(level)).otherwise(expr)
    return df.withColumn(out_col, expr)


def category_phrases(df: DataFrame, title_col: str = "job_title") -> DataFrame:
    """First phrase line (in reference order) whose phrase the lower-cased
    title contains; no hit -> General / Other.  The phrase list is a fixed
    literal of ~80 entries, so the test runs inside the projection."""
    t = F.lower(F.coalesce(F.col(title_col), F.lit("")))
    main = F.lit(D.JOB_DEFAULT["main_category"])
    sub = F.lit(D.JOB_DEFAULT["sub_category"])
    for line, m, s in reversed(D.CATEGORY_PHRASES):
        cond = _contains_any(t, [p.strip().lower() for p in line.split(" / ")])
        main = F.when(cond, F.lit(m)).otherwise(main)
        sub = F.when(cond, F.lit(s)).otherwise(sub)
    return df.withColumn("main_category", main).withColumn("sub_category", sub)


def _keyword_rows(rows=None):
    rows = rows or D.taxonomy_keyword_rows()
    order = {m: i for i, (m, _) in enumerate(D.TAXONOMY)}
    sub_order = {(m, s): i for i, (m, s) in enumerate(D.TAXONOMY_ROWS)}
    return [(m, s, k.lower(), order.get(m, 999) * 1000 + (sub_order.get((m, s), 999) if s else 0))
            for m, s, k in rows]


def category_keywords(df: DataFrame, id_col: str, title_col: str, text_col: str, keyword_rows=None,
                      title_weight: int = 3, text_weight: int = 1) -> DataFrame:
    """Keyword classifier: whole-word keyword hits in title (weight 3) and
    text (weight 1).  Candidates: each main with main-scope hits (score =
    their weight, sub 'Other') and each sub with hits (score = its weight
    plus its main's, so a specific hit beats its main alone); the best
    candidate wins (ties: taxonomy order); no hit -> General / Other.

    All inside the row: each text is matched once, the candidates' keywords
    (a parameter of a few hundred) are literals, and the best is the greatest
    struct.  No join, no shuffle; ``id_col`` is only kept for the callers."""
    scopes: dict[tuple[str, str | None], tuple[int, set[str]]] = {}
    for main, sub, keyword, order in _keyword_rows(keyword_rows):
        scopes.setdefault((main, sub), (order, set()))[1].add(keyword)
    terms = sorted({k for _, words in scopes.values() for k in words})
    hits = with_skills(with_skills(df, title_col, terms, "__th"), text_col, terms, "__xh")

    def weight(main: str, sub: str | None) -> Column:
        if (main, sub) not in scopes:
            return F.lit(0)
        words = F.array(*[F.lit(k) for k in sorted(scopes[main, sub][1])])
        return (F.size(F.array_intersect("__th", words)) * title_weight
                + F.size(F.array_intersect("__xh", words)) * text_weight)

    candidates = []
    for (main, sub), (order, _) in scopes.items():
        own = weight(main, sub)
        score = own if sub is None else F.when(own > 0, own + weight(main, None)).otherwise(0)
        candidates.append(F.struct(score.alias("score"), F.lit(-order).alias("o"), F.lit(main).alias("main"),
                                   F.lit(sub if sub is not None else "Other").alias("sub")))
    best = hits.withColumn("__b", F.array_max(F.array(*candidates)))
    found = F.col("__b.score") > 0
    return (best.withColumn("main_category", F.when(found, F.col("__b.main")).otherwise(D.JOB_DEFAULT["main_category"]))
                .withColumn("sub_category", F.when(found, F.col("__b.sub")).otherwise(D.JOB_DEFAULT["sub_category"]))
                .drop("__b", "__th", "__xh"))


def classify_cvs(cvs: DataFrame, id_col: str = "cv_id", text_col: str = "text", keyword_rows=None,
                 default: dict | None = None) -> DataFrame:
    """Rule-based CV classification (stand-in for the model call): the
    headline (first line of the cleaned CV text) counts as the title; the
    category comes from ``category_keywords``, the level from
    ``seniority_rules``; a CV without text - where the model call has
    nothing to classify and fails - gets the whole default record
    (junior, General, Blue Collar)."""
    default = default or D.CV_DEFAULT
    base = cvs.select(id_col, text_col).withColumn(
        "__headline", F.coalesce(F.get(F.split(F.col(text_col), "\n"), 0), F.lit("")))
    cat = category_keywords(base, id_col, "__headline", text_col, keyword_rows)
    lvl = seniority_rules(cat, "__headline", text_col)
    failed = F.coalesce(F.col(text_col), F.lit("")) == ""
    return lvl.select(
        id_col,
        F.when(failed, F.lit(default["main_category"])).otherwise(F.col("main_category")).alias("main_category"),
        F.when(failed, F.lit(default["sub_category"])).otherwise(F.col("sub_category")).alias("sub_category"),
        F.when(failed, F.lit(default["level"])).otherwise(F.col("level")).alias("level"))
