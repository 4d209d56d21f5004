"""Column expressions for the match score and its parts.

All arithmetic is in double; rounding is Spark ``round`` (HALF_UP on the
shortest decimal form of the double).  These are plain Catalyst
expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift import dictionaries as D


def level_index(level: Column, case_sensitive: bool) -> Column:
    """Position of a level in the scale; unknown or NULL -> junior (1).
    The CV side compares as given, the job side lower-cases first."""
    lvl = level if case_sensitive else F.lower(level)
    expr = F.lit(D.UNKNOWN_LEVEL_INDEX)
    for i, name in reversed(list(enumerate(D.LEVEL_ORDER))):
        expr = F.when(lvl == F.lit(name), F.lit(i)).otherwise(expr)
    return expr.cast("int")


def category_score(cv_main: Column, cv_sub: Column, job_main: Column, job_sub: Column) -> Column:
    """0 if main differs, 75 if sub differs, else 100 (NULL equals NULL)."""
    return (F.when(~cv_main.eqNullSafe(job_main), F.lit(float(D.CATEGORY_SCORE_MAIN_DIFF)))
             .when(~cv_sub.eqNullSafe(job_sub), F.lit(float(D.CATEGORY_SCORE_SUB_DIFF)))
             .otherwise(F.lit(float(D.CATEGORY_SCORE_EQUAL))))


def seniority_score(cv_idx: Column, job_idx: Column) -> Column:
    diff = cv_idx - job_idx
    return (F.when(diff == 0, F.lit(float(D.SENIORITY_SCORE_EQUAL)))
             .when(diff == -1, F.lit(float(D.SENIORITY_SCORE_UNDER_1)))
             .when(diff < -1, F.lit(float(D.SENIORITY_SCORE_UNDER_MORE)))
             .when(diff == 1, F.lit(float(D.SENIORITY_SCORE_OVER_1)))
             .otherwise(F.lit(float(D.SENIORITY_SCORE_OVER_MORE))))


def skill_score(n_matched: Column, n_required: Column) -> Column:
    """matched / required * 100; 0 when the job requires no skill."""
    return (F.when(n_required == 0, F.lit(0.0))
             .otherwise(n_matched.cast("double") / n_required.cast("double") * F.lit(100.0)))


def dot_sql(a: str, b: str) -> str:
    """Sequential double dot product of two float array columns (SQL)."""
    return (f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), "
            f"0D, (acc, x) -> acc + x)")


def dot_unrolled_sql(a: str, b: str, dims: int) -> str:
    """a[0]*b[0] + ... + a[dims-1]*b[dims-1] as one flat expression, without
    the lambda's work per element.  (``fast_dot_sql`` keeps the lambda as its
    branch for other widths, so the projection runs outside whole-stage code,
    where the flat form is faster and, at 384 dimensions, compiles at all.)  Same left-to-right double sum as ``dot_sql``.
    Built as one SQL string (one call to the JVM, not one per term)."""
    return " + ".join(f"CAST(get({a}, {i}) AS DOUBLE) * CAST(get({b}, {i}) AS DOUBLE)"
                      for i in range(dims)) or "0D"


def fast_dot_sql(a: str, b: str, dims: int | None) -> str:
    """Unrolled dot when both sizes equal the expected width, else the
    general form."""
    if not dims or dims > 1024:
        return dot_sql(a, b)
    return (f"CASE WHEN size({a}) = {dims} AND size({b}) = {dims} "
            f"THEN {dot_unrolled_sql(a, b, dims)} ELSE {dot_sql(a, b)} END")


def norm(a: str, dims: int | None = None) -> Column:
    """Euclidean norm in double of array column ``a``.  Computed once per
    row, not per pair, so the compact lambda form is used (the unrolled
    form is kept for the per-pair dot product, where it pays)."""
    return F.expr(f"sqrt({dot_sql(a, a)})")


def semantic_score(a: str, b: str, norm_a: str, norm_b: str, dims: int | None = None) -> Column:
    """Cosine x 100 of array columns ``a`` and ``b`` with precomputed
    norms.  A missing vector, a zero vector or vectors of different length
    give 0 (no signal)."""
    return F.expr(f"CASE WHEN {a} IS NULL OR {b} IS NULL OR size({a}) <> size({b}) "
                  f"OR {norm_a} = 0 OR {norm_b} = 0 THEN 0D "
                  f"ELSE ({fast_dot_sql(a, b, dims)}) / ({norm_a} * {norm_b}) * 100D END")


def combined_score(cat: Column, skill: Column, sen: Column, sem: Column) -> Column:
    return (F.lit(D.W_CATEGORY) * cat + F.lit(D.W_SKILLS) * skill
            + F.lit(D.W_SENIORITY) * sen + sem * F.lit(D.W_SEMANTIC))


def match_score(combined: Column) -> Column:
    """max(0, round(score, 1)); never negative, no upper clamp."""
    r = F.round(combined, 1)
    return F.when(r > 0, r).otherwise(F.lit(0.0))


def score_band(score: Column) -> Column:
    """Colour band of a rounded score: strict > 70 green, > 40 orange."""
    return (F.when(score > D.BAND_GREEN_ABOVE, F.lit("green"))
             .when(score > D.BAND_ORANGE_ABOVE, F.lit("orange"))
             .otherwise(F.lit("red")))
