"""Small helpers for writing the DuckDB oracle SQL of each query."""

from __future__ import annotations

import re

from jobsift import dictionaries as D
from jobsift.sources.fixtures import FIXTURE_SQL

WORD_CLASS = r"[^\p{L}\p{M}\p{N}_]"


def sround(x: str, d: int = 1) -> str:
    """Spark's round(double, d): HALF_UP on the shortest decimal form."""
    return f"(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {d}) AS DOUBLE) + 0.0)"


def sql_str(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def re2_escape(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def _dedup(terms):
    seen = []
    for t in terms:
        if t and t not in seen:
            seen.append(t)
    return seen


def term_pattern(term: str) -> str:
    """RE2 whole-word pattern of an entry (RE2's \\b is ASCII-only, so the
    boundary is spelled as a Unicode class; beside a non-word character of
    the entry a boundary is a word character)."""
    low, word = term.lower(), WORD_CLASS.replace("[^", "[")
    first = "(^|" + WORD_CLASS + ")" if re.match(r"\w", low[0]) else word
    last = "($|" + WORD_CLASS + ")" if re.match(r"\w", low[-1]) else word
    return first + re2_escape(low) + last


def hit_list_sql(text: str, terms, original_case: bool = False) -> str:
    """List of entries whose pattern matches lower(text).  One constant
    pattern per entry, so DuckDB compiles each regex once."""
    items = ", ".join(
        f"CASE WHEN regexp_matches(lower({text}), {sql_str(term_pattern(t))}) "
        f"THEN {sql_str(t if original_case else t.lower())} END"
        for t in _dedup(terms))
    return f"list_filter([{items}]::VARCHAR[], lambda x: x IS NOT NULL)"


def hits_sql(text: str, terms) -> str:
    """Sorted distinct lower-case hits (NULL text -> [])."""
    return f"coalesce(list_sort(list_distinct({hit_list_sql(text, terms)})), []::VARCHAR[])"


def norm_sql(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE))"


def dot_sql(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), lambda p, q: p + q, 0.0::DOUBLE)")


def level_idx_sql(col: str, case_sensitive: bool) -> str:
    c = col if case_sensitive else f"lower({col})"
    whens = " ".join(f"WHEN {c} = {sql_str(l)} THEN {i}" for i, l in enumerate(D.LEVEL_ORDER))
    return f"(CASE {whens} ELSE {D.UNKNOWN_LEVEL_INDEX} END)"


def build(final: str, fixtures: tuple[str, ...] = (), ctes: tuple[str, ...] = ()) -> str:
    """WITH <fixtures>, <ctes> <final>."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]()})" for n in fixtures] + list(ctes)
    if not parts:
        return final
    return "WITH " + ",\n".join(parts) + "\n" + final
