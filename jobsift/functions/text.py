"""Text expressions: whitespace handling, line cleaning, requirements
section, previews.  Whitespace is Unicode whitespace (``(?U)\\s``), not
just the ASCII space that Spark's ``trim`` removes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift import dictionaries as D

REQ_PATTERN = "(?isdU)(" + D.REQ_HEADERS + ")" + D.REQ_BODY


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse_ws(col: Column) -> Column:
    """Runs of Unicode whitespace -> one space, ends stripped."""
    return strip_ws(F.regexp_replace(col, r"(?U)\s+", " "))


def clean_text(col: Column) -> Column:
    """Lines split on '\\n'; inner whitespace collapsed; blank lines
    dropped; NULL or '' -> ''."""
    lines = F.transform(F.split(F.coalesce(col, F.lit("")), "\n", -1), collapse_ws)
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def requirements_section(col: Column) -> Column:
    """Bodies of every requirements section (header, optional ':' and
    whitespace, newline, text up to the next short heading line or the
    end), joined by newline, cut to 800 chars and stripped; no header ->
    the first 500 chars, stripped; NULL or '' -> ''."""
    text = strip_ws(F.coalesce(col, F.lit("")))
    bodies = F.regexp_extract_all(text, F.lit(REQ_PATTERN), 2)
    found = strip_ws(F.substring(F.array_join(bodies, "\n"), 1, D.REQ_CAP))
    fallback = strip_ws(F.substring(text, 1, D.REQ_FALLBACK))
    return F.when(F.size(bodies) > 0, found).otherwise(fallback)


def preview(col: Column, n: int = D.PREVIEW_CHARS) -> Column:
    return F.substring(F.coalesce(col, F.lit("")), 1, n)


def remainder(col: Column, n: int = D.PREVIEW_CHARS) -> Column:
    c = F.coalesce(col, F.lit(""))
    return F.when(F.length(c) > n, F.substring(c, n + 1, 1 << 30)).otherwise(F.lit(""))
