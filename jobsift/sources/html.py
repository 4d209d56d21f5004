"""Captured pages -> rows.

Flat fields (``html_fields``, ``html_text``) are read with regular expressions
inside Catalyst expressions.  Posting and listing pages nest elements and use
any entity, so they go through the standard library's HTML parser in Arrow
batches (``posting_fields``, ``urn_listing_ids``).  Fields are extracted
independently and a missing field is NULL, not ''.
"""

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift import dictionaries as D
from jobsift.functions.text import strip_ws

# Entities decoded in field text; '&amp;' goes last so '&amp;lt;' stays '&lt;'.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

# Field locators of the captured test pages (a parameter of html_fields).
PAGE_FIELDS = {
    "title": r"<title>([^<]*)</title>",
    "h1": r"<h1>([^<]*)</h1>",
    "lang": r'<html lang="([a-z]+)"',
}


def unescape(col: Column) -> Column:
    for ent, ch in ENTITIES:
        col = F.replace(col, F.lit(ent), F.lit(ch))
    return col


def field(html: Column, pattern: str) -> Column:
    """First match of group 1, entities decoded, stripped; NULL if absent."""
    v = strip_ws(unescape(F.regexp_extract(html, pattern, 1)))
    found = html.rlike(pattern)
    return F.when(F.coalesce(found, F.lit(False)), v)


def html_fields(pages: DataFrame, html_col: str = "html", fields: dict | None = None,
                keep: list[str] | None = None) -> DataFrame:
    fields = fields or PAGE_FIELDS
    cols = [F.col(c) for c in (keep or [])]
    cols += [field(F.col(html_col), p).alias(name) for name, p in fields.items()]
    return pages.select(*cols)


def text_nodes(fragment: Column) -> Column:
    """All text nodes of an HTML fragment, entity-decoded and stripped,
    empty ones dropped, joined by newline (get_text(separator='\\n',
    strip=True)).  Script/style bodies and comments are removed first."""
    cleaned = F.regexp_replace(fragment, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    nodes = F.transform(F.split(cleaned, "<[^>]*>", -1), lambda t: strip_ws(unescape(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), "\n")


def html_text(pages: DataFrame, html_col: str = "html", container: str = r"(?s)<article>(.*?)</article>",
              keep: list[str] | None = None) -> DataFrame:
    """Full text of the container element; NULL when the page has none."""
    h = F.col(html_col)
    body = F.regexp_extract(h, container, 1)
    cols = [F.col(c) for c in (keep or [])]
    return pages.select(*cols, F.when(F.coalesce(h.rlike(container), F.lit(False)), text_nodes(body))
                        .alias("text"))


VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset(("script", "style", "template"))


def has_class(attrs: list, wanted: str) -> bool:
    """The class attribute is ``wanted``, or holds it as one of its names."""
    value = dict(attrs).get("class") or ""
    return value == wanted or wanted in value.split()


class _Tree(HTMLParser):
    """Tracks open elements; an end tag closes everything inside its element,
    and one without an open element is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object]] = []

    def begin(self, tag, attrs):
        """What to keep for an element that opens (or None)."""

    def end(self, mark):
        """An element that was kept has closed."""

    def handle_starttag(self, tag, attrs):
        mark = self.begin(tag, attrs)
        if tag in VOID_TAGS:
            if mark is not None:
                self.end(mark)
        else:
            self.open.append((tag, mark))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                t, mark = self.open.pop()
                if mark is not None:
                    self.end(mark)
                if t == tag:
                    return


class _Posting(_Tree):
    def __init__(self):
        super().__init__()
        self.parts: dict[str, list[str]] = {}

    def begin(self, tag, attrs):
        for name, (want, cls) in D.POSTING_FIELDS.items():
            if tag == want and name not in self.parts and has_class(attrs, cls):
                self.parts[name] = []
                return name
        if tag == "div" and "description_text" not in self.parts and has_class(attrs, D.POSTING_DESCRIPTION_CLASS):
            self.parts["description_text"] = []
            return "description_text"
        return None

    def handle_data(self, data):
        if any(t in HIDDEN_TAGS for t, _ in self.open):
            return
        for _, mark in self.open:
            if mark is not None:
                self.parts[mark].append(data)


def parse_posting(html: str | None) -> dict[str, str | None]:
    """The fields of one detail page: text of the element, blanks cut at the
    ends; the description's text nodes, cut, non-empty, one a line."""
    p = _Posting()
    p.feed(html or "")
    p.close()
    out = {n: "".join(p.parts[n]).strip() if n in p.parts else None for n in D.POSTING_FIELDS}
    nodes = [x.strip() for x in p.parts.get("description_text", [])]
    out["description_text"] = "\n".join(x for x in nodes if x) if "description_text" in p.parts else None
    return out


POSTING_COLUMNS = [*D.POSTING_FIELDS, "description_text"]


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in POSTING_COLUMNS]))
def _posting(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_posting(h) for h in html], columns=POSTING_COLUMNS, dtype=object)


def posting_fields(responses: DataFrame, url_prefix: str = D.POSTING_URL_PREFIX,
                   keep: list[str] | None = None) -> DataFrame:
    """Usable detail pages (status 200) -> url = prefix + job id, the posting's
    fields, and the ``keep`` columns of the response.  One row per response."""
    rows = responses.where(F.col("status") == 200).select(
        F.concat(F.lit(url_prefix), F.col("job_id")).alias("url"), *(keep or []), _posting("html").alias("__f"))
    return rows.select("url", *[F.col(f"__f.{n}").alias(n) for n in POSTING_COLUMNS], *(keep or []))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """What ``posting_fields`` leaves out, without the page: job_id, status."""
    return responses.where(~F.coalesce(F.col("status") == 200, F.lit(False))).select("job_id", "status")


class _Listing(_Tree):
    """Cards (list items) in document order, each with its first entity urn."""

    def __init__(self):
        super().__init__()
        self.cards: list[list] = []

    def begin(self, tag, attrs):
        if tag == "li":
            self.cards.append([])
            return self.cards[-1]
        if tag == "div" and has_class(attrs, D.LISTING_CARD_CLASS):
            for _, card in self.open:
                if card is not None and not card:
                    card.append(dict(attrs).get(D.LISTING_URN_ATTR) or "")
        return None


def parse_listing(html: str | None) -> tuple[int, list[str]]:
    """(cards, ids): the ids up to the first card without one."""
    p = _Listing()
    p.feed(html or "")
    p.close()
    ids = []
    for card in p.cards:
        parts = card[0].split(":") if card else []
        if len(parts) <= D.URN_ID_PART:
            break
        ids.append(parts[D.URN_ID_PART])
    return len(p.cards), ids


@F.pandas_udf(T.StructType([T.StructField("cards", T.IntegerType()), T.StructField("ids", T.ArrayType(T.StringType()))]))
def _listing(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_listing(h) for h in html], columns=["cards", "ids"])


def urn_listing_ids(pages: DataFrame, run: str | None = None, start_col: str = "start",
                    html_col: str = "html") -> DataFrame:
    """Job ids of listing pages by their cards' entity urn: (<run>, start,
    pos, job_id).  A page stops at its first card without an id; a run (one
    search; the whole table without ``run``) stops at its first page without
    cards."""
    keys = [run] if run else []
    parsed = pages.select(*keys, start_col, _listing(html_col).alias("__l")).select(*keys, start_col, "__l.cards", "__l.ids")
    return _before_empty(parsed, keys, start_col, F.col("cards") == 0).select(
        *keys, start_col, F.posexplode("ids").alias("pos", "job_id"))


def _before_empty(pages: DataFrame, keys: list[str], start_col: str, empty: Column) -> DataFrame:
    """Pages of each run before its first empty one (one row per run is joined)."""
    stop = pages.where(empty).groupBy(*keys).agg(F.min(start_col).alias("__stop"))
    if keys:
        stop = stop.withColumnsRenamed({k: f"__{k}" for k in keys})
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
        live = pages.join(stop, cond, "left")
    else:
        live = pages.withColumn("__stop", stop.select("__stop").scalar())
    return live.where(F.col("__stop").isNull() | (F.col(start_col) < F.col("__stop"))).select(*pages.columns)


def response_status(responses: DataFrame) -> DataFrame:
    """Count of captured responses per HTTP status (200 = usable)."""
    return responses.groupBy("status").agg(F.count(F.lit(1)).alias("responses"))


def listing_ids(pages: DataFrame, start_col: str = "start", html_col: str = "html",
                card_pattern: str = r"(?s)<li>(.*?)</li>",
                id_pattern: str = r'<a href="/([^"]*)"', run: str | None = None) -> DataFrame:
    """Job ids from paged listing captures whose cards a pattern finds, with
    the collector's stops: a page stops at its first card without an id; a run
    (all pages without ``run``) at its first page without cards.  One row per
    id: (<run>, start, pos, job_id); ids are not deduped.

    The per-page stop is computed inside the row (array_position), the
    run's stop is one value a run - no window over pages."""
    keys = [run] if run else []
    cards = F.regexp_extract_all(F.col(html_col), F.lit(card_pattern), 1)
    live = _before_empty(pages.select(*keys, start_col, cards.alias("cards")), keys, start_col, F.size("cards") == 0)
    ok = F.transform("cards", lambda c: c.rlike(id_pattern))
    bad_pos = F.array_position(ok, F.lit(False))
    kept = F.when(bad_pos == 0, F.col("cards")).otherwise(F.slice("cards", 1, bad_pos - 1))
    return (live.select(*keys, start_col, F.posexplode(kept).alias("pos", "card"))
            .select(*keys, start_col, "pos", F.regexp_extract("card", id_pattern, 1).alias("job_id")))


def urn_job_id(urn: Column) -> Column:
    """'urn:li:jobPosting:<id>' -> '<id>' (4th ':' part, NULL if absent)."""
    return F.get(F.split(urn, ":"), D.URN_ID_PART)


def ordered_text_concat(pages: DataFrame, key: str = "cv_id", order: str = "page",
                        text: str = "text") -> DataFrame:
    """Per document: page texts in page order, blank pages skipped,
    joined by newline ('' when every page is blank)."""
    item = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(order, text))
    return (pages.groupBy(key)
            .agg(F.array_sort(F.collect_list(item)).alias("__p"))
            .select(key, F.array_join(F.transform("__p", lambda x: x[text]), "\n").alias(text)))


# ---------------------------------------------------------------------------
# Vector <-> float32 bytes (the stored BLOB form)
# ---------------------------------------------------------------------------

@F.pandas_udf(T.BinaryType())
def vector_to_blob(v: pd.Series) -> pd.Series:
    """array<float> -> little-endian float32 bytes (NULL stays NULL)."""
    given = [a for a in v if a is not None]
    data = np.concatenate(given).astype("<f4").tobytes() if given else b""  # one buffer a batch
    ends = iter(np.cumsum([4 * len(a) for a in given]).tolist())
    starts = iter([0, *np.cumsum([4 * len(a) for a in given]).tolist()])
    return pd.Series([None if a is None else data[next(starts):next(ends)] for a in v], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(b: pd.Series) -> pd.Series:
    """float32 bytes -> array<float>; NULL when the length is not a
    multiple of 4 (a corrupt buffer, scored as no signal)."""
    ok = [x is not None and len(x) % 4 == 0 for x in b]
    values = np.frombuffer(b"".join(x for x, k in zip(b, ok, strict=True) if k), "<f4").astype(np.float32)
    parts = iter(np.split(values, np.cumsum([len(x) // 4 for x, k in zip(b, ok, strict=True) if k])[:-1]))
    return pd.Series([next(parts) if k else None for k in ok], dtype=object)
