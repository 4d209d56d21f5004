"""Text and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions import text as TX
from jobsift.plans.catalog import register
from jobsift.plans.sqlkit import build, sql_str
from jobsift.sources import html as H
from jobsift.sources.fixtures import cv_blank_pages_fx, cv_pages_fx, jobs_fx, req_fx, responses_status
from jobsift.sources.tables import read_test_table

# Unicode whitespace (Java's (?U)\s) as an RE2 class
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def unescape_sql(x: str) -> str:
    for ent, ch in H.ENTITIES:
        x = f"replace({x}, {sql_str(ent)}, {sql_str(ch)})"
    return x


def _pages(spark, sf):
    return read_test_table(spark, sf, "pages")


# --- page fields and text ---------------------------------------------------

def q_html_fields(spark, sf):
    return H.html_fields(_pages(spark, sf), keep=["page_id", "url"])


def o_html_fields():
    cols = []
    for name, pat in H.PAGE_FIELDS.items():
        v = strip_sql(unescape_sql(f"regexp_extract(html, {sql_str(pat)}, 1)"))
        cols.append(f"CASE WHEN regexp_matches(html, {sql_str(pat)}) THEN {v} END AS {name}")
    return build(f"SELECT page_id, url, {', '.join(cols)} FROM pages")


def q_html_text(spark, sf):
    return H.html_text(_pages(spark, sf), keep=["page_id"])


def o_html_text():
    body = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    cleaned = (f"regexp_replace({body}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')")
    nodes = f"list_transform(regexp_split_to_array({cleaned}, '<[^>]*>'), lambda t: {strip_sql(unescape_sql('t'))})"
    text = f"array_to_string(list_filter({nodes}, lambda t: t <> ''), chr(10))"
    return build(f"SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<article>(.*?)</article>') "
                 f"THEN {text} END AS text FROM pages")


def q_listing_ids(spark, sf):
    pages = _pages(spark, sf).select((F.col("page_id") * D.LISTING_PAGE_SIZE).alias("start"), "html")
    return H.listing_ids(pages)


def o_listing_ids():
    pat = '<a href="/([^"]*)"'
    return build(f"""SELECT start, CAST(i AS INTEGER) AS pos, regexp_extract(kept[i + 1], {sql_str(pat)}, 1) AS job_id
FROM (SELECT start, kept, unnest(range(0, len(kept))) AS i FROM (
  SELECT start, CASE WHEN bad IS NULL OR bad = 0 THEN cards ELSE cards[1:bad - 1] END AS kept
  FROM (SELECT start, cards,
               list_position(list_transform(cards, lambda c: regexp_matches(c, {sql_str(pat)})), false) AS bad
        FROM (SELECT page_id * {D.LISTING_PAGE_SIZE} AS start,
                     regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS cards FROM pages))
  WHERE (SELECT min(page_id * {D.LISTING_PAGE_SIZE}) FROM pages
         WHERE len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) = 0) IS NULL
     OR start < (SELECT min(page_id * {D.LISTING_PAGE_SIZE}) FROM pages
                 WHERE len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) = 0)))""")


# --- posting and listing pages --------------------------------------------------

# Each captured page in the posting board's form: nested elements, numeric and
# named entities, the second of two location bullets, absent fields.
POSTING_PARTS = [
    ("'<html><body><h2 class=\"" + D.POSTING_FIELDS["job_title"][1] + "\"> <b>'", "title",
     "'</b> &#x26; more&nbsp;&#8217;s </h2>'"),
    ("'<a href=\"#\" class=\"" + D.POSTING_FIELDS["company_name"][1] + "\">'", "lang", "'</a><br>'"),
    ("'<span class=\"" + D.POSTING_FIELDS["location"][1] + "\">City '", "CAST(page_id % 7 AS {text})",
     "'</span><span class=\"" + D.POSTING_FIELDS["location"][1] + "\">other</span>'"),
    ("'<div class=\"core " + D.POSTING_DESCRIPTION_CLASS + "\"><div><p>'", "coalesce(title, '')",
     "'</p></div><script>var x=1;</script><div>'"),
]


def _posting_html(text: str) -> str:
    """SQL of a page's posting form; every 11th page has no applicants, every 13th no title."""
    parts = [f"concat({a}, coalesce({v.format(text=text)}, ''), {z})" for a, v, z in POSTING_PARTS]
    parts[0] = f"CASE WHEN page_id % 13 = 0 THEN '' ELSE {parts[0]} END"
    count = ("CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('<span class=\"" + D.POSTING_FIELDS["num_applicants"][1]
             + f"\">', CAST(page_id AS {text}), ' applicants</span>') END")
    return f"concat({', '.join(parts)}, coalesce(article, ''), '</div><p>&copy; end</div>', {count}, '</body></html>')"


def posting_pages(spark, sf):
    """job_id, status, html, page_id: the pages as captured detail responses."""
    pages = responses_status(spark, sf).withColumn("page_id", F.col("job_id").cast("bigint"))
    parts = pages.select("job_id", "status", "page_id",
                         F.regexp_extract("html", PAGE_TITLE, 1).alias("title"),
                         F.regexp_extract("html", H.PAGE_FIELDS["lang"], 1).alias("lang"),
                         F.regexp_extract("html", ARTICLE, 1).alias("article"))
    return parts.select("job_id", "status", "page_id", F.expr(_posting_html("STRING")).alias("html"))


PAGE_TITLE = H.PAGE_FIELDS["title"]
ARTICLE = r"(?s)<article>(.*?)</article>"


def q_posting_fields(spark, sf):
    return H.posting_fields(posting_pages(spark, sf), keep=["page_id"])


def o_posting_fields():
    # text nodes of what the pages were made from
    clean = "regexp_replace({}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
    nodes = (f"list_transform(regexp_split_to_array({clean.format('article')}, '<[^>]*>'), "
             f"lambda t: {strip_sql(unescape_sql('t'))})")
    title = unescape_sql("title")
    prefix = sql_str(D.POSTING_URL_PREFIX)
    return build(f"""SELECT {prefix} || job_id AS url,
  CASE WHEN page_id % 13 <> 0 THEN {strip_sql("concat(' ', " + title + ", ' & more', chr(160), chr(8217), 's ')")} END AS job_title,
  {strip_sql("lang")} AS company_name, 'City ' || CAST(page_id % 7 AS VARCHAR) AS location,
  CAST(NULL AS VARCHAR) AS time_posted,
  CASE WHEN page_id % 11 <> 0 THEN CAST(page_id AS VARCHAR) || ' applicants' END AS num_applicants,
  array_to_string(list_filter(list_concat([{strip_sql(title)}], {nodes}, [chr(169) || ' end']), lambda t: t <> ''), chr(10)) AS description_text,
  page_id
FROM (SELECT job_id, status, CAST(job_id AS BIGINT) AS page_id, regexp_extract(html, {sql_str(PAGE_TITLE)}, 1) AS title,
             regexp_extract(html, {sql_str(H.PAGE_FIELDS['lang'])}, 1) AS lang,
             regexp_extract(html, {sql_str(ARTICLE)}, 1) AS article FROM detail_responses)
WHERE status = 200""", ("detail_responses",))


# Listing form: five pages to a run, a card per word of the title; every 17th
# page has no cards, and a word with a full stop is a card without an urn.


def q_urn_listing_ids(spark, sf):
    pages = _pages(spark, sf).select("page_id", F.regexp_extract("html", PAGE_TITLE, 1).alias("title"))
    card = F.expr("transform(filter(split(title, ' '), w -> w <> ''), w -> CASE WHEN instr(w, '.') > 0 THEN '<li><p>ad</li>' "
                  "ELSE concat('<li class=\"c\"><div class=\"x base-card\" data-entity-urn=\"urn:li:jobPosting:', w, '\"><br>a</div></li>') END)")
    html = F.when(F.col("page_id") % 17 == 0, "<ul></ul>").otherwise(F.concat(F.lit("<ul>"), F.array_join(card, ""), F.lit("</ul>")))
    pages = pages.select(F.floor(F.col("page_id") / 5).alias("run"),
                         (F.col("page_id") % 5 * D.LISTING_PAGE_SIZE).alias("start"), html.alias("html"))
    return H.urn_listing_ids(pages, run="run")


def o_urn_listing_ids():
    return build(f"""SELECT run, start, CAST(i AS INTEGER) AS pos, {unescape_sql("ws[i + 1]")} AS job_id FROM (
  SELECT run, start, ws, unnest(range(0, CASE WHEN stop = 0 THEN len(ws) ELSE stop - 1 END)) AS i FROM (
    SELECT *, coalesce(list_position(list_transform(ws, lambda w: instr(w, '.') > 0), true), 0) AS stop,
           min(CASE WHEN page_id % 17 = 0 OR len(ws) = 0 THEN start END) OVER (PARTITION BY run) AS empty FROM (
      SELECT page_id, page_id // 5 AS run, page_id % 5 * {D.LISTING_PAGE_SIZE} AS start,
             list_filter(string_split(regexp_extract(html, {sql_str(PAGE_TITLE)}, 1), ' '), lambda w: w <> '') AS ws FROM pages))
  WHERE empty IS NULL OR start < empty)""")


def q_response_status(spark, sf):
    return H.response_status(responses_status(spark, sf))


def o_response_status():
    return build("SELECT status, count(*) AS responses FROM detail_responses GROUP BY status",
                 ("detail_responses",))


# --- CV text ------------------------------------------------------------------

def q_ordered_text_concat(spark, sf):
    return H.ordered_text_concat(cv_blank_pages_fx(spark, sf))


def _concat_sql(pages: str = "cv_pages") -> str:
    return f"""cv_text AS (
  SELECT cv_id, coalesce(string_agg(text, chr(10) ORDER BY page) FILTER (WHERE coalesce(text, '') <> ''), '')
         AS text
  FROM {pages} GROUP BY cv_id)"""


def o_ordered_text_concat():
    return build("SELECT * FROM cv_text", ("cv_blank_pages",), (_concat_sql("cv_blank_pages"),))


def q_clean_text(spark, sf):
    return H.ordered_text_concat(cv_pages_fx(spark, sf)).select(
        "cv_id", TX.clean_text(F.col("text")).alias("text"))


def clean_sql(col: str) -> str:
    """clean_text in DuckDB SQL."""
    lines = (f"list_transform(string_split(coalesce({col}, ''), chr(10)), "
             f"lambda l: {strip_sql(f'regexp_replace(l, {chr(39)}{WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})")
    return f"array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10))"


def clean_ctes() -> tuple[str, ...]:
    """cv_text (ordered page concat) and cv_clean (cleaned) CTEs."""
    return (_concat_sql(), f"cv_clean AS (SELECT cv_id, {clean_sql('text')} AS text FROM cv_text)")


def o_clean_text():
    return build("SELECT cv_id, text FROM cv_clean", ("cv_pages",), clean_ctes())


# --- descriptions -----------------------------------------------------------------

def q_requirements_section(spark, sf):
    return req_fx(spark, sf).select(
        "doc_id", TX.requirements_section(F.col("description_text")).alias("requirements"))


def q_preview_split(spark, sf):
    d = F.col("description_text")
    return jobs_fx(spark, sf).select("seq", TX.preview(d).alias("preview"), TX.remainder(d).alias("rest"))


def o_preview_split():
    n = D.PREVIEW_CHARS
    return build(f"""SELECT seq, substring(coalesce(description_text, ''), 1, {n}) AS preview,
  CASE WHEN length(coalesce(description_text, '')) > {n} THEN substring(description_text, {n + 1})
       ELSE '' END AS rest FROM jobs""", ("jobs",))


def q_vector_blob_roundtrip(spark, sf):
    emb = read_test_table(spark, sf, "embeddings").select("vec_id", "embedding")
    enc = emb.withColumn("blob", H.vector_to_blob("embedding"))
    # every 13th stored buffer is damaged (two bytes short)
    enc = enc.withColumn("blob", F.when(F.col("vec_id") % 13 == 0,
                                        F.substring("blob", 1, F.length("blob") - 2)).otherwise(F.col("blob")))
    dec = enc.withColumn("decoded", H.blob_to_vector("blob"))
    return dec.select("vec_id", F.length("blob").cast("bigint").alias("n_bytes"),
                      F.col("decoded").isNotNull().alias("decoded_ok"),
                      F.coalesce(F.col("decoded") == F.col("embedding"), F.lit(False)).alias("same"))


def o_vector_blob_roundtrip():
    return build("""SELECT vec_id,
  CAST(CASE WHEN vec_id % 13 = 0 THEN 4 * len(embedding) - 2 ELSE 4 * len(embedding) END AS BIGINT) AS n_bytes,
  vec_id % 13 <> 0 AS decoded_ok, vec_id % 13 <> 0 AS same FROM embeddings""")


register("html_fields", o_html_fields)(q_html_fields)
register("html_text", o_html_text)(q_html_text)
register("listing_ids", o_listing_ids)(q_listing_ids)
register("posting_fields", o_posting_fields)(q_posting_fields)
register("urn_listing_ids", o_urn_listing_ids)(q_urn_listing_ids)
register("rejected_responses", lambda: build(
    "SELECT job_id, status FROM detail_responses WHERE status <> 200", ("detail_responses",)))(
    lambda spark, sf: H.rejected_responses(responses_status(spark, sf)))
register("response_status", o_response_status)(q_response_status)
register("ordered_text_concat", o_ordered_text_concat)(q_ordered_text_concat)
register("clean_text", o_clean_text)(q_clean_text)
def requirements_ctes(src: str, key: str, col: str) -> tuple[str, ...]:
    """CTEs ending in req(<key>, requirements): the sections read line by line.

    A header line ends in a header (and colons, blanks); its body begins at the
    next line with more than colons and blanks and ends before the first short
    line after that which begins with a letter and is not the last.  The next
    header is looked for from there, which is the recursion."""
    blank = WS[:-1] + ":]"
    ends = f"(?i)({D.REQ_HEADERS.replace('(?:', '(')}){blank}*$"
    return (
        f"src AS (SELECT {key}, {strip_sql(f'coalesce({col}, chr(32))')} AS t FROM {src})",
        "ln AS (SELECT *, string_split(t, chr(10)) AS l, len(string_split(t, chr(10))) AS m FROM src)",
        f"""marks AS (
  SELECT *, [i FOR i IN range(1, m) IF regexp_matches(l[i], {sql_str(ends)})] AS heads,
         [i FOR i IN range(1, m + 1) IF NOT regexp_full_match(l[i], '{blank}*')] AS full_lines,
         [i FOR i IN range(2, m) IF regexp_matches(l[i], '(?i)^[A-Z]') AND length(l[i]) <= 61] AS stops
  FROM ln)""",
        f"""walk AS (
  SELECT {key}, l, m, heads, full_lines, stops, [h FOR h IN heads][1] AS h, 0 AS n FROM marks
  UNION ALL
  SELECT {key}, l, m, heads, full_lines, stops, [x FOR x IN heads IF x >= stop][1], n + 1 FROM (
    SELECT *, coalesce([x FOR x IN stops IF x > coalesce([y FOR y IN full_lines IF y > h][1], m)][1], m + 1) AS stop
    FROM walk WHERE h IS NOT NULL))""",
        f"""bodies AS (
  SELECT {key}, n, array_to_string(l[first:coalesce([x FOR x IN stops IF x > first][1], m + 1) - 1], chr(10)) AS body
  FROM (SELECT *, coalesce([y FOR y IN full_lines IF y > h][1], m) AS first FROM walk WHERE h IS NOT NULL))""",
        f"""req AS (
  SELECT s.{key}, CASE WHEN b.all_ IS NULL THEN {strip_sql(f'substring(s.t, 1, {D.REQ_FALLBACK})')}
                  ELSE {strip_sql(f'substring(b.all_, 1, {D.REQ_CAP})')} END AS requirements
  FROM src s LEFT JOIN (SELECT {key}, string_agg(body, chr(10) ORDER BY n) AS all_ FROM bodies GROUP BY {key}) b
    ON s.{key} = b.{key})""")


def o_requirements_section():
    sql = build("SELECT doc_id, requirements FROM req", ("req_in",), requirements_ctes("req_in", "doc_id", "description_text"))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


register("requirements_section", o_requirements_section)(q_requirements_section)
register("preview_split", o_preview_split)(q_preview_split)
register("vector_blob_roundtrip", o_vector_blob_roundtrip)(q_vector_blob_roundtrip)
