"""op1: every page's url against the rules and the list of reported urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.common import table
from jobsift.llm.urls import judge_urls

# The policy, as (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
# A page with symbol runs in its title is reported as junk, and its url listed.
JUNK_TITLE = r"<title>[^<]*(\*\*\*|###|%%%|\$\$\$)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(JUNK_TITLE)).select("url")
    return judge_urls(pages, listed, RULES)


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    whens_rule, whens_verdict = "", ""
    for how, text in sorted(RULES, key=lambda r: -len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}')"
        whens_rule += f" WHEN {fits} THEN '{text}'"
        whens_verdict += f" WHEN {fits} THEN '{how}'"
    return f"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM parts),
bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?\\z', ''), '^(www|m)\\.', '') AS site,
         regexp_replace(path, '/\\z', '') AS dir,
         regexp_replace(regexp_replace(query, '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS params
  FROM split),
canon AS (
  SELECT *, CASE WHEN site <> '' THEN concat(site, dir, CASE WHEN params <> '' THEN '?' || params ELSE '' END) END AS canon
  FROM bare),
listed AS (SELECT DISTINCT canon FROM canon WHERE regexp_matches(html, '<title>[^<]*(\\*\\*\\*|###|%%%|\\$\\$\\$)') AND canon IS NOT NULL),
judged AS (
  SELECT c.*, l.canon IS NOT NULL AS listed, CASE{whens_rule} END AS rule, CASE{whens_verdict} END AS fixed
  FROM canon c LEFT JOIN listed l ON c.canon = l.canon)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _oracle()}
