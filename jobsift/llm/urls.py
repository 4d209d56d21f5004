"""URL filter: policy rules first, then a list of canonical URLs behind a
blocked Bloom filter.

``judge_urls(pages, listed, rules)`` gives every page a verdict.  The filter
of the listed URLs is a table of 512-bit blocks (eight 64-bit words, one bit
of a key in each word) built by one aggregation with map-side ``bit_or``.
Its size follows the list up to ``MAX_BLOCKS`` (8 MB of bits), so it is
always small enough to broadcast; a longer list only lets more false
positives through, and the exact hash join behind the filter removes them.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule, and is never listed (verdict allow); repeated pages are judged
each by itself; null entries of the list are ignored; an empty list blocks
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import ascii_lower

WORDS = 8                # 64-bit words of a block
BITS_PER_KEY = 16        # about 6 false positives in 10,000 while under MAX_BLOCKS
MAX_BLOCKS = 1 << 17     # bound of the broadcast table, whatever the list holds


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host (without user, default port, ``www.`` or ``m.``) + path (without a
    last slash) + query without tracking parameters; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^[^@]*@", ""), r":(80|443)?\z", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"/\z", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query))
                                       .otherwise(F.lit(""))))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(keys: DataFrame, column: str, n_keys: int) -> tuple[DataFrame, int]:
    """(table of blocks, number of blocks): ``_block`` and words ``_w0.._w7``."""
    blocks = min(MAX_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS))))
    key = F.col(column)
    one = F.lit(1).cast("bigint")
    masks = [F.call_function("shiftleft", one, b).alias(f"_w{i}") for i, b in enumerate(_bits(key))]
    return (keys.select(_block(key, blocks).alias("_block"), *masks).groupBy("_block")
            .agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]), blocks)


def may_hit(key: Column) -> Column:
    """True if the block joined to a row holds all bits of its key."""
    hit = F.lit(True)
    for i, b in enumerate(_bits(key)):
        hit = hit & (F.call_function("shiftrightunsigned", F.col(f"_w{i}"), b).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(hit, F.lit(False))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages(page_id, url), listed(url) -> page_id, host, path, rule, verdict,
    listed (boolean: the canonical url is on the list)."""
    wanted = listed.select(canonical_url(F.col("url")).alias("_canon")).where("_canon is not null").distinct()
    filter_, blocks = bloom_blocks(wanted, "_canon", wanted.count())
    url = F.col("url")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = (pages.select("page_id", F.coalesce(url_host(url), F.lit("")).alias("host"),
                           F.coalesce(url_path(url), F.lit("")).alias("path"), canonical_url(url).alias("_canon"))
              .withColumns({"rule": rule, "verdict": verdict})
              .withColumn("_block", F.coalesce(_block(F.col("_canon"), blocks), F.lit(-1)))
              .join(F.broadcast(filter_), "_block", "left")
              .withColumn("_maybe", F.col("_canon").isNotNull() & may_hit(F.col("_canon"))))
    out = ["page_id", "host", "path", "rule", "verdict"]
    sure = judged.where(~F.col("_maybe")).select(*out, F.lit(False).alias("listed"))
    # possible hits only: the exact join by the canonical url itself
    checked = (judged.where("_maybe")
               .join(wanted.withColumn("_on", F.lit(True)), "_canon", "left")
               .select(*out, F.coalesce("_on", F.lit(False)).alias("listed")))
    return (sure.unionByName(checked)
            .withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))))
