"""op1, op2, op3: against plain Python and on edge rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobsift.llm import mixing, q_mixing, quality, urls
from jobsift.llm.q_urls import RULES
from jobsift.llm.quality import repeated_window_words, text_stats
from llm_helpers import SMOKE, docs, edge_docs, no_docs, prose  # noqa: F401


# -- op1 ----------------------------------------------------------------------

def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if url and url in listed else "allow"


def test_urls_against_python(spark):
    seen = ["http://a.example.net/es/1?x#y", "https://www.example.com/en/3", "https://EXAMPLE.com/en/", "http://example.com",
            "http://notexample.com/en/1", "http://x.org/a", "http://x.org/b", None, "no url", "://", "http://x.org/a",
            "http://a.net/fr/", "http://a.net/fr", "http://u@x.org:80/c/\n", "http://x.org/c?a=://b/"]
    listed = ["http://x.org/a", "http://y.org/", None, "zzz"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(seen)], "page_id long, url string, host string, path string")
    got = urls.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES).collect()
    assert len(got) == len(seen)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(seen[r.page_id], listed), seen[r.page_id]


def test_urls_other_spellings_and_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('https://www.site', id, '.org/p/') AS url")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://Site', id, '.org/p?utm_source=z#q') AS url")
    got = urls.judge_urls(pages, listed, []).where("listed").select("page_id").collect()
    assert sorted(r[0] for r in got) == list(range(3000))


def test_urls_small_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", 1)  # every key seems to hit
    listed = spark.range(2000).selectExpr("concat('http://s', id, '.org/') AS url")
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://s', id, '.org/') AS url")
    assert urls.judge_urls(pages, listed, []).where("verdict = 'block'").count() == 2000


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, pages.select("url"), RULES).count() == 0


# -- op2 ----------------------------------------------------------------------

def plain_targets(sizes):
    """Weights 3, 1, 2 by source, capped shares reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = goal - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows, slack):
    sizes, taken, targets, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        targets[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    want = plain_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]), s
        assert abs(taken[s] - targets[s]) <= slack * largest[s] + 1, s
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_mix_targets_and_words(spark, docs):
    rows = q_mixing.op2_mixing(spark, SMOKE).collect()
    assert len(rows) == docs.count()
    check_mix(rows, 0.51)


def test_mix_reruns_and_other_splits_agree(spark, docs):
    a = mixing.mix(docs, q_mixing.cycled_weights).select("doc_id", "taken").collect()
    b = mixing.mix(docs.repartition(7, "text"), q_mixing.cycled_weights).select("doc_id", "taken").collect()
    assert sorted(a) == sorted(b)


def test_mix_tree_of_residuals(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 2)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    check_mix(mixing.mix(docs, q_mixing.cycled_weights).collect(), 0.51)


def test_mix_edges(edge_docs, no_docs):
    rows = mixing.mix(edge_docs, q_mixing.cycled_weights).collect()
    assert len(rows) == edge_docs.count()
    check_mix(rows, 0.51)
    assert mixing.mix(no_docs, q_mixing.cycled_weights).collect() == []


def test_pivotal_keeps_sum_and_expectation():
    import numpy as np
    rng = np.random.default_rng(1)
    p, size = rng.random(40), rng.integers(1, 9, 40).astype(float)
    total, mean = (p * size).sum(), np.zeros(40)
    for _ in range(4000):
        q, _ = mixing.pivotal(p, size, rng.random(40))
        assert abs((q * size).sum() - total) < 1e-6
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        mean += q / 4000
    assert np.abs(mean - p).max() < 0.05


# -- op3 ----------------------------------------------------------------------

def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = defaultdict(list)
    for i in range(len(words) - 2):
        wins[tuple(words[i:i + 3])].append(i)
    cover = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_base_counts_of_all_texts(docs, edge_docs):
    for d in (docs, edge_docs):
        got = quality.line_verdicts(d).collect()
        texts = Counter((r.doc_id, plain_stats(r.text or "")) for r in d.select("doc_id", "text").collect())
        assert Counter((r.doc_id, tuple(r[s] for s in quality.STATS)) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_windows_of_odd_words():
    assert text_stats("a b c a b c a")[4] == 7
    assert repeated_window_words(b"x x x".split()) == 0
    assert repeated_window_words(b"x x x x".split()) == 4


def host_docs(spark):
    """Host h: 80 documents that share three lines, 60 near copies of one
    text, 30 documents of little but the shared lines."""
    shared = [prose(1000 + i, 30) for i in range(3)]
    rows = [(i, "\n".join([*(prose(6 * i + k, 15) for k in range(6)), *shared]), "h") for i in range(80)]
    base = [prose(2000 + k, 9) for k in range(12)]
    for i in range(60):
        lines = list(base)
        lines[i % 12] = f"edit {i} " + lines[i % 12]
        rows.append((100 + i, "\n".join(lines), "h"))
    rows += [(200 + i, "\n".join([*shared, prose(3000 + i, 14)]), "h") for i in range(30)]
    rows += [(300, "\n".join([*shared, prose(4000, 14)]), "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), shared


def test_boilerplate_goes_and_clean_documents_stay(spark):
    d, shared = host_docs(spark)
    got = {r.doc_id: r for r in quality.line_verdicts(d).collect()}
    assert all(got[i].kept and got[i].removed_words == 90 for i in range(80))
    assert all(got[100 + i].kept and not got[100 + i].removed_words for i in range(60))   # copies are no boilerplate
    assert not any(got[200 + i].kept for i in range(30))                                  # depleted
    assert got[300].kept                                                                  # another host
    out = {r.doc_id: r.text for r in quality.clean_documents(d).collect()}
    assert set(out) == {i for i, r in got.items() if r.kept}
    assert all(line not in out[5] for line in shared) and shared[0] in out[300]


def test_quality_edges(edge_docs, no_docs):
    got = quality.clean_documents(edge_docs)
    assert got.columns == edge_docs.columns
    assert {r.doc_id for r in got.collect()} == {1, 2, 6, None, 10}
    assert got.where("doc_id = 1").count() == 2
    assert quality.line_verdicts(no_docs).count() == 0 and quality.clean_documents(no_docs).count() == 0


def test_crc_fold(spark):
    from jobsift.llm.common import crc_fold
    got = spark.range(50).select("id", crc_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
