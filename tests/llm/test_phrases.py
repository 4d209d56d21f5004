"""op11: filters and packing by round trips, phrases against brute force and SQL."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobsift.llm import phrases, q_phrases
from llm_helpers import SMOKE, docs, edge_docs, no_docs  # noqa: F401
from tools.oracle_compare import compare, duck

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    """(lang, words) -> occurrences, and all words a language."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain_collocations(rows, top, least):
    f, n = plain_counts(rows)
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        longer = [b for (m, v), b in cand.items() if m == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                             for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, got = Counter(), []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], *rest))
    return got


def some_texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "I.B", "New", "York", "new\tyork", "x y z w", "x y z w v", "😀", "zz", "NEW YORK CITY"]
    seps = [" ", " ", "  ", "\t", ". ", ", ", "\n", " ", "\r\n"]
    return [("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]))
            for _ in range(n)] + [(None, "en"), ("", None), ("...", "fr"), ("new york " * 400, "en"), ("a" * 9000, "en")]


@pytest.mark.parametrize("top", [2000, 7])
def test_against_brute_force(spark, top):
    rows = some_texts()
    rows += rows[:20]  # repeated rows count again
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, word string, f int, ids string")
    got = [tuple(r) for r in phrases.collocations(df.repartition(5), top, 8).orderBy("lang", "rank").collect()]
    want = plain_collocations(rows, top, 8)
    assert got == want and len({r[0] for r in got}) >= 3


def test_counts_do_not_depend_on_the_split(spark, docs):
    def counts(df):
        p, w, _ = phrases.phrase_counts(df, 10)
        spelt = (p.withColumn("key", F.xxhash64("ids")).select("ids", "f", F.posexplode("ids").alias("i", "id"))
                 .join(w.select("id", "lang", "word"), "id").groupBy("ids", "f", "lang")
                 .agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w")))
        return {(r.lang, tuple(x.word for x in r.w)): r.f for r in spelt.collect()}
    one = counts(docs.coalesce(1))
    assert one == counts(docs.repartition(7))
    f, _ = plain_counts([(r.text, r.lang) for r in docs.collect()])
    assert one == {k: v for k, v in f.items() if v >= 10}


@pytest.mark.parametrize("w", [1, 3, 16, 32, 33, 60, 64])
def test_permutation_is_invertible(w):
    rng = np.random.default_rng(w)
    if w <= 3:
        left, right = (x.ravel().astype(np.uint64) for x in np.mgrid[0:1 << w, 0:1 << w])
    else:
        left, right = (rng.integers(0, 1 << w if w < 64 else (1 << 64) - 1, 5000, dtype=np.uint64) for _ in range(2))
    a, b = phrases.permute(left, right, w)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(zip(left.tolist(), right.tolist(), strict=True)))
    assert int(max(a.max(), b.max())) < 1 << w
    back = phrases.unpermute(a, b, w)
    assert (back[0] == left).all() and (back[1] == right).all()


@pytest.mark.parametrize(("w", "rbits"), [(4, 4), (4, 2), (17, 6), (34, 7), (40, 12), (64, 5)])
def test_filter_round_trip(w, rbits):
    rng = np.random.default_rng(w)
    top = (1 << w) - 1
    left, right = rng.integers(0, top, 4000, dtype=np.uint64, endpoint=True), rng.integers(0, top, 4000, dtype=np.uint64, endpoint=True)
    left = left >> np.uint64(rbits) | np.uint64(5 % (1 << rbits)) << np.uint64(w - rbits)  # of one range
    _, first, left, right = phrases.distinct(left, right, w)
    left, right = left[first], right[first]
    counts = rng.integers(1, 300, len(left))
    counts[:3] = [254, 255, 1 << 40]
    data = phrases.encode(left, right, counts, w, rbits)
    got = phrases.decode(data)
    assert got[3] == w and all((x == y).all() for x, y in zip(got[:3], (left, right, counts), strict=True))
    if w == 17:  # compact: far below 24 bytes an entry
        assert len(data) < 8 * len(left)


@pytest.mark.parametrize("bits", [7, 20, 32])
def test_packing_keeps_words(bits):
    ids = np.random.default_rng(bits).integers(1, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    at = np.arange(900)
    for n in (2, 3, 4):
        left, right = phrases.halves(ids, at, n, bits)
        words = phrases.unhalve(left, right, n, bits)
        assert (words == np.stack([ids[at + i] for i in range(n)], axis=1)).all()


def test_chunks_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "WINDOW", 16)
    texts = [t for t, _ in some_texts(4, 30)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": pa.array(texts, pa.string())})
    got, n = [], 0
    for b in phrases._chunk_batches([batch]):
        for r in b.to_pylist():
            words = [".", *r["words"]]
            assert np.bincount(np.frombuffer(r["ids"], np.uint32), minlength=len(words))[1:].tolist() == r["counts"]
            got += " ".join(words[i] for i in np.frombuffer(r["ids"], np.uint32)).split(".")
            n += 1
    want = [p for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(ASCII))]
    pieces = lambda ps: [re.findall(r"[^\x20\x09]+", p) for p in ps if p.strip(" \t")]
    assert pieces(got) == pieces(want) and n > 5


def test_exact_scores_past_64_bits(spark):
    row = spark.sql("""SELECT cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div
        (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint) AS s
        FROM VALUES (8999999999999999999L, 9000000000000000000L, 9000000000000000001L) AS t(a, l, r)""").first()
    assert row.s == 2000000 * 8999999999999999999 // 18000000000000000001


def test_edges_and_empty(spark, edge_docs, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    rows = [(r.text, r.lang) for r in edge_docs.collect()]
    assert [tuple(r) for r in phrases.collocations(edge_docs).orderBy("lang", "rank").collect()] == plain_collocations(rows, 2000, 30)
    assert phrases.collocations(edge_docs.where("text = ''")).count() == 0


def test_query_against_sql(spark):
    res = compare(spark, duck(SMOKE), SMOKE, "op11", q_phrases.op11_collocations, q_phrases.ORACLE)
    assert res["status"] == "match" and "types" not in res, res
