"""op9, op10, the pipeline: against brute force, edge rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from jobsift.llm import lm, q_lm, suffix
from llm_helpers import SMOKE, docs, edge_docs, no_docs, prose  # noqa: F401


def plain_kept(texts):
    """(bytes left, bytes removed, runs) of each text, every 200-byte string looked up."""
    data, at = [(t or "").encode() for t in texts], defaultdict(list)
    for i, d in enumerate(data):
        for s in range(len(d) - suffix.LENGTH + 1):
            at[d[s:s + suffix.LENGTH]].append((i, s))
    gone = [np.zeros(len(d) + 1, bool) for d in data]
    for where in at.values():
        if len(where) > 1:
            for i, s in where:
                gone[i][s:s + suffix.LENGTH] = True
    out = []
    for d, g in zip(data, gone, strict=True):
        runs = int((np.diff(np.r_[False, g].astype(int)) == 1).sum())
        out.append((bytes(b for b, x in zip(d, g, strict=False) if not x), int(g.sum()), runs))
    return out


def check_kept(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = Counter((i, len((t or "").encode()), n, runs, hashlib.sha256(k).hexdigest())
                   for (i, t), (k, n, runs) in zip(rows, plain_kept([t for _, t in rows]), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect())
    assert got == want
    return sum(n for _, _, n, _, _ in want.elements())


def test_repeats_of_the_smoke_documents(docs):
    assert check_kept(docs) > 0


def test_repeats_with_edits(spark, edge_docs, no_docs):
    import random
    rng, base, rows = random.Random(2), prose(1, 300, 3000), []
    for i in range(40):
        a = rng.randrange(len(base) - 150)
        piece = base[a:a + rng.choice([150, 199, 200, 201, 203, 350, 700])]
        if i % 3 == 0:
            k = rng.randrange(len(piece))
            piece = piece[:k] + "é" + piece[k + 1:]
        rows.append((i, prose(100 + i, rng.randrange(60)) + piece + prose(200 + i, rng.randrange(60))))
    rows += [(90, "ab" * 300), (91, "ab" * 110), (92, "a" * 199), (93, "a" * 200), (94, "a" * 201), (95, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert check_kept(df.repartition(3)) > 0
    check_kept(edge_docs)
    assert suffix.remove_repeats(no_docs).count() == 0


def test_starts_near_the_ends_of_short_texts():
    got = suffix.repeated_starts(np.array([1, 1]), [b"ab", b"abc"], [b"x" * suffix.REACH, b"x" * suffix.REACH])
    assert got[:, :3].all() and not got[:, 3:].any()
    assert not suffix.repeated_starts(np.array([1, 2]), [b"", b""], [b"", b""]).any()


# -- op10 ---------------------------------------------------------------------

def plain_base(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            train.update(lm.tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ws = lm.tokens(t)
        out.append((i, len(ws), sum(w in train for w in ws), n,
                    sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def test_base_scores_and_better_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 700)       # most words are joined
    got = q_lm.op10_lm_scores(spark, SMOKE).toPandas().set_index("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i, n, known, total, base in plain_base(rows):
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert got["score"].sum() > got["base_score"].sum()


def test_model_probabilities_add_up():
    m = lm.LogBilinear(np.arange(1, 30, dtype=float))
    rng = np.random.default_rng(0)
    m.o = rng.normal(size=m.o.shape).astype(np.float32)
    k = len(m.o)
    for h1, h2 in ((0, 3), (k, k), (5, k)):
        p = m.log_probs(np.full(k, h1), np.full(k, h2), np.arange(k))
        assert abs(np.exp(p).sum() - 1) < 1e-5


def test_nce_learns_a_pattern():
    m = lm.LogBilinear(np.array([100.0, 100, 100, 1]))
    ids = np.tile([0, 1, 2], 4000)
    h1, h2 = lm._contexts(ids, np.array([0]), 4)
    acc, rng = {n: np.full(getattr(m, n).shape, 1.0, np.float32) for n in "orbc"}, np.random.default_rng(1)
    for _ in range(6):
        for i in range(0, len(ids), 1000):
            j = slice(i, i + 1000)
            lm.nce_train(m, h1[j], h2[j], ids[j], acc, rng)
    assert m.log_probs(h1[10:100], h2[10:100], ids[10:100]).mean() > math.log(0.7)


def test_lm_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    d = edge_docs.select("doc_id", "text")
    got = lm.score_texts(d, d).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    assert all(r.n_known == r.n_tokens for r in got)
    none = lm.score_texts(d, d.limit(0)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score <= 1e-9 for r in none)
    assert lm.score_texts(no_docs.select("doc_id", "text"), d).count() == 0


# -- the pipeline -------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    from jobsift.llm import bench, linededup, minhash, quality
    out = corpus_pipeline.run(spark, SMOKE)
    ids = {r.doc_id for r in out.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup",
                                                      "benchmark decontamination", "mixing"]
    kept = {r.doc_id for r in quality.line_verdicts(docs).where("kept").collect()}
    assert ids <= kept
    items = spark.read.parquet(f"{SMOKE}/benchmark.parquet")
    assert not ids & {r.doc_id for r in bench.find_leaks(docs, items).collect()}
    groups = defaultdict(set)
    for r in minhash.near_classes(docs).collect():
        groups[r.class_id].add(r.doc_id)
    assert all(len(g & ids) <= 1 for g in groups.values() if len(g) > 1)
    # clean documents stay: kept by the rules, alone in their class, no leak, and mostly not said before
    gone = {r.doc_id: r.n_removed for r in linededup.removed_lines(docs).collect()}
    clean = {d for g in groups.values() if len(g) == 1 for d in g} & kept
    clean -= {r.doc_id for r in bench.find_leaks(docs, items).collect()}
    assert {d for d in clean if not gone.get(d)} <= ids


def test_stages_keep_columns_and_take_edges(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for d in (edge_docs, no_docs):
            out = stage(spark, d, SMOKE)
            if name != "mixing":
                assert out.columns == d.columns, name
            assert out.count() <= d.count()
