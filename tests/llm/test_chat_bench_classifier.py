"""op5, op7, op8: against plain Python, held-out accuracy, edge rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.llm import bench, chat, classifier, q_classifier
from llm_helpers import SMOKE, docs, edge_docs, no_docs, prose  # noqa: F401


# -- op7 ----------------------------------------------------------------------

MAIL = "conv_id long, turn long, text string, conv string, level string"


def test_nested_quotes_and_reply_order(spark):
    rows = [(1, 0, "First line.\nSecond line."), (1, 1, "> first   LINE.\nI agree."),
            (1, 2, ">> First line.\n> I agree.\nNo."), (1, 3, "> Second line.\n> never said\nOther thread end."),
            (1, 4, "no quotes at all"), (1, 5, "> > First line.\n>\n> No.\n> no quotes at all"),
            (2, 0, "> I agree.\nI agree."), (2, 1, "> I agree.")]
    rows = [(*r, "x", "y") for r in rows]
    rows += [(None, 0, "> First line.", "x", "y"), (3, None, "text", "x", "y"), (4, 0, None, "x", "y"), (4, 1, "", "x", "y")]
    got = {(r.conv, r.turn): r for r in chat.link_quotes(spark.createDataFrame(rows, MAIL)).collect()}
    assert len(got) == len(rows)
    view = lambda c, t: (got[c, t].body, got[c, t].n_quotes, got[c, t].max_level, got[c, t].n_linked,
                         got[c, t].parent_turn, got[c, t].thread_root, got[c, t].depth)
    assert view(1, 0) == ("First line.\nSecond line.", 0, 0, 0, None, 0, 0)
    assert view(1, 1) == ("I agree.", 1, 1, 1, 0, 0, 1)
    assert view(1, 2) == ("No.", 2, 2, 2, 1, 0, 2)
    assert view(1, 3) == ("Other thread end.", 2, 1, 1, 0, 0, 1)
    assert view(1, 4) == ("no quotes at all", 0, 0, 0, None, 4, 0)
    assert view(1, 5) == ("", 3, 2, 3, 4, 4, 1)  # a tie: the later original
    assert view(2, 0)[1:] == (1, 1, 0, None, 0, 0)  # its own text is no original
    assert view(2, 1)[1:] == (1, 1, 1, 0, 0, 1)
    assert view(None, 0)[1:] == (1, 1, 0, None, 0, 0) and view(4, 0)[0] is None


def test_deep_thread_and_repeated_rows(spark):
    rows = [(1, t, f"> message {t - 1}\nmessage {t}") for t in range(40)] + [(1, 7, "> message 6\nmessage 7")]
    got = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(got) == 41 and all(r.depth == r.turn and r.thread_root == 0 for r in got)


def test_chat_empty(spark):
    assert chat.link_quotes(spark.createDataFrame([], MAIL)).count() == 0


# -- op8 ----------------------------------------------------------------------

def plain_words(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def plain_leaks(documents, items, threshold=0.8):
    """All windows of all item sizes, exact weighted Jaccard."""
    sh = {i: [tuple(w[k:k + 5]) for k in range(len(w) - 4)] for i, t in items if len(w := plain_words(t)) >= 5}
    df = Counter(s for x in sh.values() for s in set(x))
    weight = lambda s: round((1 + np.log((len(sh) + 1) / (df[s] + 1))) * 1000)
    found = {}
    for d, t in documents:
        w = plain_words(t)
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        near = {s for s in grams} & set(df)
        for i, x in sh.items():
            if not near.intersection(x):
                continue
            mine, m = Counter(x), len(x)
            for a in range(max(1, len(grams) - m + 1)):
                win = Counter(grams[a:a + m])
                common = sum(min(c, win[s]) * weight(s) for s, c in mine.items())
                total = sum(c * weight(s) for s, c in mine.items()) + sum(c * weight(s) for s, c in win.items()) - common
                if common >= threshold * total - 1e-9:
                    found[d, i] = max(found.get((d, i), 0), common / total)
    return found


def test_leaks_of_the_smoke_tables(spark, docs):
    items = spark.read.parquet(f"{SMOKE}/benchmark.parquet")
    want = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in bench.find_leaks(docs, items).collect()}
    assert got == pytest.approx(want) and want


def test_edited_leaks_and_edges(spark, edge_docs, no_docs):
    item = prose(50, 60)
    words = item.split()
    edits = {20: words, 21: [w.upper() + "," for w in words], 22: words[2:] + ["z", "q"], 23: words[:55], 24: words[:30] + ["new"] + words[31:],
             25: words[:20] + words[40:], 26: words * 3}
    rows = [(i, prose(60, 30) + " " + " ".join(w) + " " + prose(61, 40)) for i, w in edits.items()]
    more = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * 11) for i, t in rows], edge_docs.schema)
    every = edge_docs.unionByName(more)
    items = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, None, "x"), (4, item, "x"), (None, prose(9, 3), "x")],
                                  "item_id long, text string, size string")
    want = plain_leaks([(r.doc_id, r.text) for r in every.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in bench.find_leaks(every, items).collect()}
    assert got == pytest.approx(want) and {d for d, _ in got} >= {20, 21, 22, 26}
    left = bench.decontaminate(every, items)
    assert left.columns == every.columns
    assert left.count() == every.count() - len({d for d, _ in got})
    assert bench.find_leaks(no_docs, items).count() == 0
    assert bench.find_leaks(every, items.limit(0)).count() == 0


def test_hamming_blocks_miss_no_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-2**63, 2**63 - 1, 20)
    left, right = [], [(int(i), int(b), 1) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in (0, 5, bench.RADIUS, bench.RADIUS + 1):
            flips = 0
            for bit in rng.choice(64, k, replace=False):
                flips |= 1 << int(bit)
            left.append((len(left), int(np.int64(np.uint64(int(b) & (2**64 - 1)) ^ np.uint64(flips)).item()), 1))
    l_df = spark.createDataFrame(left, "l long, fp long, size int")
    r_df = spark.createDataFrame(right, "r long, fp long, size int")
    got = {tuple(r) for r in bench.hamming_candidates(l_df, r_df).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(i, j) for i, a, _ in left for j, b, _ in right if apart(a, b) <= bench.RADIUS}


# -- op5 ----------------------------------------------------------------------

def test_held_out_accuracy(spark):
    got = q_classifier.op5_quality_classifier(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (8, 1), (7, 0), (3, 0), (None, 1), (6, None), (99, 0)], "doc_id long, label int")
    model = classifier.train(edge_docs, labels)
    got = classifier.score(edge_docs.drop("score"), model).select("doc_id", "score").collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    one = classifier.train(edge_docs, labels.where("label = 1"))
    assert all(r.score > 0.5 for r in classifier.score(edge_docs.drop("score"), one).collect())
    assert classifier.train(no_docs, labels).probability([0.0])[0] < 1
    assert classifier.score(no_docs.drop("score"), model).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = classifier.dual_coordinate_descent(rows, y, 5, np.full(60, 0.5), epochs=4000)
    def loss(w):
        return (w @ w) / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w[:5] + w[5])).sum()
    best = loss(w)
    assert all(loss(w + d) >= best - 1e-3 for d in rng.normal(scale=0.05, size=(300, 6)))


def test_shapes():
    assert classifier.word_shape(b"Das,!!") == b"Aa,!" and classifier.word_shape("é12".encode()) == b"a0"
    assert F is not None
