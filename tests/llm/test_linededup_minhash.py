"""op4, op6: against brute force, edge rows, hot groups."""

import re
from collections import defaultdict

import numpy as np
import pytest

from jobsift.llm import linededup, minhash
from llm_helpers import docs, edge_docs, no_docs, prose  # noqa: F401


def plain_removed(rows, t=0.8):
    """(doc_id, line) of every line that matches an earlier one."""
    seen, out = [], []
    for doc, text in rows:
        for i, line in enumerate((text or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if len(s) >= linededup.MIN_TOKENS:
                if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                    out.append((doc, i))
                seen.append(s)
    return sorted(out)


def got_removed(df, **kw):
    return sorted((r.doc_id, i) for r in linededup.removed_lines(df, **kw).collect() for i in r.removed)


def test_lines_of_the_smoke_documents(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = plain_removed(rows)
    assert want and got_removed(docs) == want


@pytest.mark.parametrize("group", [2, 256])
def test_hot_line_variants(spark, group):
    """Many variants of one line, and many lines with one rare word in common."""
    import random
    rng, rows = random.Random(3), []
    base = prose(1, 30, 10_000).split()
    for i in range(120):
        v = list(base)
        for k in range(rng.randrange(6)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(v) + "\n" + prose(i, 9, 60) + " rareword\nshort line"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_removed(df, group=group) == plain_removed(rows)


def test_short_lines(spark):
    """Repeats of one to four words go; of different sets, four words in five match."""
    rows = [(0, "Of.\nAll rights reserved.\na b c d\np q r\nv w x y z"), (1, "of.\nreserved. All rights\na b c d e\np q s\nv w x y"),
            (2, "Of.\n\nnew\np q\nnew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_removed(df) == [(1, 0), (1, 1), (1, 2), (1, 4), (2, 0), (2, 4)]


def test_line_edges(spark, edge_docs, no_docs):
    got = {(r.doc_id, r._row): r for r in linededup.removed_lines(edge_docs).collect()}
    by_doc = defaultdict(list)
    for (d, _), r in got.items():
        by_doc[d].append(r.n_removed)
    assert sorted(by_doc[1]) == [0, 1] and by_doc[2] == [1] and by_doc[6] == [0] and sorted(by_doc[None]) == [0, 1]
    assert 3 not in by_doc and 4 not in by_doc
    out = linededup.drop_matched_lines(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert linededup.removed_lines(no_docs).count() == 0 and linededup.drop_matched_lines(no_docs).count() == 0


def test_dropped_lines_follow_in_n_chars(spark):
    line = prose(3, 20)
    rows = [(1, line + "\n" + prose(4, 20), 1), (2, prose(5, 30) + "\n" + line + "\nend", 1)]
    out = {r.doc_id: r for r in linededup.drop_matched_lines(
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[2].text == prose(5, 30) + "\nend" and out[2].n_chars == len(out[2].text) and out[1].text == rows[0][1]


def test_unique_text_of_a_mostly_shared_document_stays(spark):
    shared, own = prose(3, 55), prose(4, 45)
    rows = [(1, shared), (2, shared + "\n" + own), (3, shared + "\n \n")]
    out = linededup.drop_matched_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: shared, 2: own}


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    n = rng.integers(5, 12, 50)
    sets = [np.sort(np.where(rng.random(k) < 0.4, rng.integers(0, 1 << 62, k).astype(np.uint64),
                             rng.integers(0, 1 << 18, k).astype(np.uint64) + linededup._TOP)) for k in n]
    words = linededup.pack(np.concatenate(sets), n)
    at, k, code = linededup.unpack_prefixes(words, n, n)
    assert (code == np.concatenate(sets)).all() and (at == np.repeat(np.arange(50), n)).all()
    for i in range(49):
        x, y = set(sets[i].tolist()), set(sets[i + 1].tolist())
        assert linededup.shared_words(words[i], words[i + 1], n[i], n[i + 1]) == len(x & y)


# -- op6 ----------------------------------------------------------------------

def plain_classes(rows, t=0.8):
    """Components of exact weighted Jaccard, every pair."""
    count, n, hashes, words = np.zeros(minhash.BUCKETS), 0, {}, minhash.Words()
    for i, (_, text) in enumerate(rows):
        hashes[i] = words(text)
        count[np.unique(minhash.buckets_of(hashes[i]))] += 1
        n += 1
    idf = (1.0 + np.log((n + 1.0) / (count + 1.0))).astype(np.float32).astype(float)
    sets = {i: minhash.weighted_shingles(h, idf) for i, h in hashes.items()}
    inverse, parent = defaultdict(list), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    borderline = 0
    for i, (keys, _) in sets.items():
        near = {j for k in keys.tolist() for j in inverse[k]}
        for j in near:
            s = minhash.similarity(sets[i], sets[j])
            borderline += t <= s < t + 0.02
            if s >= t:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for k in keys.tolist():
            inverse[k].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {tuple(sorted(g)) for g in groups.values()}, borderline


def got_classes(df):
    groups, keep = defaultdict(list), defaultdict(int)
    for r in minhash.near_classes(df).collect():
        groups[r.class_id].append(r.doc_id)
        keep[r.class_id] += r.keep
    assert all(k == 1 for k in keep.values())
    return {tuple(sorted(g)) for g in groups.values()}


def test_classes_of_the_smoke_documents(docs):
    want, _ = plain_classes(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert got_classes(docs) == want


def test_large_group_and_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 50)
    import random
    rng, rows = random.Random(5), []
    base = prose(1, 200, 5000).split()
    for i in range(150):  # near copies of one text
        v = list(base)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(v)))
    passage = prose(2, 60, 5000)
    rows += [(1000 + i, prose(10 + i, 60, 5000) + " " + passage) for i in range(80)]  # a passage in common only
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_classes(df) == plain_classes(rows)[0]


def star_rows(edits, n=300):
    """A text and n variants that are like it but not like each other; it comes
    in the middle.  Edits are words of the text, so that all words weigh alike."""
    import random
    rng, rows = random.Random(11), []
    base = prose(1, 250, 5000).split()
    for i in range(n):
        v = list(base)
        for k in rng.sample(range(250), edits):
            v[k] = rng.choice(base)
        rows.append((i if i < n // 2 else i + 1, " ".join(v)))
    return [*rows, (n // 2, " ".join(base))]


def test_base_text_joins_its_variants(spark):
    rows = star_rows(4)
    want = plain_classes(rows)[0]
    assert len(want) == 1
    assert got_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_base_text_in_split_buckets(spark, monkeypatch):
    """Parts of buckets and of groups, by rows and by bytes."""
    monkeypatch.setattr(minhash, "PART", 40)
    monkeypatch.setattr(minhash, "PART_BYTES", 20_000)
    rows = star_rows(4)
    assert got_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain_classes(rows)[0]


def test_rows_of_60_percent_equal_samples_share_a_group():
    """29 of 48 samples agree (60.4 %) with a text that is no centre itself, as it
    agrees with a centre in 44: the centre agrees in 25, and links both."""
    import pyarrow as pa
    mine = np.arange(minhash.SAMPLES, dtype=np.uint32)
    centre, near, other = mine.copy(), mine.copy(), mine + np.uint32(1000)
    near[44:] += np.uint32(500)
    other[:25] = near[:25]
    other[44:] = near[44:]
    assert ((near == other).sum(), (centre == other).sum()) == (29, 25)
    rows = [(0, 0, 0, 0, n, part, x.astype(np.uint32).tobytes()) for n, part, x in
            ((1, 0, centre), (2, 0, near), (3, 0, other), (4, 0, mine + np.uint32(5000)))]
    names = ["i", "v", "p", "q", "node", "part", "samples"]

    def links(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
        return [tuple(r.values()) for b in minhash._possible_batches(iter([batch])) for r in b.to_pylist()]
    assert links(rows) == [(2, 1), (3, 1)]
    # two parts: every row of one with every row of the other
    assert links([(0, 0, 0, 1, n, n % 2, x) for _, _, _, _, n, _, x in rows]) == [(1, 2), (3, 2)]


def test_group_of_wide_similarity(spark, monkeypatch):
    """Variants from hardly to half edited: every link of the group is found,
    and rows stay few although most pairs are possible ones."""
    import random
    rng, rows = random.Random(7), []
    base = prose(3, 160, 5000).split()
    for i in range(350):
        v = list(base)
        for _ in range(rng.choice([1, 3, 6, 9, 14, 20])):
            v[rng.randrange(len(v))] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, borderline = plain_classes(rows)
    assert got_classes(df) == want and 5 < len(want) < 345 and borderline
    monkeypatch.setattr(minhash, "PART", 60)
    assert got_classes(df) == want
    idf = minhash.word_idf(df)
    nodes = minhash.signatures(df, idf)
    members = nodes.select(nodes._row.alias("node"), "samples", nodes.doc_id.alias("v")).selectExpr("node", "samples", "0 as i", "0L as v")
    assert minhash.possible_links(members).count() < 350 * 7  # a forest for each of the parts' cells


def test_near_edges(edge_docs, no_docs):
    rows = minhash.near_classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.class_id)
    assert of[1] == of[2] == {1} and of[3] == {3} and of[4] == {4} and of[6] == {6}
    out = minhash.drop_near_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2
    assert minhash.near_classes(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    weights = rng.random(len(keys)) * 5 + 0.5
    other = weights * rng.choice([1.0, 0.6, 1.7], len(keys))
    sampler = minhash.Sampler()
    want, same = np.minimum(weights, other).sum() / np.maximum(weights, other).sum(), 0
    for i in range(40):  # fresh keys, so fresh samples
        k = keys + np.uint64(i * 7919)
        s = sampler(np.r_[k, k], np.r_[weights, other], np.array([0, len(k)]))
        same += (s[0] == s[1]).mean() / 40
    assert abs(same - want) < 0.05


def test_words():
    assert len(minhash.Words()("A, b_c! É")) == 3 and not len(minhash.Words()(None)) and re
