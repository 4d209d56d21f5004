"""op3: the verdict against a plain computation, templates, groups of copies."""

import random
from collections import defaultdict

import pytest

from jobsift.llm import quality
from llm_helpers import docs  # noqa: F401
from llm_helpers import prose as numbered


def prose(seed, n):
    """Without digits, which normal lines do not tell apart."""
    return numbered(seed, n).translate(str.maketrans("0123456789", "abcdefghij"))


def plain_verdicts(rows, max_docs):
    """(doc_id, text, host) -> kept, removed words; lines and shingles as strings."""
    hashes = quality.WordHash()
    texts = defaultdict(set)  # (host, line) -> texts
    for _, text, host in rows:
        for line in (text or "").encode().split(b"\n"):
            if norm := quality.normal_line(line):
                texts[host, norm].add(text)
    candidates = {k for k, v in texts.items() if len(v) > max_docs}
    held = defaultdict(set)
    for k in candidates:
        for t in texts[k]:
            held[k[0], t].add(k)
    sketch = {(h, t): quality.sketch(b"\x00" if h is None else h.encode(), t.encode(), hashes) for h, t in held}
    n = defaultdict(int)
    for s in sketch.values():
        for x in s:
            n[x] += 1
    who = defaultdict(set)
    for (h, t), lines in held.items():
        own = sum(n[x] <= max_docs for x in sketch[h, t])
        distinct = own >= quality.MIN_OWN * len(sketch[h, t])
        for k in lines:
            # copies count by any one line that they share: here by the first in the text
            who[k].add(t if distinct else min(lines, key=lambda k: quality.line_keys(b"\x00" if h is None else h.encode(), k[1])[0][0]))
    gone = {k for k, v in who.items() if len(v) > max_docs}
    out = []
    for i, text, host in rows:
        stats = quality.text_stats(text or "")
        cut = sum(len(norm.split(b" ")) for line in (text or "").encode().split(b"\n")
                  if (norm := quality.normal_line(line)) and (host, norm) in gone)
        bad = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        out.append((i, not bad and stats[0] - cut >= 0.3 * stats[0], cut))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_docs", [1, 3, 30])
def test_verdict_against_plain_python(docs, max_docs):
    got = quality.line_verdicts(docs, max_docs=max_docs).select("doc_id", "kept", "removed_words").collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want = plain_verdicts(rows, max_docs)
    assert sorted(map(tuple, got), key=repr) == want
    assert max_docs > 1 or any(r[2] for r in want)


@pytest.mark.parametrize(("shared", "own"), [(3, 6), (5, 2), (10, 4), (10, 2)])
def test_template_lines_go_whatever_their_number(spark, shared, own):
    lines = [prose(10**7 + i, 12) for i in range(shared)]
    rows = [(i, "\n".join([*lines[:shared // 2], *(prose(50 * i + k, 12) for k in range(own)), *lines[shared // 2:]]), "h")
            for i in range(120)]
    got = quality.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.removed_words == 12 * shared for r in got)
    assert all(r.kept == (r.n_words >= 50 and own >= 0.3 * (own + shared)) for r in got)


def test_groups_of_copies_stay(spark):
    """400 near copies with word edits in any line, exact copies, and 300 documents with a shared line."""
    rng = random.Random(2)
    base = prose(1, 360).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(len(w))] = prose(rng.randrange(10**6), 1) + "x"
        rows.append((i, "\n".join(" ".join(w[k:k + 12]) for k in range(0, 360, 12)), "h"))
    rows += [(1000 + i, "\n".join(prose(77 + k, 12) for k in range(9)), "h") for i in range(200)]
    line = prose(5, 10)
    rows += [(2000 + i, "\n".join([prose(10**5 + i, 60), line]), "h") for i in range(300)]
    rows += [(3000 + i, rows[i][1] + "\n" + line, "h") for i in range(0, 400, 2)]
    got = quality.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in got)
    assert all(r.removed_words == (10 if r.doc_id >= 2000 else 0) for r in got)


def test_shared_shingles_are_marked_not_joined(spark):
    """The shingles of documents stay as many rows as they are, whatever part of them is shared."""
    rows = [(i, i, [1, 2 + i % 3], list(range(100)) + [1000 + i] * (i % 2)) for i in range(50)]
    base = spark.createDataFrame(rows, "_row long, content long, lines array<long>, sketch array<long>")
    got = quality.boilerplate(base, 30, 0.2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (s#" not in plan and "Join LeftOuter, (s#" in plan
    assert got.collect() == []  # one group of copies counts as its least line
    own = [(i, i, [1, 2 + i % 3], [10_000 + 100 * i + x for x in range(100)]) for i in range(50)]
    assert [r.line for r in quality.boilerplate(spark.createDataFrame(own, base.schema), 30, 0.2).collect()] == [1]
