"""op10: the score against a plain softmax over all classes, token by token."""

import math
from collections import Counter

import numpy as np

from jobsift.llm import lm
from llm_helpers import docs  # noqa: F401


def test_scores_of_plain_softmax(spark, docs, monkeypatch):
    kept, real = [], lm.train

    def train(*a):
        kept.append(real(*a))
        return kept[-1]
    monkeypatch.setattr(lm, "train", train)
    monkeypatch.setattr(lm, "CLASSES", 200)  # most words share the last class
    monkeypatch.setattr(lm, "HEAD", 900)     # and most of those are joined
    training = docs.where("doc_id % 10 <> 0")
    got = {r.doc_id: r.score for r in lm.score_texts(docs.select("doc_id", "text"), training).collect()}
    count = Counter()
    for r in training.collect():
        count.update(lm.tokens(r.text))
    # the words of their own class: all with a count above some bound, so a set without ties cut
    m = kept[0]
    other = len(m.o) - 1
    words = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))][:other]
    at = {w: i for i, w in enumerate(words)}
    total, inside = sum(count.values()), sum(count[w] for w in words)
    rest = math.log10(total - inside + 0.1 * (len(count) - other + 1))
    begin = other + 1
    for r in docs.orderBy("doc_id").limit(25).collect():
        before, want = (begin, begin), 0.0
        for w in lm.tokens(r.text):
            c = at.get(w, other)
            q = m.r[before[0]] * m.c[0] + m.r[before[1]] * m.c[1]
            s = (m.o @ q + m.b).astype(float)
            want += (s[c] - np.logaddexp.reduce(s)) / math.log(10)
            if c == other:
                want += math.log10(count[w] + 0.1) - rest
            before = (c, before[0])
        assert abs(got[r.doc_id] - want) < 1e-3 + 1e-4 * abs(want), r.doc_id
