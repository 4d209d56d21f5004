"""op10: lookups of words and sums of gradients."""

import numpy as np

from jobsift.llm import lm


def test_scores_look_words_up_once(spark, monkeypatch):
    """One dictionary for the rows and the model: no second pass over the tokens."""
    def again(*a):
        raise AssertionError("tokens are looked up twice")
    monkeypatch.setattr(lm, "train", lambda docs, head, total: lm.LogBilinear(np.array([*[c for _, c in head], 0], float)))
    monkeypatch.setattr(lm, "_id_chunks", again)
    df = spark.createDataFrame([(1, "a b A"), (2, None), (3, "b zz")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in lm.score_texts(df, df.where("doc_id < 3")).collect()}
    assert got == {1: (4, 4, 5), 2: (1, 1, 5), 3: (3, 2, 5)}


def test_gradients_of_a_row_are_summed():
    at = np.array([3, 70_000, 3, 0, 70_000])
    for size in (4, 80_000):  # 16 bits and more
        rows, g = lm._add_rows(np.zeros(size), at % size, np.arange(10, dtype=float).reshape(5, 2))
        want = {k: np.arange(10).reshape(5, 2)[at % size == k].sum(axis=0).tolist() for k in set((at % size).tolist())}
        assert dict(zip(rows.tolist(), g.tolist(), strict=True)) == want
