"""Words and samples are taken a chunk at once, with the values of one text at a time."""

import re

import numpy as np
import pytest
import xxhash

from jobsift.llm import minhash

TEXTS = [None, "", " ", "a", "...", "A, b_c! É", "İstanbul ǅ ß²½ x\x00y\x1fz", " a b_—c", "٣٤ 漢字,仮名 😀x", "same same Same", "\n", "éx \x7f1"]


@pytest.mark.parametrize("chunk", [1 << 23, 9, 1])
def test_words_of_many_texts(monkeypatch, chunk):
    monkeypatch.setattr(minhash, "_CHUNK", chunk)
    want = [[xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", (t or "").lower())] for t in TEXTS]
    assert [h.tolist() for h in minhash.Words().of(TEXTS)] == want
    assert [minhash.Words()(t).tolist() for t in TEXTS] == want
    assert not list(minhash.Words().of([]))


def test_a_word_is_hashed_once_a_chunk(monkeypatch):
    hashed = []
    plain = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(minhash.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or plain(w))
    assert sum(map(len, minhash.Words().of(["one two", "two three one"] * 50))) == 250 and len(hashed) == 3


def test_slices_hold_everything_once():
    sizes = [3, 9, 1, 1, 1, 20, 0, 2]
    cut = [sizes[x] for x in minhash._slices(sizes, 5)]
    assert sum(cut, []) == sizes and all(sum(c) <= 5 or len(c) == 1 for c in cut)
    assert not list(minhash._slices([], 5))


def test_samples_do_not_depend_on_the_slice():
    rng = np.random.default_rng(4)
    keys, weights = rng.integers(0, 1 << 62, 900).astype(np.uint64), rng.random(900) * 5 + 0.5
    starts, sampler = np.array([0, 5, 400, 401]), minhash.Sampler()
    whole = sampler(keys, weights, starts)
    for n, (i, j) in enumerate(zip(starts, [*starts[1:], 900], strict=True)):
        assert np.array_equal(sampler(keys[i:j], weights[i:j], np.array([0]))[0], whole[n])
    # as the formula gives them
    i, j = (keys * sampler.odd[7, 0] >> np.uint64(48)).astype(int), (keys * sampler.odd[7, 1] >> np.uint64(48)).astype(int)
    ln_s = np.log(weights).astype(np.float32)
    t = np.floor(ln_s * sampler.over[i] + sampler.beta[i])
    ln_a = sampler.ln_c[j] - (t - sampler.beta[i] + np.float32(1)) * sampler.r[i]
    assert np.array_equal(np.minimum.reduceat(ln_a, starts).view(np.uint32), whole[:, 7])
