"""op4: bitmaps of line sets, compared before the words."""

import random

import numpy as np
import pyarrow as pa

from jobsift.llm import linededup


def packed_sets(sets):
    cache = linededup.Codes({linededup._hash(b"w%d" % i): i for i in range(300)})  # the others are rare
    n, code = linededup.line_codes([[b"w%d" % w for w in s] for s in sets], cache)
    return n, linededup.pack(code, n)


def test_bitmaps_bound_the_shared_words():
    rng = random.Random(5)
    base = rng.sample(range(2000), 600)
    sets = [rng.sample(base, k) for k in (1, 2, 5, 15, 16, 17, 64, 300, 520, 590, 600, 600)] + [rng.sample(range(2000), k) for k in (3, 80, 700)]
    n, words = packed_sets(sets)
    maps = linededup.bitmaps(words, n)
    for i in range(len(sets)):
        for j in range(len(sets)):
            shared = len(set(sets[i]) & set(sets[j]))
            assert shared <= linededup.most_shared(maps[i], maps[j], int(n[i]), int(n[j]))
    assert linededup.bitmaps([], np.zeros(0, np.int64)) == []


def test_only_near_pairs_go_on_to_the_words():
    near, far = list(range(100)), list(range(30, 130))
    n, words = packed_sets([near, [*near[:95], *range(500, 505)], far, list(range(1000, 1100))])
    maps = linededup.bitmaps(words, n)
    cols = {"a": [1, 1, 1], "b": [2, 3, 4], "ma": [maps[0]] * 3, "mb": maps[1:], "na": [100] * 3, "nb": [100] * 3}
    batch = pa.RecordBatch.from_pydict(cols)
    kept = [tuple(r.values()) for b in linededup._near_batches(0.8)([batch]) for r in b.to_pylist()]
    assert kept == [(1, 2)]
