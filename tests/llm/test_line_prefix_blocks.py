"""op4: words hashed at once, parity bitmaps, prefix rows in blocks."""

import random

import numpy as np
import pyarrow as pa

from jobsift.llm import linededup


def test_words_hashed_at_once_are_those_of_split():
    rng = random.Random(3)
    for _ in range(200):
        text = b"".join(rng.choice([b"a", b"b", b" ", b"\t", b"\n", b"\x0b", b"\x1c", b"\x85", b"\0", b"q" * rng.randint(1, 80)])
                        for _ in range(rng.randint(0, 120)))
        n, h = linededup.hashed_words(text)
        words = text.split()
        assert n.tolist() == [len(x.split()) for x in text.split(b"\n")]
        assert [linededup._hash(w) for w in words] == h.tolist() and len(set(words)) == len(set(h.tolist()))
    close = np.array([5 << 40, (5 << 40) + 1, 5 << 40, 3], np.uint64)  # equal in the upper bits
    for h in (close, np.random.default_rng(1).integers(0, 500, 3000).astype(np.uint64), close[:0]):
        got, of = linededup.distinct_hashes(h)
        assert got.tolist() == sorted(set(h.tolist())) and got[of].tolist() == h.tolist()


def test_large_sets_of_other_words_do_not_reach_the_words():
    """Bitmaps of which most bits are set passed any two large sets."""
    rng = random.Random(7)
    sets = [[b"w%d" % w for w in rng.sample(range(10 ** 6), 90)] for _ in range(40)]
    sets = [[*s, b"shared"] for s in sets]
    texts = pa.array([b"\n".join(map(b" ".join, [s])).decode() for s in sets])
    ids = pa.array(range(len(sets)))
    batch = pa.RecordBatch.from_arrays([ids, texts, ids, ids], names=["doc_id", "text", "_key", "_row"])
    made = list(linededup._set_batches(linededup.Codes({}))([batch]))
    bits = np.concatenate([np.asarray(b.column("bits")) for b in made])
    i, j = np.triu_indices(len(sets), 1)
    most = (182 - np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64))) // 2
    assert (most >= linededup.least_overlap(np.array([91]), np.array([91]))).mean() < 0.05


def test_blocks_give_every_pair_of_any_order_of_documents():
    rng = random.Random(11)
    lines, base = [], None
    for i in range(240):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.randint(4, 60))] if i % 4 == 0 else base
        lines.append(" ".join([*base[:len(base) - i % 3], f"u{i}"]))
    for ids in (pa.array(range(240)), pa.array([f"k{i}" for i in range(240)]), pa.array([None, *range(239)]), pa.array(np.arange(240) / 7)):
        row = pa.array(range(240))
        batch = pa.RecordBatch.from_arrays([ids, pa.array(lines), row, row], names=["doc_id", "text", "_key", "_row"])
        made = pa.Table.from_batches(linededup._set_batches(linededup.Codes({}))([batch])).combine_chunks().to_batches()
        blocks = pa.Table.from_batches(linededup._prefix_blocks(0.8, 5)(made)).sort_by("part").to_batches()
        rows = [r for b in linededup._pair_batches(0.8, 256)(blocks) for r in b.to_pylist()]
        found = {frozenset((r["a"], r["b"])) for r in rows}
        set_of = made[0].column("set").to_pylist()
        words = [frozenset(x.split()) for x in lines]
        want = {frozenset((set_of[i], set_of[j])) for i in range(240) for j in range(i)
                if words[i] != words[j] and len(words[i] & words[j]) >= 0.8 * len(words[i] | words[j]) - 1e-9}
        assert want and want <= found and len(found) < 6 * len(want)
        few = [r for b in linededup._pair_batches(0.8, 3)(blocks) for r in b.to_pylist()]
        assert any(r["a"] is None for r in few) and {frozenset((r["a"], r["b"])) for r in few if r["a"] is not None} <= found


def test_disk_of_a_prefix_row():
    n = 5000
    rng = np.random.default_rng(2)
    cols = [rng.integers(-2 ** 62, 2 ** 62, n), rng.integers(-2 ** 62, 2 ** 62, n), rng.integers(4, 90, n), rng.integers(0, 9, n),
            rng.integers(-2 ** 62, 2 ** 62, n), rng.integers(0, 40000, n)]
    block = linededup.to_planes(cols)
    assert all((a == b).all() for a, b in zip(cols, linededup.from_planes(block, n), strict=True))
    assert len(pa.compress(block, codec="lz4", asbytes=True)) < 30 * n  # 33.6 bytes as rows of their own
