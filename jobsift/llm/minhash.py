"""MinHash near-duplicates: improved consistent weighted sampling (ICWS) over
TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are five words (runs of letters, digits and ``_``, lower-cased); a
shorter text is one shingle.  A shingle weighs its count times the mean
smoothed IDF of its words.  IDF is taken per word and not per shingle: a
shingle's frequency is the size of its group of copies, and would make a
large group's common text weigh nothing and its few edits everything.  Word
frequencies cover all documents, in ``BUCKETS`` hashed counters (1 MB, the
size of what is broadcast at any scale).

``SAMPLES`` consistent samples a text in ``BANDS`` bands of ``ROWS``: a pair
at similarity 0.8 shares a bucket with probability 0.998 and has POSSIBLE of
its samples in common with 0.9995; at 0.9 with 1 - 3e-6.  What follows is exact:

1. Texts of a bucket are compared by their samples and joined to groups of
   what is possibly similar.  A text that has SURE of its samples in common
   with a centre before it is no centre itself; others are compared with
   centres only, at POSSIBLE less what SURE leaves open, so two texts with
   POSSIBLE of the samples in common are always in one group.
2. The texts of a group come together once, and all pairs of them are verified
   by weighted Jaccard similarity through the group's shingle postings.

Buckets and groups beyond ``PART`` rows or ``PART_BYTES`` of text are dealt to
parts, and each part meets each other in a task of its own, so no pair is left
out and no task holds more than two parts.  Either step gives only links that
join what is not joined yet in its task, a row a text at most and not one a
pair, so large groups of copies make few rows.  Links become classes by
connected components.  Copies of a text are one node from the start.

Defined cases: texts without a word (null, empty) are their own classes;
repeated rows are copies; a null doc_id takes part, but a class is named by
its least doc_id that is not null (null if there is none); an empty table
gives an empty result.
"""

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import broadcast_if_small, fresh, materialise, row_key
from jobsift.llm.graph import components

N = 5
THRESHOLD = 0.8
BUCKETS = 1 << 18
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
PART = 1 << 11        # members of a bucket or group that meet in one task
PART_BYTES = 16 << 20 # bytes of text of them, on average
# shares of the samples that agree.  A pair has the same samples in each bucket
# that it shares, so one under POSSIBLE is lost: of pairs at similarity 0.8 one
# in 2,000, at 0.82 one in 8,700 (binomial, 48 samples)
POSSIBLE, SURE = 0.6, 0.9
NEAR = POSSIBLE + SURE - 1  # samples do not agree where either pair of a text between them does not

# words are runs of letters, digits and _ (what \w matches): all other bytes become blanks
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_BLANKED = bytes(c if c > 127 or chr(c).isalnum() or c == ord("_") else 32 for c in range(256))
_CHUNK = 1 << 23  # characters of text whose words are hashed at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SAMPLED = 1 << 16  # shingles that are sampled at once: their columns stay in the CPU's cache
_TABLE = 1 << 16  # tabulated random variates, indexed by 16 bits of a sample's hash


def _slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of ``sizes`` of at most ``limit`` in all, or one that is larger."""
    i, n = 0, 0
    for j, size in enumerate(sizes):
        if j > i and n + size > limit:
            yield slice(i, j)
            i, n = j, 0
        n += size
    if i < len(sizes):
        yield slice(i, len(sizes))


class Words:
    """Hashes of texts' words, in order; a word is hashed once a chunk."""

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.of([text]))

    def of(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        for x in _slices([len(t or "") for t in texts], _CHUNK):
            yield from self._chunk([self._plain(t) for t in texts[x]])

    @staticmethod
    def _plain(text: str | None) -> bytes:
        text = (text or "").lower()
        return (text if text.isascii() else _OTHER.sub(" ", text)).encode()

    @staticmethod
    def _chunk(texts: list[bytes]) -> list[np.ndarray]:
        text = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_BLANKED), np.uint8)
        inside = text != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and last bytes are blanks
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[words.indices.to_numpy()]
        ends = np.cumsum([len(t) + 1 for t in texts])  # of each text, with its blank
        return np.split(h, np.searchsorted(starts, ends[:-1], side="right"))


def buckets_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def weighted_shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their weights."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0)
    n = min(N, len(h))
    w, m = idf[buckets_of(h)], len(h) - n + 1
    key, weight = np.zeros(m, np.uint64), np.zeros(m)
    for i in range(n):
        key = (key ^ h[i:i + m]) * _MIX
        key ^= key >> np.uint64(29)
        weight += w[i:i + m]
    keys, first, tf = np.unique(key, return_index=True, return_counts=True)
    return keys, tf * (weight[first] / n)


def similarity(a, b) -> float:
    """Weighted Jaccard of two (keys, weights)."""
    (ka, wa), (kb, wb) = a, b
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - common
    return float(common / total) if total else 0.0


class Sampler:
    """ICWS: sample k of a weighted set S is the shingle with the least
    ln a = ln c - r (t - beta + 1), t = floor(ln S / r + beta), with r and c from
    Gamma(2, 1) and beta uniform; two sets take the same (shingle, t) with
    probability their weighted Jaccard similarity.  As ln a is a function of
    (shingle, t, k), its bits stand for the sample."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.over = (1.0 / self.r).astype(np.float32)
        self.beta = rng.random(_TABLE).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.odd = rng.integers(1 << 62, size=(SAMPLES, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, SAMPLES) sample bits; texts are slices beginning at starts, none empty."""
        ln_s = np.log(weights).astype(np.float32)
        out = np.empty((SAMPLES, len(starts)), np.float32)
        shift, n = np.uint64(48), len(keys)
        at, other = np.empty(n, np.uint64), np.empty(n, np.uint64)
        t, x = np.empty(n, np.float32), np.empty(n, np.float32)
        for k in range(SAMPLES):
            np.right_shift(np.multiply(keys, self.odd[k, 0], out=at), shift, out=at)
            np.right_shift(np.multiply(keys, self.odd[k, 1], out=other), shift, out=other)
            i, j = at.view(np.int64), other.view(np.int64)  # under _TABLE, so clip changes nothing
            self.beta.take(i, out=x, mode="clip")
            self.over.take(i, out=t, mode="clip")
            t *= ln_s
            t += x
            np.floor(t, out=t)
            t -= x
            t += np.float32(1)
            t *= self.r.take(i, out=x, mode="clip")
            self.ln_c.take(j, out=x, mode="clip")
            x -= t
            out[k] = np.minimum.reduceat(x, starts)
        return np.ascontiguousarray(out.T).view(np.uint32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys of ROWS samples each."""
    s = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ s[:, :, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


# -- over tables --------------------------------------------------------------

def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, count, n = Words(), np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for h in words.of(b.column("text").to_pylist()):
            count[np.unique(buckets_of(h))] += 1
            n += 1
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[count[at], n])], names=["bucket", "n"])


def word_idf(docs: DataFrame) -> np.ndarray:
    """Smoothed IDF by word bucket, from all documents."""
    rows = (docs.select("text").mapInArrow(_df_batches, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy(int)] = rows["n"]  # -1: all documents
    return 1.0 + np.log((df[-1] + 1.0) / (df[:-1] + 1.0))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> _row, doc_id, _key, size (characters), t1, t2 (of
    the words), bands and samples (null without a word)."""
    small = idf.astype(np.float32)

    def run(batches):
        words, sampler, idf = Words(), Sampler(), small.astype(float)
        for b in batches:
            texts = b.column("text").to_pylist()
            marks, node, parts = [], {}, []
            for h in words.of(texts):
                d = xxhash.xxh3_128_digest(h.tobytes())
                marks.append(d)
                if d not in node and len(h):  # copies of this batch are sampled once
                    node[d] = len(parts)
                    parts.append(weighted_shingles(h, idf))
            bands, lens = [], [len(p[0]) for p in parts]
            for x in _slices(lens, _SAMPLED):
                s = sampler(np.concatenate([p[0] for p in parts[x]]), np.concatenate([p[1] for p in parts[x]]),
                            np.r_[0, np.cumsum(lens[x])[:-1]])
                bands.extend(zip(band_keys(s), map(bytes, s), strict=True))
            both = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_key"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.array([bands[node[d]][0] if d in node else None for d in marks], pa.list_(pa.int64())),
                 pa.array([bands[node[d]][1] if d in node else None for d in marks], pa.binary())],
                names=["doc_id", "_key", "size", "t1", "t2", "bands", "samples"])

    kind = dict(docs.dtypes)["doc_id"]
    return materialise(docs.select("doc_id", "text", row_key("doc_id", "text").alias("_key"))
                       .mapInArrow(run, f"doc_id {kind}, _key long, size long, t1 long, t2 long, bands array<long>, samples binary")
                       .withColumn("_row", F.monotonically_increasing_id()))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, _key, class_id, keep (one row of each class)."""
    idf = word_idf(docs)
    sig = signatures(docs, idf)
    # copies are one node, named by their least row
    row = F.min(F.struct("_row", "_key", "size")).alias("f")
    nodes = sig.where("bands is not null").groupBy("t1", "t2").agg(row, F.first("bands").alias("bands"),
                                                                   F.first("samples").alias("samples"))
    nodes = materialise(nodes.select("t1", "t2", F.col("f._row").alias("node"), F.col("f._key").alias("_key"),
                                     F.col("f.size").alias("size"), "bands", "samples"))
    band = nodes.select("node", F.posexplode("bands").alias("i", "v"))
    shared = band.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "v")
    members = materialise(band.join(shared, ["i", "v"]))  # of buckets that more than one text has
    groups = components(possible_links(members.join(nodes.select("node", "samples"), "node")))
    groups = groups.join(nodes.select("node", "_key", "size"), "node")
    comp = components(exact_links(docs, groups, idf, threshold))
    of_row = sig.select("_row", "doc_id", "_key", "t1", "t2").join(nodes.select("t1", "t2", "node"), ["t1", "t2"], "left")
    of_row = of_row.join(comp, "node", "left").withColumn("node", F.coalesce("comp", "node", "_row"))
    of_row = materialise(of_row.select("_row", "doc_id", "_key", "node"))
    first = of_row.groupBy("node").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row"))["_row"].alias("_first"))
    return of_row.join(first, "node").select("doc_id", "_key", "class_id", (F.col("_row") == F.col("_first")).alias("keep"))


class Forest:
    """Which of n rows are joined."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were not joined before."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def in_cells(df: DataFrame, parts: str) -> DataFrame:
    """Rows with their number of ``parts`` -> a row for each cell that they are
    in: each part meets itself (p = q) and every other part (p < q)."""
    df = df.withColumn("part", F.pmod(F.xxhash64("node"), F.col(parts)))
    df = df.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    return df.withColumn("p", F.least("part", "x")).withColumn("q", F.greatest("part", "x")).drop("x", parts)


def _cell_groups(batches: Iterator[pa.RecordBatch], keys: list[str], cols: list[str]):
    """Rows sorted by cell and node -> (cell, its rows as a list a column)."""
    at, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in [*keys, *cols]), strict=True):
            key = row[:len(keys)]
            if key != at and held:
                yield at, list(zip(*held, strict=True))
                held = []
            at = key
            if not held or held[-1][0] != row[len(keys)]:  # a repeated row is read once
                held.append(row[len(keys):])
    if held:
        yield at, list(zip(*held, strict=True))


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _possible_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of buckets -> links (a, b) of rows that may be similar."""
    for (_, _, p, q), (node, part, data) in _cell_groups(batches, ["i", "v", "p", "q"], ["node", "part", "samples"]):
        samples = np.frombuffer(b"".join(data), np.uint32).reshape(-1, SAMPLES)
        forest, a, b = Forest(len(node)), [], []

        def link(i, near):
            for j in near.tolist():
                if forest.join(i, j):  # noqa: B023
                    a.append(node[i])  # noqa: B023
                    b.append(node[j])  # noqa: B023
        if p == q:
            centre, held, n = np.empty(len(node), np.int64), np.empty_like(samples), 0
            for i in range(len(node)):
                agree = (held[:n] == samples[i]).sum(axis=1)
                link(i, centre[:n][agree >= NEAR * SAMPLES])
                if not n or agree.max() < SURE * SAMPLES:
                    centre[n], held[n] = i, samples[i]
                    n += 1
        else:
            home = np.flatnonzero(np.array(part) == p)
            for i in np.flatnonzero(np.array(part) == q).tolist():
                agree = (samples[home] == samples[i]).sum(axis=1)
                link(i, home[agree >= NEAR * SAMPLES])
        yield _pairs(a, b)


def possible_links(members: DataFrame) -> DataFrame:
    """members(node, samples, i, v): buckets of more than one -> links (a, b)."""
    sizes = members.groupBy("i", "v").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    cells = in_cells(members.join(sizes, ["i", "v"]), "parts")
    keys = ["i", "v", "p", "q"]
    return (cells.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "part", "samples")
            .mapInArrow(_possible_batches, "a long, b long"))


def similar_rows(sets: list, home: np.ndarray, guests: np.ndarray, threshold: float):
    """Pairs (i, j), i of ``guests`` and j of ``home``, of sets that are similar
    enough, by the postings of the home sets' shingles; a set that is in both
    meets those before it."""
    keys = np.concatenate([sets[j][0] for j in home.tolist()])
    weights = np.concatenate([sets[j][1] for j in home.tolist()])
    rows = np.repeat(np.arange(len(home)), [len(sets[j][0]) for j in home.tolist()])
    order = np.argsort(keys, kind="stable")
    keys, weights, rows = keys[order], weights[order], rows[order]
    total = np.array([s[1].sum() for s in sets])
    at_home = {j: x for x, j in enumerate(home.tolist())}
    for i in guests.tolist():
        k, w = sets[i]
        lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        before = at_home.get(i, len(home))
        common = np.bincount(rows[at], np.minimum(weights[at], np.repeat(w, n)), len(home))[:before]
        union = total[i] + total[home[:before]] - common
        near = np.flatnonzero((common > 0) & (common >= threshold * union * (1 - 1e-12)))
        if len(near):
            yield i, home[near]


def _exact_batches(idf: np.ndarray, threshold: float):
    """Cells of groups -> links (a, b) of texts that are similar."""
    small = idf.astype(np.float32)

    def run(batches):
        words, idf = Words(), small.astype(float)
        for (_, p, q), (node, part, text) in _cell_groups(batches, ["comp", "p", "q"], ["node", "part", "text"]):
            sets = [weighted_shingles(h, idf) for h in words.of(text)]
            forest, a, b = Forest(len(node)), [], []
            home, guests = (np.flatnonzero(np.array(part) == x) for x in (p, q))
            if len(home):
                for i, near in similar_rows(sets, home, guests, threshold):
                    for j in near.tolist():
                        if forest.join(i, j):
                            a.append(node[i])
                            b.append(node[j])
            yield _pairs(a, b)
    return run


def exact_links(docs: DataFrame, groups: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """docs(doc_id, text), groups(node, comp, _key, size) -> links (a, b) that join
    all similar texts of a group.  Texts go through one exchange."""
    groups = materialise(groups)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("size") / PART_BYTES))
    dealt = materialise(groups.drop("size").join(groups.groupBy("comp").agg(parts.alias("parts")), "comp"))
    rows = docs.select("text", row_key("doc_id", "text").alias("_key")).join(
        broadcast_if_small(dealt, dealt.count(), 64, 8 << 20), "_key").drop("_key")
    keys = ["comp", "p", "q"]
    return (in_cells(rows, "parts").repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "part", "text")
            .mapInArrow(_exact_batches(idf, threshold), "a long, b long"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, in the columns of ``docs``."""
    key = fresh(docs, "_key")
    keep = near_classes(docs, threshold).where("keep").select(F.col("_key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(keep, key).dropDuplicates([key]).select(*docs.columns)
