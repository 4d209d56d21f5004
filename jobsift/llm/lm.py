"""Log-bilinear language model, trained with noise-contrastive estimation.

Words are what ``bytes.split`` gives, A-Z lower-cased; every text ends with
one end token, written as the empty word.  ``count_tokens`` counts all
training tokens (partial counts per task, summed by Spark).  The model's
classes are the ``CLASSES - 1`` most counted words and one class for all
others; a word of that class has its smoothed share of the class's tokens, so
that probabilities add up to 1 over the known words and one unknown word.

The log-bilinear part predicts class w from the two words before:
``s = o_w . (c1 * r_1 + c2 * r_2) + b_w``.  Each task trains on all of its
training documents with shared noise words per minibatch, from the same
start; the models are averaged by tokens, row by row, in Spark.  Scoring
takes the distinct contexts of a chunk, multiplies them with all output
vectors in blocks, and normalises exactly.

Words of the head (at most ``HEAD``, by a count threshold) go to the tasks as
a dictionary; all rarer words are joined to their counts by hash, summed per
document before.

Defined cases: null and empty texts have the end token alone; with no
training documents every word is unknown and the model is the unigram base;
repeated rows are documents of their own; null ids count as the empty text
for the fold; an empty table gives an empty result.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import materialise

END = b""
ALPHA = 0.1       # fixed value of the unigram base
HEAD = 1 << 18    # most words in the tasks' dictionary
CLASSES = 1024    # model classes, the last one for all other words
DIM = 24
BATCH = 4096
NOISE = 64        # noise words a minibatch shares
RATE = 0.15
CHUNK = 1 << 20   # tokens scored together
FLUSH = 1 << 19   # distinct words a task holds before it hands counts on


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def word_hash(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


# -- counts -------------------------------------------------------------------

def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c):
        words = list(c)
        return pa.RecordBatch.from_arrays(
            [pa.array([word_hash(w) for w in words], pa.int64()), pa.array(words, pa.binary()),
             pa.array(list(c.values()), pa.int64())], names=["h", "word", "c"])
    counts = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            counts.update(tokens(t))
            if len(counts) > FLUSH:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def count_tokens(docs: DataFrame) -> DataFrame:
    """docs(text) -> h, word, c over all tokens, one end token a text."""
    return (docs.select("text").mapInArrow(_count_batches, "h long, word binary, c long")
            .groupBy("h", "word").agg(F.sum("c").alias("c")))


def head_words(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The most counted words, ``limit`` at most: all words from the least
    count on that still fits (a histogram of count classes tells it)."""
    scale = F.floor(F.log2("c") * 16)
    bins = counts.groupBy(scale.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for b in bins:
        total += b["n"]
        if total > limit:
            break
        least = b["k"]
    if least is None:
        return []
    rows = counts.where(scale >= least).select("word", "c").toPandas()
    rows = rows.sort_values(["c", "word"], ascending=[False, True], kind="stable")
    return list(zip(map(bytes, rows["word"]), rows["c"].tolist(), strict=True))


# -- the model ----------------------------------------------------------------

class LogBilinear:
    """Parameters: r (context vectors, one more for the text's start), o and b
    (output vectors and biases), c1 and c2 (position weights)."""

    def __init__(self, freq: np.ndarray, dim: int = DIM, seed: int = 3):
        k = len(freq)
        rng = np.random.default_rng(seed)
        self.q = (freq + 1.0) / (freq + 1.0).sum()  # noise distribution
        self.r = rng.normal(0, 0.3, (k + 1, dim)).astype(np.float32)
        self.o = np.zeros((k, dim), np.float32)
        self.b = np.log(self.q).astype(np.float32)
        self.c = np.stack([np.full(dim, 1.0), np.full(dim, 0.5)]).astype(np.float32)

    def hidden(self, h1, h2):
        return self.r[h1] * self.c[0] + self.r[h2] * self.c[1]

    def log_probs(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, block: int = 2048) -> np.ndarray:
        """Normalised log p(w | h1, h2): every distinct context once."""
        start = len(self.o) + 1
        ctx, at = np.unique(h1.astype(np.int64) * start + h2, return_inverse=True)
        q = self.hidden(ctx // start, ctx % start)
        log_z = np.empty(len(ctx), np.float32)
        for i in range(0, len(ctx), block):
            s = q[i:i + block] @ self.o.T
            s += self.b
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            log_z[i:i + block] = np.log(s.sum(axis=1)) + top
        out = np.empty(len(w))
        for i in range(0, len(w), 1 << 16):
            j = slice(i, i + (1 << 16))
            out[j] = np.einsum("ij,ij->i", q[at[j]], self.o[w[j]]) + self.b[w[j]] - log_z[at[j]]
        return out


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their summed gradients."""
    order = np.argsort(at.astype(np.uint16) if len(target) <= 1 << 16 else at, kind="stable")  # 16 bits: a radix sort
    keys = at[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, axis=0)


def nce_train(m: LogBilinear, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, acc: dict, rng) -> None:
    """One minibatch of noise-contrastive estimation, AdaGrad steps."""
    k = NOISE
    noise = rng.choice(len(m.q), k, p=m.q)
    r1, r2, ow, on = m.r[h1], m.r[h2], m.o[w], m.o[noise]
    q = r1 * m.c[0] + r2 * m.c[1]
    log_kq = np.log(k * m.q)
    true = np.einsum("ij,ij->i", q, ow) + m.b[w] - log_kq[w]
    false = q @ on.T + m.b[noise] - log_kq[noise]
    g_true = (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
    g_false = (-1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32)
    dq = g_true[:, None] * ow + g_false @ on
    at, go = _add_rows(m.o, np.r_[w, noise], np.r_[g_true[:, None] * q, g_false.T @ q])
    _, gb = _add_rows(m.b, np.r_[w, noise], np.r_[g_true, g_false.sum(axis=0)][:, None])
    ar, gr = _add_rows(m.r, np.r_[h1, h2], np.r_[dq * m.c[0], dq * m.c[1]])
    gc = np.stack([(dq * r1).sum(axis=0), (dq * r2).sum(axis=0)])
    for name, rows, g in (("o", at, go), ("b", at, gb[:, 0]), ("r", ar, gr), ("c", slice(None), gc)):
        p, a = getattr(m, name), acc[name]
        a[rows] += g * g
        p[rows] += RATE * g / np.sqrt(a[rows])


def _contexts(ids: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The one and two ids before each, ``begin`` before a text's start."""
    h1, h2 = np.roll(ids, 1), np.roll(ids, 2)
    h1[starts] = begin
    h2[starts] = begin
    second = starts + 1
    second = second[second < len(ids)]
    second = np.setdiff1d(second, starts)
    h2[second] = begin
    return h1, h2


def _chunks(texts, size: int):
    """Ids of whole texts, concatenated to chunks of about ``size`` tokens, and
    their starts; a long text is its own chunk."""
    parts, starts, n = [], [], 0
    for ids in texts:
        parts.append(ids)
        starts.append(n)
        n += len(ids)
        if n >= size:
            yield np.concatenate(parts), np.array(starts)
            parts, starts, n = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(starts)


def _id_chunks(texts, ids: dict[bytes, int], other: int, size: int):
    """``_chunks`` of the texts' class ids."""
    return _chunks((np.fromiter(map(ids.get, ws, repeat(other)), np.int64, len(ws)) for ws in map(tokens, texts)), size)


def train(docs: DataFrame, head: list[tuple[bytes, int]], total: int) -> LogBilinear:
    """docs(text): all training texts -> the tasks' models, averaged."""
    words = head[:CLASSES - 1]
    freq = np.array([c for _, c in words] + [max(0, total - sum(c for _, c in words))], float)
    ids, other = {w: i for i, (w, _) in enumerate(words)}, len(words)

    def run(batches):
        m, rng, seen = LogBilinear(freq), None, 0
        acc = {n: np.full(getattr(m, n).shape, 1.0, np.float32) for n in "orbc"}
        for b in batches:
            for chunk, starts in _id_chunks(b.column("text").to_pylist(), ids, other, 1 << 18):
                rng = rng or np.random.default_rng(int(chunk[:64].sum()) + len(chunk))
                h1, h2 = _contexts(chunk, starts, other + 1)
                order = rng.permutation(len(chunk))
                for i in range(0, len(order), BATCH):
                    j = order[i:i + BATCH]
                    nce_train(m, h1[j], h2[j], chunk[j], acc, rng)
                seen += len(chunk)
        if seen:
            # one row for each class: n * parameters, to be summed
            pad = lambda x: np.vstack([x, np.zeros((len(m.r) - len(x), x.shape[1]))])
            table = np.hstack([m.r, pad(m.o), pad(m.b[:, None]), pad(m.c)]) * float(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(table))), pa.array(np.full(len(table), seen)),
                 *[pa.array(np.ascontiguousarray(table[:, j])) for j in range(table.shape[1])]],
                names=["at", "n", *[f"v{j}" for j in range(table.shape[1])]])

    width = 3 * DIM + 1
    schema = "at long, n long, " + ", ".join(f"v{j} double" for j in range(width))
    sums = (docs.select("text").mapInArrow(run, schema).groupBy("at")
            .agg(F.sum("n").alias("n"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)])
            .toPandas().sort_values("at"))  # CLASSES + 1 rows
    m = LogBilinear(freq)
    if len(sums):
        v = sums[[f"v{j}" for j in range(width)]].to_numpy() / sums[["n"]].to_numpy()
        k = len(freq)
        m.r, m.o = v[:, :DIM].astype(np.float32), v[:k, DIM:2 * DIM].astype(np.float32)
        m.b, m.c = v[:k, 2 * DIM].astype(np.float32), v[:2, 2 * DIM + 1:].astype(np.float32)
    return m


# -- scores -------------------------------------------------------------------

def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), training(text) -> doc_id, the other columns of
    docs but text, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    counts = materialise(count_tokens(training))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    head = head_words(counts, HEAD)
    model = train(training, head, total)
    words = head[:CLASSES - 1]
    other = len(words)
    in_classes = sum(c for _, c in words)
    # log10 of a word's share: of all tokens (base), of its class (the others)
    base_z = np.log10(total + ALPHA * (distinct + 1))
    other_z = np.log10(total - in_classes + ALPHA * (distinct - other + 1))
    at = {w: i for i, (w, _) in enumerate(head)}
    log_c = np.log10(np.array([c for _, c in head], float) + ALPHA)
    keep = [c for c in docs.columns if c not in ("text", "_row")]

    def run(batches):
        for b in batches:
            rows = {n: [] for n in ("n_tokens", "n_head", "base", "model", "n_other", "tail", "tf")}
            scores = []

            def classes(texts):
                """Class ids of each text: its tokens are looked up once, for the rows and the model."""
                for text in texts:
                    ws = tokens(text)
                    ids = np.fromiter(map(at.get, ws, repeat(-1)), np.int64, len(ws))
                    rare = np.flatnonzero(ids < 0).tolist()
                    tail = Counter(ws[k] for k in rare)
                    known = ids[ids >= 0] if rare else ids
                    outside = known[known >= other]
                    rows["n_tokens"].append(len(ws))
                    rows["n_head"].append(len(known))
                    rows["base"].append(log_c[known].sum())
                    rows["model"].append(log_c[outside].sum())  # the class's share, without its sum
                    rows["n_other"].append(len(outside) + len(rare))
                    rows["tail"].append([word_hash(w) for w in tail])
                    rows["tf"].append(list(tail.values()))
                    yield np.where((ids < 0) | (ids > other), other, ids)  # the head's first words are the classes

            for chunk, starts in _chunks(classes(b.column("text").to_pylist()), CHUNK):
                h1, h2 = _contexts(chunk, starts, other + 1)
                scores.append(np.add.reduceat(model.log_probs(h1, h2, chunk), starts) / np.log(10))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["n_head"], pa.int64()),
                 pa.array(rows["base"], pa.float64()), pa.array(score + np.array(rows["model"], float), pa.float64()),
                 pa.array(rows["n_other"], pa.int64()), pa.array(rows["tail"], pa.list_(pa.int64())),
                 pa.array(rows["tf"], pa.list_(pa.int64()))],
                names=[*keep, "n_tokens", "n_head", "base", "model", "n_other", "tail", "tf"])

    types = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "n_tokens long, n_head long, base double, model double, "
                        "n_other long, tail array<long>, tf array<long>"])
    parts = materialise(docs.select(*keep, "text").mapInArrow(run, schema)
                        .withColumn("_row", F.monotonically_increasing_id()))
    tail = parts.select("_row", F.explode(F.arrays_zip("tail", "tf")).alias("x")).select(
        "_row", F.col("x.tail").alias("h"), F.col("x.tf").alias("tf"))
    found = (tail.join(counts.select("h", "c"), "h", "left").groupBy("_row")
             .agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"),
                  F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("tail_log")))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return parts.drop("tail", "tf").join(found, "_row", "left").select(
        *keep, "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * float(base_z)).alias("base_score"),
        (F.col("model") + tail_log - F.col("n_other") * float(other_z)).alias("score"))
