"""Collocations: phrases of two to four words, counted in quotient filters.

Texts become token chunks (``CHUNK`` tokens of one language at most, as
numbers of the chunk's own words, 0 between pieces).  Words counted
``min_count`` times or more get dense ids, unique over (lang, word), so an id
stands for its language too; all others are 0 from then on, as no phrase with
them can be counted often enough.

An n-gram is packed from its word ids into two halves of w bits (w: the bits
of an id for two words, twice that for three and four).  A Feistel network
permutes the 2w bits; it is invertible whatever its rounds do, so the key
*is* the n-gram and counts are lossless.  A counting quotient filter keeps
sorted keys as quotient and full remainder: one bit a quotient that occurs,
one bit an entry that ends its quotient's run, the remainder's bytes, and a
byte of count (larger counts beside it).  The top bits of a key name its
range; each chunk leaves one small filter a range, and the filters of a range
are merged in one task.  As keys are permuted, ranges are even whatever words
are frequent: the most frequent phrase is one entry a chunk.

Level by level (2, 3, 4 words): merged filters keep the n-grams counted often
enough, and tell each chunk which of its own entries these are (a bit each);
only where both shorter n-grams are frequent is the next one counted.  So the
tables are exact for every phrase counted ``min_count`` times or more.

``collocations`` scores each candidate by its lowest-scoring cut with exact
decimal arithmetic, drops those inside a longer one that holds 80% of their
occurrences, and ranks per language.

Defined cases: a null lang is ``und`` (with texts that say so); null and empty
texts have no words; repeated rows count each time; a text without breaks is
read in windows cut at blanks, whole; an empty table gives an empty result;
extra columns are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsift.llm.common import materialise

MIN_COUNT = 30         # fixed value of the candidates
LONGEST = 4            # words of a phrase
INSIDE_PCT = 80        # fixed value: occurrences inside a longer phrase that drop a candidate
CHUNK = 1 << 21        # tokens a task gathers before it writes its chunks
WINDOW = 1 << 22       # bytes of a text that are split at once
RANGE = 1 << 20        # entries of a range at most, on average

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEYS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
_ODD = np.uint64(0xFF51AFD7ED558CCD)


# -- chunks of tokens ---------------------------------------------------------

class Numbers(dict):
    """Word -> its number in the chunk, from 1; 0 is the break between pieces."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokens(text: bytes, numbers: Numbers) -> Iterator[np.ndarray]:
    """The numbers of a text's words, with 0 at breaks, window by window."""
    data = text.translate(_TABLE).replace(b".", b" . ")
    at = 0
    while at < len(data):
        end = len(data) if at + WINDOW >= len(data) else data.rfind(b" ", at, at + WINDOW)
        if end <= at:  # one word is longer than the window
            end = data.find(b" ", at + WINDOW)
            end = len(data) if end < 0 else end
        words = data[at:end].split()
        yield np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
        at = end + 1


_CHUNK_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                           ("ids", pa.binary())])


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[str, tuple[Numbers, list]] = {}
    held = 0

    def flush():
        for lang, (numbers, parts) in chunks.items():
            ids = np.concatenate(parts)
            count = np.bincount(ids, minlength=len(numbers))
            yield pa.RecordBatch.from_pylist([{
                "lang": lang, "words": [w.decode() for w in numbers if numbers[w]], "counts": count[1:],
                "ids": ids.tobytes()}], schema=_CHUNK_SCHEMA)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            if not text.is_valid:
                continue
            numbers, parts = chunks.setdefault(lang, (Numbers(), []))
            for ids in tokens(text.as_buffer().to_pybytes(), numbers):
                parts.append(ids)
                held += len(ids)
            parts.append(np.zeros(1, np.uint32))
            if held >= CHUNK:
                yield from flush()
                chunks, held = {}, 0
    yield from flush()


def _id_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk numbers -> vocabulary ids (0: a break, or a word that is not frequent)."""
    for b in batches:
        for shard, ids, pairs in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), b.column("pairs"), strict=True):
            ids = np.frombuffer(ids, np.uint32)
            of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
            pairs = pairs.values.to_numpy(zero_copy_only=False)
            of[pairs >> 32] = pairs & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([of[ids].tobytes()], pa.binary())],
                                             names=["shard", "ids"])


# -- packed n-grams -----------------------------------------------------------

def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (x ^ np.uint64(key)) * _ODD
    x ^= x >> np.uint64(33)
    x *= _ODD
    return (x ^ x >> np.uint64(29)) & mask


def permute(left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of pairs of w-bit numbers."""
    mask = np.uint64((1 << w) - 1)
    for key in _KEYS:
        left, right = right, left ^ _round(right, key, mask)
    return left, right


def unpermute(left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << w) - 1)
    for key in reversed(_KEYS):
        left, right = right ^ _round(left, key, mask), left
    return left, right


def width(n: int, bits: int) -> int:
    """Bits of a half of an n-gram."""
    return bits if n == 2 else 2 * bits


def halves(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that begin at these places."""
    word = [ids[at + i].astype(np.uint64) for i in range(n)]
    b = np.uint64(bits)
    if n == 2:
        return word[0], word[1]
    return word[0] << b | word[1], word[2] if n == 3 else word[2] << b | word[3]


def unhalve(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(entries, n) word ids."""
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    words = {2: lambda: [left, right], 3: lambda: [left >> b, left & mask, right],
             4: lambda: [left >> b, left & mask, right >> b, right & mask]}[n]()
    return np.stack(words, axis=1).astype(np.int64)


def distinct(left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the pairs, and for the sorted pairs whether each is the
    first of its value: (order, first, sorted left, sorted right)."""
    if 2 * w <= 64:
        order = np.argsort(left << np.uint64(w) | right, kind="stable")  # sorted runs are merged
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    return order, first, left, right


# -- counting quotient filters ------------------------------------------------

def _to_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_bytes(data: bytes, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(count, n)
    return out.view("<u8").ravel()


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, w: int, rbits: int) -> bytes:
    """The filter of sorted distinct keys of one range (the top rbits of left)."""
    n, rest = len(left), w - rbits
    q = min(rest, max(0, n.bit_length() - 1))
    low = np.uint64(rest - q)
    tail = left & np.uint64((1 << rest) - 1)
    quotient = (tail >> low).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    large = np.flatnonzero(counts >= 255)
    slot = np.minimum(counts, 255).astype(np.uint8)
    parts = [np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
             _to_bytes(tail & ((np.uint64(1) << low) - np.uint64(1)), (rest - q + 7) // 8),
             _to_bytes(right, (w + 7) // 8), slot.tobytes(), counts[large].astype("<u8").tobytes()]
    head = struct.pack("<IBBBQ", n, w, rbits, q, int(left[0] >> np.uint64(rest)) if rbits else 0)
    return head + b"".join(parts)


_HEAD = struct.calcsize("<IBBBQ")


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """left, right, counts and w of a filter."""
    n, w, rbits, q, top = struct.unpack_from("<IBBBQ", data)
    rest = w - rbits
    sizes = [((1 << q) + 7) // 8, (n + 7) // 8, n * ((rest - q + 7) // 8), n * ((w + 7) // 8), n]
    ends = (_HEAD + np.cumsum([0, *sizes])).tolist()
    part = [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(part[0], np.uint8), count=1 << q))
    run_end = np.unpackbits(np.frombuffer(part[1], np.uint8), count=n).astype(np.int64)
    quotient = occupied[np.cumsum(run_end) - run_end].astype(np.uint64)
    left = quotient << np.uint64(rest - q) | _from_bytes(part[2], n, (rest - q + 7) // 8)
    left |= np.uint64(top << rest)
    counts = np.frombuffer(part[4], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[ends[-1]:], "<u8")
    return left, _from_bytes(part[3], n, (w + 7) // 8), counts, w


# -- counting, level by level -------------------------------------------------

class Places:
    """Where a chunk's n-grams begin whose shorter n-grams are all frequent."""

    def __init__(self, ids: np.ndarray, bits: int, rbits: int):
        self.ids, self.bits, self.rbits, self.n = ids, bits, rbits, 1
        self.frequent = ids > 0

    def count(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """One word more: (range, left, right, counts) of the distinct n-grams, range by range."""
        self.n += 1
        self.at = np.flatnonzero(self.frequent[:-1] & self.frequent[1:])
        w = width(self.n, self.bits)
        left, right = permute(*halves(self.ids, self.at, self.n, self.bits), w)
        order, first, left, right = distinct(left, right, w)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        left, right, counts = left[start], right[start], np.diff(start, append=len(order))
        top = left >> np.uint64(w - min(self.rbits, w))
        self.cuts = np.flatnonzero(np.r_[True, top[1:] != top[:-1], True]) if len(top) else np.zeros(1, np.int64)
        for i, j in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield int(top[i]), left[i:j], right[i:j], counts[i:j]

    def mark(self, bits_of_ranges: list[bytes]) -> None:
        """Which entries are frequent, range by range."""
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
                 for b, n in zip(bits_of_ranges, np.diff(self.cuts).tolist(), strict=True)]
        self.frequent = np.zeros(len(self.frequent) - 1, bool)
        if flags:
            self.frequent[self.at] = np.concatenate(flags)[self.entry]


def _filter_batches(n: int, bits: int, rbits: int):
    """Chunks with the marks of the shorter n-grams -> shard, range, filter."""
    def run(batches):
        w = width(n, bits)
        for b in batches:
            marks = [b.column(f"marks{m}") for m in range(2, n)]
            for i, (shard, ids) in enumerate(zip(b.column("shard").to_pylist(), b.column("ids"), strict=True)):
                ids = np.frombuffer(ids.as_buffer(), np.uint32)
                places = Places(ids, bits, rbits)
                for m in marks:
                    for _ in places.count():
                        pass
                    places.mark([x["bits"] for x in sorted(m[i].as_py() or [], key=lambda x: x["range"])])
                found = [(r, encode(left, right, c, w, min(rbits, w))) for r, left, right, c in places.count()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.binary())], names=["shard", "range", "filter"])
    return run


def _merge_batches(min_count: int, rbits: int):
    """Filters sorted by range -> range, shard, data: the merged filter of
    frequent n-grams (shard null), and each shard's marks."""
    schema = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])

    def merged(at, rows):
        parts = [decode(f) for _, f in rows]
        w = parts[0][3]
        left, right, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order, first, left, right = distinct(left, right, w)
        start = np.flatnonzero(first)
        total = np.add.reduceat(counts[order], start)
        often = total >= min_count
        flag = np.empty(len(order), bool)
        flag[order] = often[np.cumsum(first) - 1]
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        out = [(at, shard, np.packbits(f).tobytes()) for (shard, _), f in zip(rows, np.split(flag, ends), strict=True)]
        if often.any():
            keep = start[often]
            out.append((at, None, encode(left[keep], right[keep], total[often], w, min(rbits, w))))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    def run(batches):
        at, rows = None, []
        for b in batches:
            for r, shard, f in zip(*(b.column(c).to_pylist() for c in ("range", "shard", "filter")), strict=True):
                if r != at and rows:
                    yield merged(at, rows)
                    rows = []
                at = r
                rows.append((shard, f))
        if rows:
            yield merged(at, rows)
    return run


def _phrase_batches(n: int, bits: int):
    def run(batches):
        for b in batches:
            for f in b.column("data").to_pylist():
                left, right, counts, w = decode(f)
                ids = unhalve(*unpermute(left, right, w), n, bits)
                offsets = np.arange(0, ids.size + 1, n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel())),
                                                  pa.array(counts)], names=["ids", "f"])
    return run


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Numbers from 1 without gaps; one row a partition goes to the driver."""
    df = materialise(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    base, at = [], 1
    for p, n in sizes:
        base.append((p, at))
        at += n
    starts = df.sparkSession.createDataFrame(base, "_p long, _base long")
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(df.join(F.broadcast(starts), part == F.col("_p"))
                       .withColumn(name, F.col("_base") + row).drop("_at", "_p", "_base"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(text, lang) -> phrases(ids, f) of one to LONGEST words counted
    min_count times or more, words(lang, word, id, f) of those, and
    sizes(lang, n) with all words of a language."""
    spark = docs.sparkSession
    chunks = materialise(
        docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_chunk_batches, "lang string, words array<string>, counts array<long>, ids binary")
        .withColumn("shard", F.monotonically_increasing_id()))
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = materialise(chunks.groupBy("lang").agg(F.sum(count).alias("n")))
    each = chunks.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
    words = dense_ids(each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
                      .where(F.col("f") >= min_count), "id")
    bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    pair = F.shiftleft((F.col("i") + 1).cast("long"), 32).bitwiseOR(F.col("id")).alias("pair")
    pairs = (each.select("shard", "lang", "i", F.col("w.words").alias("word")).join(words.select("lang", "word", "id"), ["lang", "word"])
             .select("shard", pair).groupBy("shard").agg(F.collect_list("pair").alias("pairs")))
    shards = materialise(chunks.select("shard", "ids").join(pairs, "shard").mapInArrow(_id_batches, "shard long, ids binary"))
    total = shards.agg(F.sum(F.length("ids")).alias("n")).first()["n"] or 0
    rbits = max(4, (total // 4 // RANGE).bit_length())

    phrases = words.select(F.array("id").alias("ids"), "f")
    for n in range(2, LONGEST + 1):
        filters = shards.mapInArrow(_filter_batches(n, bits, rbits), "shard long, range long, filter binary")
        merged = materialise(filters.repartition("range").sortWithinPartitions("range", "shard")
                             .mapInArrow(_merge_batches(min_count, rbits), "range long, shard long, data binary"))
        phrases = phrases.unionByName(merged.where("shard is null").mapInArrow(_phrase_batches(n, bits), "ids array<long>, f long"))
        if n < LONGEST:
            marks = (merged.where("shard is not null").groupBy("shard")
                     .agg(F.collect_list(F.struct("range", F.col("data").alias("bits"))).alias(f"marks{n}")))
            shards = shards.join(marks, "shard")  # a chunk without n-grams has no longer ones
    return materialise(phrases), words, sizes


def collocations(docs: DataFrame, top: int = 2000, min_count: int = MIN_COUNT) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: the best
    ``top`` phrases of each language."""
    phrases, words, sizes = phrase_counts(docs, min_count)
    cand = phrases.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"))
    f = lambda key, value: phrases.select(F.col("ids").alias(key), F.col("f").alias(value))
    size = F.size("ids")
    cut = cand.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
                     F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    cut = cut.join(f("left", "l"), "left").join(f("right", "r"), "right")
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div"
                   " (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    lowest = (cut.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
              .select("ids", "a", "x.score", "x.l", "x.r"))
    # the most frequent longer candidate that holds a phrase
    part = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m)))))
    longer = (cand.where(size > 2).select(part.alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    inside = F.lit(100) * wide("longer") >= F.lit(INSIDE_PCT) * wide("a")
    left = lowest.join(longer, "ids", "left").where(F.col("longer").isNull() | ~inside).drop("longer")
    left = left.join(words.select(F.col("id").alias("_id"), "lang"), F.col("ids")[0] == F.col("_id")).drop("_id")
    # spell only what can be in the result: all ties of the last place included
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    left = materialise(left.withColumn("place", F.rank().over(w)).where(F.col("place") <= top))
    spelt = (left.select("ids", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id")
             .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
             .select("ids", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = left.join(spelt, "ids").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
