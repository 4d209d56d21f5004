"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (blank-separated, A-Z lower-cased); every
line with a word takes part.  Two lines match
if the Jaccard similarity of their sets is ``THRESHOLD`` or more, and a line
is removed if it matches any earlier line (order: doc_id, nulls last, then
line number).

1. Words are counted over all texts; the most counted (``HEAD`` at most) are
   ranked by count, all rarer ones come before them by hash: one fixed order,
   rare words first.  (Any fixed order gives the same matches; counts under
   TASK_COUNT in a task are left out, which may only cost some rarity.)
2. A set is named by its hash; its first occurrence comes from a narrow
   aggregate, and each task gives its words once.
   A set that can match only equal ones (up to three words at 0.8) goes no
   further.
3. Two sets that match share one of the first n - ceil(t n) + 1 words.  The
   rows (prefix word, set) are grouped by word; pairs must pass the length
   filter, the positional filter (words left behind the shared one) and a
   bound on the overlap by bitmaps of 64 bits, the parities of the words that
   fall on each; none of them loses a match.  The rows are dealt to parts by
   word and go there in blocks, a part's rows of a batch each.
4. What is left is compared by bitmaps that grow with the sets (``BITS`` a
   word at least), the same bound without loss; the words go only with the
   pairs that pass, which are verified by exact Jaccard on the whole sets.

A set needs one earlier match, not all: in a group of more than
``GROUP`` sets (many variants of one line) every set first meets the group's
earliest, and only sets that found no match anywhere go on to the others.

Defined cases: null and empty texts have no lines to remove; repeated rows
are later documents (all their lines match); ties in order (equal doc_ids) are
broken by the row; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import WORD, broadcast_if_small, fresh, materialise, row_key
from jobsift.llm.quality import WordHash, sketch

MIN_TOKENS = 1  # every line with a word
THRESHOLD = 0.8
HEAD = 1 << 18
TASK_COUNT = 4  # a word that a task counts less often cannot matter to the ranks
GROUP = 256
LISTED = 1 << 16  # codes of large groups, up to which each task holds them
BITS = 2  # bits a word in the bitmaps of the second comparison
SKETCHED = 64  # least shingle hashes of a sketch, their upper 32 bits
COPY_AT = 0.7  # similarity of a copy by sketches, whose error is about 0.05
CHUNK = 1 << 20  # words handled together (whole texts)
PART = 1 << 18  # prefix rows grouped together, about (whole groups)

_TOP = np.uint64(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of 8 bytes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed_words(lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lines joined by line feeds -> (words of each line, 63-bit hash of every word).
    A word of 64 bytes or less is mixed in steps of 8, all words at once."""
    data = b"\n" + lines + b"\n" + bytes(8)
    a = np.frombuffer(data, np.uint8)[:-8]
    blank = (a == 32) | (a - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    h = _mixed((eights[start] & _LOW[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD))
    at = np.flatnonzero(size > 8)
    for k in range(8, 64, 8):
        if not len(at):
            break
        h[at] = _mixed(h[at] ^ _mixed(eights[start[at] + k] & _LOW[np.minimum(size[at] - k, 8)]) + _ODD)
        at = at[size[at] > k + 8]
    for i in at.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:start[i] + size[i]])
    return np.diff(np.searchsorted(start, np.flatnonzero(a == 10))), h >> np.uint64(1)


def _hash(w: bytes) -> int:
    return int(hashed_words(w)[1][0])


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """(batch, number of the first row, whole texts) of about CHUNK words."""
    for b in batches:
        first, texts, size = 0, [], 0
        for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= 6 * CHUNK:
                yield b, first, texts
                first, texts, size = i + 1, [], 0
        if texts:
            yield b, first, texts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(h, c):
        some = c >= TASK_COUNT
        return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(c[some])], names=["h", "c"])

    def merged(held):
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, c = h[order], c[order]
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[begin], np.add.reduceat(c, begin)

    held, size = [], 0
    for _, _, texts in _text_chunks(batches):
        h = hashed_words(b"\n".join(texts).lower())[1]
        h.sort()
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        if len(begin):
            held.append((h[begin], np.diff(np.r_[begin, len(h)])))
            size += len(begin)
        if size > 1 << 20:
            held = [merged(held)]
            size = len(held[0][0])
            if size > 1 << 19:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*merged(held))


def word_ranks(docs: DataFrame) -> dict[int, int]:
    """Hash -> rank of the most counted words, the most frequent last."""
    counts = materialise(docs.select("text").mapInArrow(_count_batches, "h long, c long")
                         .groupBy("h").agg(F.sum("c").alias("c")))
    scale = F.floor(F.log2("c") * 16)
    total, least = 0, None
    for b in counts.groupBy(scale.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect():
        total += b["n"]
        if total > HEAD:
            break
        least = b["k"]
    if least is None:
        return {}
    rows = counts.where(scale >= least).toPandas().sort_values(["c", "h"], kind="stable")
    return {h: i for i, h in enumerate(rows["h"].tolist())}


def prefix_length(n: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def only_equal(n: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    """Whether sets of n words match no set but an equal one."""
    return (np.ceil(t * n - 1e-9) >= n) & (np.floor(n / t + 1e-9) <= n)


def least_overlap(n: np.ndarray, m: np.ndarray, t: float = THRESHOLD) -> np.ndarray:
    """Words that sets of n and m words must share."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def pack(code: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Codes of sets of n words each, sorted: rare words (hashes) as 8 bytes,
    then ranks as 4."""
    rare = code < _TOP
    before = np.r_[0, np.cumsum(rare)]
    ends = np.cumsum(n)
    lo, hi = before[ends - n], before[ends]      # rare words before each set's start and end
    a, b = code[rare].tobytes(), (code[~rare] - _TOP).astype(np.uint32).tobytes()
    return [a[8 * x:8 * y] + b[4 * (e - k - x):4 * (e - y)]
            for x, y, e, k in zip(lo.tolist(), hi.tolist(), ends.tolist(), n.tolist(), strict=True)]


def unpack_prefixes(words: list[bytes], n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, position, code) of the first p words of each packed set."""
    size = np.array([len(w) // 4 for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint32)
    start = np.cumsum(size) - size
    rare = size - n                              # 8 bytes: one quarter word more than its one
    at = np.repeat(np.arange(len(words)), p)
    k = np.arange(len(at)) - np.repeat(np.cumsum(p) - p, p)
    is_rare = k < rare[at]
    i = np.where(is_rare, start[at] + 2 * k, start[at] + rare[at] + k)
    low = flat[i].astype(np.uint64)
    high = flat[np.minimum(i + 1, len(flat) - 1)].astype(np.uint64) << np.uint64(32)
    return at, k, np.where(is_rare, low | high, low + _TOP)


def shared_words(x: bytes, y: bytes, n: int, m: int) -> int:
    """Words that two packed sets share."""
    a, b = len(x) - 4 * n, len(y) - 4 * m        # 4 bytes for each rare word
    rare = set(memoryview(x)[:2 * a].cast("q")).intersection(memoryview(y)[:2 * b].cast("q"))
    return len(rare) + len(set(memoryview(x)[2 * a:].cast("I")).intersection(memoryview(y)[2 * b:].cast("I")))


class Codes:
    """Hashes of words -> their codes: the rank of a ranked word, else the hash."""

    def __init__(self, ranks: dict[int, int]):
        hashes = np.fromiter(ranks, np.uint64, len(ranks))
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], np.fromiter(ranks.values(), np.uint64, len(ranks))[order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at] + _TOP, h)


def distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(h, return_inverse=True), by one sort of upper bits and places."""
    low = np.uint64(len(h).bit_length())
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    at = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = h[at]
    if (found[1:] < found[:-1]).any():  # hashes that differ only below
        return np.unique(h, return_inverse=True)
    new = np.ones(len(h), bool)
    new[1:] = found[1:] != found[:-1]
    of = np.empty(len(h), np.int64)
    of[at] = np.cumsum(new) - 1
    return found[new], of


def set_codes(size: np.ndarray, h: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines of ``size`` words -> (words of each line,
    codes): the distinct words of every line, rare first."""
    distinct, at = distinct_hashes(h)
    code = codes(distinct)
    order = np.argsort(code)
    rank = np.empty(len(code), np.int64)
    rank[order] = np.arange(len(code))
    both = (np.repeat(np.arange(len(size)), size) << 32) | rank[at]
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return np.bincount(both >> 32, minlength=len(size)), code[order][both & 0xFFFFFFFF]


def line_codes(lines: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """``set_codes`` of lines given by their words."""
    return set_codes(*hashed_words(b"\n".join(map(b" ".join, lines))), codes)


def _set_batches(codes: Codes):
    names = ["doc_id", "_key", "_row", "line", "set", "n", "bits", "words"]

    def out(b, first, texts):
        size, h = hashed_words(b"\n".join(texts).lower())
        held = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        lines = np.arange(len(size)) - np.repeat(np.cumsum(held) - held, held)
        rows = np.repeat(np.arange(first, first + len(texts)), held)
        n, code = set_codes(size, h, codes)
        take = n >= MIN_TOKENS
        code, n, rows, lines = code[np.repeat(take, n)], n[take], rows[take], lines[take]
        starts = np.cumsum(n) - n
        mixed = _mixed(code)
        some = len(n) > 0
        ids = np.add.reduceat(mixed, starts) if some else np.zeros(0, np.uint64)
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), starts) if some else ids
        doc = b.column("doc_id").take(pa.array(rows))
        ids_of = b.column("doc_id").to_pylist()  # in the order of documents: nulls last
        place = np.empty(len(ids_of), np.int64)
        place[sorted(range(len(ids_of)), key=lambda i: (ids_of[i] is None, ids_of[i]))] = np.arange(len(ids_of))
        order = np.lexsort((lines, place[rows]))
        new = np.zeros(len(n), bool)
        new[order[np.unique(ids[order], return_index=True)[1]]] = True
        packed = np.full(len(n), None, object)
        packed[new] = pack(code[np.repeat(new, n)], n[new])
        return pa.RecordBatch.from_arrays(
            [doc, *[b.column(c).take(pa.array(rows)) for c in ("_key", "_row")], pa.array(lines.astype(np.int32)),
             pa.array(ids.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(bits.view(np.int64)),
             pa.array(packed, pa.binary())], names=names)

    def run(batches):
        for chunk in _text_chunks(batches):
            yield out(*chunk)
    return run


def _pair_batches(t: float, group: int):
    """Blocks of prefix rows, sorted by part -> candidate pairs (a, b); rows of large
    groups that met only the earliest: (null, b)."""
    share = t / (1 + t)

    def near(n, rest, bits, i, j):
        """Of pairs of rows, those that pass the positional filter and the bitmaps."""
        both = n[i] + n[j]
        least = share * both - 1e-9
        ok = np.flatnonzero((rest[i] >= least) & (rest[j] >= least))
        i, j = i[ok], j[ok]
        ok = (both[ok] - np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64))) // 2 >= least[ok]
        return i[ok], j[ok]

    def pairs_of(code, set_, n, k, bits, place):
        rest, found = n - k, []
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[begin, len(code)])
        start = np.repeat(begin, size)
        large = np.repeat(size > group, size)
        lone = np.zeros(len(code), bool)
        for x, y in zip(begin[size > group].tolist(), (begin + size)[size > group].tolist(), strict=True):
            at = x + np.lexsort((set_[x:y], place[x:y]))[0]  # the earliest of a large group meets the others
            lone[x:y] = True
            lone[at] = False
            i = x + np.flatnonzero(np.minimum(n[x:y], n[at]) >= t * np.maximum(n[x:y], n[at]) - 1e-9)
            found.append(near(n, rest, bits, np.full(len(i), at), i))
        i = np.flatnonzero(~large)
        d = 1
        while len(i):  # of a small group, all pairs that pass: the d-th row before, as long as it is not too short
            i = i[i - d >= start[i]]
            i = i[n[i - d] >= t * n[i] - 1e-9]
            found.append(near(n, rest, bits, i - d, i))
            d += 1
        a, b = (set_[np.concatenate([f[x] for f in found] or [begin[:0]])] for x in (0, 1))
        a, b = a[a != b], b[a != b]
        deferred, codes = set_[lone], code[lone]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[a, np.zeros(len(deferred), np.int64)], mask=np.r_[np.zeros(len(a), bool), np.ones(len(deferred), bool)]),
             pa.array(np.r_[b, deferred]),
             pa.array(np.r_[np.zeros(len(a), np.int64), codes])], names=["a", "b", "code"])

    def run(batches):
        of, held = None, []

        def pairs():
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((rows[2], rows[0]))
            return pairs_of(*[x[order] for x in rows])
        for b in batches:
            for part, blob, size in zip(*(b.column(c).to_pylist() for c in ("part", "rows", "size")), strict=True):
                if held and part != of:
                    yield pairs()
                    held = []
                of = part
                held.append(from_planes(blob, size))
        if held:
            yield pairs()
    return run


def bitmaps(words: list[bytes], n: np.ndarray) -> list[bytes]:
    """A bitmap of each packed set, of a power of two of bits (64 at least), a bit
    set if an odd number of words fall on it: two sets whose maps differ in d bits
    differ in d words at least."""
    out, n = [], np.asarray(n, np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // CHUNK)) + 1, len(n)] if len(n) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at, _, code = unpack_prefixes(words[i:j], n[i:j], n[i:j])
        size = 1 << np.maximum(6, np.ceil(np.log2(BITS * n[i:j])).astype(np.int64))
        ends = np.cumsum(size)
        mixed = (code ^ (code >> np.uint64(31))) * _ODD
        place = ((mixed ^ (mixed >> np.uint64(32))) & (size[at] - 1).astype(np.uint64)).astype(np.int64)
        bits = np.bincount((ends - size)[at] + place, minlength=ends[-1]) & 1
        packed = np.packbits(bits.astype(bool), bitorder="little").tobytes()
        out += [packed[a:b] for a, b in zip(((ends - size) // 8).tolist(), (ends // 8).tolist(), strict=True)]
    return out


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """Words that sets of n and m words share at most, by their bitmaps."""
    if len(x) < len(y):
        x, y = y, x
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size = 8 * len(x)
    while size > 8 * len(y):  # the larger one's halves on each other
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (n + m - (a ^ b).bit_count()) // 2


def _bitmap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = bitmaps(b.column("words").to_pylist(), b.column("n").to_numpy())
        yield b.append_column("map", pa.array(found, pa.binary()))


def _near_batches(t: float):
    def run(batches):
        for b in batches:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            most = [most_shared(*p) for p in zip(*(b.column(c).to_pylist() for c in ("ma", "mb")), n.tolist(), m.tolist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.array(most, np.int64) >= least_overlap(n, m, t)))
    return run


def _verify_batches(t: float):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("wa", "wb", "na", "nb")), strict=True):
                common = shared_words(x, y, n, m)
                ok.append(common >= t * (n + m - common) - 1e-9)
            yield batch.select(["b", "f"]).filter(pa.array(ok, pa.bool_()))
    return run


def _prefixes(batches: Iterator[pa.RecordBatch], t: float):
    """(batch of sets that can match others, n, row number, position, code) of their prefix words."""
    for b in batches:
        b = b.filter(pa.array(~only_equal(b.column("n").to_numpy().astype(np.int64), t)))
        if b.num_rows:
            n = b.column("n").to_numpy().astype(np.int64)
            yield b, n, *unpack_prefixes(b.column("words").to_pylist(), n, prefix_length(n, t))


def _prefix_batches(t: float, wanted: np.ndarray | None = None):
    """Prefix rows, of the wanted codes if given (sorted)."""
    def run(batches):
        for b, _, at, k, code in _prefixes(batches, t):
            if wanted is not None:
                some = wanted[np.minimum(np.searchsorted(wanted, code.view(np.int64)), len(wanted) - 1)] == code.view(np.int64)
                at, k, code = at[some], k[some], code[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.view(np.int64)), *[b.column(c).take(pa.array(at)) for c in ("doc_id", "set", "n")],
                 pa.array(k.astype(np.int32)), b.column("bits").take(pa.array(at))],
                names=["code", "doc_id", "set", "n", "k", "bits"])
    return run


_ROW = [np.dtype(x) for x in ("<i8", "<i8", "<u4", "<u4", "<i8", "<i8")]  # code, set, n, k, bits, order


def to_planes(cols: list[np.ndarray]) -> bytes:
    """Columns of prefix rows, first bytes together, then second bytes, ...: a block that compresses."""
    return b"".join(np.ascontiguousarray(c.astype(d).view(np.uint8).reshape(-1, d.itemsize).T).tobytes()
                    for c, d in zip(cols, _ROW, strict=True))


def from_planes(block: bytes, size: int) -> list[np.ndarray]:
    out, at = [], 0
    for d in _ROW:
        planes = np.frombuffer(block, np.uint8, size * d.itemsize, at).reshape(d.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(d).ravel())
        at += size * d.itemsize
    return [x.astype(np.int64) if x.dtype.itemsize == 4 else x for x in out]


def about_order(ids: pa.Array) -> np.ndarray:
    """Numbers that never fall in the order of documents, nulls last; large groups
    begin with the least.  (Ties only cost comparisons.)"""
    kind = ids.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        found = np.array([int.from_bytes((x or "").encode()[:7].ljust(7, b"\0"), "big") for x in ids.to_pylist()], np.int64)
    elif pa.types.is_integer(kind):
        found = np.array(ids.cast(pa.int64()).fill_null(0))
    else:
        found = np.zeros(len(ids), np.int64)
    found[ids.is_null().to_numpy(zero_copy_only=False)] = np.iinfo(np.int64).max
    return found


def _prefix_blocks(t: float, parts: int):
    """Prefix rows dealt by their word to parts; a block holds a part's rows of one batch."""
    def run(batches):
        for b, n, at, k, code in _prefixes(batches, t):
            part = (_mixed(code) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((code, part))
            set_, bits, place = (np.asarray(x)[at] for x in (b.column("set"), b.column("bits"), about_order(b.column("doc_id"))))
            rows = [x[order] for x in (code, set_, n[at], k, bits, place)]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            here = np.flatnonzero(np.diff(cuts))
            for some in np.array_split(here, max(1, len(order) >> 18)):
                blocks = [to_planes([x[cuts[p]:cuts[p + 1]] for x in rows]) for p in some.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(blocks, pa.binary()), pa.array(np.diff(cuts)[some], pa.int32())],
                    names=["part", "rows", "size"])
    return run


def document_order():
    """Order of lines: doc_id (nulls last; any type that has an order), then line."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "line")


def line_matches(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (lines, sets): lines(doc_id, _key, _row, line,
    set, n) of every line that takes part, n its distinct words; sets(set,
    first_row, first_line, matched, match_row): its first occurrence, and if an
    earlier other set matches, with the row of the earliest that was compared."""
    ranks = word_ranks(docs)
    kind = dict(docs.dtypes)["doc_id"]
    keyed = (docs.select("doc_id", "text", row_key("doc_id", "text").alias("_key"))
             .withColumn("_row", F.monotonically_increasing_id()))
    raw = materialise(keyed.mapInArrow(
        _set_batches(Codes(ranks)),
        f"doc_id {kind}, _key long, _row long, line int, set long, n int, bits long, words binary")).withColumn("ord", document_order())
    first = materialise(raw.groupBy("set").agg(F.min(F.struct("ord", "_row", "line")).alias("f")))  # used by each verification
    given = raw.where("words is not null").select("doc_id", "set", "n", "bits", "words")  # a set's words, once a chunk
    rows = given.agg(F.sum(F.col("n") * (1 - threshold) + 1)).first()[0] or 0
    blocks = given.mapInArrow(_prefix_blocks(threshold, 1 + int(rows) // PART), "part int, rows binary, size int")
    found = materialise(blocks.repartition("part").sortWithinPartitions("part")
                        .mapInArrow(_pair_batches(threshold, group), "a long, b long, code long")
                        .select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("a").isNull().alias("lone"),
                                "code")
                        .distinct())
    both = found.where("not lone").select(F.col("x").alias("a"), F.col("y").alias("b"))

    def verified(pairs):
        """The later set of each pair that matches, and the first occurrence of the earlier one."""
        pairs = materialise(pairs)
        wanted = materialise(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())
        words = given.select("set", "n", "words").join(broadcast_if_small(wanted, wanted.count(), 24, 16 << 20), "set")
        words = words.dropDuplicates(["set"])
        words = materialise(words.mapInArrow(_bitmap_batches, "set long, n int, words binary, map binary").join(first, "set"))
        ma, mb = (words.select(F.col("set").alias(x), F.col("map").alias(f"m{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        pairs = materialise(pairs.join(ma, "a").join(mb, "b").select("a", "b", "ma", "mb", "na", "nb")
                            .mapInArrow(_near_batches(threshold), "a long, b long"))
        wa, wb = (words.select(F.col("set").alias(x), F.col("words").alias(f"w{x}"), F.col("n").alias(f"n{x}"),
                               F.struct("f.ord", "f._row", F.col("set").alias("s")).alias(f"f{x}")) for x in "ab")
        ok = pairs.join(wa, "a").join(wb, "b").select(
            F.when(F.col("fa") < F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("b"),
            F.least("fa", "fb").alias("f"), "wa", "wb", "na", "nb")
        return (ok.mapInArrow(_verify_batches(threshold), f"b long, f {dict(ok.dtypes)['f']}")
                .groupBy(F.col("b").alias("set")).agg(F.min("f").alias("f")).select("set", F.col("f._row").alias("match_row")))

    matched = materialise(verified(both))
    open_ = found.where("lone").select(F.col("y").alias("set")).join(matched, "set", "left_anti")
    if open_.limit(1).count():  # sets of large groups that still lack an earlier match: all earlier ones
        n, m = F.col("n").cast("long"), F.col("n2").cast("long")
        need = F.ceil((n + m) * threshold / (1 + threshold) - 1e-9)
        # only the rows of the large groups are dealt again
        codes = materialise(found.where("lone").select("code").distinct())
        n_codes = codes.count()
        wanted = np.array(sorted(r["code"] for r in codes.collect()), np.int64) if n_codes <= LISTED else None
        prefix = given.mapInArrow(_prefix_batches(threshold, wanted),
                                  f"code long, doc_id {kind}, set long, n int, k int, bits long")
        large = materialise(prefix if wanted is not None else prefix.join(broadcast_if_small(codes, n_codes, 24), "code"))
        left = large.join(open_.distinct(), "set")
        right = large.select(F.col("code").alias("c2"), F.col("doc_id").alias("d2"), F.col("set").alias("s2"),
                              F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("bits").alias("b2"))
        cond = ((F.col("code") == F.col("c2")) & (F.col("doc_id").isNull() | (F.col("d2") <= F.col("doc_id"))) & (F.col("s2") != F.col("set"))
                & (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9)
                & (F.least(n - F.col("k"), m - F.col("k2")) >= need)
                & (F.floor((n + m - F.bit_count(F.col("bits").bitwiseXOR(F.col("b2")))) / 2) >= need))
        more = left.join(right, cond).select(F.least("s2", "set").alias("a"), F.greatest("s2", "set").alias("b")).distinct()
        matched = materialise(matched.union(verified(more).join(matched.select("set"), "set", "left_anti")))
    sets = (first.select("set", F.col("f._row").alias("first_row"), F.col("f.line").alias("first_line"))
            .join(matched.withColumn("matched", F.lit(True)), "set", "left")
            .withColumn("matched", F.coalesce("matched", F.lit(False))))
    return raw.select("doc_id", "_key", "_row", "line", "set", "n"), sets


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text) -> _key, _row, doc_id, n_lines (that take part),
    n_removed, removed (line numbers from 0); documents without such lines
    are left out."""
    lines, sets = line_matches(docs, threshold, group)
    gone = F.col("matched") | (F.col("_row") != F.col("first_row")) | (F.col("line") != F.col("first_line"))
    return (lines.join(sets, "set").groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("_key").alias("_key"), F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(gone, 1)).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(gone, F.col("line")))).alias("removed")))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        found = [(np.array(sketch(b"", (t or "").encode(), hashes)[:SKETCHED], np.int64) >> 31).astype(np.uint32).tobytes()
                 for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(found, pa.binary())], names=["_key", "sketch"])


def sketch_similarity(x: bytes, y: bytes) -> float:
    """Jaccard similarity of two shingle sets by their least hashes."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    least = np.union1d(a, b)[:min(len(a), len(b))]
    return float(np.isin(least, np.intersect1d(a, b)).mean()) if len(least) else 0.0


def _copy_batches(at: float):
    def run(batches):
        for b in batches:
            ok = [sketch_similarity(x, y) >= at for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["_row", "source"]).filter(pa.array(ok, pa.bool_()))
    return run


def lines_to_cut(docs: DataFrame, threshold: float = THRESHOLD, copy_at: float = COPY_AT) -> DataFrame:
    """docs(doc_id, text) -> _row, _key, cut (line numbers from 0): those of
    ``removed_lines``, but a document that is a copy of an earlier one as a
    whole, edits aside, keeps the lines that it has from it.  Such a document is for a near-duplicate stage to drop; without those
    lines only its edits and its lines broken elsewhere would be left, a broken
    text that no stage knows.

    A document is compared with the one that most of its words come from (by
    the first occurrences and first matches of its lines): a copy if
    ``copy_at`` of their five-word shingles agree, by sketches.  Lines that
    both have from elsewhere go from both, and a document without any line of
    its own loses all lines."""
    lines, sets = line_matches(docs, threshold)
    own = (F.col("_row") == F.col("first_row")) & (F.col("line") == F.col("first_line")) & F.col("match_row").isNull()
    origin = F.when(~own, F.coalesce("match_row", "first_row"))
    by_origin = (lines.join(sets, "set").select("_key", "_row", "line", "n", origin.alias("origin")).repartition("_row")
                 .groupBy("_row", "origin").agg(F.first("_key").alias("_key"), F.sum("n").alias("words"),
                                                F.collect_list("line").alias("lines")))
    part = F.struct(F.when(F.col("origin") != F.col("_row"), F.col("words")).alias("shared"), "origin", "lines")
    rows = materialise(by_origin.groupBy("_row").agg(F.first("_key").alias("_key"), F.collect_list(part).alias("parts"),
                                                     F.max(F.col("origin").isNull()).alias("has_own")))
    most = F.array_max(F.transform(F.filter("parts", lambda p: p["shared"].isNotNull()),
                                   lambda p: F.struct(p["shared"].alias("shared"), (-p["origin"]).alias("less"))))
    pairs = rows.where("has_own").select("_row", "_key", (-most["less"]).alias("source")).where("source is not null")
    pairs = materialise(pairs.join(rows.select(F.col("_row").alias("source"), F.col("_key").alias("source_key")), "source"))
    wanted = materialise(pairs.select("_key").union(pairs.select("source_key")).distinct())
    sketches = materialise(docs.select("text", row_key("doc_id", "text").alias("_key"))
                           .join(broadcast_if_small(wanted, wanted.count(), 32), "_key")
                           .mapInArrow(_sketch_batches, "_key long, sketch binary").dropDuplicates(["_key"]))
    x, y = (sketches.select(F.col("_key").alias(k), F.col("sketch").alias(n)) for k, n in (("_key", "x"), ("source_key", "y")))
    copies = (pairs.join(x, "_key").join(y, "source_key").select("_row", "source", "x", "y")
              .mapInArrow(_copy_batches(copy_at), "_row long, source long"))
    cut = F.flatten(F.transform(F.filter("parts", lambda p: p["origin"].isNotNull() & ~p["origin"].eqNullSafe(F.col("source"))),
                                lambda p: p["lines"]))
    return rows.join(copies, "_row", "left").select("_row", "_key", F.sort_array(cut).alias("cut"))


def drop_matched_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without their matched lines (``lines_to_cut``), in the
    columns of ``docs`` (``n_chars``, if there, follows).  Documents of which no
    word is left go; repeated rows are one document."""
    cols, key, cut, rest = docs.columns, *(fresh(docs, c) for c in ("_key", "_gone", "_left"))
    gone = (lines_to_cut(docs, threshold).groupBy(F.col("_key").alias(key)).agg(F.min_by("cut", F.size("cut")).alias(cut))
            .where(F.size(cut) > 0))
    keyed = docs.withColumn(key, row_key("doc_id", "text")).dropDuplicates([key]).join(gone, key, "left")
    parts = F.split(F.col("text"), "\n")
    at = F.sequence(F.lit(0), F.size(parts) - 1)
    left = F.array_join(F.transform(F.array_except(at, F.col(cut)), lambda i: F.get(parts, i)), "\n")
    words = lambda c: F.regexp_count(F.col(c), F.lit(WORD))
    out = keyed.withColumn(rest, F.when(F.col(cut).isNotNull(), left))
    out = out.where(F.col(rest).isNull() | (words(rest) > 0))
    out = out.withColumn("text", F.coalesce(rest, "text"))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*cols)
