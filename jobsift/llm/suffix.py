"""Exact removal of long repeated byte strings by prefix-free parsing.

Each text is UTF-8 bytes; a byte goes if a string of ``LENGTH`` bytes that
covers it starts anywhere else, in the same text or another.

1. Triggers.  A rolling hash over ``BLOCK`` bytes runs over each text; a
   position triggers if its hash is the least among the ``WINDOW`` blocks of
   some LENGTH-byte string.  Triggers depend on the bytes of that string
   alone, so all its copies have the same ones, and each has one at least.
   They cut the text in phrases: what leads up to a trigger, and what follows.
2. Parse.  A trigger is written as (hash of its block, hash of its whole
   neighbourhood: all bytes that a LENGTH-byte string over the block can
   reach).  Equal neighbourhoods repeat wholly; blocks that occur once repeat
   nothing.  Copies inside a task combine before the shuffle.
3. Corpus order.  Where one block has several neighbourhoods, the distinct
   left phrases (the dictionary, read backwards from the trigger) and the
   distinct right phrases (the parse behind it) are sorted, with the lengths
   that neighbours in each order share.  A string that starts e bytes before
   the block repeats if its left phrase shares e bytes and its right phrase
   the rest with those of another trigger; the two orders combine to give
   that for every e, byte for byte.  (Only the first LENGTH bytes of the order
   matter, so the parse needs no recursion.)
4. Spans are merged per text and cut out.

A block's rows are streamed in sorted order, a neighbourhood at most once per
task of the parse, so memory is bounded by the distinct neighbourhoods of a
block, not by its copies.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; texts
of one repeated character and other periodic texts trigger at each period;
repeated rows remove each other; an empty table gives an empty result.  The
kept bytes may cut a character, so they are hashed, and decoded for texts
only with replacement dropped.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import materialise, row_key

LENGTH = 200                # fixed value: the shortest string that counts
BLOCK = 64                  # bytes of the rolling hash
REACH = LENGTH - BLOCK      # bytes a string may extend beyond its block
WINDOW = REACH + 1          # blocks of a LENGTH-byte string
CHUNK = 1 << 20             # bytes hashed together (whole texts)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class Rolling:
    """Polynomial hashes of any byte ranges of a buffer, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) < len(data) + 1:
            self.up = _powers(self.base, len(data) + 1)
            self.down = _powers(self.inverse, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * self.down[lo]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width], by doubling; shorter at the end."""
    have = 1
    while have * 2 <= width:
        y = x.copy()
        best(x[:-have], x[have:], out=y[:len(x) - have])
        x, have = y, have * 2
    if (rest := width - have) and len(x) > rest:
        y = x.copy()
        best(x[:-rest], x[rest:], out=y[:len(x) - rest])
        x = y
    return x


def triggers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: Rolling, around: Rolling):
    """(text number, position, block hash, neighbourhood hash) of all triggers
    in texts data[starts[i]:ends[i]] of LENGTH bytes or more each."""
    block.load(data)
    around.load(data)
    n, top = len(data), np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.full(n, top, np.uint64)
    m = n - BLOCK + 1
    at = np.arange(m)
    h[:m] = block.ranges(at, at + BLOCK)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(n)   # bytes from here to the text's end
    h[left < BLOCK] = top
    least = _sliding(h, WINDOW, np.minimum)
    least[left < LENGTH] = 0                               # no string starts here
    # a block triggers if some window that holds it has it as its least
    back = _sliding(least[::-1], WINDOW, np.maximum)[::-1]
    pos = np.flatnonzero((back == h) & (h != top))
    of = text[pos]
    lo, hi = np.maximum(pos - REACH, starts[of]), np.minimum(pos + LENGTH, ends[of])
    c = around.ranges(lo, hi) + (pos - lo).astype(np.uint64) * _MIX
    return of, pos - starts[of], h[pos].view(np.int64), c.view(np.int64)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi), sorted; touching ranges are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > far[:-1]])
    return lo[new], far[np.r_[new[1:] - 1, len(far) - 1]]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, around, doc, pos, twice), and for neighbourhoods that
    repeat inside a batch, spans (null, null, doc, lo, hi)."""
    block, around = Rolling(_BASE[0]), Rolling(_BASE[1])
    for b in batches:
        keys = np.array(b.column("_key").to_pylist(), np.int64)
        parts, raw, rows, size = [], [], [], 0
        texts = b.column("text").to_pylist()
        lens = []
        for i in range(len(texts) + 1):
            if i == len(texts) or size >= CHUNK:
                if raw:
                    ends = np.cumsum(lens)
                    of, pos, k, c = triggers(np.frombuffer(b"".join(raw), np.uint8), ends - np.array(lens), ends, block, around)
                    r = np.array(rows)[of]
                    parts.append((k, c, keys[r], pos, np.array(lens)[of]))
                raw, rows, lens, size = [], [], [], 0
            if i < len(texts):
                data = (texts[i] or "").encode()
                if len(data) >= LENGTH:
                    raw.append(data)
                    rows.append(i)
                    lens.append(len(data))
                    size += len(data)
        if not parts:
            continue
        k, c, doc, pos, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((c, k))
        k, c, doc, pos, length = (x[order] for x in (k, c, doc, pos, length))
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        begin = np.flatnonzero(new)
        count = np.diff(np.r_[begin, len(k)])
        many = np.repeat(count > 1, count)
        if many.any():
            o = np.flatnonzero(many)
            o = o[np.argsort(doc[o], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, doc[o][1:] != doc[o][:-1]])
            sd, sl, sh = [], [], []
            for at in np.split(o, cuts[1:]):
                lo, hi = merged(np.maximum(pos[at] - REACH, 0), np.minimum(pos[at] + LENGTH, length[at]))
                sd.append(np.full(len(lo), doc[at[0]]))
                sl.append(lo)
                sh.append(hi)
            none = pa.nulls(sum(map(len, sd)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array(np.concatenate(sd)), pa.array(np.concatenate(sl)), pa.array(np.concatenate(sh)),
                 pa.nulls(len(none), pa.bool_())], names=["block", "around", "doc", "pos", "hi", "twice"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(k[begin]), pa.array(c[begin]), pa.array(doc[begin]), pa.array(pos[begin]),
             pa.array(np.minimum(pos[begin] + LENGTH, length[begin])), pa.array(count > 1)],
            names=["block", "around", "doc", "pos", "hi", "twice"])


def _whole_groups(batches, key: str):
    """Batches cut where ``key`` changes (rows arrive sorted by it)."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[b.num_rows - 1].as_py()
        arr = k.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(arr, last))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[0].as_py() != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _repeat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (block, around): spans of repeated neighbourhoods, and one row
    for each neighbourhood of a block that has several (``open``: it is single)."""
    for t in _whole_groups(batches, "block"):
        k, c, doc, pos, hi, twice = (t.column(n).to_numpy() for n in ("block", "around", "doc", "pos", "hi", "twice"))
        new_k = np.r_[True, k[1:] != k[:-1]]
        new = new_k | np.r_[True, c[1:] != c[:-1]]
        run = np.cumsum(new) - 1
        group = np.cumsum(new_k) - 1
        twice_run = (np.bincount(run) > 1) | (np.bincount(run, weights=twice) > 0)
        repeats = twice_run[run]
        begin = np.flatnonzero(new)
        kinds = np.bincount(group[begin])                    # neighbourhoods of a block
        single = np.bincount(group[begin], weights=~twice_run) > 0
        several = begin[((kinds > 1) & single)[group[begin]]]
        n = int(repeats.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(n, np.int64), k[several]], mask=np.r_[np.ones(n, bool), np.zeros(len(several), bool)]),
             pa.array(np.r_[doc[repeats], doc[several]]), pa.array(np.r_[np.maximum(pos[repeats] - REACH, 0), pos[several]]),
             pa.array(np.r_[hi[repeats], hi[several]]), pa.array(np.r_[np.zeros(n, bool), ~repeats[several]])],
            names=["block", "doc", "lo", "hi", "open"])


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the triggers to compare -> left phrase (backwards) and right phrase of each."""
    for b in batches:
        out = {n: [] for n in ("block", "doc", "pos", "open", "before", "behind")}
        for key, text, at in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
            data = text.encode()
            for x in at:
                p = x["lo"]
                for n, v in (("block", x["block"]), ("doc", key), ("pos", p), ("open", x["open"]),
                             ("before", data[max(0, p - REACH):p][::-1]), ("behind", data[p + BLOCK:p + LENGTH])):
                    out[n].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["block"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["pos"], pa.int64()),
             pa.array(out["open"], pa.bool_()), pa.array(out["before"], pa.binary()), pa.array(out["behind"], pa.binary())],
            names=list(out))


def shared_order(group: np.ndarray, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sort (group, phrase): rank of each, and the bytes that each rank's
    phrase shares with the one before it (-1 where the group changes)."""
    n = len(phrases)
    m = np.frombuffer(b"".join(p.ljust(REACH, b"\0") for p in phrases), np.uint8).reshape(n, REACH)
    lead = np.frombuffer(group.astype(">u8").tobytes(), np.uint8).reshape(n, 8)
    full = np.ascontiguousarray(np.hstack([lead, m]))
    order = np.argsort(full.view(f"V{REACH + 8}").ravel(), kind="stable")
    s = full[order]
    same = s[1:] == s[:-1]
    share = np.where(same.all(axis=1), REACH, same.argmin(axis=1) - 8)
    share = np.r_[-1, np.where(same[:, :8].all(axis=1), share, -1)] if n else np.zeros(0, int)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, share


def repeated_starts(group: np.ndarray, before: list[bytes], behind: list[bytes]) -> np.ndarray:
    """(triggers, REACH + 1) booleans: the string that starts e bytes before
    the block has another start."""
    n = len(before)
    rank_l, share_l = shared_order(group, before)
    rank_r, share_r = shared_order(group, behind)
    len_l, len_r = np.array([len(x) for x in before]), np.array([len(x) for x in behind])
    out = np.zeros((n, REACH + 1), bool)
    for e in range(REACH + 1):
        rows = np.flatnonzero((len_l >= e) & (len_r >= REACH - e))
        if not len(rows):
            continue
        left = np.cumsum(share_l < e)[rank_l[rows]]             # classes of phrases alike for e bytes
        right = np.cumsum(share_r < REACH - e)[rank_r[rows]]
        pair = left * (n + 1) + right
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        out[rows[order[twice]], e] = True
    return out


def _order_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_groups(batches, "block"):
        k, doc, pos, open_ = (t.column(n).to_numpy() for n in ("block", "doc", "pos", "open"))
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]])
        ok = repeated_starts(group, t.column("before").to_pylist(), t.column("behind").to_pylist())
        ok &= open_[:, None].astype(bool)
        edge = np.diff(np.pad(ok, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, e0 = np.nonzero(edge == 1)       # runs of starts, e0 <= e < e1
        _, e1 = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(pos[row] - (e1 - 1)), pa.array(pos[row] - e0 + LENGTH)], names=["doc", "lo", "hi"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(text) -> _key, spans (array of (lo, hi) byte ranges, may overlap)
    of the texts with repeated strings; _key is the text's own."""
    keyed = docs.select("text", F.col("_key"))
    parse = materialise(keyed.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _parse_batches, "block long, around long, doc long, pos long, hi long, twice boolean"))
    found = materialise(parse.where("block is not null").repartition("block").sortWithinPartitions("block", "around")
                        .mapInArrow(_repeat_batches, "block long, doc long, lo long, hi long, open boolean"))
    several = (found.where("block is not null").groupBy("doc")
               .agg(F.collect_set(F.struct("block", "lo", "open")).alias("at")))
    order = (keyed.join(several, F.col("_key") == F.col("doc")).select("_key", "text", "at")
             .mapInArrow(_context_batches, "block long, doc long, pos long, open boolean, before binary, behind binary")
             .dropDuplicates(["block", "doc", "pos"])
             .repartition("block").sortWithinPartitions("block")
             .mapInArrow(_order_batches, "doc long, lo long, hi long"))
    spans = (parse.where("block is null").select("doc", F.col("pos").alias("lo"), "hi")
             .unionByName(found.where("block is null").select("doc", "lo", "hi")).unionByName(order))
    return spans.groupBy(F.col("doc").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed)."""
    if spans is None or not len(spans):
        return data, 0, 0
    s = np.array([(x["lo"], x["hi"]) for x in spans])
    lo, hi = merged(s[:, 0], s[:, 1])
    keep, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        keep.append(data[at:a])
        at = b
    return b"".join([*keep, data[at:]]), int((hi - lo).sum()), len(lo)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text", row_key("text").alias("_key"))
    spans = repeated_spans(keyed)

    def run(batches):
        for b in batches:
            out = [cut((t or "").encode(), s) + (len((t or "").encode()),)
                   for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([o[0] for o in out], pa.binary()), *[pa.array([o[i] for o in out], pa.int64()) for i in (3, 1, 2)],
                 pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return keyed.join(spans, "_key", "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
