"""Quality rules: counts of one text, then lines that many documents of a
host repeat.

``line_verdicts`` gives each document its base counts, the words of its
boilerplate lines and the verdict; ``clean_documents`` takes those lines out
of the kept documents.  A line (lower case, digits as 0, blanks collapsed) is
boilerplate if more than ``MAX_DOCS`` distinct documents of its host hold it.
A document with less than ``MIN_LEFT`` of its words outside such lines is
depleted and goes.

Distinct documents are counted in two steps, so that a group of copies, near
copies too, does not make its own text boilerplate:

1. candidates are the lines that more than ``MAX_DOCS`` different texts hold;
2. a document that holds candidates counts as itself if ``MIN_OWN`` of it is
   its own, else by the least candidate line that it holds.  Near copies have
   little of their own and the same lines, so a group of any size counts once
   or a few times; pages on one template have texts of their own and count.
   What is not its own are the five-word shingles that more than ``MAX_DOCS``
   texts with candidates share, on a sketch of each document's least
   ``SKETCH`` shingle hashes (an eighth of them, within those limits).

Defined cases: a null text has no words (base_failed); a null host (source)
is a host of its own; lines without a word never count; repeated rows are one
document in the counts and get the same verdict; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import fresh, materialise, row_key

MIN_WORDS = 50       # fixed value of the base rules
MAX_REPEAT_PCT = 50  # fixed value of the base rules
MAX_DOCS = 30        # documents of a host that may share a line
MIN_OWN = 0.2        # share of a document that must be its own to count as distinct
MIN_LEFT = 0.3       # share of words a document must keep
SHINGLE = 5          # words of a shingle
SKETCH = (64, 128)   # least and most shingles of a sketch

_MIX = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more (each word once)."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1 << 20:  # keep the product of three below 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    tri = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order][1:] == tri[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def normal_line(line: bytes) -> bytes:
    """Lower-cased ASCII, digits as 0, blanks collapsed; empty without a word."""
    return b" ".join(line.lower().split()).translate(_DIGITS)


def line_keys(host: bytes, text: bytes) -> tuple[list[int], list[int]]:
    """Per distinct line of a text: key of (host, line), its words (all occurrences)."""
    words: dict[int, int] = {}
    for line in text.split(b"\n"):
        norm = normal_line(line)
        if norm:
            key = xxhash.xxh3_64_intdigest(norm, seed=xxhash.xxh32_intdigest(host)) >> 1
            words[key] = words.get(key, 0) + norm.count(b" ") + 1
    return list(words), list(words.values())


class WordHash(dict):
    """Word -> 64-bit hash, cached."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def sketch(host: bytes, text: bytes, hashes: WordHash) -> list[int]:
    """The least hashes of a text's distinct shingles (host, SHINGLE words)."""
    words = text.lower().split()
    if not words:
        return []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    key = np.full(len(h) - n + 1, xxhash.xxh3_64_intdigest(host), np.uint64)
    for i in range(n):
        key = (key ^ h[i:i + len(key)]) * _MIX
        key ^= key >> np.uint64(31)
    key = np.unique(key >> np.uint64(1))
    return key[:min(max(SKETCH[0], len(key) // 8), SKETCH[1])].tolist()


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().strip():
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - blanks, symbols, dup, repeated_window_words(words)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in batches:
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        hosts = [b"\x00" if h is None else h.encode() for h in b.column("host").to_pylist()]
        stats = list(zip(*(text_stats(t.decode()) for t in texts), strict=True)) or [()] * 5
        lines = list(zip(*map(line_keys, hosts, texts), strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("_key"), *[pa.array(s, pa.int64()) for s in stats],
             pa.array(lines[0], pa.list_(pa.int64())), pa.array(lines[1], pa.list_(pa.int32())),
             pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64()),
             pa.array([sketch(h, t, hashes) for h, t in zip(hosts, texts, strict=True)], pa.list_(pa.int64()))],
            names=["doc_id", "_key", *STATS, "lines", "line_words", "content", "sketch"])


def boilerplate(base: DataFrame, max_docs: int, min_own: float) -> DataFrame:
    """base(_row, content, lines, sketch) -> line: those of too many distinct documents."""
    count = F.count(F.lit(1)).alias("n")
    line = base.select("_row", "content", F.explode("lines").alias("line"))
    candidates = materialise(line.select("line", "content").distinct().groupBy("line").agg(count)
                             .where(F.col("n") > max_docs).select("line"))
    # one row a text (and host: the keys of lines name it), with the candidates that it holds
    held = (line.join(candidates, "line").groupBy("content", "line").agg(F.min("_row").alias("_row"))
            .groupBy("_row", "content").agg(F.min("line").alias("least"), F.collect_list("line").alias("held")))
    held = materialise(held.join(base.select("_row", "sketch"), "_row"))
    shingle = held.select("_row", F.explode("sketch").alias("s"))
    shared = shingle.groupBy("s").agg(count).where(F.col("n") > max_docs).select("s")
    # a shingle meets its mark once at most: as many rows as shingles, whatever they share
    mine = shingle.join(shared.withColumn("shared", F.lit(True)), "s", "left").groupBy("_row").agg(
        F.count_if(F.col("shared").isNull()).alias("mine"))
    own = F.coalesce("mine", F.lit(0))
    who = F.when(own >= min_own * F.size("sketch"), F.col("content")).otherwise(F.col("least"))
    return (held.join(mine, "_row", "left").select(F.explode("held").alias("line"), who.alias("who")).distinct()
            .groupBy("line").agg(count).where(F.col("n") > max_docs).select("line"))


def line_verdicts(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS,
                  min_own: float = MIN_OWN, min_left: float = MIN_LEFT) -> DataFrame:
    """docs(doc_id, text, <host>) -> doc_id, _key, the counts of STATS,
    base_failed, removed_words, removed_lines (keys), kept."""
    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, _key long, {', '.join(f'{s} long' for s in STATS)}, "
              "lines array<long>, line_words array<int>, content long, sketch array<long>")
    base = (docs.select("doc_id", "text", F.col(host).cast("string").alias("host"))
            .withColumn("_key", row_key("doc_id", "text", "host")).mapInArrow(_stats_batches, schema))
    base = materialise(base.withColumn("_row", F.monotonically_increasing_id()))
    common = materialise(boilerplate(base, max_docs, min_own))
    removed = (base.select("_row", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
               .select("_row", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w")).join(common, "line")
               .groupBy("_row").agg(F.sum("w").cast("long").alias("removed_words"),
                                    F.collect_list("line").alias("removed_lines")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (base.drop("lines", "line_words", "content", "sketch").join(removed, "_row", "left").drop("_row")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
            .withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))))


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents with their boilerplate lines taken out, in the
    columns of ``docs`` (``n_chars``, if there, follows the text)."""
    cols, key, gone = docs.columns, fresh(docs, "_k"), fresh(docs, "_gone")
    verdicts = (line_verdicts(docs, host, **limits).where("kept")
                .select(F.col("_key").alias(key), F.col("removed_lines").alias(gone)).dropDuplicates([key]))
    keyed = docs.withColumn(key, row_key("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))))
    joined = keyed.join(verdicts, key)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        drop_lines("text", F.col(host).cast("string"), gone))
    out = joined.withColumn("text", text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*cols)


def drop_lines(text, host, keys):
    @F.pandas_udf("string")
    def drop(text, host, keys):
        import pandas as pd
        out = []
        for t, h, gone in zip(text, host, keys, strict=True):
            if t is None or gone is None or not len(gone):
                out.append(t)
                continue
            seed = xxhash.xxh32_intdigest(b"\x00" if h is None else h.encode())
            gone = set(map(int, gone))
            out.append("\n".join(x for x in t.split("\n") if not (norm := normal_line(x.encode()))
                                 or xxhash.xxh3_64_intdigest(norm, seed=seed) >> 1 not in gone))
        return pd.Series(out, dtype=object)
    return drop(text, host, keys)
