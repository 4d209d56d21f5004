"""Exact top-k by inner product over a vector-approximation file.

Rows with equal vectors are one class with its ``k + 1`` least ids (no other
copy can be in a result), so thousands of copies cost one vector.  The classes
are dealt to blocks by hash.  The approximation file holds one row a block:
for every dimension the limits of ``2^BITS`` cells of about equally many
values, and each vector as its cell numbers, a byte a dimension.  (Of 51,282
vectors of 64 dimensions 14 a query are read with cells of 8 bits, 92 with 6,
7,750 with 4.)

A search scans only that file.  A vector's cells give a lower and an upper
bound of its score: with cell centre m and half width h, q.m -+ |q|.h.

1. Each block of queries meets each block of cells (a query set against all
   rows, in blocks) and leaves the ``k + 1`` best lower bounds a query; the
   (k + 1)-th best of all blocks is the query's limit.
2. The same scan again gives the classes whose upper bound reaches the limit.
3. Their exact vectors are read in the order of the bounds: the best
   ``2 (k + 1)`` of each query first, whose (k + 1)-th exact score is a better
   limit, then all that still reach it.  A class that is never read has an
   upper bound under k + 1 known scores, so the result is exact.

Blocks of queries are broadcast if their counted size is under ``LIMIT``; else
they are dealt to the blocks of cells by a join on the block.  No task holds
more than one block of each.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, as query or candidate; only vectors of the same length have a
score; equal scores go to the smaller id, null ids last; repeated rows are
candidates (and queries) of their own, and a query leaves out one row only,
its own; fewer rows than k give fewer results; an empty table gives an empty
result; extra columns are never read.  Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.llm.common import materialise

BITS = 8               # of a cell number
CELLS = 1 << BITS
BLOCK = 8192           # vectors of a block at most, on average
BLOCK_VALUES = 1 << 21 # components of a block, on average
QUERIES = 256          # queries of a block, on average
LIMIT = 8 << 20        # bytes of query blocks that may be broadcast
HELD = 1024            # query blocks whose best bounds a task holds


def scaled(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


# -- blocks -------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Sorted rows -> (key, rows of that key)."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, i].tolist())
            if key != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(b.slice(i, j - i))
    if held:
        yield at, pa.Table.from_batches(held)


def matrix(column, n: int, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (n, dim), and the least and greatest value of each cell (dim, CELLS)."""
    n, dim = x.shape
    codes, lo, hi = np.empty((n, dim), np.uint8), np.zeros((dim, CELLS)), np.zeros((dim, CELLS))
    for d in range(dim):
        order = np.argsort(x[:, d], kind="stable")
        v = x[order, d]
        inner = v[np.arange(1, CELLS) * n // CELLS]
        code = np.searchsorted(inner, v, side="right")
        codes[order, d] = code
        first = np.searchsorted(code, np.arange(CELLS))
        last = np.searchsorted(code, np.arange(CELLS), side="right")
        full = last > first
        lo[d, full], hi[d, full] = v[first[full]], v[last[full] - 1]
    return codes, lo, hi


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (dim, block), rows in _groups(batches, ["dim", "block"]):
        codes, lo, hi = cells(matrix(rows.column("vec"), rows.num_rows, dim))
        yield pa.RecordBatch.from_pylist([{
            "dim": dim, "block": block, "ids": rows.column("c").to_numpy().astype(np.int64).tobytes(), "codes": codes.tobytes(),
            "lo": lo.tobytes(), "hi": hi.tobytes()}], schema=pa.schema(
                [("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "codes", "lo", "hi"))]))


def approximation_file(classes: DataFrame, n: int) -> DataFrame:
    """classes(c, dim, vec), n of them -> dim, block, ids, codes, lo, hi: one row a block."""
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_VALUES / F.greatest(F.lit(1), F.col("dim")))))
    block = F.pmod(F.xxhash64("c"), F.ceil(F.lit(n) / rows))
    return materialise(
        classes.select("dim", "c", "vec", block.alias("block")).repartition("dim", "block")
        .sortWithinPartitions("dim", "block")
        .mapInArrow(_cell_batches, "dim int, block long, ids binary, codes binary, lo binary, hi binary"))


def _query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (dim, block), rows in _groups(batches, ["dim", "qblock"]):
        yield pa.RecordBatch.from_pylist([{
            "dim": dim, "qblock": block, "q": rows.column("c").to_numpy().astype(np.int64).tobytes(),
            "qvec": matrix(rows.column("vec"), rows.num_rows, dim).tobytes(),
            "need": rows.column("need").to_numpy().astype(np.float64).tobytes()}], schema=pa.schema(
                [("dim", pa.int32()), ("qblock", pa.int64()), *((c, pa.binary()) for c in ("q", "qvec", "need"))]))


def query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """queries(c, dim, vec, need), n of them -> dim, qblock, q, qvec, need: one row a block."""
    block = F.pmod(F.xxhash64("c", F.lit(1)), F.lit(max(1, -(-n // QUERIES))))
    return (queries.select("dim", "c", "vec", "need", block.alias("qblock")).repartition("dim", "qblock")
            .sortWithinPartitions("dim", "qblock")
            .mapInArrow(_query_batches, "dim int, qblock long, q binary, qvec binary, need binary"))


def meet(file: DataFrame, queries: DataFrame, values: int) -> DataFrame:
    """Each block of queries with each block of cells of its length."""
    if values * 8 <= LIMIT:
        return file.join(F.broadcast(queries), "dim")
    blocks = file.select("dim", "block")
    return file.join(queries.join(blocks, "dim"), ["dim", "block"])


# -- the scans ----------------------------------------------------------------

class Block:
    """Centres and half widths of a block's vectors, decoded once for all queries."""

    def __init__(self):
        self.key = None

    def bounds(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids, lower and upper bounds (queries, vectors)."""
        dim = row["dim"]
        if self.key != (dim, row["block"]):
            self.key = (dim, row["block"])
            self.ids = np.frombuffer(row["ids"], np.int64)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), dim)
            lo, hi = (np.frombuffer(row[c]).reshape(dim, CELLS) for c in ("lo", "hi"))
            at = np.arange(dim)
            self.mid, self.half = ((lo + hi) / 2)[at, codes], ((hi - lo) / 2)[at, codes]
            self.most = np.maximum(np.abs(lo), np.abs(hi)).max(axis=1, initial=0.0)
        q = np.frombuffer(row["q"], np.int64)
        vec = np.frombuffer(row["qvec"]).reshape(len(q), dim)
        centre, width = vec @ self.mid.T, np.abs(vec) @ self.half.T
        width += (np.abs(vec) @ self.most)[:, None] * 2.0 ** -40  # what doubles may round away
        return q, self.ids, centre - width, centre + width


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _limit_batches(k: int):
    """-> q, bound: the k best lower bounds of each query in the task's blocks."""
    def run(batches):
        block, best = Block(), {}

        def flush():
            q = np.concatenate([np.zeros(0, np.int64), *(np.repeat(q, b.shape[1]) for q, b in best.values())])
            b = np.concatenate([np.zeros(0), *(b.ravel() for _, b in best.values())])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(b)], names=["q", "bound"])
        for row in _rows(batches):
            q, _, low, _ = block.bounds(row)
            key = row["dim"], row["qblock"]
            if key in best:
                low = np.concatenate([best[key][1], low], axis=1)
            if low.shape[1] > k:
                low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            best[key] = q, low
            if len(best) > HELD:
                yield flush()
                best = {}
        yield flush()
    return run


def _reach_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """-> q, c, bound: the vectors whose upper bound reaches the query's limit."""
    block = Block()
    for row in _rows(batches):
        q, ids, _, high = block.bounds(row)
        i, j = np.nonzero(high >= np.frombuffer(row["need"])[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(ids[j]), pa.array(high[i, j])], names=["q", "c", "bound"])


def _best(rows: DataFrame, value: str, k: int) -> DataFrame:
    """rows(q, value) -> q, need: the k-th greatest value of each q that has k."""
    w = Window.partitionBy("q").orderBy(F.desc(value))
    top = rows.select("q", value).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.where(F.col("r") == k).select("q", F.col(value).cast("double").alias("need"))


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(q, c) -> q, c, score."""
    of_q = classes.select(F.col("c").alias("q"), F.col("vec").alias("qvec"))
    score = F.aggregate(F.zip_with("vec", "qvec", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return (pairs.select("q", "c").join(classes.select("c", "vec"), "c").join(of_q, "q")
            .select("q", "c", score.alias("score")))


def top_k(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows(vec_id, vec array<long>, is_query) -> query_id, rank (from 1),
    vec_id, score: the k greatest inner products of each query with all rows
    but its own."""
    rows = rows.where("vec is not null").select("vec_id", "vec", F.coalesce("is_query", F.lit(False)).alias("is_query"))
    w = Window.partitionBy("vec").orderBy(F.asc_nulls_last("vec_id"))
    member = F.struct(F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("id"))
    classes = (rows.select("vec", "vec_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
               .groupBy("vec").agg(F.sort_array(F.collect_list(member)).alias("members")))
    classes = materialise(classes.select("vec", "members", F.size("vec").alias("dim"))
                          .withColumn("c", F.monotonically_increasing_id()))
    asked = (rows.where("is_query").groupBy("vec", "vec_id").agg(F.count(F.lit(1)).alias("times"))
             .join(classes.select("vec", "c"), "vec"))
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), "times", F.col("c").alias("q")))
    queries = classes.join(asked.select(F.col("q").alias("c")).distinct(), "c").select("c", "dim", "vec")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("v")).first()
    n, values = size["n"], (size["v"] or 0) + size["n"] * 2
    file = approximation_file(classes, classes.count())

    packed = query_blocks(queries.withColumn("need", F.lit(float("-inf"))), n)
    low = meet(file, packed, values).mapInArrow(_limit_batches(k + 1), "q long, bound double")
    need = _best(low, "bound", k + 1)
    limited = (queries.join(need.select(F.col("q").alias("c"), "need"), "c", "left")
               .withColumn("need", F.coalesce("need", F.lit(float("-inf")))))
    reach = materialise(meet(file, query_blocks(limited, n), values)
                        .mapInArrow(_reach_batches, "q long, c long, bound double"))

    w = Window.partitionBy("q").orderBy(F.desc("bound"), "c")
    ahead = reach.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * (k + 1)).select("q", "c")
    first = materialise(_exact(ahead, classes))
    need = _best(first, "score", k + 1)
    rest = (reach.join(first.select("q", "c"), ["q", "c"], "left_anti").join(need, "q", "left")
            .where(F.col("need").isNull() | (F.col("bound") >= F.col("need"))))
    scored = first.unionByName(_exact(rest, classes))

    # at most k + 1 classes of a query can hold a row of its result
    least = F.col("members")[0]
    w = Window.partitionBy("q").orderBy(F.desc("score"), least["no"], least["id"])
    best = scored.join(classes.select("c", "members"), "c").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    one = best.select("q", "score", "c", F.explode("members").alias("m"))
    lists = one.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("less"), F.col("m.no").alias("no"), F.col("m.id").alias("id"), "c"))), 1, k + 1).alias("l"))
    found = asked.join(lists, "q").withColumn("own", F.array_position(
        F.transform("l", lambda x: (x["c"] == F.col("q")) & x["id"].eqNullSafe(F.col("query_id"))), True))
    others = F.slice(F.filter("l", lambda x, i: i + 1 != F.col("own")), 1, k)
    return (found.withColumn("l", others).select("query_id", "l", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
            .select("query_id", F.posexplode("l").alias("i", "x"))
            .select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score")))
