"""CV x job matching by blocks: exact top K without scoring every pair.

``match.score_pairs`` makes one row a candidate pair.  Here both sides are
dealt to blocks that agree in main and sub category, level and vector width
(jobs in their band of required skills too), so category and seniority scores
are one number for a pair of blocks, and the score of all its pairs has an
upper bound:

    0.25 category + 0.30 * 100 * min(1, most CV skills / least required)
    + 0.25 seniority + 0.20 * 100

(the last part only where both have vectors).  The search is a threshold
algorithm over these bounds, in two rounds of Spark jobs:

1. every block of CVs meets the job blocks of its highest bounds that hold at
   least ``2 K`` jobs; the K-th best score of each CV is its threshold;
2. it meets the other blocks whose bound reaches the lowest threshold of its
   CVs.  Blocks under it cannot hold a result and are never read.

Job blocks of a main category form groups of about ``GROUP_BYTES``.  A task
holds the blocks of one group as they are stored and the CV blocks that meet any
of them follow, each once with its cells: what is shuffled is a group's bytes a
task and a CV block's bytes a group, not a CV block a cell.  A pair of blocks is
scored there: skill overlap by the postings of both blocks
(skill -> rows), frequent skills by one matrix product, so dictionaries of any
size cost what their hits cost; then only where category, skills and seniority with a full
semantic part reach the CV's threshold, cosines by one matrix product.  Of the
blocks that a CV meets in a task, its K best rows leave (and those that rounding or ties may
put among them); their cosines are summed again in the order of
``scores.dot_sql``, so scores and ties are exactly those of the pair-wise form.

Blocks meet through their headers (a few numbers a block): bypass CVs meet
all job blocks by a second, salted key of the headers, and only when there are
bypass CVs; no job row is doubled.

Defined cases: NULL vectors, zero vectors and vectors of another width have
semantic score 0; vectors with a NULL element have a NULL one, and the match
score 0, as in the pair-wise form; a job without required skills has skill score 0; NULL main
categories match only bypass CVs; equal scores go by url, then seq.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift import dictionaries as D
from jobsift.functions import scores as S
from jobsift.operators.match import SCORE_RECORD, attach_job_details, skill_names
from jobsift.sources.sinks import drop_scratch, scratch_table
from jobsift.sources.tables import default_parallelism

JOB_BLOCK = 4096   # jobs of a block at most, on average
CV_BLOCK = 256     # CVs of a block at most, on average
GROUP_BYTES = 64 << 20   # of the job blocks that a task holds, about
PARTS_A_CORE = 6         # parts of the work for each core, if they are between these pairs of rows
LEAST_PAIRS, MOST_PAIRS = 1 << 22, 1 << 32
HEADER_SALTS = 64  # parts of the header rows of one key
DENSE = 256        # skills that at least one in so many pairs of two blocks share count as frequent
STEP = 4_000_000   # pairs of rows with one of the other skills that are counted at a time
AT_ONCE = 512      # frequent skills of one matrix product
MARGIN = 0.1 + 1e-6  # scores are rounded to 0.1, and a matrix product rounds a little differently
GROUP = ["main", "sub", "lvl", "dim"]


def _width(vec: str, nrm: str) -> Column:
    """Vector width, 0 for a vector that has no semantic score, below 0 for one with a NULL element."""
    return (F.when(F.col(vec).isNull() | (F.col(nrm) == 0), 0).when(F.col(nrm).isNull(), -F.size(vec))
            .otherwise(F.size(vec)).alias("dim"))


def prepare_cvs(cvs: DataFrame, bypass: bool) -> DataFrame:
    """cvs: cv_id, main_category, sub_category, level, vector, skills -> with ``cid``, a row id (once written)."""
    star = (F.col("main_category") == D.BYPASS_CATEGORY) & F.lit(bypass)
    out = cvs.select(
        "cv_id", F.coalesce(star, F.lit(False)).alias("star"), F.col("main_category").alias("main"),
        F.col("sub_category").alias("sub"), S.level_index(F.col("level"), case_sensitive=True).alias("lvl"),
        F.col("vector").alias("vec"), S.norm("vector").alias("nrm"), F.array_sort(skill_names(F.col("skills"))).alias("names"))
    return out.withColumn("dim", _width("vec", "nrm")).withColumn("cid", F.monotonically_increasing_id())


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """jobs: seq, url, main_category, sub_category, level, bert_vector, skills -> with ``jid``, a row id (once written)."""
    out = jobs.select(
        "seq", "url", F.col("main_category").alias("main"), F.col("sub_category").alias("sub"),
        S.level_index(F.col("level"), case_sensitive=False).alias("lvl"), F.col("bert_vector").alias("vec"),
        S.norm("bert_vector").alias("nrm"), F.array_sort(skill_names(F.col("skills"))).alias("names"))
    # bands of required skills: 0, 1, 2, 3-4, 5-8, ...
    band = F.when(F.size("names") == 0, -1).otherwise(F.ceil(F.log2(F.size("names")))).cast("int")
    return out.withColumn("dim", _width("vec", "nrm")).withColumn("band", band).withColumn("jid", F.monotonically_increasing_id())


def _pack_batches(keys: list[str], carried: list[str]):
    """Rows sorted by block -> one row a block: its keys, n, the ids (``carried``
    as lists), vectors and norms as bytes, and its skills as postings: names,
    where the rows of each begin, and the rows."""
    def pack(key, parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t.column(c).combine_chunks() for c in ("vec", "nrm", "names", *carried)}
        dim, names = key["dim"], col["names"]
        sizes = pc.list_value_length(names).to_numpy().astype(np.int32)
        of = names.flatten().dictionary_encode(null_encoding="encode")  # skills in the order of their first rows
        codes = of.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(names), dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
        starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(of.dictionary)))].astype(np.int32)
        vec = col["vec"].flatten().to_numpy(zero_copy_only=False).astype("<f4") if dim > 0 else np.zeros(0)
        row = {**key, "n": len(names), "least": int(sizes.min()), "most": int(sizes.max()),
               "bytes": vec.nbytes + 2 * rows.nbytes + 8 * len(starts) + 16 * len(names) + of.dictionary.nbytes, "vec": vec.tobytes(),
               "nrm": col["nrm"].fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8").tobytes(), "sizes": sizes.tobytes(),
               "names": of.dictionary.to_pylist(), "starts": starts.tobytes(), "rows": rows.tobytes()}
        fields = [t.schema.field(c) for c in keys]
        kinds = {"n": pa.int32(), "least": pa.int32(), "most": pa.int32(), "bytes": pa.int64(), "vec": pa.binary(), "nrm": pa.binary(),
                 "sizes": pa.binary(), "names": pa.list_(pa.string()), "starts": pa.binary(), "rows": pa.binary()}
        arrays = [pa.array([row[f.name]], f.type) for f in fields] + [pa.array([row[c]], k) for c, k in kinds.items()]
        arrays += [pa.ListArray.from_arrays([0, len(names)], col[c]) for c in carried]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *kinds, *carried])

    def run(batches):
        at, held = None, []
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if rows[i] != at and held:
                    yield pack(dict(zip(keys, at, strict=True)), held)
                    held = []
                at = rows[i]
                held.append(b.slice(i, j - i))
        if held:
            yield pack(dict(zip(keys, at, strict=True)), held)
    return run


def _blocks(rows: DataFrame, group: list[str], size: int, carried: list[str], order: list[str]) -> DataFrame:
    """One row a block of about ``size`` rows of one group, in ``order``."""
    many = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).alias("_m"))
    same = None
    for c in group:
        e = F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
        same = e if same is None else same & e
    dealt = rows.alias("r").join(many.alias("m"), same).select("r.*", F.pmod(F.xxhash64(carried[0]), "_m").alias("_b"))
    keys, kind = [*group, "_b"], dict(dealt.dtypes)
    schema = (", ".join(f"{c} {kind[c]}" for c in keys) + ", n int, least int, most int, bytes long, vec binary, nrm binary, sizes binary, "
              "names array<string>, starts binary, rows binary, " + ", ".join(f"{c} array<{kind[c]}>" for c in carried))
    return (dealt.select(*keys, *carried, "vec", "nrm", "names").repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInArrow(_pack_batches(keys, carried), schema).drop("_b"))


def _bound(cat: Column, sen: Column) -> Column:
    """Upper bound of the score of two headers (least skills of a job, most of a CV)."""
    skill = F.when(F.col("least") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("most") / F.col("least")) * 100)
    sem = F.when((F.col("cdim") == F.col("dim")) & (F.col("dim") > 0), F.lit(100.0)).otherwise(F.lit(0.0))
    return S.combined_score(cat, skill, sen, sem)


def all_cells(cvb: DataFrame, jobb: DataFrame) -> DataFrame:
    """Candidate pairs of blocks: cb, jb, n (jobs), cat, sen, bound."""
    h = cvb.select("cb", "star", F.col("main").alias("cmain"), F.col("sub").alias("csub"), F.col("lvl").alias("clvl"),
                   F.col("dim").alias("cdim"), "most")
    j = jobb.select("jb", "main", "sub", "lvl", "dim", "n", "least", F.pmod("jb", F.lit(HEADER_SALTS)).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HEADER_SALTS - 1).cast("long"))).alias("salt")
    met = h.where("not star").withColumn("main", F.col("cmain")).select("*", salts).join(j, ["main", "salt"])
    if h.where("star").limit(1).count():
        met = met.unionByName(h.where("star").select("*", salts).join(j, "salt"))
    cat = S.category_score(F.col("cmain"), F.col("csub"), F.col("main"), F.col("sub"))
    sen = S.seniority_score(F.col("clvl"), F.col("lvl"))
    return met.select("cb", "jb", "n", cat.alias("cat"), sen.alias("sen"), _bound(cat, sen).alias("bound"))


def _cells(cvb: DataFrame, jobb: DataFrame, k: int) -> DataFrame:
    """``all_cells`` with ``ahead``: those of round 1."""
    w = Window.partitionBy("cb").orderBy(F.desc("bound"), "jb").rowsBetween(Window.unboundedPreceding, -1)
    return all_cells(cvb, jobb).withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)) < 2 * k)


# -- one pair of blocks -------------------------------------------------------

class Side:
    """A block as arrays; ``names``: its skills, whose rows begin at ``starts``."""

    def __init__(self, dim: int, vec: bytes, nrm: bytes, sizes: bytes, names: pa.Array, starts: bytes, rows: bytes):
        self.size = np.frombuffer(sizes, np.int32)
        self.n, self.dim, self.names = len(self.size), dim, names
        self.starts, self.rows = np.frombuffer(starts, np.int32).astype(np.int64), np.frombuffer(rows, np.int32)
        self.held = np.diff(self.starts)
        if dim > 0:
            self.vec, self.nrm = np.frombuffer(vec, "<f4").reshape(self.n, dim), np.frombuffer(nrm, "<f8")

    @cached_property
    def unit(self) -> np.ndarray:
        return self.vec / self.nrm[:, None]


def _runs(begin: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The whole numbers of all these runs, one after the other."""
    ends = np.cumsum(held)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - held), held)


def overlap(cv: Side, job: Side) -> np.ndarray:
    """(CVs, jobs): skills that both have, by the postings of both blocks; the frequent ones by one matrix product."""
    count = np.zeros((cv.n, job.n), np.int32)
    if not (len(cv.names) and len(job.names)):
        return count
    place = pc.index_in(cv.names, value_set=job.names).fill_null(-1).to_numpy(zero_copy_only=False)
    a = np.flatnonzero(place >= 0)
    b = place[a]
    many = DENSE * cv.held[a] * job.held[b] >= cv.n * job.n
    for at in range(0, int(many.sum()), AT_ONCE):
        x, y = a[many][at:at + AT_ONCE], b[many][at:at + AT_ONCE]
        of_cv, of_job = np.zeros((cv.n, len(x)), np.float32), np.zeros((len(x), job.n), np.float32)
        of_cv[cv.rows[_runs(cv.starts[x], cv.held[x])], np.repeat(np.arange(len(x)), cv.held[x])] = 1
        of_job[np.repeat(np.arange(len(y)), job.held[y]), job.rows[_runs(job.starts[y], job.held[y])]] = 1
        count += (of_cv @ of_job).astype(np.int32)
    a, b = a[~many], b[~many]
    if len(a):  # of each CV row with one of the other skills: the job rows with it
        row = cv.rows[_runs(cv.starts[a], cv.held[a])].astype(np.int64) * job.n
        begin, held = np.repeat(job.starts[b], cv.held[a]), np.repeat(job.held[b], cv.held[a])
        flat, ends = count.reshape(-1), np.cumsum(held)
        cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1], STEP)), len(held)])
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.repeat(row[x:y], held[x:y]) + job.rows[_runs(begin[x:y], held[x:y])]
            if 8 * len(at) < len(flat):
                np.add.at(flat, at, 1)
            else:
                flat += np.bincount(at, minlength=len(flat)).astype(np.int32)
    return count


def best_of(raw: np.ndarray, floor: float, k: int) -> np.ndarray:
    """Positions that can be among the k best: by falling score, of equal scores the first k."""
    at = np.flatnonzero(raw >= floor - MARGIN)
    if len(at) > k:
        v = raw[at]
        at = at[v >= np.partition(v, len(v) - k)[len(v) - k] - MARGIN]
    at = at[np.argsort(-raw[at], kind="stable")]
    v = raw[at]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return at[np.arange(len(v)) - np.repeat(first, np.diff(np.r_[first, len(v)])) < k]


def score_blocks(cv: Side, job: Side, cat: float, sen: float, floors: np.ndarray, k: int, so_far: np.ndarray | None = None):
    """(cv positions, job positions, matched, raw scores, pairs scored in full) of the rows that can be among the k
    best of a CV; ``so_far``: floors of what leaves, as high as ``floors`` or higher."""
    matched = overlap(cv, job)
    of_skill = np.divide(D.W_SKILLS * 100.0, job.size, out=np.zeros(job.n), where=job.size > 0)
    part = matched * of_skill
    part += D.W_CATEGORY * cat + D.W_SENIORITY * sen
    kind = semantic_kind(cv, job)
    if kind == NO_SCORE:
        part[:] = 0.0
    least, so_far = floors - MARGIN, floors if so_far is None else so_far
    open_ = part >= (least - (D.W_SEMANTIC * 100.0 if kind == COSINE else 0.0))[:, None]
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    raw = part if open_.shape == (len(rows), len(cols)) else part[np.ix_(rows, cols)]
    if kind == COSINE and len(rows):
        raw += (D.W_SEMANTIC * 100.0 * cv.unit[rows]) @ job.unit[cols].T
        raw[np.isnan(raw)] = np.inf
    np.maximum(raw, 0.0, out=raw)
    reach = np.flatnonzero(raw.max(axis=1) >= so_far[rows] - MARGIN) if len(cols) else []
    at = [best_of(raw[r], so_far[rows[r]], k) for r in reach]
    i = np.repeat(rows[reach], [len(a) for a in at])
    j = cols[np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)]
    value = np.concatenate([*(raw[r][a] for r, a in zip(reach, at, strict=True)), np.zeros(0)])
    return i, j, matched[i, j], value, len(rows) * len(cols)


def kth_best(i: np.ndarray, raw: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best of the scores of each of n rows, minus infinity where there are fewer."""
    order = np.lexsort((-raw, i))
    at = np.searchsorted(i[order], np.arange(n)) + k - 1
    held = np.bincount(i, minlength=n) >= k
    out = np.full(n, -np.inf)
    out[held] = raw[order[at[held]]]
    return out


NO_VECTOR, COSINE, NO_SCORE = range(3)


def semantic_kind(cv: Side, job: Side) -> int:
    """Semantic part of the pairs of two blocks: 0, a cosine, or NULL (a NULL element in vectors of one width)."""
    if cv.dim == 0 or abs(cv.dim) != abs(job.dim):
        return NO_VECTOR
    return COSINE if cv.dim > 0 and job.dim > 0 else NO_SCORE


def semantic(cv: Side, job: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Semantic scores of pairs of rows, added left to right as the pair-wise form adds."""
    sem = np.zeros(len(i))
    a, b = cv.vec[i].T.astype(np.float64), job.vec[j].T.astype(np.float64)
    for d in range(cv.dim):
        sem += a[d] * b[d]
    return sem / (cv.nrm[i] * job.nrm[j]) * 100.0


_SIDE = ["dim", "vec", "nrm", "sizes", "names", "starts", "rows"]


def each_cv_block(batches: Iterator[pa.RecordBatch]):
    """Rows of ``_met_blocks`` -> of every CV block its columns, itself, and its cells: columns of the job block,
    itself, cat, sen.  Of the blocks of jobs, the bytes that came are held; a block is made to arrays for its cell."""
    at, held = None, {}
    for b in batches:
        kinds, jbs = list(zip(b.column("jg").to_pylist(), b.column("slice").to_pylist(), strict=True)), b.column("jb").to_pylist()
        for x, kind in enumerate(kinds):
            if kind != at:
                at, held = kind, {}
            row = lambda name, x=x, b=b: b.column(name)[x]
            if jbs[x] is not None:  # the blocks of jobs come before the CV blocks
                own = {n: c.take(pa.array([x]))[0] for n, c in zip(b.schema.names, b.columns, strict=True) if c[x].is_valid}
                held[jbs[x]] = own.__getitem__
                continue
            met = b.column("cells")[x].as_py()
            yield row, _side(row), ((held[c["jb"]], _side(held[c["jb"]]), c["cat"], c["sen"]) for c in met)


def _side(row) -> Side:
    return Side(*(row(c).values if c == "names" else row(c).as_py() for c in _SIDE))


def each_cell(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Rows of ``_met_blocks``: ``work(column of the CV row, cv, job, cat, sen)`` of every pair of blocks,
    where ``column(name)`` is a list of the CV block and ``column(name, True)`` one of the job block."""
    for row, cv, cells in each_cv_block(batches):
        for of_job, job, cat, sen in cells:
            yield work(lambda name, job_s=False: (of_job if job_s else row)(name).values, cv, job, cat, sen)  # noqa: B023


def _cell_batches(k: int):
    def work(row, cv, cells):
        floors = row("floors").values.to_numpy(zero_copy_only=False)
        kept, scored, so_far = [], 0, floors
        for of_job, job, cat, sen in cells:  # those of the highest bounds first
            *found, n = score_blocks(cv, job, cat, sen, floors, k, so_far)
            scored += n
            if len(found[0]):
                kept.append((of_job, job, cat, sen, found))
                i, raw = (np.concatenate([f[x] for *_, f in kept]) for x in (0, 3))
                so_far = np.maximum(floors, kth_best(i, raw, cv.n, k))
        for of_job, job, cat, sen, found in kept:
            i, j, matched, raw = (f[found[3] >= so_far[found[0]] - MARGIN] for f in found)
            kind, n = semantic_kind(cv, job), len(i)
            sem = semantic(cv, job, i, j) if kind == COSINE else np.zeros(n)
            ids = [of_job(c).values.take(pa.array(j)) for c in ("seq", "jid", "url")]
            yield [row("cv_id").values.take(pa.array(i)), row("cid").values.take(pa.array(i)), *ids, pa.array(matched, pa.int32()),
                   pa.array(job.size[j], pa.int32()), pa.array(np.full(n, cat)), pa.array(np.full(n, sen)),
                   pa.array(sem, pa.float64(), mask=np.full(n, kind == NO_SCORE)), pa.array(raw, pa.float64()), pa.nulls(n, pa.int64())]
        # the last row: how many pairs were scored in full
        none = [pa.nulls(1, row(c).values.type) for c in ("cv_id", "cid")] + [pa.nulls(1, t) for t in of_jobs]
        yield [*none, *(pa.nulls(1, t) for t in (pa.int32(), pa.int32(), *[pa.float64()] * 4)), pa.array([scored], pa.int64())]

    of_jobs: list[pa.DataType] = []

    def run(batches):
        for row, cv, cells in each_cv_block(batches):
            of_jobs[:] = [row(c).type.value_type for c in ("seq", "jid", "url")]
            for columns in work(row, cv, cells):
                yield pa.RecordBatch.from_arrays(columns, names=["cv_id", "cid", "seq", "jid", "url", "n_matched", "n_required",
                                                                 "cat", "sen", "sem", "raw", "scored"])
    return run


def category_cells(cvb: DataFrame, jobb: DataFrame) -> DataFrame:
    """Pairs of blocks of one main category, bypass blocks with all: cb, jb, cat and sen 0 (blocks without scores)."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HEADER_SALTS - 1).cast("long"))).alias("salt")
    c, j = cvb.select("cb", "star", "main", salts), jobb.select("jb", "main", F.pmod("jb", F.lit(HEADER_SALTS)).alias("salt"))
    met = c.where("not star").select("cb", "main", "salt").join(j, ["main", "salt"]).select("cb", "jb").unionByName(
        c.where("star").select("cb", "salt").join(j.drop("main"), "salt").select("cb", "jb"))
    return met.select("cb", "jb", F.lit(0.0).alias("cat"), F.lit(0.0).alias("sen"), F.lit(0.0).alias("bound"))


def skill_blocks(rows: DataFrame, group: list[str], size: int, carried: list[str], block: str) -> DataFrame:
    """Blocks of rows without vectors; ``carried`` begins with an id."""
    plain = rows.withColumns({"dim": F.lit(0), "vec": F.lit(None).cast("array<float>"), "nrm": F.lit(None).cast("double")})
    return _blocks(plain, [*group, "dim"], size, carried, carried[:1]).withColumn(block, F.monotonically_increasing_id())


def _job_groups(jobb: DataFrame) -> DataFrame:
    """jb, jg: neighbouring blocks of a main category of about ``GROUP_BYTES`` (a row a block; no job rows)."""
    near = [c for c in ("sub", "lvl", "dim", "band") if c in jobb.columns]
    before = F.sum("bytes").over(Window.partitionBy("main").orderBy(*near, "jb").rowsBetween(Window.unboundedPreceding, -1))
    return jobb.select("jb", F.xxhash64("main", F.floor(F.coalesce(before, F.lit(0)) / F.lit(GROUP_BYTES))).alias("jg"))


def _met_blocks(cells: DataFrame, cvb: DataFrame, jobb: DataFrame, of_cv: list[str], of_job: list[str]) -> DataFrame:
    """For each part of the work (jg, slice): the blocks of jobs of its cells, once each, then the CV blocks, with the
    columns of both sides; a CV row has ``cells``, the blocks of jobs that it meets there, by falling bound.
    A part is a group of job blocks and a slice of the CV blocks that meet them."""
    sizes = lambda t, key, n: t.select(key, F.col("n").alias(n))
    met = scratch_table(
        cells.select("cb", "jb", "cat", "sen", "bound").join(_job_groups(jobb), "jb").join(sizes(jobb, "jb", "nj"), "jb")
        .join(sizes(cvb, "cb", "nc"), "cb").withColumn("work", F.col("nc") * F.col("nj").cast("long")), "met")
    work, groups = met.agg(F.coalesce(F.sum("work"), F.lit(0)), F.countDistinct("jg")).first()  # two numbers
    each = min(max(work / (PARTS_A_CORE * default_parallelism(cells.sparkSession)), LEAST_PAIRS), MOST_PAIRS)
    slices = met.groupBy("jg").agg(F.ceil(F.sum("work") / F.lit(each)).alias("_m"))
    met = met.join(slices, "jg").withColumn("slice", F.pmod(F.xxhash64("cb"), "_m"))
    cell = F.struct((-F.col("bound")).alias("b"), "jb", "cat", "sen")
    left = met.groupBy("jg", "slice", "cb").agg(F.sort_array(F.collect_list(cell)).alias("cells")).join(cvb.select("cb", *of_cv, *_SIDE), "cb")
    right = met.select("jg", "slice", "jb").distinct().join(jobb.select("jb", *of_job, *_SIDE), "jb")
    parts = 2 * (int(work / each) + groups) + 1
    return (left.unionByName(right, allowMissingColumns=True).repartition(parts, "jg", "slice")
            .sortWithinPartitions("jg", "slice", F.col("cb").asc_nulls_first(), "jb"))


def _scan(cells: DataFrame, cvb: DataFrame, jobb: DataFrame, floors: DataFrame, k: int) -> DataFrame:
    """Candidates of these pairs of blocks; ``floors``: cb, floors (one a CV of the block, in its order)."""
    kind = {"cv_id": dict(cvb.dtypes)["cv_id"], "seq": dict(jobb.dtypes)["seq"]}
    met = _met_blocks(cells, cvb.join(floors, "cb"), jobb, ["cv_id", "cid", "floors"], ["seq", "jid", "url"])
    item = lambda t: t[len("array<"):-1]
    return met.mapInArrow(
        _cell_batches(k), f"cv_id {item(kind['cv_id'])}, cid long, seq {item(kind['seq'])}, jid long, url string, n_matched int, "
                          "n_required int, cat double, sen double, sem double, raw double, scored long")


def job_blocks(jobs_p: DataFrame) -> DataFrame:
    return (_blocks(jobs_p, [*GROUP, "band"], JOB_BLOCK, ["jid", "seq", "url"], ["url", "seq"])
            .withColumn("jb", F.monotonically_increasing_id()))


def cv_blocks(cvs_p: DataFrame) -> DataFrame:
    return (_blocks(cvs_p, ["star", *GROUP], CV_BLOCK, ["cid", "cv_id"], ["cv_id"])
            .withColumn("cb", F.monotonically_increasing_id()))


def best_pairs(cvs: DataFrame, jobs: DataFrame, k: int = D.TOP_K, bypass: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(candidates with their score parts, counts of the work, prepared CVs, prepared jobs, tables of the candidates)."""
    jobs_p = scratch_table(prepare_jobs(jobs), "match-jobs")
    cvs_p = scratch_table(prepare_cvs(cvs, bypass), "match-cvs")
    jobb = scratch_table(job_blocks(jobs_p), "match-jobs")
    cvb = scratch_table(cv_blocks(cvs_p), "match-cvs")
    cells = scratch_table(_cells(cvb, jobb, k), "match-cells")
    none = cvb.select("cb", F.array_repeat(F.lit(float("-inf")), F.col("n")).alias("floors"))
    first = scratch_table(_scan(cells.where("ahead"), cvb, jobb, none, k), "match-pairs")
    w = Window.partitionBy("cv_id").orderBy(F.desc("raw"))
    kth = (first.where("scored is null").select("cv_id", "raw").withColumn("r", F.row_number().over(w))
           .where(F.col("r") <= k).where(F.col("r") == k).select("cv_id", F.col("raw").alias("kth")))
    members = cvb.select("cb", F.posexplode("cv_id").alias("at", "cv_id")).join(kth, "cv_id", "left")
    floor = F.coalesce("kth", F.lit(float("-inf")))
    floors = scratch_table(members.groupBy("cb").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", floor.alias("f")))), lambda x: x["f"]).alias("floors"),
        F.min(floor).alias("least")), "match-floors")
    late = cells.where("not ahead").join(floors.select("cb", "least"), "cb").where(F.col("bound") >= F.col("least") - MARGIN)
    rest = scratch_table(_scan(late, cvb, jobb, floors.select("cb", "floors"), k), "match-pairs")
    found = first.unionByName(rest)
    size = lambda t, key, name: t.select(key, F.col("n").alias(name))
    candidates = (cells.join(size(cvb, "cb", "nc"), "cb").agg(F.sum(F.col("nc") * F.col("n")).alias("candidate_pairs")))
    work = scratch_table(found.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored_pairs")).join(candidates), "match-work")
    drop_scratch(jobb, cvb, cells, floors)
    return found.where("scored is null").drop("scored"), work, cvs_p, jobs_p, [first, rest]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Candidates (some K a CV and group of jobs) -> the k best of each CV with rounded scores."""
    skill = S.skill_score(F.col("n_matched"), F.col("n_required"))
    rows = found.select(
        "cv_id", "cid", "seq", "jid", "url",
        S.match_score(S.combined_score(F.col("cat"), skill, F.col("sen"), F.col("sem"))).alias("match_score"),
        F.round("cat", 1).alias("score_category"), F.round(skill, 1).alias("score_skills"),
        F.round("sen", 1).alias("score_seniority"), F.round("sem", 1).alias("score_semantic"))
    order = [F.desc("match_score"), "url", "seq"]
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("cv_id").orderBy(*order)).cast("bigint"))
            .where(F.col("rank") <= k))


def match_topk(cvs: DataFrame, jobs: DataFrame, k: int = D.TOP_K, bypass: bool = True,
               max_broadcast_bytes: int = 64 << 20, by_row: bool = False) -> DataFrame:
    """The K best jobs of each CV with the full score record, as
    ``match.match_topk`` gives them; the skills come from the rows, so no
    dictionary is needed.  ``by_row``: a result takes the skills of its very rows, so
    repeated and null ids come out as in the pair-wise form; else those of its ids."""
    found, _, cvs_p, jobs_p, tables = best_pairs(cvs, jobs, k, bypass)
    top, ids = ranked(found, k).drop("url"), ["cid", "jid"] if by_row else ["cv_id", "seq"]
    top = top if by_row else top.drop("cid", "jid")
    cv_names, job_names = (t.select(key, F.col("names").alias(n)) for t, key, n in
                           ((cvs_p, ids[0], "cv_names"), (jobs_p, ids[1], "job_names")))
    named = top.join(cv_names, ids[0]).join(job_names, ids[1]).select(
        *(c for c in top.columns if c not in ("cid", "jid")), F.array_sort(F.array_intersect("job_names", "cv_names")).alias("matched_skills"),
        F.array_sort(F.array_except("job_names", "cv_names")).alias("missing_skills"))
    named = scratch_table(named, "match-top")
    drop_scratch(cvs_p, jobs_p, *tables)
    display = jobs.select(
        "seq", "job_title", F.col("company_name").alias("company"), "url", F.col("search_date").alias("date"),
        F.col("description_text").alias("description"), "location", "search_date", "main_category")
    n, width = named.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("matched_skills") + F.size("missing_skills")), F.lit(0.0))).first()
    return attach_job_details(named, display, int(n * (128 + 24 * width)), max_broadcast_bytes).select(*SCORE_RECORD)


def match_work(cvs: DataFrame, jobs: DataFrame, k: int = D.TOP_K, bypass: bool = True) -> DataFrame:
    """One row: candidate_pairs (of the equi-join) and scored_pairs (whose cosine was taken)."""
    return best_pairs(cvs, jobs, k, bypass)[1].select("candidate_pairs", "scored_pairs")
