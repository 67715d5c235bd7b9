"""Exact top-k inner products with a three-phase uniform threshold.

A vector's score against a query is the sum of ``lists`` partial scores, one per range of dimensions; each range is a
score list.  Queries and candidates are packed into blocks of bounded size.  Candidates are dealt once into teams of a few blocks
that a task holds; the query blocks (the small side) are sent to every team and stream past it (a stated query set against all
rows, in blocks), so a candidate is shuffled once a phase, however many queries there are.

1. Every block gathers, per query and list, the k best entries, and completes the scores of these alone.  It also reports each
   list's smallest partial score.  The k-th best complete score over all blocks is a safe cutoff for the query.
2. Shifted by the lists' minima, all partial scores are non-negative, so a vector that reaches the cutoff must reach the
   uniform threshold (shifted cutoff / lists) in at least one list.  The cutoffs go to all blocks, which collect the
   entries at or above the threshold and drop those whose upper bound stays below the cutoff.
3. The collected vectors' remaining partial scores are looked up, and a block reports its k best complete scores that
   reach the cutoff.  Nothing else leaves a block, so ties and copies cannot flood a query.

Scores are exact integers while they fit in a long.  Vectors that are null, or hold null or non-finite components, take
no part; vectors of different lengths count as padded with zeros.  A query skips the rows with its own id.  Null ids
sort first.  Empty inputs give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.staging import NULL_ID, Stage

_LOW = -(2 ** 63)
#: vectors that a task holds while the queries stream past, at eight bytes a component
TEAM_BYTES = 1 << 27


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 1024) -> DataFrame:
    """Rows with a usable vector, with ``vec`` = floor(scale * x) per component as bigint."""
    x = F.col(column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.filter(x.isNotNull() & F.coalesce(sound, F.lit(False)))
            .withColumn("vec", F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("bigint"))))


def _pack(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id, vec): (block, ids, kind, mat), packed where the rows are."""

    def run(batches):
        from pyspark import TaskContext
        part, seq, ids, vecs = TaskContext.get().partitionId(), 0, [], []

        def block():
            mat = np.zeros((len(ids), dims), dtype=np.int64)
            for r, v in enumerate(vecs):
                mat[r, :len(v)] = v
            top = int(np.abs(mat).max()) if mat.size else 0
            kind = "<i2" if top < 2 ** 15 else "<i4" if top < 2 ** 31 else "<i8"
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]),
                 pa.array([kind]), pa.array([mat.astype(kind).tobytes()])], names=["block", "ids", "kind", "mat"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                vecs.append(v.values.to_numpy())
                if len(ids) == size:
                    yield block()
                    seq, ids, vecs = seq + 1, [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, "block bigint, ids binary, kind string, mat binary")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with a dense number from 0 (one tiny row per block is numbered, then joined back)."""
    num = blocks.select("block").withColumn("no", F.row_number().over(W.orderBy("block")).cast("bigint") - 1)
    return blocks.join(num, "block")


def _matrix(kind: str, mat: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(mat, kind).reshape(-1, dims) if dims else np.zeros((0, 0), np.int64)


def _partials(q: np.ndarray, x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """lists x queries x vectors partial scores; doubles where they are exact, else 64-bit integers."""
    peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0))
    kind = np.float64 if peak * max(q.shape[1], 1) < 2 ** 53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    return np.stack([q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])]).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score descending, id ascending)."""
    if len(scores) > 4 * k:   # all that reach the k-th score, then the exact order
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class _Merged:
    """The k best of the blocks that one task has seen for the current query block."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]

    def add(self, r: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.rows[r][0], scores]), np.concatenate([self.rows[r][1], ids])
        at = _best(s, i, self.k)
        self.rows[r] = s[at], i[at]


def _meetings(batches, dims: int):
    """(query block number, query ids, q, cutoffs, [(vector ids, x), ...]) for every query block of every team: rows come sorted by
    team, its candidate blocks first."""
    team, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["team"] != team:
                team, held = row["team"], []
            ids, mat = np.frombuffer(row["ids"], "<i8"), _matrix(row["kind"], row["mat"], dims)
            if row["no"] < 0:
                held.append((ids, mat))
            else:
                yield row["no"], ids, mat, row["cutoffs"], held


def _gather(dims: int, cuts: list[int], k: int):
    """Phase 1: per query the complete scores of the local lists' best entries, and the lists' minima."""
    lists = len(cuts) - 1

    def run(batches):
        for no, qids, q, _, held in _meetings(batches, dims):
            n = len(qids)
            best, low = _Merged(n, k), np.full((lists, n), 2 ** 62, dtype=np.int64)
            for ids, x in held:
                part = _partials(q, x, cuts)
                low = np.minimum(low, part.min(axis=2))
                for r in range(n):
                    other = np.flatnonzero(ids != qids[r])
                    if not len(other):
                        continue
                    seen = np.unique(np.concatenate([other[_best(part[j, r, other], ids[other], k)] for j in range(lists)]))
                    best.add(r, part[:, r, seen].sum(axis=0), ids[seen])
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([r[0] for r in best.rows], pa.list_(pa.int64())), pa.array(list(low.T), pa.list_(pa.int64()))],
                    names=["no", "r", "scores", "low"])

    return run


def _resolve(dims: int, cuts: list[int], k: int):
    """Phases 2 and 3: entries at the uniform threshold, upper bounds, complete scores."""
    lists = len(cuts) - 1

    def run(batches):
        for no, qids, q, cut, held in _meetings(batches, dims):
            best = _Merged(len(qids), k)
            cut = np.frombuffer(cut, "<i8").reshape(len(qids), lists + 1)
            for ids, x in held:
                part = _partials(q, x, cuts)
                for r in range(len(qids)):
                    floor, low = int(cut[r, 0]), cut[r, 1:]
                    keep = ids != qids[r]
                    if floor != _LOW:
                        need = -((int(low.sum()) - floor) // lists)   # uniform threshold over the shifted lists, rounded up
                        met = part[:, r, :] >= (low + need)[:, None]
                        at = np.flatnonzero(met.any(axis=0) & keep)
                        # only entries at the threshold are read on; the others count as just below it
                        shifted = np.where(met[:, at], part[:, r, at] - low[:, None], max(need - 1, 0))
                        at = at[shifted.sum(axis=0) + low.sum() >= floor]
                    else:
                        at = np.flatnonzero(keep)
                    total = part[:, r, at].sum(axis=0)
                    if floor != _LOW:
                        at, total = at[total >= floor], total[total >= floor]
                    if len(at):
                        best.add(r, total, ids[at])
            at = np.repeat(np.arange(len(qids)), [len(r[0]) for r in best.rows])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(qids[at]),
                     pa.array(np.concatenate([r[1] for r in best.rows])), pa.array(np.concatenate([r[0] for r in best.rows]))],
                    names=["no", "r", "query_id", "vec_id", "score"])

    return run


def exact_topk(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 4,
               query_block: int = 256, block: int = 4096, group: int = 8) -> DataFrame:
    """The k best vectors of every query row: (query_id, rank, vec_id, score); ``vectors`` and ``queries`` are (id, vec).

    About ``group`` blocks of candidates make a team, whose lists are merged where they are; a team holds at most about
    ``TEAM_BYTES`` of vectors."""
    stage = Stage(spark, "topk")
    dims = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    cuts = [round(i * dims / lists) for i in range(lists + 1)]
    norm = [d.select(F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "vec") for d in (queries, vectors)]
    n_q, n_v = (d.count() for d in norm)
    block = max(1, min(block, TEAM_BYTES // (8 * group * max(dims, 1))))
    n_teams = max(1, math.ceil(n_v / block / group))
    qs = stage.put(_numbered(_pack(norm[0].repartition(max(1, math.ceil(n_q / query_block))), query_block, dims)))
    xs = stage.put(_pack(norm[1].repartition(n_teams), block, dims))
    queries_ = qs.select("no", "ids", "kind", "mat", F.lit(None).cast("binary").alias("cutoffs"))
    every_team = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_teams - 1).cast("bigint")))
    held = xs.select(F.shiftright("block", 32).alias("team"), F.lit(-1).cast("bigint").alias("no"), "ids", "kind", "mat",
                     F.lit(None).cast("binary").alias("cutoffs"))

    def grid(q: DataFrame) -> DataFrame:
        rows = held.unionByName(q.withColumn("team", every_team))
        return rows.repartition(n_teams, "team").sortWithinPartitions("team", "no")

    got = stage.put(grid(queries_).mapInArrow(_gather(dims, cuts, k), "no bigint, r int, scores array<bigint>, low array<bigint>"))
    per_query = got.groupBy("no", "r").agg(
        F.flatten(F.collect_list("scores")).alias("s"),
        *[F.min(F.col("low")[j]).alias(f"low{j}") for j in range(lists)])
    tau = F.when(F.size("s") >= k, F.sort_array("s", asc=False)[k - 1]).otherwise(F.lit(_LOW))
    cutoffs = (per_query.select("no", F.struct("r", tau.alias("tau"), *[f"low{j}" for j in range(lists)]).alias("c"))
               .groupBy("no").agg(F.sort_array(F.collect_list("c")).alias("c")))
    names = ["tau", *[f"low{j}" for j in range(lists)]]

    def as_bytes(batches):
        for b in batches:
            flat = [np.array([[e[n] for n in names] for e in c], "<i8").tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.binary())], names=["no", "cutoffs"])

    with_cut = queries_.drop("cutoffs").join(cutoffs.mapInArrow(as_bytes, "no bigint, cutoffs binary"), "no")
    found = grid(with_cut).mapInArrow(_resolve(dims, cuts, k), "no bigint, r int, query_id bigint, vec_id bigint, score bigint")
    w = W.partitionBy("no", "r").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score"))
