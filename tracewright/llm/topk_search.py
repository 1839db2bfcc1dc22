"""Exact top-k inner-product search by three-phase uniform threshold.

A score is the sum of partial scores of `LISTS` blocks of components, each a
list of its own. For every round of queries:

1. every task gathers, for each query and pair of lists, its k best partial scores and
   resolves the full scores of those rows only; over all tasks they give a k-th
   best that the true one can't be below: the safe cutoff, which is broadcast;
2. the lists are walked one after the other, and an entry is collected only
   while its row can reach the cutoff: with what its lists so far add up to and
   the most the rest can (norms bound it). Of what is left, a row counts only if
   some list is at or above cutoff / LISTS, as one below in all is below in sum;
3. the lists that are left are resolved for those few rows alone, and the k best
   stay.

A round holds as many queries as `ROUND` bytes do; each reads the table twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import spread

LISTS = 8
#: Bytes of query vectors that are broadcast at once, and queries multiplied at once.
ROUND = 16 << 20
BLOCK = 256
#: Share of rows that can still reach the cutoff below which they are resolved one by one.
FEW = 0.1
#: Triples (query, id, score) that a task gathers before it drops those that are not among the best.
TRIPLES = 1 << 19
SCALE = 1024


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as floor(scale * x), without vectors that are null or hold null or non-finite components."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))


def _matrix(batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components as doubles, which are exact for sums below 2**53; vectors of another width take no part."""
    v = batch.column("v")
    right = pc.equal(pc.list_value_length(v), width).fill_null(False)
    batch = batch.filter(right)
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return batch.column("vec_id").to_numpy(zero_copy_only=False), flat.reshape(-1, width).astype(float)


def _lists(width: int, n: int = LISTS) -> list[slice]:
    edges = np.linspace(0, width, min(n, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _own(qids, ids):
    return qids[:, None] == ids[None, :]


KIND = "query_id long, vec_id long, score long"


def _out(q, v, s):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])


def _blocks(n: int):
    return [slice(at, at + BLOCK) for at in range(0, n, BLOCK)]


def _phase_one(queries, k: int):
    """The full scores of rows that are among a task's k best of some list, as far as it has read."""
    def run(batches):
        qids, q = queries.value
        parts = _lists(q.shape[1], LISTS // 2)  # two lists as one: fewer entries say as much
        kth = np.full((len(parts), len(q)), -np.inf)  # what a partial score must pass
        kept: list[tuple] = []
        for batch in batches:
            ids, x = _matrix(batch, q.shape[1])
            if not len(ids):
                continue
            for own in _blocks(len(qids)):
                same = np.argwhere(_own(qids[own], ids))
                chosen = []
                for j, part in enumerate(parts):
                    partial = q[own, part] @ x[:, part].T
                    partial[same[:, 0], same[:, 1]] = -np.inf
                    pick = partial > kth[j, own][:, None]
                    rise = np.flatnonzero(np.count_nonzero(pick, axis=1) > k)  # this batch alone has k better ones
                    if len(rise):
                        kth[j, own.start + rise] = np.partition(partial[rise], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                        pick[rise] = partial[rise] > kth[j, own.start + rise][:, None]
                        short = rise[np.count_nonzero(pick[rise], axis=1) < k]  # equal ones: any k of them
                        pick[short[:, None], np.argpartition(partial[short], len(ids) - k, axis=1)[:, len(ids) - k :]] = True
                    chosen.append(np.flatnonzero(pick))
                at, to = np.divmod(np.unique(np.concatenate(chosen)), len(ids))
                kept.append((at + own.start, ids[to], np.einsum("ij,ij->i", q[own][at], x[to])))
                kept = _few(kept, k, len(q))
        if kept:
            at, ids, s = _best(kept, k)
            yield _out(qids[at], ids, s)

    return run


def _norms(v: np.ndarray, parts: list[slice]) -> np.ndarray:
    """After each list, the norm of the components in the lists that follow."""
    squares = np.stack([(v[:, p] ** 2).sum(axis=1) for p in parts], axis=1)
    return np.sqrt(np.maximum(squares.sum(axis=1, keepdims=True) - np.cumsum(squares, axis=1), 0))


def resolve(q: np.ndarray, x: np.ndarray, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pairs (query, row) whose score is tau or more, their scores, and how many entries of each list were multiplied."""
    parts = _lists(q.shape[1])
    share, rest_q, rest_x = tau / len(parts), _norms(q, parts), _norms(x, parts)
    sums = np.zeros((len(q), len(x)))
    work, at = [], None

    def reaching(j: int, rows: slice) -> np.ndarray:
        return sums[:, rows] + np.outer(rest_q[:, j], rest_x[rows, j]) >= (tau - 1)[:, None]  # 1: more than rounding can take

    for j, part in enumerate(parts):
        if at is None:
            sums += q[:, part] @ x[:, part].T
            work.append(sums.size)
            if j + 1 < len(parts) and reaching(j, slice(None, None, 1 + len(x) // 64)).mean() > FEW:
                continue  # a few rows say that most can still reach the cutoff
            alive = reaching(j, slice(None))
            at, to = np.nonzero(alive)
            s = sums[at, to]
        else:
            s = s + np.einsum("ij,ij->i", q[at, part], x[to, part])
            work.append(len(s))
        keep = s + rest_q[at, j] * rest_x[to, j] + 1 >= tau[at]
        at, to, s = at[keep], to[keep], s[keep]
    keep = s >= tau[at]
    at, to, s = at[keep], to[keep], s[keep]
    some = np.any([np.einsum("ij,ij->i", q[at, part], x[to, part]) >= share[at] for part in parts], axis=0)  # the uniform threshold: one list at least has its share
    return at[some], to[some], s[some], work


def _phase_two(queries, cutoffs, k: int):
    """Rows that can reach the cutoff, resolved: each task's k best."""
    def run(batches):
        (qids, q), tau = queries.value, cutoffs.value
        kept: list[tuple] = []
        for batch in batches:
            ids, x = _matrix(batch, q.shape[1])
            if not len(ids):
                continue
            for own in _blocks(len(qids)):
                at, to, s, _ = resolve(q[own], x, tau[own])
                good = qids[own][at] != ids[to]
                kept.append((at[good] + own.start, ids[to[good]], s[good]))
                kept = _few(kept, k, len(q))
        if kept:
            at, ids, s = _best(kept, k)
            yield _out(qids[at], ids, s)

    return run


def _few(kept: list[tuple], k: int, queries: int) -> list[tuple]:
    """kept, cut down to each query's k best where that is due: a task holds some 4 k triples a query at most, or TRIPLES."""
    return [_best(kept, k)] if sum(len(x[0]) for x in kept) > max(TRIPLES, 4 * k * queries) else kept


def _best(kept, k: int):
    """Of (query, id, score) triples, each query's k best, ties to the smaller id."""
    at, ids, s = (np.concatenate([x[i] for x in kept]) for i in range(3))
    order = np.lexsort((ids, -s, at))
    at, ids, s = at[order], ids[order], s[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[rank < k], ids[rank < k], s[rank < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """Each query's k highest integer scores: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    vectors, queries: vec_id, embedding. The score is the inner product of
    floor(scale * x); a row with the query's own vec_id is no candidate.
    Vectors that are null or hold null or non-finite components, null vec_ids
    and vectors of another width than the query take no part. A repeated vec_id
    is a candidate row each time it comes; a repeated query counts once.
    Fewer candidates than k give them all; empty tables give no rows.
    """
    spark = vectors.sparkSession
    spread.ready(spark)
    rows = integer_vectors(vectors, scale)
    asked = spread.cut(integer_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    sizes = [r["w"] for r in asked.select(F.size("v").alias("w")).distinct().collect()]
    out = None
    for width in sorted(w for w in sizes if w > 0):
        own = asked.where(F.size("v") == width)
        rounds = max(1, -(-own.count() * width * 8 // (ROUND * 3 // 4)))
        for r in range(rounds):
            block = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow()  # about ROUND bytes
            if not len(block):
                continue
            qids, q = _matrix(block.combine_chunks().to_batches()[0], width)
            shared = spark.sparkContext.broadcast((qids, q))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            first = rows.mapInArrow(_phase_one(shared, k), KIND).withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score")
            known = {x["query_id"]: x["score"] for x in first.collect()}
            tau = np.array([known.get(i, -(2.0**60)) for i in qids.tolist()], float)
            cutoffs = spark.sparkContext.broadcast(tau)
            found = rows.mapInArrow(_phase_two(shared, cutoffs, k), KIND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            found = found if rounds == 1 else spread.cut(found)
            out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
