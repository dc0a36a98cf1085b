"""Exact top-k inner-product search by no-random-access aggregation.

Candidates are dealt into blocks; in a block every dimension is a sorted list.
All lists are read in lockstep from the end that helps the query. At a depth,
an entry beyond the frontier is known and anything else is between the frontier
and the list's far end, which gives each candidate a lower and an upper score.
As the frontier at a depth is the same for every query, the bounds of a block
of queries are two matrix products: the upper one takes unseen entries as the
frontier, the lower one as the far end. Reading stops for a query as soon as
the candidates whose upper bound reaches its k-th lower bound are few enough,
or at the lists' end; those candidates' scores are then resolved exactly, and
outsiders, which cannot qualify, are never scored. The best k of the blocks are
merged by Spark.

Every pair of a query block and a candidate block is a task of bounded size.
Bounds and scores are whole numbers in double precision, exact up to 2**53; a
block that could exceed it is scored in 64-bit integers, and a score beyond 64
bits raises OverflowError.

Edge cases: vectors that are null or hold a null or non-finite component take
no part; of vectors of different length the missing components count as zero,
so an empty vector scores zero; ties go to the smaller vec_id; rows without
vec_id take no part; repeated rows are candidates of their own, but rows with
the query's vec_id are never its candidates; of several vectors under one query
id the smallest, component by component, asks; a component that doesn't fit into
64 bits raises an error, as such a score does; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the lists read before bounds are compared.
DEPTHS = (0.25, 0.5, 0.75)
CANDIDATE_BLOCK, QUERY_BLOCK, LARGEST_BLOCK = 2048, 1024, 16384


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * component) of the vectors that take part."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return (
        vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("wide")).where(usable)
        .select("vec_id", F.transform("wide", lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * F.lit(float(scale))).cast("bigint")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint"))).alias("v"))
    )


def _matrix(rows: pd.Series, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best k in a block, ids ascending in ``ids``."""
    n = len(ids)
    lists = np.sort(vectors, axis=0)
    low, high = lists[0], lists[-1]
    gain, loss = np.maximum(queries, 0), np.minimum(queries, 0)
    shortlist: list[np.ndarray | None] = [None] * len(queries)
    active = np.arange(len(queries))
    exact = queries.dtype != np.float64
    for depth in DEPTHS if n > 4 * k and not exact else ():
        read = max(1, int(depth * n))
        top, bottom = lists[n - read], lists[read - 1]
        upper = gain[active] @ np.maximum(vectors, top).T + loss[active] @ np.minimum(vectors, bottom).T
        lower = gain[active] @ np.where(vectors >= top, vectors, low).T + loss[active] @ np.where(vectors <= bottom, vectors, high).T
        own = ids == query_ids[active][:, None]
        lower[own] = -np.inf  # rows with the query's vec_id are no answers, however many
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        inside = (upper >= kth[:, None]) & ~own
        done = inside.sum(axis=1) <= max(4 * k, n // 8)
        for row in np.flatnonzero(done):
            shortlist[active[row]] = np.flatnonzero(inside[row])
        active = active[~done]
        if not len(active):
            break
    if len(active):
        whole = queries[active] @ vectors.T
    at = {q: i for i, q in enumerate(active)}
    for q, query_id in enumerate(query_ids):
        chosen = shortlist[q]
        scores = vectors[chosen] @ queries[q] if chosen is not None else whole[at[q]]
        found = ids if chosen is None else ids[chosen]
        other = found != query_id
        found, scores = found[other], scores[other]
        if len(found) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            some = scores >= cut
            found, scores = found[some], scores[some]
        order = np.lexsort((found, -scores))[:k]
        yield query_id, found[order], scores[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, candidate_block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; both inputs are (vec_id, v array<long>)."""
    n, m = candidates.count(), queries.count()
    size = candidate_block or min(LARGEST_BLOCK, max(CANDIDATE_BLOCK, n // 64))
    c_blocks, q_blocks = max(1, -(-n // size)), max(1, -(-m // query_block))
    block = lambda parts, seed, *more: F.pmod(F.xxhash64("vec_id", *more, F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select(block(q_blocks, 1).alias("qb"), every(c_blocks).alias("cb"), "vec_id", "v")
    # of equal rows no more than k can be among the best k; others of one vec_id are dealt out by their vector
    rows = candidates.groupBy("vec_id", "v").agg(F.count("*").alias("m")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(k)).cast("int"))))
    right = rows.select(every(q_blocks).alias("qb"), block(c_blocks, 2, "v").alias("cb"), "vec_id", "v")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
        if not len(q) or not len(c):
            return none
        c = c.sort_values("vec_id", kind="stable")
        width = max(1, max(map(len, q["v"])), max(map(len, c["v"])))
        a, b = _matrix(q["v"], width, np.int64), _matrix(c["v"], width, np.int64)
        most = width * (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1)
        if most >= 1 << 63:
            a, b = a.astype(object), b.astype(object)
        elif most < 1 << 53:
            a, b = a.astype(np.float64), b.astype(np.float64)
        found = [x for x in block_top(q["vec_id"].to_numpy(), a, c["vec_id"].to_numpy(), b, k) if len(x[1])]
        if not found:
            return none
        return pd.DataFrame({"query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]), "vec_id": np.concatenate([x[1] for x in found]), "score": np.concatenate([x[2] for x in found]).astype(np.int64)})

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = F.row_number().over(_by_query())
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")


def search(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """The k best of all other rows for every row whose vec_id is divisible by ``every``."""
    ready = quantized(vectors, scale)
    asked = ready.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(asked, ready, k)
