import math

import numpy as np
from geoloom.llm import topk


def brute(rows, k):
    ready = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {i: v for i, v in reversed(ready) if i % 20 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ready if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 24)]) for i in range(1500)]
    rows += [(i, rows[0][1]) for i in range(1500, 1900)]  # a hot vector
    rows += [(2000, None), (2020, [None] * 24), (2040, [math.nan] * 24), (2060, []), (2080, [0.5]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = {tuple(r) for r in topk.search(df, k=20).collect()}
    assert got == brute(rows, 20)
    ready = topk.quantized(df)
    small = topk.top_k(ready.where("vec_id % 20 = 0"), ready, 20, candidate_block=300, query_block=20)
    assert {tuple(r) for r in small.collect()} == got


def test_bounds_stop_early_but_exactly():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 12, (20, 16))
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 2, (4000, 16)))
    ids = np.arange(4000)
    for q, found, scores in topk.block_top(ids[:50], v[:50], ids, v, 10):
        s = v @ v[q]
        best = sorted((-x, i) for i, x in enumerate(s) if i != q)[:10]
        assert list(zip(-scores, found)) == best


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(df).count() == 0


def test_wide_values(spark):
    rows = [(0, [1e7, 3e7]), (1, [2e7, -1e7]), (2, [5e6, 1e7])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, k=2).collect()} == brute(rows, 2)


def test_repeated_query_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(1, 400)]
    rows += [(0, [3.0 + 0.01 * j] * 8) for j in range(60)] + [(7, rows[6][1])] * 30  # more than k rows of one id, and more than k equal rows
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    ready = topk.quantized(df)
    queries = ready.where("vec_id = 0").orderBy("v").limit(1).unionByName(ready.where("vec_id = 20"))
    got = {tuple(r) for r in topk.top_k(queries, ready, 10).collect()}
    assert got == {r for r in brute(rows, 10) if r[0] in (0, 20)}


def test_repeated_query_ids_and_large_components(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 5.0]), (3, [0.5, 0.5])]
    schema = "vec_id bigint, embedding array<double>"
    for order in (rows, rows[::-1]):
        got = topk.search(spark.createDataFrame(order, schema), k=2).collect()
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 64 * 5 * 64), (2, 1, 64 * 64)]
    import pytest

    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame([*rows, (4, [1e300, 0.0])], schema), k=2).collect()
