import random
import re

import pytest
from geoloom.llm import mixing
from pyspark.sql import functions as F


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = {s for s in order if not sizes[s]}
    while True:
        rest = [s for s in order if s not in full]
        level = (sum(sizes.values()) - 3 * sum(sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        new = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= new


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("ab" for _ in range(int(rng.paretovariate(0.9)) % 3000)), f"s{min(7, int(rng.expovariate(0.6)))}") for i in range(900)]
    return rows + [(1000, None, "s1"), (1001, "x y\tz", None), (1002, "", "empty"), (1003, "one", "tiny"), (3, rows[3][1], rows[3][2]), (None, "p q", "s2")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, size int")
    out = mixing.report(df, block_words=64, shard_words=512).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, source, taken, largest = {}, {}, {}, {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        source[d] = s
    want = plain_targets(sizes)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.size * len(r.shards) <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    total = sum(abs(taken[s] - want[s]) for s in sizes)
    assert total < 0.03 * sum(sizes.values())
    again = mixing.report(df.repartition(3), block_words=64, shard_words=512).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_rows_follow_the_report(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    options = {"block_words": 128, "shard_words": 2048}
    want = {str(r.doc_id): r.n for r in mixing.report(df, **options).where("taken > 0").groupBy("doc_id").agg(F.sum(F.size("shards")).alias("n")).collect()}
    mixed = mixing.mix(df, **options)
    assert mixed.columns == df.columns
    assert {str(r.doc_id): r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixing.report(df.limit(0)).count() == 0


def test_tree_splits_exactly_and_fairly(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 250), (2, 50), (3, 0)], "source_no int, draws bigint")
    cells = mixing.split_tree(quotas, 10, 5).collect()
    for no, n in ((0, 700), (1, 250), (2, 50)):
        own = sorted((c.first, c.n) for c in cells if c.source_no == no)
        assert sum(x[1] for x in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
    by_shard = {}
    for c in cells:
        by_shard[c.shard] = by_shard.get(c.shard, 0) + c.n
    assert set(by_shard.values()) == {100} and len(by_shard) == 10
    assert 1 < len({c.n for c in cells if c.source_no == 0})


def test_hypergeometric_law(spark):
    u = mixing.uniform(F.lit(1), F.col("id"))
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(30), F.lit(70), F.lit(20), u).alias("k")).toPandas()["k"]
    assert draws.between(0, 20).all() and abs(draws.mean() - 6) < 0.12 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    edge = spark.range(50).select(mixing.hypergeometric(F.lit(5), F.lit(0), F.lit(3), u).alias("k")).distinct().collect()
    assert [r.k for r in edge] == [3]
