"""Statistics over places with many points, against plain sums over pairs, and quantiles."""

import math
import random

import pytest
from geoloom.operators import attributes, spatial
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(7)
    spots = [(rng.randrange(30) / 2, rng.randrange(30) / 2) for _ in range(30)]
    rows = [(i, *spots[rng.randrange(30)], rng.uniform(-5, 9)) for i in range(200)] + [(200, 90.0, 90.0, 1.0)]
    return rows, spark.createDataFrame(rows, "_idx bigint, x double, y double, v double")


@pytest.fixture
def paired(monkeypatch):
    seen, run = [], spatial.neighbours
    monkeypatch.setattr(spatial, "neighbours", lambda points, *a, **b: seen.append(points.count()) or run(points, *a, **b))
    return seen


def near(rows, distance):
    return {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= distance}


def test_hotspots(crowd, paired):
    rows, df = crowd
    v, n = [r[3] for r in rows], len(rows)
    mean = sum(v) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in v) / n)
    pairs = near(rows, 4.0)
    for r in spatial.hotspots(df, "v", "distance", distance=4.0).collect():
        held = [x[3] for x in rows if x[0] == r._idx or (r._idx, x[0]) in pairs]
        w = len(held)
        assert r.gi_z == pytest.approx((sum(held) - mean * w) / (sd * math.sqrt((n * w - w * w) / (n - 1))), abs=2e-6)
    assert paired[0] <= 31


@pytest.mark.parametrize("standard", [True, False])
def test_moran(crowd, paired, standard):
    rows, df = crowd
    n, pairs = len(rows), near(rows, 4.0)
    degree = {r[0]: sum(a == r[0] for a, _ in pairs) for r in rows}
    w = {(a, b): 1 / degree[a] if standard else 1.0 for a, b in pairs}
    mean = sum(r[3] for r in rows) / n
    z = {r[0]: r[3] - mean for r in rows}
    s0 = sum(w.values())
    i = n / s0 * sum(x * z[a] * z[b] for (a, b), x in w.items()) / sum(x * x for x in z.values())
    s1 = sum((x + w.get((b, a), 0)) ** 2 for (a, b), x in w.items()) / 2
    s2 = sum((sum(x for (a, _), x in w.items() if a == k) + sum(x for (_, b), x in w.items() if b == k)) ** 2 for k in z)
    e = -1 / (n - 1)
    variance = (n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - e * e
    got = spatial.morans_i(df, "v", "distance", distance=4.0, row_standardize=standard).first()
    assert (got.morans_i, got.variance, got.n) == (pytest.approx(i, abs=2e-6), pytest.approx(variance, abs=2e-9), n)
    assert paired[0] <= 31


@pytest.mark.parametrize("least", [1, 9])
def test_clusters(crowd, paired, least):
    rows, df = crowd
    pairs = near(rows, 1.0)
    core = {r[0] for r in rows if sum(a == r[0] for a, _ in pairs) + 1 >= least}
    label = {i: i for i in core}
    for _ in rows:
        label = {i: min([label[i], *(label[b] for a, b in pairs if a == i and b in core)]) for i in label}
    for r in rows:
        if r[0] not in core and (held := [b for a, b in pairs if a == r[0] and b in core]):
            label[r[0]] = label[min(held)]
    names = {k: n for n, k in enumerate(sorted(set(label.values())))}
    got = {r._idx: (r.cluster_id, r.cluster_size) for r in spatial.dbscan(df, 1.0, least).collect()}
    sizes = {k: sum(x == k for x in label.values()) for k in names}
    assert got == {r[0]: (names[label[r[0]]], sizes[label[r[0]]]) if r[0] in label else (-1, None) for r in rows}
    assert paired[0] <= 31


def test_quantiles(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice([None, 1.5, 2.5, rng.gauss(0, 9)]),) for _ in range(700)], "v double")
    steps = [i / 37 for i in range(38)]
    assert attributes.quantiles(df.repartition(5), F.col("v"), steps) == df.agg(F.percentile("v", F.array(*map(F.lit, steps)))).first()[0]
    # no aggregate that holds all values in one place
    monkeypatch.setattr(attributes.F, "percentile", None)
    assert attributes.classify_breaks(df, "v", "natural_breaks", 3).where("class is null and v is not null").isEmpty()
