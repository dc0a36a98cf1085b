import numpy as np
import pytest
from geoloom.llm import vector_copies
from geoloom.llm.queries import QUERIES


def plain_links(rows, cosine=0.9):
    """n_links and component by brute force; rows of (vec_id, vector or None)."""
    ok = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    width = max([1, *(len(v) for (_, v), o in zip(rows, ok) if o)])
    x = np.zeros((len(rows), width))
    for k, ((_, v), o) in enumerate(zip(rows, ok)):
        if o:
            x[k, : len(v)] = np.array(v, np.float64)
    norm = np.linalg.norm(x, axis=1)
    x[norm > 0] /= norm[norm > 0, None]
    near = (x @ x.T >= cosine) & np.array(ok)[:, None] & np.array(ok)
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(near, label, len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(((i, int(near[k].sum()), least[label[k]] if i is not None else None) for k, (i, _) in enumerate(rows)), key=repr)


def planted(seed, n=900, width=16):
    """Vectors around few directions, near copies on both sides of the threshold, exact copies, one large group."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    x = base[rng.integers(12, size=n)] + 1.2 * rng.normal(size=(n, width))
    for i in range(0, 300, 3):
        g = rng.normal(size=width)
        g -= g @ x[i] / (x[i] @ x[i]) * x[i]
        c = rng.choice([0.88, 0.91, 0.95, 0.99])
        x[i + 1] = c * x[i] / np.linalg.norm(x[i]) + np.sqrt(1 - c * c) * g / np.linalg.norm(g)
    x[300:500] = x[300] + 0.05 * rng.normal(size=(200, width))
    x[500:540] = x[500]
    return x.astype(np.float32)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, label int, node int")


@pytest.mark.parametrize("per_cell", [2, 16, 5000])
def test_recall_and_no_false_links(spark, per_cell):
    x = planted(3)
    rows = list(enumerate(x))
    got = vector_copies.near_vectors(frame(spark, rows), per_cell=per_cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found, want = {r.vec_id: r for r in got.collect()}, plain_links(rows)
    assert len(found) == len(rows)
    assert all(found[i].n_links <= n for i, n, _ in want)
    assert sum(r.n_links for r in found.values()) >= 0.98 * sum(n for _, n, _ in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert np.mean([found[i].component_id == c for i, _, c in want]) > 0.98
    if per_cell == 5000:  # one cell: all pairs meet
        assert [(i, found[i].n_links, found[i].component_id) for i, _, _ in want] == want


def test_blocks_of_a_cell_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vector_copies, "BLOCK", 50)
    monkeypatch.setattr(vector_copies, "STRIP", 16)
    rows = list(enumerate(planted(4, 600)))
    want = {i: (n, c) for i, n, c in plain_links(rows)}
    got = vector_copies.near_vectors(frame(spark, rows), per_cell=40, recall=1.0).collect()
    same = [want[r.vec_id] == (r.n_links, r.component_id) for r in got]
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and np.mean(same) > 0.99


def test_edge_cases(spark):
    a, b = [1.0, 0.0, 2.0], [2.0, 0.0, 4.0]
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 0.0, 2.0]), (8, [float("inf"), 0.0, 2.0]), (None, a), (1, a), (9, a), (9, [0.0, 1.0, 0.0]), (10, [0.0, -3.0]), (11, [0.0, 1.0]), (12, [1e300, 0.0, 2e300])]
    want = plain_links([(i, [c / 1e300 for c in v] if i == 12 else v) for i, v in rows])
    got = vector_copies.near_vectors(frame(spark, rows, "double")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    assert vector_copies.near_vectors(frame(spark, rows[2:5])).count() == 3
    assert vector_copies.near_vectors(frame(spark, [])).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    index = vector_copies.MultiIndex(vector_copies.rows_of(__import__("pyarrow").array(rng.normal(size=(300, 9)).tolist()), 9), 6, 0.9, 0.9)
    a, b = rng.random(6), rng.random(6)
    cells = list(index.traverse(a, b))
    assert sorted(c for c, _ in cells) == list(range(36))
    assert [t for _, t in cells] == sorted(t for _, t in cells)
    assert all(abs(a[c // 6] + b[c % 6] - t) < 1e-12 for c, t in cells)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {i: n for i, n, _ in plain_links(rows)}
    got = QUERIES["op12_vectors"](spark, sf).collect()
    assert sorted(r.vec_id for r in got) == sorted(want)
    assert all(r.n_links <= want[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.9 * sum(want.values())
