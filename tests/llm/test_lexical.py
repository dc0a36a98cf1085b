import math
import random
import re

import numpy as np
import pytest
from geoloom.llm import lexical
from geoloom.llm.queries import ORACLE_SQL, QUERIES

DOCS, ITEMS = "doc_id bigint, text string, rank int", "item_id bigint, text string"


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, words = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * len(b) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "naïve", "X9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "_"]).join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)]  # copies: ties
    docs += [(None, docs[5][1]), (2000, None), (2001, ""), (2002, "-- ,"), (7, docs[7][1]), (2003, "w3 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(20)] + [(50, None), (51, "nowhere"), (52, ""), (3, "w40 naïve"), (None, "w1 w2")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 300, "leaf": 3}, {"block_terms": 20, "shard_postings": 900, "leaf": 1}])
@pytest.mark.parametrize("k", [5, 50])
def test_brute_force(spark, sizes, k):
    docs, items = corpus(k)
    got = lexical.rank_documents(spark.createDataFrame([(*d, 1) for d in docs], DOCS), spark.createDataFrame(items, ITEMS), k, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranking(docs, items, k)


def test_tree_prunes_and_bounds():
    """Bounds are at least all scores below a node, and a search leaves most documents out."""
    rng = np.random.default_rng(1)
    n, terms = 4000, 300
    share = np.maximum(0.6 / np.arange(1, terms + 1), 0.004)
    doc, term = np.nonzero(rng.random((n, terms)) < share)
    tf, m = rng.integers(1, 6, len(doc)), rng.integers(60, 200, n)
    tree = lexical.FPTree(np.arange(n), m, doc, term, tf, terms, leaf=8)
    dense = np.zeros((n, terms), np.int64)
    dense[doc, term] = tf
    below = np.zeros((len(tree.parent), n), bool)
    below[tree.at, np.arange(n)] = True
    for node in range(len(tree.parent) - 1, 0, -1):
        below[tree.parent[node]] |= below[node]
    assert below[0].all()
    most = 0
    for _ in range(20):
        some, weights = np.sort(rng.choice(terms, 6, replace=False)), rng.integers(1, 9000, 6)
        exact = (weights * (10**9 * dense[:, some] // (1000 * dense[:, some] + 20 * m[:, None]))).sum(1)
        nodes = np.arange(len(tree.parent))
        bounds = tree._sum(tree.node_keys, tree.node_tf, nodes, tree.least_m, some, weights)
        assert all((exact[b] <= x).all() for b, x in zip(below, bounds))
        ids, scores, scored = tree.search(some, weights, 10)
        order = np.lexsort((np.arange(n), -exact))[:10]
        order = order[exact[order] > 0]
        assert list(ids) == list(order) and list(scores) == list(exact[order])
        most = max(most, scored)
    assert most < n / 2


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(spark.createDataFrame([(1, "a", 1)], DOCS), items.limit(0)).collect() == []
    assert lexical.rank_documents(spark.createDataFrame([(1, None, 1)], DOCS), items).collect() == []


def test_same_rows_as_sql(spark):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL["op11_lexical"]).fetchall()
    got = QUERIES["op11_lexical"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
