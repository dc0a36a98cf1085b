import math
from itertools import combinations

import numpy as np
import pytest
from geoloom.llm import language_id as L
from geoloom.llm.queries import QUERIES, vocabulary


def all_segmentations(word, logs, pieces):
    marked, total = L.START + word, -math.inf
    for n in range(len(marked)):
        for cuts in combinations(range(1, len(marked)), n):
            edges = [0, *cuts, len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in pieces for p in parts):
                total = np.logaddexp(total, sum(logs[pieces[p]] for p in parts))
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    cells = L.Lattice(pieces)
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(9), 2))
    words = ["abab", "a", "bbaab", "aba", "abba"]
    got = cells.forward(words, logs)
    for w, row in zip(words, got):
        for k in range(2):
            assert abs(row[k] - all_segmentations(w, logs[k], {p: i for i, p in enumerate(pieces)})) < 1e-9
    counts = cells.expected(words, np.ones(5), logs, np.array([0, 1, 0, 1, 0]))
    lengths = np.array([len(p) for p in pieces] + [1])
    assert abs((counts * lengths).sum() - sum(len(w) + 1 for w in words)) < 1e-9
    assert np.isfinite(cells.forward(["xyz"], logs)).all()


@pytest.fixture(scope="module")
def pieces():
    return vocabulary("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.count(), found.where("lang_pred = lang").count()
    assert n > 200 and right / n > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark, pieces):
    rows = [(i, "the house is on the hill and", "en") for i in range(6)] + [(10 + i, "das haus ist auf dem berg und", "de") for i in range(6)]
    rows += [(30, None, "en"), (31, "12 34 !!", None), (32, "", "de"), (33, "haus " * 5000, None), (34, "ж" * 300, None), (None, "the hill", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(df, pieces)
    got = {r.doc_id: r for r in L.identify(df, model, pieces, "doc_id", "lang").collect()}
    assert [got[i].lang_pred for i in (0, 10, 30, 31, 32, 33, None)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert got[34].lang_pred in ("de", "en") and got[31].score == 0
    empty = L.train(df.limit(0), pieces)
    assert {r.lang_pred for r in L.identify(df, empty, pieces, "doc_id").collect()} == {"und"}
