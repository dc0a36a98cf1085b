import random
import re
import zlib
from collections import Counter

import pytest
from geoloom.llm import spelling
from geoloom.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, word string"


def plain_vocabulary(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_vocabulary(docs)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéñ÷"
    words = {"".join(rng.choices(letters, k=rng.randrange(4, 8))) for _ in range(60)}
    for w in sorted(words):
        for _ in range(9):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    words = sorted(words)
    weights = [2 ** rng.randrange(9) for _ in words]
    docs = [(i, rng.choice([" ", "1", ". "]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=60))) for i in range(200)]
    return docs + [(None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "x" * 9000 + " aaaaa aaaaa aaaaaa aaaaaa aaaaaa"), (903, "aaaaa ÀÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀÀ àÀÀÀÀ")]


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 40, "pass_bytes": 90}])
def test_brute_force(spark, sizes):
    docs = corpus(5)
    got = spelling.variants(spark.createDataFrame([(*d, "x") for d in docs], DOCS), **sizes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(docs)
    assert len(want) > 150 and sum(w[1] is not None and w[2] != w[1] for w in want) > 5
    assert sorted(map(tuple, got.collect())) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_spelling"](spark, sf).collect())) == plain_variants(docs)


def test_filters_have_no_false_negatives_and_few_positives():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(4000)})
    slices, blocks, passes = spelling.plan({8: 3000}, 2000, 5000)
    assert slices[8] == 5 and [len(p) for p in passes] == [2, 2, 1]
    import numpy as np

    parts = {(8, s): np.zeros(blocks[8], np.uint64) for s in range(slices[8])}
    for _, _, codes in spelling.codes_by_length(words[:3000]):
        h = spelling.mixed(spelling.sums(codes))
        for x, s, b, m in zip(h, spelling.slice_of(h, slices[8]), spelling.block_of(h, blocks[8]), spelling.mask_of(h)):
            parts[(8, int(s))][int(b)] |= m
    filters = spelling.Filters(slices, parts)
    for _, _, codes in spelling.codes_by_length(words):
        held = filters.hold(8, spelling.sums(codes))
        assert held[:3000].all() and held[3000:].mean() < 0.02


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], DOCS)
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(docs.limit(0)).collect() == []
