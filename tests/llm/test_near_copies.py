import random

import corpus_pipeline
import pytest
from geoloom.llm import near_copies


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def plain_kept(rows):
    """Smallest doc_id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sorted({min(k for j, (k, _) in enumerate(rows) if find(j) == find(i)) for i in range(len(rows))})


def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [rng.choices(vocabulary, k=rng.randint(3, 150)) for _ in range(40)]
    for base in texts[:12]:
        for _ in range(8):
            near = list(base)
            for _ in range(rng.randint(1, 5)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(near)
    common = rng.choices(vocabulary, k=12)
    texts += [common + rng.choices(vocabulary, k=20) for _ in range(20)]  # shingles that unlike texts share
    out = [(i, ("\n" if i % 3 else " ").join(t)) for i, t in enumerate(texts)]
    return out + [(900, None), (901, " "), (902, ""), (903, out[0][1]), (904, out[1][1].upper())]


@pytest.mark.parametrize("large", [2, 24])
def test_pairs_of_the_whole_table(spark, large):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, source string")
    kept = near_copies.deduplicate(df, large=large)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(data)


def test_stage_of_the_pipeline(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, df, "").collect()) == plain_kept(data)
    assert corpus_pipeline.dedup_near(spark, df.limit(0), "").count() == 0


def test_parities_never_rule_out_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(1, 3000))) for _ in range(2))
        z = np.union1d(x[: rng.integers(0, len(x) + 1)], y[: rng.integers(0, len(y) + 1)])
        apart = len(np.setxor1d(x, z))
        assert int(np.bitwise_count((near_copies.parities(x) ^ near_copies.parities(z)).view(np.uint64)).sum()) <= apart
