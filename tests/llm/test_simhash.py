import random

import pytest
import xxhash
from geoloom.llm import simhash
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints(spark):
    texts = ["a b c d a b c", "One", "", "x y", "Über ÜBER " * 9, "\x0b\x0c a\tb\nc d"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("large", [2, 24, 1000])
def test_links_by_brute_force(spark, large):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:6]:
        for _ in range(40):
            b ^= 1 << rng.randrange(64)
            prints.add(b ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else b)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 2, large)).collect()}
    want = plain_components(list(map(simhash.signed, prints)), prints)
    assert [found.get(simhash.signed(p), simhash.signed(p)) for p in prints] == want


def test_groups_of_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i % 5] + " tail") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "  "), (3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    known = [(i, t or "") for i, t in rows if i is not None]
    want = plain_components([i for i, _ in known], [plain_fingerprint(t) for _, t in known])
    assert [x[1:] for x in got if not x[0]] == sorted(zip((i for i, _ in known), want))
    assert got[-1][0] and got[-1][2] == 4
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
