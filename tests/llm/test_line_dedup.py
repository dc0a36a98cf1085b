import random

import numpy as np
import pyarrow as pa
import pytest
from geoloom.llm import line_dedup
from pyspark.sql import functions as F


def plain(rows, threshold=0.8):
    seen, out = [], {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset("".join(c.lower() if "A" <= c <= "Z" else c for c in line).encode().split())
            if words and any(len(words & s) >= threshold * len(words | s) - 1e-9 for s in seen):
                gone.append(n)
            if words:
                seen.append(words)
        out[doc] = gone
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(120)]
    rows = []
    for doc in range(60):
        picked = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            picked.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((doc, "\n".join(picked)))
    hot = " ".join(vocabulary[:30])
    rows += [(100 + i, hot + f" extra{i} more{i * 7}") for i in range(40)]
    return rows + [(200, None), (201, ""), (202, "\n\n  \n"), (5, rows[5][1]), (None, lines[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id bigint, text string, line string, n int")
    gone = {}
    for r in line_dedup.removed_lines(df).distinct().collect():
        gone.setdefault(r.doc_id, []).append(r.line)
    want = plain(rows)
    assert {k: sorted(v) for k, v in gone.items()} == {k: v for k, v in want.items() if v}
    done = line_dedup.deduplicate_lines(df)
    assert done.columns == df.columns and done.count() == len(rows)
    for r in done.collect():
        text = dict(rows)[r.doc_id]
        assert r.text == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[r.doc_id]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.deduplicate_lines(df, counted=True).count() == 0


@pytest.mark.parametrize("few, long_list", [(1, 20000), (1, 8), (4, 12)])
def test_large_lists(spark, monkeypatch, few, long_list):
    """Lists of any size take the same decisions; the limits travel to the tasks as they are pickled."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "LONG_LIST", long_list)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in line_dedup.removed_lines(df).distinct().collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in plain(rows).items() if v}


def test_many_variants_under_one_word(spark):
    """5,000 variants that are copies of the first, and 5,000 that are not, under common words."""
    alike = [(i, f"one two three four five six seven eight nine ten v{i}") for i in range(5000)]
    apart = [(10000 + i, f"red green blue black white u{i}") for i in range(5000)]
    df = spark.createDataFrame(alike + apart, "doc_id bigint, text string")
    gone = {r.doc_id for r in line_dedup.removed_lines(df).collect()}
    assert gone == {i for i, _ in alike[1:]}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e\nx", 1, 2, 3, 4), (2, "a b c d e", 5, 6, 7, 8)], "doc_id bigint, text string, n_lines int, gone int, key int, `a.b` int")
    done = line_dedup.deduplicate_lines(df)
    assert done.columns == df.columns and {tuple(r) for r in done.collect()} == {(1, "a b c d e\nx", 1, 2, 3, 4), (2, "", 5, 6, 7, 8)}


def test_hashes_of_words():
    """All words at once, as if each text were split alone; equal words have equal hashes, others have others."""
    rng = random.Random(4)
    pieces = ["", "Ab", "aB", "c", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "ÄÖ", "äÖ", "a\x1cb", "a\x00", "a", "a\x85", "\u3000", "b" * 2000]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\t", "\n", "\x0b  "]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for array in (pa.array(texts), pa.array(texts).slice(7, 100), pa.array(texts, pa.large_string()).slice(399), pa.array([], pa.string()), pa.array(["", ""])):
        hashes, at = line_dedup.hashed_words(array)
        want = [(i, w) for i, text in enumerate(array.to_pylist()) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
        assert at.tolist() == [i for i, _ in want]
        of = dict(zip([w for _, w in want], hashes.tolist(), strict=True))
        assert [of[w] for _, w in want] == hashes.tolist() and len(set(of.values())) == len(of)


def test_copies_keep_the_earliest():
    """Of one set the earliest place stays, twice if its document is written twice."""
    c, c2 = np.array([5, 5, 5, 5, 6, 5]), np.array([1, 1, 1, 1, 1, 2])
    doc, line, key = np.array([2, 1, 1, 1, 0, 9]), np.array([0, 3, 3, 4, 0, 0]), np.array([7, 8, 8, 8, 9, 9])
    assert line_dedup.copies(c, c2, doc, line, key).tolist() == [True, False, False, True, False, False]


def test_postings_move_in_packs(spark, monkeypatch):
    """What is shuffled are packs of postings by part, not a row for each, and none of copies; nothing is lost in them."""
    monkeypatch.setattr(line_dedup, "PART", 200)
    df = spark.createDataFrame([*corpus(5), *((1000 + i, "same words in all of these lines") for i in range(300))], "doc_id bigint, text string")
    rows = df.select("doc_id", line_dedup.row_key().alias("key"), "text").where("text is not null").coalesce(1)
    lines = line_dedup.cut(line_dedup.line_sets(rows, line_dedup.rarity(rows), 0.8))
    packs = line_dedup.packed(lines).collect()
    word, _, at, c, _, _ = line_dedup.unpacked([r.packed for r in packs])
    loose = line_dedup.postings_of(lines).select("word", "at", "c").collect()
    assert sorted(zip(word.tolist(), at.tolist(), c.tolist(), strict=True)) == sorted(map(tuple, loose))
    assert len(loose) == lines.agg(F.sum("posted")).first()[0] and len({r.part for r in packs}) > 1
    assert len(packs) < len(loose) / 20 and lines.where("copy").where("posted > 0 or size(prefix) > 0 and array_max(prefix) != 0").isEmpty()
    assert lines.where("copy").count() >= 290


@pytest.mark.parametrize("held, long_list", [(50, 12), (300, 8), (50, 20000)])
def test_parts_beyond_memory(spark, monkeypatch, held, long_list):
    """A part of which long lists are cut, while their classes come in any order, takes the same decisions."""
    for name, value in {"HELD": held, "LONG_LIST": long_list, "FEW": 4, "FEW_PAIRS": 0, "PACKED": 20, "PACKED_ROWS": 8, "PART": 1 << 30}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = corpus(6)
    random.Random(6).shuffle(rows)
    got = {}
    for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).distinct().collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in plain(rows).items() if v}
