"""Spelling variants through Bloom-guided neighbourhoods.

A vocabulary of counted words is put into Bloom filters, one for each length of
word, in blocks of 64 bits so that a probe touches one number. Every word
generates its deletions, which are probed in the filter of the next shorter
words, and its replacements by later letters, probed in that of its own length:
each near pair is generated from one of its words. Insertions are the deletions
of the other word. Only what a filter holds is shuffled, to an exact join with
the vocabulary, which removes false positives.

What is broadcast is bounded: a filter beyond ``PART_BYTES`` is split by the
hash into slices, and slices are broadcast in passes of ``PASS_BYTES`` at most,
in each of which the words probe the slices at hand.

A word's form is its near word of the largest count if that is at least twice its own.
Counts at least double along forms, so they have no cycles, and pointer
doubling finds the last form in a few rounds.

Edge cases: null text has no words, a null doc_id counts as empty text in the
hash, repeated rows count as often as they are there, a very long text or run
is a text or word like any other; an empty table, or one without words, gives no
rows; other columns are passed over.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, counting, cut, map_columns

#: Bits of a filter for each word; bits set by a word; bytes of a slice and of all slices broadcast at once.
BITS_A_WORD, PROBES, PART_BYTES, PASS_BYTES = 24, 5, 8 << 20, 32 << 20
#: Words that a task counts before it passes the counts on; words that are probed at once.
MOST_KEYS, PROBE_ROWS = 200_000, 2048
#: An odd number, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VOCABULARY = "word string, n bigint"


def observed(text: str, doc_id: int | None, least: int) -> Counter:
    """Counts of the words of a text: lower-cased runs, of which one in 97 by hash loses a code point."""
    runs = Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode().translate(LOWER).decode()))
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n of the words that are long and frequent enough."""

    def parts(batch, counts):
        for text, doc_id in zip(batch["text"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
            counts.update(observed(text, doc_id, least_length))

    make = counting(parts, MOST_KEYS, lambda counts: {"word": list(counts), "n": list(counts.values())})
    ready = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(ready, VOCABULARY, make).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def codes_by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in the list, and code points of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), length).astype(np.uint64)


def sums(codes: np.ndarray) -> np.ndarray:
    """The polynomial of each row, before it is mixed."""
    return (codes * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h * BASE) >> np.uint64(40)) % np.uint64(slices)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def mask_of(h: np.ndarray) -> np.ndarray:
    mask = np.zeros_like(h)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return mask


class Filters:
    """The slices at hand: (length, slice) -> blocks; ``slices`` has the number of slices of every length."""

    def __init__(self, slices: dict[int, int], parts: dict[tuple[int, int], np.ndarray]) -> None:
        self.slices, self.parts = slices, parts
        self.lengths = {length for length, _ in parts}

    def hold(self, length: int, sums: np.ndarray) -> np.ndarray:
        h, out = mixed(sums), np.zeros(sums.shape, bool)
        n = self.slices[length]
        own = slice_of(h, n) if n > 1 else None
        for s in range(n):
            if (blocks := self.parts.get((length, s))) is not None:
                mask = mask_of(h)
                held = blocks[block_of(h, len(blocks)).astype(np.int64)] & mask == mask
                out |= held if own is None else held & (own == s)
        return out


def candidates(words: list[str], filters: Filters, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """Place of a word, and an edit of it that a filter holds."""
    for length, at, codes in codes_by_length(words):
        whole, power = sums(codes), powers(length)
        if length - 1 in filters.lengths:
            terms = codes * power
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            shorter = before + (whole[:, None] - before - terms) * INVERSE
            last = np.ones(codes.shape, bool)
            last[:, :-1] = codes[:, 1:] != codes[:, :-1]  # of equal letters in a row any one gives the same word
            for row, i in zip(*np.nonzero(filters.hold(length - 1, shorter) & last), strict=True):
                word = words[at[row]]
                yield int(at[row]), word[:i] + word[i + 1 :]
        if length in filters.lengths:
            for i in range(length):
                later = letters > codes[:, i, None]
                rows, which = np.nonzero(later)
                held = filters.hold(length, whole[rows] + (letters[which] - codes[rows, i]) * power[i])
                for row, letter in zip(rows[held], which[held], strict=True):
                    word = words[at[row]]
                    yield int(at[row]), word[:i] + chr(int(letters[letter])) + word[i + 1 :]


def plan(sizes: dict[int, int], part_bytes: int, pass_bytes: int) -> tuple[dict[int, int], dict[int, int], list[list[tuple[int, int]]]]:
    """Slices of each length, blocks of each slice, and the slices of each pass."""
    slices = {length: max(1, -(-n * BITS_A_WORD // (8 * part_bytes))) for length, n in sizes.items()}
    blocks = {length: max(1, -(-n * BITS_A_WORD // (64 * slices[length]))) for length, n in sizes.items()}
    passes, room = [], 0
    for length in sorted(sizes):
        for s in range(slices[length]):
            if not passes or room < 8 * blocks[length]:
                passes.append([])
                room = pass_bytes
            passes[-1].append((length, s))
            room -= 8 * blocks[length]
    return slices, blocks, passes


def filter_blocks(words: DataFrame, slices: dict[int, int], blocks: dict[int, int]) -> DataFrame:
    """length, slice, block and bits of the filters."""

    def make():
        def one(batch):
            out = {c: [] for c in ("length", "slice", "block", "bits")}
            for length, at, codes in codes_by_length(batch["word"].to_pylist()):
                h = mixed(sums(codes))
                for c, x in (("length", np.full(len(at), length)), ("slice", slice_of(h, slices[length])), ("block", block_of(h, blocks[length])), ("bits", mask_of(h))):
                    out[c].append(x.astype(np.int64) if c != "bits" else x.view(np.int64))
            return {c: np.concatenate(x).astype(np.int32 if c in ("length", "slice") else np.int64) for c, x in out.items()}

        return one

    return map_columns(words.select("word"), "length int, slice int, block bigint, bits bigint", make, PROBE_ROWS).groupBy("length", "slice", "block").agg(F.bit_or("bits").alias("bits"))


def near_pairs(words: DataFrame, part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, other and other_n: every word with each word that differs by one code point, both ways; ``words`` is a stored table (word, n)."""
    spark = words.sparkSession
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    found = spark.createDataFrame([], "word string, n bigint, candidate string")
    if not sizes:
        return found.selectExpr("word", "candidate other", "n other_n")
    letters = np.array(sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint64)
    slices, blocks, passes = plan(sizes, part_bytes, pass_bytes)
    bits = cut(filter_blocks(words, slices, blocks))
    for some in passes:
        lengths = sorted({length for length, _ in some})
        wanted = F.lit(False)
        for length, s in some:
            wanted |= (F.col("length") == length) & (F.col("slice") == s)
        parts = {(length, s): np.zeros(blocks[length], np.uint64) for length, s in some}
        rows = bits.where(wanted).toPandas()
        for (length, s), group in rows.groupby(["length", "slice"]):
            parts[length, s][group["block"].to_numpy()] = group["bits"].to_numpy(np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast(Filters(slices, parts))

        def make(shared=shared):
            filters = shared.value

            def one(batch):
                held = list(candidates(batch["word"].to_pylist(), filters, letters))
                if not held:
                    return None
                at = np.array([i for i, _ in held])
                return {"word": batch["word"].take(_int(at)), "n": batch["n"].take(_int(at)), "candidate": [c for _, c in held]}

            return one

        probing = words.where(F.length("word").isin(sorted({*lengths, *(x + 1 for x in lengths)})))
        found = found.unionByName(map_columns(probing, "word string, n bigint, candidate string", make, PROBE_ROWS))
    met = found.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("m")), "candidate")
    both = F.array(F.struct(F.col("word"), F.col("candidate").alias("other"), F.col("m").alias("other_n")), F.struct(F.col("candidate").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return met.select(F.inline(both))


def _int(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x, pa.int64())


def last_forms(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word and the end of its chain for all words that have a form; ``forms`` is (word, form)."""
    ends = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ends.join(onward, "root", "left_semi").isEmpty():
            return ends
        ends = cut(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = cut(vocabulary(docs, least_length, least_count))
    near = near_pairs(words, **sizes)
    best: Column = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    seen = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(seen, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    described = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = last_forms(described.where(F.col("form").isNotNull()))
    return described.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
