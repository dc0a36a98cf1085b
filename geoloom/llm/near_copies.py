"""Near copies by the exact Jaccard similarity of word shingles.

SimHash fingerprints (see ``simhash``) propose first pairs: texts under one
fingerprint, and fingerprints two bits apart. At a similarity of 0.8 two 64-bit
fingerprints differ in about ten bits, so a prefix filter proposes the others:
in one common order of all shingles, two sets that are similar enough share a
shingle among the first ``n - ceil(similarity * n) + 1`` of each. Every pair that
its sizes, positions and parities don't rule out is verified by the intersection of both
sets, so no pair is missed and none is taken by chance (but for equal 64-bit
hashes).

The order puts shingles that a sample of the documents repeats last. Any order
gives the same result; this one keeps common shingles out of the prefixes.

A shingle that more than ``LARGE_GROUP`` sets share would bring together all
pairs of them. There each set is verified against one of the group first. Then
only pairs of different components are left, and of them those with a set
outside the component that is most frequent under the shingle.

Edge cases: as in ``simhash``: fewer words than a shingle make one shingle of
all, texts without words are copies of each other, repeated rows keep one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_columns, row_key, text_of
from .simhash import LARGE_GROUP, components, links, majority, shingle_hashes, signed

#: One document in so many is sampled for the order of shingles; so many repeated shingles are put last.
SAMPLE, REPEATED = 32, 1_000_000
SET = "doc_id bigint, row bigint, id bigint, fp bigint, n int, prefix array<int>, sketch array<bigint>"


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; that of no words if it has none."""
    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes).view(np.int64) if len(hashes) else np.zeros(1, np.int64)


def set_id(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes()))


def prefix_of(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles by count in the sample, then hash, as 32-bit hashes: those that share one only add candidates. ``common`` ascends."""
    n = len(hashes)
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, counts[at], 0)
    return (hashes[np.lexsort((hashes, seen))][: n - math.ceil(similarity * n - 1e-9) + 1] >> 32).astype(np.int32)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parities of the shingles in 2048 classes: two sets differ in at least as many shingles as these do in bits."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(53)).astype(np.int64), minlength=2048) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def repeated_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that a sample of the documents repeats."""

    def make():
        return lambda batch: {"sets": pa.array([shingle_set(t, shingle) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))}

    some = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = map_columns(some, "sets array<bigint>", make).select(F.explode("sets").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = counted.orderBy(F.col("n").desc(), "h").limit(REPEATED).toPandas().sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def described(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, row, and of the text's shingle set the id, fingerprint, size and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_shingles(docs, shingle))

    def make():
        common, counts = shared.value

        def one(batch):
            sets = [shingle_set(t, shingle) for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "row": batch["row"], "id": [set_id(s) for s in sets], "fp": [signed(majority(s.view(np.uint64))) for s in sets], "n": [len(s) for s in sets], "prefix": pa.array([prefix_of(s, similarity, common, counts) for s in sets], pa.list_(pa.int32())), "sketch": [parities(s) for s in sets]}

        return one

    return map_columns(docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row"), text_of().alias("text")), SET, make)


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float, where: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are similar enough; ``where`` has a row of each id."""

    def make():
        return lambda batch: {"id": batch["id"], "hashes": pa.array([shingle_set(t, shingle) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))}

    marks = where.groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    side = lambda end: marks.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch"))
    n, m = F.col("a_n"), F.col("b_n")
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, k: t + k)
    # similar sets have similarity * (n + m) / (1 + similarity) in common, so they differ in no more than the rest
    most = n + m - 2 * F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    pairs = cut(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(differ <= most).select("a", "b"))
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    n = needed.count()
    one = cut(where.join(bounded(needed, 32 * n), "id").groupBy("id").agg(F.min("row").alias("row")))
    texts = docs.select(row_key().alias("row"), text_of().alias("text")).join(bounded(one, 48 * n), "row")
    sets = cut(map_columns(texts.select("id", "text"), "id bigint, hashes array<bigint>", make).repartition("id").dropDuplicates(["id"]))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where(common * (1 + similarity) >= similarity * (F.size("x") + F.size("y")) - 1e-9).select("a", "b"))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets under one fingerprint or under linked ones, through the smallest set of each."""
    least = sets.groupBy("fp").agg(F.min("id").alias("b"))
    same = sets.join(least, "fp").select(F.col("id").alias("a"), "b")
    linked = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    return cut(same.unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b").distinct())


def possible(similarity: float):
    """Whether sizes and positions of x and y under a shared shingle leave enough in common."""
    most = F.least("x.at", "y.at") + 1 + F.least(F.col("x.n") - F.col("x.at") - 1, F.col("y.n") - F.col("y.at") - 1)
    return most * (1 + similarity) >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-9


def similar_links(docs: DataFrame, marked: DataFrame, shingle: int, similarity: float, large: int) -> DataFrame:
    """Links (a, b) of set ids whose components are those of all pairs that are similar enough."""
    sets = marked.groupBy("id").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    found = verified(docs, fingerprint_pairs(sets.select("id", "fp")), shingle, similarity, marked)
    postings = sets.select("id", "n", F.posexplode("prefix").alias("at", "key"))
    shared = cut(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    postings = cut(postings.join(bounded(shared, 40 * shared.count()), "key"))

    def placed() -> DataFrame:
        """Postings under the keys that have several components, each with its own."""
        roots = cut(components(found).withColumnRenamed("node", "id"))
        own = postings.join(bounded(roots, 40 * roots.count()), "id", "left").withColumn("component", F.coalesce("root", "id")).drop("root")
        split = cut(own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
        return cut(own.join(bounded(split, 32 * split.count()), "key"))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & possible(similarity))
        return cut(met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())

    if not postings.where(F.col("size") > large).isEmpty():
        some = placed().where(F.col("size") > large)
        hubs = some.groupBy("key").agg(F.min_by(F.struct("id", "n", "at", "component"), F.xxhash64("id")).alias("h")).select("key", "h.*")
        found = cut(found.unionByName(verified(docs, pairs(some, hubs), shingle, similarity, marked)))
    rest = placed()
    most = rest.groupBy("key").agg(F.mode("component", deterministic=True).alias("most"))
    outside = rest.join(most, "key").where("component <> most").drop("most")
    return found.unionByName(verified(docs, pairs(outside, rest), shingle, similarity, marked))


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, large: int = LARGE_GROUP) -> DataFrame:
    """The documents with all their columns, one row kept of each component of similar texts; which one is as in ``simhash.deduplicate``."""
    marked = cut(described(docs, shingle, similarity))
    roots = components(similar_links(docs, marked, shingle, similarity, large)).withColumnRenamed("node", "id")
    group = marked.select("doc_id", "row", "id").join(roots, "id", "left").withColumn("component", F.coalesce("root", "id")).withColumn("no_id", F.col("doc_id").isNull())
    best = group.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("best")).select(F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"))
    copies = marked.groupBy("doc_id", "row").agg(F.count("*").alias("copies"))
    keep = cut(best.join(copies, (F.col("best_row") == F.col("row")) & F.col("best_id").eqNullSafe(F.col("doc_id"))).select("best_id", "best_row", "copies"))
    # all columns travel in one, so that none of their names can clash; only rows that are repeated are shuffled
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"))
    kept = rows.join(bounded(keep, 48 * keep.count()), (F.col("row") == F.col("best_row")) & F.col("id").eqNullSafe(F.col("best_id")))
    once = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["row", "best_id"]))
    return once.select(*[F.col(f"all.`{c}`") for c in docs.columns])
