"""SimHash near-duplicate groups through pigeonhole blocks.

Each text becomes a 64-bit fingerprint of its word shingles. Fingerprints are
made distinct first, so copies cost one row. A fingerprint is split into
``distance + 2`` blocks; two that differ in at most ``distance`` bits agree in
at least two blocks, so the join keys are pairs of blocks, and the Hamming
distance is verified on what the join brings together.

A block key that many distinct fingerprints share would bring together all
pairs of them. Such a group is not joined pair by pair: each member is written
under itself and its one-bit neighbours outside the shared blocks. Two members
differ in at most two bits exactly if they meet under one of these, so linking
each member to the smallest there keeps every link's component with rows in
proportion to the group. This needs a distance of 2 or less; beyond that all
groups are joined.

Components come from alternating rounds over the link table, where every node
points its larger neighbours, then its smaller ones, at the smallest; each
round is cut by a reliable checkpoint.

Edge cases: null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all; null doc_ids never
become a component's smallest id unless all ids in it are null; repeated rows
share a fingerprint; extra columns are passed over.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, map_columns, row_key, text_of

#: Distinct fingerprints under a key from which the key's group is linked through neighbours.
LARGE_GROUP = 24
#: Bit i of byte b, for counting set bits by byte value.
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for byte in range(8):
        ones = np.bincount(lanes[:, byte], minlength=256) @ BITS
        for bit in range(8):
            if 2 * int(ones[bit]) > len(hashes):
                out |= 1 << 8 * byte + bit
    return out


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, *keep: str) -> DataFrame:
    """doc_id, the long columns of ``keep``, and the text's fingerprint as a signed long."""

    def make():
        def one(batch):
            found = [fingerprint(t, shingle) for t in batch["text"].to_pylist()]
            return {c: batch[c] for c in ("doc_id", *keep)} | {"fp": [x - (1 << 64) if x >> 63 else x for x in found]}

        return one

    out = "".join(f"{c} bigint, " for c in ("doc_id", *keep)) + "fp bigint"
    return map_columns(docs.select(F.col("doc_id").cast("bigint"), *keep, text_of().alias("text")), out, make)


def block_masks(distance: int) -> list[int]:
    """Masks of all pairs of distance + 2 blocks of the 64 bits."""
    edges = [round(i * 64 / (distance + 2)) for i in range(distance + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, distance: int = 2, large: int = LARGE_GROUP) -> DataFrame:
    """Links (a > b) between distinct fingerprints whose components are those of all close pairs."""
    masks = [signed(m) for m in block_masks(distance)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["block", "key"]))
    least = large if distance <= 2 else 1 << 62
    few = shared.where(F.col("n") <= least)
    pairs = (
        few.alias("x").join(few.select("block", "key", F.col("fp").alias("other")).alias("y"), ["block", "key"])
        .where((F.col("fp") > F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    if distance > 2:
        return pairs.distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("block") + 1)
    near = (
        shared.where(F.col("n") > least)
        .select("fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(mask) == 0)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).distinct()
    )
    hubs = near.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("at", "b")
    starred = near.join(hubs, "at").where((F.col("fp") > F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance))
    return pairs.unionByName(starred.select(F.col("fp").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and the smallest node of its component, for all nodes that have a link (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").distinct())
        seen, edges = state, after
        state = _state(edges)
        if state == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _grouped(marked: DataFrame, distance: int) -> DataFrame:
    """``marked`` with its component's smallest fingerprint and smallest doc_id."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = components(links(distinct.select("fp"), distance))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    ids = roots.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return marked.join(roots.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, and component_id: the smallest doc_id that links of at most ``distance`` bits reach."""
    return _grouped(cut(fingerprints(docs, shingle)), distance).select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicate(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The documents with all their columns, one row kept of each group.

    The smallest doc_id stays (a null one only if the group has no other), of
    several texts under it the one with the smallest hash, of repeated rows one.
    """
    columns, docs = docs.columns, docs.withColumn("__row_key", row_key())
    marked = cut(fingerprints(docs, shingle, "__row_key"))
    group = _grouped(marked, distance).withColumn("no_id", F.col("doc_id").isNull())
    keep = group.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "__row_key")).alias("best")).select("best.__row_key")
    return docs.join(keep, "__row_key", "left_semi").dropDuplicates(["__row_key"]).select(columns)
