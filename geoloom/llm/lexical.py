"""Ranked lexical search over a document FP-tree.

Each document becomes the vector of its query terms with their frequencies. The
documents are dealt into shards of a bounded number of postings. In a shard
every vector is ordered by descending document frequency, so vectors share the
paths of one trie: a node stands for the documents that begin with its path, a
path without branches is one node, and documents stay at the node where they end
or where few are left. Each node has the largest frequency of every term and
the least ``m`` below it. As a term's part of a score rises with its frequency
and falls with ``m``, these give a bound of all scores below a node. An item
searches the trie depth first, the best child first: what a node keeps is
scored, and subtrees whose bound doesn't reach the item's k-th score so far, or
reaches it with larger doc_ids only, are never entered. Each shard gives at
most k documents an item; Spark merges them.

Items are taken in blocks of a bounded number of terms, so that what is
broadcast (terms, their frequencies, items) is bounded; more items mean more
passes. Numbers of the whole corpus (N, L, df) are Spark aggregates.

Edge cases: null or termless text takes no part and counts in no number; rows
are documents of their own, also if repeated; a null doc_id comes after all
others among equal scores; rows under one item_id are one item; items without
terms, or whose terms no document holds, have no rows; empty tables give no
rows; other columns are passed over. A term of very many occurrences and a very
long text are no special case; sums beyond 64 bits raise an error in ``L``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_columns, shards_for

#: Bytes that end a term become blanks, A-Z become lower case, all others stay.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Postings of a shard, (item, term) rows of a block of items, documents that stay together in a node.
SHARD_POSTINGS, BLOCK_TERMS, LEAF = 1_000_000, 200_000, 32
#: Nodes that a step of a search takes from the top of its stack.
STEP = 24
#: Stands for a null doc_id, which no 64-bit id can exceed.
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class FPTree:
    """The trie of a shard: ``doc_ids`` (int64), ``m`` (int64), and postings (doc, term, tf) with terms numbered by descending frequency."""

    def __init__(self, doc_ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: int, leaf: int = LEAF) -> None:
        self.doc_ids, self.m, self.terms = doc_ids, m, terms
        order = np.argsort(doc * terms + term, kind="stable")
        self.doc_keys, self.doc_tf = (doc * terms + term)[order], tf[order]
        doc, term = doc[order], term[order]
        self._grow(len(doc_ids), doc, term, leaf)
        self._bound(doc, term, self.doc_tf)

    def _grow(self, n: int, doc: np.ndarray, term: np.ndarray, leaf: int) -> None:
        """Nodes level by level; ``at`` is the node where each document stays."""
        start = np.searchsorted(doc, np.arange(n + 1))
        length = np.diff(start)
        at, parent, level = np.zeros(n, np.int64), [np.array([-1])], [np.array([0])]
        active, depth, count = np.arange(n), 0, 1
        while len(active):
            size = np.bincount(at[active], minlength=count)
            active = active[(size[at[active]] > leaf) & (length[active] > depth)]
            if not len(active):
                break
            key = at[active] * self.terms + term[start[active] + depth]
            keys, which, members = np.unique(key, return_inverse=True, return_counts=True)
            above = keys // self.terms
            # a child with all documents of its node is the same node, one step further down the path
            fresh = members < size[above]
            name = np.where(fresh, count + np.cumsum(fresh) - 1, above)
            at[active] = name[which]
            depth += 1
            if fresh.any():
                parent.append(above[fresh])
                level.append(np.full(int(fresh.sum()), len(level)))
                count += int(fresh.sum())
        self.at, self.parent, self.level = at, np.concatenate(parent), np.concatenate(level)
        by_node, by_parent = np.argsort(at, kind="stable"), np.argsort(self.parent, kind="stable")
        self.own, self.own_start = by_node, np.searchsorted(at[by_node], np.arange(count + 1))
        self.child, self.child_start = by_parent, np.searchsorted(self.parent[by_parent], np.arange(count + 1))

    def _bound(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Largest frequencies, least m and least doc_id of each subtree, from the leaves up."""
        count = len(self.parent)
        self.least_m, self.least_id = np.full(count, LAST), np.full(count, LAST)
        np.minimum.at(self.least_m, self.at, self.m)
        np.minimum.at(self.least_id, self.at, self.doc_ids)
        own_key, first = self.at[doc] * self.terms + term, np.argsort(self.at[doc], kind="stable")
        edges = np.searchsorted(self.level[self.at[doc][first]], np.arange(self.level[-1] + 2)) if len(doc) else np.zeros(self.level[-1] + 2, np.int64)
        waiting: list[list] = [[] for _ in range(self.level[-1] + 1)]
        keys, most = [], []
        for depth in range(self.level[-1], -1, -1):
            some = first[edges[depth] : edges[depth + 1]]
            waiting[depth].append((own_key[some], tf[some]))
            key, value = (np.concatenate(x) for x in zip(*waiting[depth], strict=True))
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            key, value = key[heads], np.maximum.reduceat(value, heads) if len(heads) else value
            keys.append(key)
            most.append(value)
            waiting[depth] = []
            if depth:
                up = self.parent[key // self.terms]
                for d in np.unique(self.level[up]):
                    there = self.level[up] == d
                    waiting[d].append((up[there] * self.terms + key[there] % self.terms, value[there]))
                nodes = np.flatnonzero(self.level == depth)
                np.minimum.at(self.least_m, self.parent[nodes], self.least_m[nodes])
                np.minimum.at(self.least_id, self.parent[nodes], self.least_id[nodes])
        self.node_keys, self.node_tf = np.concatenate(keys[::-1]), np.concatenate(most[::-1])

    def _sum(self, keys: np.ndarray, tfs: np.ndarray, rows: np.ndarray, m: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        wanted = rows[:, None] * self.terms + terms
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        tf = np.where(keys[place] == wanted, tfs[place], 0)
        return (weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[:, None]))).sum(axis=1)

    def _ranges(self, starts: np.ndarray, nodes: np.ndarray, what: np.ndarray) -> np.ndarray:
        low, size = starts[nodes], starts[nodes + 1] - starts[nodes]
        return what[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """doc_ids and scores of the best k, and how many documents were scored."""
        ids, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not len(self.doc_keys):
            return ids, scores, scored
        nodes = np.zeros(1, np.int64)
        stack = [(nodes, self._sum(self.node_keys, self.node_tf, nodes, self.least_m[nodes], terms, weights))]
        while stack:
            nodes, bounds = stack.pop()
            worst, last = (scores[-1], ids[-1]) if len(ids) == k else (0, LAST)
            open_ = (bounds > worst) | ((bounds == worst) & (worst > 0) & (self.least_id[nodes] < last))
            nodes, bounds = nodes[open_], bounds[open_]
            if len(nodes) > STEP:
                stack.append((nodes[:-STEP], bounds[:-STEP]))
                nodes = nodes[-STEP:]
            if not len(nodes):
                continue
            docs = self._ranges(self.own_start, nodes, self.own)
            if len(docs):
                scored += len(docs)
                found = self._sum(self.doc_keys, self.doc_tf, docs, self.m[docs], terms, weights)
                some = (found > 0) & (found >= worst)
                ids, scores = np.concatenate([ids, self.doc_ids[docs[some]]]), np.concatenate([scores, found[some]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            below = self._ranges(self.child_start, nodes, self.child)
            if len(below):
                bounds = self._sum(self.node_keys, self.node_tf, below, self.least_m[below], terms, weights)
                order = np.argsort(bounds, kind="stable")
                stack.append((below[order], bounds[order]))
        return ids, scores, scored


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its distinct terms."""

    def make():
        def one(batch):
            found = [sorted(set(terms_of(t))) for t in batch["text"].to_pylist()]
            return {"item_id": batch["item_id"], "terms": pa.array(found, pa.list_(pa.binary()))}

        return one

    ready = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull())
    return map_columns(ready, "item_id bigint, terms array<binary>", make).select("item_id", F.explode("terms").alias("term")).distinct()


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, salt, n (all terms of the text), and the numbers and frequencies of those of ``terms`` that it holds."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def make():
        number = known.value

        def one(batch):
            ns, ids, tfs = [], [], []
            for text in batch["text"].to_pylist():
                counts = Counter(terms_of(text or b""))
                ns.append(counts.total())
                held = counts.keys() & number.keys()
                ids.append([number[t] for t in held])
                tfs.append([counts[t] for t in held])
            return {"doc_id": batch["doc_id"], "salt": list(range(len(ns))), "n": ns, "ids": pa.array(ids, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))}

        return one

    ready = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_columns(ready, "doc_id bigint, salt int, n bigint, ids array<int>, tfs array<bigint>", make)


def _block(docs: DataFrame, rows: list, k: int, shard_postings: int, leaf: int) -> DataFrame:
    """item, doc_id, score: for the (item_id, term) rows of one block of items, the best k of each shard."""
    spark = docs.sparkSession
    terms = sorted({bytes(r.term) for r in rows})
    found = cut(vectors(docs, terms))
    total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words"), F.sum(F.size("ids")).alias("postings")).first()
    n_docs, words = total.docs, int(total.words or 0)
    df = {r.t: r.df for r in found.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    by_frequency = sorted(df, key=lambda t: (-df[t], terms[t]))
    rank = np.full(len(terms), -1, np.int64)
    rank[by_frequency] = np.arange(len(by_frequency))
    number = {t: i for i, t in enumerate(terms)}
    item_sets: dict = {}
    for r in rows:
        if (t := rank[number[bytes(r.term)]]) >= 0:
            item_sets.setdefault(r.item_id, []).append(t)
    weights = np.array([weight(n_docs, df[t]) for t in by_frequency], np.int64)
    shared = spark.sparkContext.broadcast((rank, weights, [(i, np.array(sorted(t), np.int64)) for i, t in item_sets.items()]))

    def run(table: pa.Table) -> pa.Table:
        rank, weights, items = shared.value
        ids, tfs = table["ids"].combine_chunks(), table["tfs"].combine_chunks()
        doc = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
        m = np.array([100 - 50 + 50 * n * n_docs // words for n in table["n"].to_pylist()], np.int64)
        tree = FPTree(table["doc_id"].fill_null(LAST).to_numpy(), m, doc, rank[ids.flatten().to_numpy()], tfs.flatten().to_numpy(), len(weights), leaf)
        out = []
        for item, terms in items:
            held, scores, _ = tree.search(terms, weights[terms], k)
            out.append((item, held, scores))
        sizes = [len(x[1]) for x in out]
        whole = np.concatenate([x[1] for x in out])
        item_ids = pa.array([x[0] for x in out], pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), sizes)))
        return pa.table({"item_id": item_ids, "doc_id": pa.array(whole, mask=whole == LAST), "score": pa.array(np.concatenate([x[2] for x in out]))})

    if not item_sets:
        return spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    shards = shards_for(total.postings, shard_postings)
    dealt = found.where(F.size("ids") > 0).withColumn("shard", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    pairs = cut(item_terms(items))
    blocks = shards_for(pairs.count(), block_terms)
    found = None
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        part = _block(docs, rows, k, shard_postings, leaf)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
