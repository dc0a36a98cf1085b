"""Near-duplicate vectors through an inverted multi-index.

Both halves of the (normalised) vectors have a codebook of their own; a vector's
cell is its pair of nearest codewords, so the cells are the product grid of the
codebooks. Each vector visits the cells nearest to it in the order of a
multi-sequence traversal of its two sorted lists of distances, until the summed
distance exceeds that of its own cell by a fixed amount. That amount is measured
on the sample the codebooks are fitted to: neighbours at exactly the wanted
cosine are made of its vectors, towards other vectors and into directions at
random, and the amount is what finds the wanted share (``recall``) of them.
Real neighbours are closer, so the share found is larger. The sample is bounded
(``SAMPLE`` vectors); every vector is indexed and visits cells.

What meets in a cell is verified by its cosine in double precision. Equal vectors
are made one with a multiplicity first. Members and visitors of a cell are dealt
into blocks, so a cell of any size is done in tasks of bounded size; a task
gives one row a vector: how many vectors it is linked with there, and one link
to the smallest vector of its component within the task. A pair that meets
in both of its cells is counted in one of them for either side. Components are
those of these links. There is no limit on visits, members or links.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do rows without vec_id; missing components of
shorter vectors count as zero; repeated rows, and rows that share a vec_id, are
vectors of their own; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns, shards_for
from .simhash import components

#: Vectors that the codebooks are fitted to, mean vectors of a cell, most codewords of a half.
SAMPLE, PER_CELL, MOST_WORDS = 16_384, 128, 1024
#: Members and visitors of a block, visitors compared at once, synthetic neighbours for each kind of direction.
BLOCK, STRIP, TRIALS = 4096, 512, 4096


def split(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id and v of the vectors that can link, and vec_id of the others; v keeps single precision if the input has no more."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0)
    links = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    return rows.where(links), rows.where(~links).select("vec_id")


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of lists, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    out = np.zeros((len(column), width))
    if (length == width).all():
        out[:] = flat.reshape(len(column), width)
    else:
        out[np.repeat(np.arange(len(column)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a word without vectors takes the vector that is farthest from its own."""
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = squared(x, words)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        words[empty] = x[np.argsort(d[np.arange(len(x)), near])[::-1][: len(empty)]]
    return words


class MultiIndex:
    """Codebooks of both halves, and how far beyond its own cell's distance a vector goes on."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.half = -(-sample.shape[1] // 2)
        self.k = min(k, len(sample))
        self.words = [codebook(x, self.k, rng) for x in self.halves(sample)]
        self.reach = self._calibrated(sample, cosine, recall, rng)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (squared(part, words) for part, words in zip(self.halves(x), self.words, strict=True))
        return a, b

    def _calibrated(self, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> float:
        if self.k == 1 or sample.shape[1] == 1:
            return 0.0
        x = sample[rng.integers(len(sample), size=TRIALS)]
        reach = 0.0
        for toward in (rng.normal(size=x.shape), sample[rng.integers(len(sample), size=TRIALS)]):
            side = toward - (toward * x).sum(1)[:, None] * x
            size = np.linalg.norm(side, axis=1)
            some = size > 1e-9
            y = cosine * x[some] + math.sqrt(max(0, 1 - cosine**2)) * side[some] / size[some, None]
            if not len(y):
                continue
            p, q = self.distances(x[some]), self.distances(y)
            beyond = lambda p, q: sum(d[np.arange(len(d)), e.argmin(1)] - d.min(1) for d, e in zip(p, q, strict=True))
            reach = max(reach, float(np.quantile(np.minimum(beyond(p, q), beyond(q, p)), recall)))
        return reach

    def traverse(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, float]]:
        """Cells by ascending summed distance; a and b are a vector's distances to the words of either half."""
        i_words, j_words = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i_words].tolist(), b[j_words].tolist()
        i_words, j_words = i_words.tolist(), j_words.tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            total, i, j = heapq.heappop(heap)
            yield i_words[i] * self.k + j_words[j], total
            # each cell is reached once: downwards from the first column, to the right from everywhere
            if j + 1 < self.k:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each vector visits, its own first."""
        out = []
        for a, b in zip(*self.distances(x), strict=True):
            cells, most = [], math.inf
            for cell, total in self.traverse(a, b):
                if total > most:
                    break
                if not cells:
                    most = total + self.reach
                cells.append(cell)
            out.append(cells)
        return out


def linked_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the smallest place of each component; ``label`` are those before."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]


def meet(visitors: pa.Table, members: pa.Table, width: int, cosine: float) -> dict:
    """What a block of visitors and a block of members of one cell have in common: node, links found, and a link to ``root``."""
    q, c = rows_of(visitors["v"], width), rows_of(members["v"], width)
    q_node, c_node = visitors["node"].to_numpy(), members["node"].to_numpy()
    q_m, c_m = visitors["m"].to_numpy().astype(np.float64), members["m"].to_numpy().astype(np.float64)
    nodes, place = np.unique(np.concatenate([q_node, c_node]), return_inverse=True)
    q_at, c_at = place[: len(q)], place[len(q) :]
    cells, q_cell = np.unique(visitors["own"].to_numpy(), return_inverse=True)
    lists = members["cells"].combine_chunks()
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(c)), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
    known = cells[at] == flat
    back = np.zeros((len(c), len(cells)), bool)  # whether a member visits the cells of the visitors itself
    back[row[known], at[known]] = True
    links, label = np.zeros(len(nodes)), np.arange(len(nodes))
    for start in range(0, len(q), STRIP):
        some = slice(start, start + STRIP)
        near = (q[some] @ c.T >= cosine) & (q_node[some, None] != c_node)
        if not near.any():
            continue
        np.add.at(links, q_at[some], near @ c_m)
        np.add.at(links, c_at, q_m[some] @ (near & ~back[:, q_cell[some]].T))
        x, y = np.nonzero(near)
        label = linked_labels(label, q_at[some][x], c_at[y])
    out = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
    return {"node": nodes[out], "links": links[out].astype(np.int64), "root": nodes[label[out]]}


def _fitted(distinct: DataFrame, total: int, cosine: float, recall: float, per_cell: int, width: int) -> MultiIndex:
    k = min(MOST_WORDS, max(1, math.isqrt(total // per_cell)))
    rows = distinct.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toArrow()
    return MultiIndex(rows_of(rows["v"], width), k, cosine, recall)


def _met(distinct: DataFrame, index: MultiIndex, width: int, cosine: float) -> DataFrame:
    """node, links and root from all blocks of all cells."""
    kind = dict(distinct.dtypes)["v"]
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def make():
        def one(batch):
            cells = shared.value.visits(rows_of(batch["v"], width))
            return {"node": batch["node"], "m": batch["m"], "v": batch["v"], "own": [x[0] for x in cells], "cells": pa.array(cells, pa.list_(pa.int32()))}

        return one

    placed = cut(map_columns(distinct, f"node bigint, m bigint, v {kind}, own int, cells array<int>", make))
    members = placed.select(F.col("own").alias("cell"), *[F.col(c).alias(c) for c in ("node", "m", "v", "cells")])  # under new names inside: a cogroup asks for it
    visitors = placed.select("node", "m", "v", "own", F.explode("cells").alias("cell"))
    # at most MOST_WORDS squared rows
    sizes = members.groupBy("cell").agg(F.count("*").alias("members")).join(visitors.groupBy("cell").agg(F.count("*").alias("visitors")), "cell")
    blocks = cut(sizes.select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("c_blocks"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("q_blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = visitors.join(blocks, "cell").select("cell", of("q_blocks").alias("qb"), every("c_blocks").alias("cb"), "node", "m", "v", "own")
    right = members.join(blocks, "cell").select("cell", every("q_blocks").alias("qb"), of("c_blocks").alias("cb"), "node", "m", "v", "cells")

    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        if not len(visitors) or not len(members):
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root")})
        return pa.table(meet(visitors, members, width, cosine))

    keys = ("cell", "qb", "cb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, per_cell: int = PER_CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    linking, others = split(vectors)
    rows = cut(linking.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))
    once = rows.groupBy("h", "g").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    distinct = cut(once.withColumn("node", F.monotonically_increasing_id()))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    found = others.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if size.n:
        index = _fitted(distinct, size.n, cosine, recall, per_cell, size.width)
        met = cut(_met(distinct.select("node", "m", "v"), index, size.width, cosine))
        links = met.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(met.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
        joined = distinct.select("h", "g", "m", "least", "node").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
        known = joined.join(least, "root").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
        found = found.unionByName(rows.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
