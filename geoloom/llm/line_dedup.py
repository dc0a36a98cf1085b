"""Line dedup as an exact set-similarity join.

A line is the set of its lower-cased words. It is removed if an earlier line,
by (doc_id, line number, set, text hash), has the same set or one with Jaccard
similarity of at least ``threshold``.

Lines with one set become one class, which is placed by its first line; what has
the set of an earlier line of its batch is removed there and goes no further. The
words of a class are ordered by rarity: by a corpus count of fixed size (words
hashed into ``COUNTERS`` counters, on a logarithmic scale), then by hash, so the
order is the same for all lines. Two similar sets share a word of their prefixes,
so classes are dealt out by prefix word and met there under the length filter,
the positional filter and a bitmap filter (words hashed into 64 parities, 128 for
sets of more than ``WIDE`` words; sets differ in at least as many words as their
bitmaps do in bits). What is left is verified on the words of both lines.

Words that occur once in the corpus get no posting. A word of more than ``HOT``
occurrences is paired with the words that can be the second one that two similar
sets share, so no posting list of a single word has more classes than that. Postings are packed
by parts, ranges of their keys that hold about ``PART`` of them, so what is shuffled
are a few rows with many postings each.

A class needs only one earlier match. Under a key of up to ``FEW`` classes all of
them are held against each other. Under others each class is held against the
earliest one first, and only those that the filters tell apart from it are held
against the rest there. Classes whose candidates fail, though the filters took them
for copies of the earliest one, and those of lists over ``LONG_LIST``, are then held
against all earlier classes under their keys. So a group of thousands of variants
isn't joined pair by pair, and no link that could decide is left out.

Edge cases: null text is empty text; lines without words always stay; documents
equal in doc_id and text are one document written twice and keep the same lines;
a document that loses all lines becomes the empty text; null doc_ids come before
all others; extra columns stay as they are under any name; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, bounded, cut, map_columns, row_key, shards_for, text_of

THRESHOLD, COUNTERS = 0.8, 1 << 18
#: Steps of the logarithmic count for a doubling, and the step from which a word is paired (4096 occurrences).
STEPS, HOT = 8, 96
#: Classes under one key that are all held against each other, and those that are in one task's memory.
FEW, LONG_LIST = 256, 20_000
#: Pairs that are verified at once.
FEW_PAIRS = 1 << 15
#: Words from which a set's bitmap has 128 bits; sizes and positions that go into 16 bits.
WIDE, MOST = 48, (1 << 16) - 1
#: Postings of a part, which one task holds, those that a task packs at once, and those of a part from which long lists are cut.
PART, PACKED, HELD = 1 << 19, 1 << 18, 1 << 21
#: Lines whose postings are spread at once.
PACKED_ROWS = 1 << 12
#: Bytes that a hash takes at a time, its masks for the last ones, and the bytes between words.
BLOCK = 8
MASKS = np.array([(1 << 8 * i) - 1 for i in range(BLOCK + 1)], np.uint64)
SMALL = np.frombuffer(LOWER, np.uint8)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hash of 64-bit hashes, another one for each salt."""
    x = x ^ np.uint64(salt)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word of the texts and the number of its text.

    A hash takes a word's length and its blocks of eight bytes one by one, all words at a time.
    """
    _, ends, held = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.zeros(high - low + BLOCK, np.uint8)
    if high > low:
        data[:-BLOCK] = SMALL[np.frombuffer(held, np.uint8)[low:high]]
    inside = np.zeros(high - low + 2, bool)
    inside[1:-1] = ~SPACE[data[:-BLOCK]]
    # words of neighbouring texts may touch
    bounds = offsets - low
    after, before = inside[1:], inside[:-1]
    edge = after != before
    touch = bounds[after[bounds] & before[bounds]]
    edge[touch] = True
    edges = np.flatnonzero(edge)
    if len(touch):
        edges = np.repeat(edges, 1 + (after[edges] & before[edges]))
    start, length = edges[::2], edges[1::2] - edges[::2]
    blocks = np.ndarray(len(data) - BLOCK + 1, np.uint64, data, strides=(1,))
    hashes = mixed(blocks[start] & MASKS[np.minimum(length, BLOCK)], 7)
    hashes += length.view(np.uint64)
    more = np.flatnonzero(length > BLOCK)
    done = BLOCK
    while len(more):
        hashes[more] = mixed(hashes[more], 8) ^ mixed(blocks[start[more] + done] & MASKS[np.minimum(length[more] - done, BLOCK)], 9)
        done += BLOCK
        more = more[length[more] > done]
    return hashes, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds)))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-cased words, and for each word of the texts its place there and the number of its text."""
    hashes, at = hashed_words(texts)
    coded = pa.array(hashes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), at


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the words of each counter occur, on a logarithmic scale (0: once); as large for any corpus."""

    def make():
        total = np.zeros(COUNTERS, np.int64)

        def one(batch):
            hashes, _ = hashed_words(batch["text"])
            total[:] += np.bincount((hashes % np.uint64(COUNTERS)).view(np.int64), minlength=COUNTERS)

        def end():
            used = np.flatnonzero(total)
            return {"counter": used.astype(np.int32), "n": total[used]}

        return one, end

    summed = map_columns(docs.select(text_of().alias("text")), "counter int, n bigint", make).groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.uint8)
    out[summed["counter"].to_numpy()] = np.minimum(STEPS * np.log2(summed["n"].to_numpy(np.float64)), 255)
    return out


def distinct_words(texts: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct words of each text, by text, then rarity."""
    hashes, code, at = numbered(texts)
    count = counts[(hashes % np.uint64(COUNTERS)).astype(np.int64)]
    by = count.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
    order = np.argsort(by, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = np.sort(at << 32 | rank[code])
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    word = order[keys & 0xFFFFFFFF]
    return keys >> 32, hashes[word], count[word]


def whole(doc_id: pa.Array) -> np.ndarray:
    """Nulls come before all others."""
    return doc_id.fill_null(np.iinfo(np.int64).min).to_numpy()


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def postings(text: np.ndarray, word: np.ndarray, count: np.ndarray, start: np.ndarray, n: np.ndarray, copy: np.ndarray, threshold: float) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text that is no copy its prefix as keys (0: none), and the keys of pairs (high half) with the number of words before the second word (low half).

    A pair of sets shares need = ceil(threshold * n) words at least. If its first common
    word is at i, the second one is among the n - i - need + 1 words behind that.
    """
    place = np.arange(len(text)) - np.repeat(start, n)
    length = prefix_length(n, threshold)
    # a set of n words can be like another one only if n of n + 1 common words are enough
    length = np.where(~copy & (n >= threshold * (n + 1) - 1e-9), length, 0)
    inside = np.flatnonzero(place < np.repeat(length, n))
    short = np.maximum(mixed(word[inside], 3) >> np.uint64(32), 1).astype(np.uint32).view(np.int32)
    singles = np.where((count[inside] > 0) & (count[inside] < HOT), short, 0)
    hot = inside[count[inside] >= HOT]
    behind = np.minimum(np.repeat(length, n)[hot] - place[hot], np.repeat(n, n)[hot] - place[hot] - 1)
    first = np.repeat(hot, behind)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind)
    key = mixed(word[first], 4) + mixed(word[second], 5) >> np.uint64(32)
    pairs = (key << np.uint64(32)).view(np.int64) | place[second] - 1
    ends = np.r_[text[start], np.iinfo(np.int64).max]
    return tuple(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[owner], ends).astype(np.int32)), pa.array(keys)) for owner, keys in ((inside, singles), (first, pairs)))


def copies(c: np.ndarray, c2: np.ndarray, doc: np.ndarray, line: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which lines have the set of an earlier one among them; lines at one place in equal documents are one line."""
    by = np.argsort(c)
    equal = np.flatnonzero(c[by][1:] == c[by][:-1])
    some = by[np.unique(np.concatenate([equal, equal + 1]))]
    some = some[np.lexsort((key[some], line[some], doc[some], c2[some], c[some]))]
    differs = lambda *columns: np.r_[True, np.any([a[some][1:] != a[some][:-1] for a in columns], 0)]
    out = np.zeros(len(c), bool)
    if len(some):
        first = np.maximum.accumulate(np.where(differs(c, c2), np.arange(len(some)), 0))
        out[some] = np.any([a[some] != a[some[first]] for a in (doc, line, key)], 0)
    return out


LINES = "doc_id bigint, key bigint, line int, c bigint, c2 bigint, n int, lo bigint, hi bigint, copy boolean, posted int, prefix array<int>, pairs array<bigint>"


def line_sets(rows: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Every line that has words: its place, the hashes c and c2 of its set, the set's size and bitmap, and its postings and their number.

    ``copy`` marks lines that have the set of an earlier line of their batch; those have no postings.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def make():
        def one(batch):
            lines = pc.split_pattern(batch["text"], "\n")
            lengths = np.diff(lines.offsets.to_numpy())
            text, word, count = distinct_words(lines.flatten(), shared.value)
            start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
            n = np.diff(np.r_[start, len(text)])
            if not len(start):
                return None
            line = text[start]
            doc = np.repeat(np.arange(len(lines)), lengths)[line]
            number = line - (np.cumsum(lengths) - lengths)[doc]
            c, c2 = (np.add.reduceat(mixed(word, salt), start).view(np.int64) for salt in (1, 2))
            copy = copies(c, c2, whole(batch["doc_id"])[doc], number, batch["key"].to_numpy()[doc])
            prefix, pairs = postings(text, word, count, start, n, copy, threshold)
            posted = np.diff(pairs.offsets.to_numpy()) + np.add.reduceat(np.r_[prefix.values.to_numpy() != 0, False].astype(np.int32), prefix.offsets.to_numpy()[:-1]) * (np.diff(prefix.offsets.to_numpy()) > 0)
            place = mixed(word, 6) >> np.uint64(57)
            bit = np.uint64(1) << (place & np.uint64(63))
            wide = np.repeat(n > WIDE, n) & (place >= 64)
            taken = pa.array(doc)
            return {
                "doc_id": batch["doc_id"].take(taken), "key": batch["key"].take(taken), "line": number.astype(np.int32), "n": n.astype(np.int32),
                "c": c, "c2": c2, "copy": copy, "posted": posted.astype(np.int32),
                "lo": np.bitwise_xor.reduceat(np.where(wide, 0, bit), start).view(np.int64), "hi": np.bitwise_xor.reduceat(np.where(wide, bit, 0), start).view(np.int64),
                "prefix": prefix, "pairs": pairs,
            }

        return one

    return map_columns(rows, LINES, make)


def room(n: np.ndarray, left: np.ndarray, m: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Length and positional filters for sets of n and m words that first meet with so many words left."""
    need = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    return (np.minimum(left, others) >= need) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)


def alike(x: dict, y: dict, threshold: float) -> np.ndarray:
    """Bitmap filter."""
    need = np.ceil(threshold / (1 + threshold) * (x["n"] + y["n"]) - 1e-9)
    both = (x["n"] > WIDE) & (y["n"] > WIDE)
    a, b = (np.where(both, z["lo"], z["lo"] ^ z["hi"]).view(np.uint64) for z in (x, y))
    bits = np.bitwise_count(a ^ b) + np.where(both, np.bitwise_count((x["hi"] ^ y["hi"]).view(np.uint64)), 0)
    return bits <= x["n"] + y["n"] - 2 * need


def might_match_columns(threshold: float) -> Column:
    """Length, positional and bitmap filters as a condition of a join of x and y."""
    x, y = ({c: F.col(f"{side}.{c}") for c in ("n", "pos", "lo", "hi")} for side in "xy")
    need = F.ceil(threshold / (1 + threshold) * (x["n"] + y["n"]) - 1e-9)
    shorter = F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"]) - 1e-9
    left = [F.when(z["n"] < MOST, z["n"] - z["pos"] - 1).otherwise(MOST) for z in (x, y)]
    wide = F.bit_count(x["lo"].bitwiseXOR(y["lo"])) + F.bit_count(x["hi"].bitwiseXOR(y["hi"]))
    folded = F.bit_count(x["lo"].bitwiseXOR(x["hi"]).bitwiseXOR(y["lo"].bitwiseXOR(y["hi"])))
    bits = F.when((x["n"] > WIDE) & (y["n"] > WIDE), wide).otherwise(folded)
    return shorter & (1 + F.least(*left) >= need) & (bits <= x["n"] + y["n"] - 2 * need)


def spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, at) of the postings of a batch of lines; at is line, n and pos in 32, 16 and 16 bits."""
    prefix, pairs = batch["prefix"], batch["pairs"]
    sizes = [np.diff(lists.offsets.to_numpy()) for lists in (prefix, pairs)]
    row, second = (np.repeat(np.arange(batch.num_rows), size) for size in sizes)
    key, pair = (lists.flatten().to_numpy() for lists in (prefix, pairs))
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes[0]) - sizes[0], sizes[0])
    some = key != 0
    row, key = np.concatenate([row[some], second]), np.concatenate([key[some], (pair >> 32).astype(np.int32)])
    pos = np.minimum(np.concatenate([pos[some], pair & 0xFFFFFFFF]), MOST)
    at = batch["line"].to_numpy().astype(np.int64) << 32 | np.minimum(batch["n"].to_numpy(), MOST).astype(np.int64) << 16
    return row, key, at[row] | pos


def postings_of(lines: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A row for each posting of the lines, or for those under one of the keys."""
    wanted = None
    if keys is not None and 4 * keys.count() <= BROADCAST_BYTES:
        wanted = lines.sparkSession.sparkContext.broadcast(np.unique(keys.toPandas()["word"].to_numpy(np.int32)))

    def make():
        def one(batch):
            row, key, at = spread(batch)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted.value, key), max(len(wanted.value) - 1, 0))
                some = wanted.value[place] == key if len(wanted.value) else np.zeros(len(key), bool)
                row, key, at = row[some], key[some], at[some]
            taken = pa.array(row)
            return {"word": key, "at": at} | {k: batch[k].take(taken) for k in ("doc_id", "c", "lo", "hi")} if len(key) else None

        return one

    listed = map_columns(_with_postings(lines), "word int, doc_id bigint, at bigint, c bigint, lo bigint, hi bigint", make, PACKED_ROWS)
    return listed if keys is None or wanted is not None else listed.join(keys, "word", "left_semi")


def _with_postings(lines: DataFrame) -> DataFrame:
    return lines.where("posted > 0").select("doc_id", "line", "n", "c", "lo", "hi", "prefix", "pairs")


def packed(lines: DataFrame) -> DataFrame:
    """The postings by parts, ranges of their keys: (part, packed), many postings a row, column after column.

    Parts hold about ``PART`` postings, however many there are in all.
    """
    parts = shards_for(lines.agg(F.sum("posted")).first()[0], PART)

    def make():
        held: list[list[np.ndarray]] = []

        def flush():
            if not held:
                return None
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            key = columns[0].view(np.uint32)
            by = np.argsort(key)
            columns = [x[by] for x in columns]
            part = key[by].astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(first, np.r_[first[1:], len(part)], strict=True)]
            return {"part": part[first].astype(np.int32), "packed": pa.array(rows, pa.binary())}

        def one(batch):
            row, key, at = spread(batch)
            held.append([key, whole(batch["doc_id"])[row], at, *(batch[k].to_numpy()[row] for k in ("c", "lo", "hi"))])
            return flush() if sum(len(x[0]) for x in held) >= PACKED else None

        return one, flush

    return map_columns(_with_postings(lines), "part int, packed binary", make, PACKED_ROWS)


def unpacked(rows: list[bytes]) -> list[np.ndarray]:
    """The columns word, doc_id, at, c, lo and hi of packed postings."""
    sizes = [len(x) // 44 for x in rows]
    columns = [[np.frombuffer(x, np.int32, n) for x, n in zip(rows, sizes, strict=True)]]
    columns += [[np.frombuffer(x, np.int64, n, n * (4 + 8 * i)) for x, n in zip(rows, sizes, strict=True)] for i in range(5)]
    return [np.concatenate(x) for x in columns]


def once(word: np.ndarray, doc: np.ndarray, at: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The earliest line of each set under each key, by key, then size."""
    by = np.argsort(word.view(np.uint32).astype(np.uint64) << np.uint64(32) | c.view(np.uint64) & np.uint64(0xFFFFFFFF))
    same = (word[by][1:] == word[by][:-1]) & (c[by][1:] & 0xFFFFFFFF == c[by][:-1] & 0xFFFFFFFF)
    tied = np.r_[False, same] | np.r_[same, False]
    some = by[tied]
    n = at >> 16 & MOST
    some = some[np.lexsort((at[some] >> 32, doc[some], n[some], hi[some], lo[some], c[some], word[some]))]
    if len(some):
        some = some[np.r_[True, np.any([x[some][1:] != x[some][:-1] for x in (word, c, lo, hi, n)], 0)]]
    kept = np.concatenate([by[~tied], some])
    return kept[np.argsort(word[kept].view(np.uint32).astype(np.int64) << 16 | n[kept])]


def candidates(parts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of set hashes, x the later one; with y null, x is yet to be held against the others of a list if no pair decides.

    The postings of a part come together, and only one part's are held at once. Of a part with a
    very long list, the list's earliest class is all that is kept of it.
    """

    def make():
        held: list[list[np.ndarray]] = []
        state = {"part": None, "limit": HELD}
        long: set[int] = set()

        def groups(word, doc, at, c, lo, hi) -> list[np.ndarray]:
            # in a list, classes stand by size, so those of like size stand together
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            key = np.repeat(np.arange(len(start)), size) << 32 | at >> 16 & MOST
            own, line = {"lo": lo, "hi": hi, "n": at >> 16 & MOST}, at >> 32
            left = np.where(own["n"] < MOST, own["n"] - (at & MOST), MOST)
            long_one, whole = np.repeat((size > LONG_LIST) | np.isin(word[start], [*long]), size), np.repeat(size <= FEW, size)
            whole &= ~long_one
            pairs = []

            def compare(x, y):
                """Which of the pairs might match; those are kept."""
                far = np.flatnonzero(room(own["n"][x], left[x], own["n"][y], left[y], threshold))
                x, y = x[far], y[far]
                near = alike(*({k: a[z] for k, a in own.items()} for z in (x, y)), threshold)
                return far[near], x[near], y[near]

            def meet(x, first, others):
                """Each x against the next so many of the others from the first on, in slices of bounded size."""
                ends = np.cumsum(others)
                for low in range(0, int(ends[-1]) if len(ends) else 0, 1 << 18):
                    high = min(low + (1 << 18), int(ends[-1]))
                    rows = np.arange(np.searchsorted(ends, low, "right"), np.searchsorted(ends, high) + 1)
                    begins = ends[rows] - others[rows]
                    row = np.repeat(rows, np.minimum(ends[rows], high) - np.maximum(begins, low))
                    yield x[row], np.arange(low, high) + (first - ends + others)[row]

            earliest = np.flatnonzero(~whole & (doc == np.repeat(np.minimum.reduceat(doc, start), size)))
            earliest = earliest[np.lexsort((c[earliest], line[earliest], key[earliest] >> 32))]
            lead = np.full(len(start), -1)
            lead[key[earliest[::-1]] >> 32] = earliest[::-1]
            lead = np.repeat(lead, size)
            later = np.flatnonzero(~whole & (lead != np.arange(len(word))))
            hit, x, y = compare(later, lead[later])
            pairs.append((x, y))
            near = np.zeros(len(word), bool)
            near[later[hit]] = True
            undecided = c[later[near[later] | long_one[later]]]
            open_ = ~near & ~long_one & (lead != np.arange(len(word)))
            # open classes meet those before them in the list, and those after them that aren't open
            x = np.flatnonzero(open_)
            first = np.searchsorted(key, key[x] >> 32 << 32 | np.ceil(threshold * own["n"][x] - 1e-9).astype(np.int64))
            for x, y in meet(x, first, np.maximum(x - first, 0)):
                pairs.append(compare(x, y)[1:])
            closed, x = np.flatnonzero(~open_ & ~long_one), np.flatnonzero(open_ & ~whole)
            first = np.searchsorted(closed, x)
            last = np.searchsorted(key[closed], key[x] >> 32 << 32 | np.minimum((own["n"][x] / threshold + 1e-9).astype(np.int64), MOST), "right")
            for x, y in meet(x, first, np.maximum(last - first, 0)):
                pairs.append(compare(x, closed[y])[1:])
            x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
            swap = (doc[x] < doc[y]) | (doc[x] == doc[y]) & ((line[x] < line[y]) | (line[x] == line[y]) & (c[x] < c[y]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            decides = ~near[x] | (y == lead[x])
            x, y = x[decides], y[decides]
            return [np.r_[c[x], undecided], np.r_[c[y], np.zeros(len(undecided), np.int64)], np.arange(len(x) + len(undecided)) >= len(x)]

        def met(last: bool) -> list[list[np.ndarray]]:
            """What comes of the postings held; but for the last ones of a part, only long lists are done."""
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            by = once(*columns)
            columns = [x[by] for x in columns]
            word = columns[0]
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            of_long = (size > LONG_LIST) | np.isin(word[start], [*long])
            done = np.repeat(size > 1 if last else of_long & (size > 1), size)
            out = [groups(*(x[done] for x in columns))] if done.any() else []
            held.clear()
            if last:
                long.clear()
            else:
                long.update(word[start[of_long]].tolist())
                mine = np.flatnonzero(np.repeat(of_long, size))
                mine = mine[np.lexsort((columns[3][mine], columns[2][mine] >> 32, columns[1][mine], word[mine]))]
                lead = mine[np.r_[True, word[mine][1:] != word[mine][:-1]]] if len(mine) else mine
                kept = np.sort(np.concatenate([np.flatnonzero(~np.repeat(of_long, size)), lead]))
                held.append([x[kept] for x in columns])
            return out

        def result(out: list[list[np.ndarray]]) -> dict | None:
            x, y, none = (np.concatenate(z) for z in zip(*out, strict=True)) if out else ([], [], [])
            return {"x": x, "y": pa.array(y, pa.int64(), mask=none)} if len(x) else None

        def one(batch):
            """Parts that have ended are done; the last one waits for its other rows."""
            out, part = [], batch["part"].to_numpy()
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for i, j in zip(first, np.r_[first[1:], len(part)], strict=True):
                if held and state["part"] != part[i]:
                    out += met(True)
                    state["limit"] = HELD
                state["part"] = part[i]
                held.append(unpacked([x.as_py() for x in batch["packed"][i:j]]))
                if (n := sum(len(x[0]) for x in held)) > state["limit"]:
                    out += met(False)
                    state["limit"] = max(HELD, 2 * sum(len(x[0]) for x in held))
            return result(out)

        return one, lambda: result(met(True)) if held else None

    together = parts.repartition("part").sortWithinPartitions("part")
    return map_columns(together, "x bigint, y bigint", make)


def words_of(ends: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(c, c2, place, words) of the classes with set hash c, read from the first line of each."""

    def make():
        once = np.zeros(COUNTERS, np.uint8)

        def one(batch):
            lists = batch["wanted"]
            each = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            split = pc.split_pattern(batch["text"], "\n")
            chosen = split.flatten().take(pa.array(split.offsets.to_numpy()[doc] - split.offsets[0].as_py() + each.field("line").to_numpy()))
            text, word, _ = distinct_words(chosen, once)
            offsets = np.searchsorted(text, np.arange(len(chosen) + 1)).astype(np.int32)
            return {"c": each.field("c"), "c2": each.field("c2"), "doc_id": batch["doc_id"].take(pa.array(doc)), "line": each.field("line"), "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(word.view(np.int64)))}

        return one

    n = ends.count()
    first = lines.where("not copy").select("doc_id", "key", "line", "c", "c2").join(bounded(ends, 32 * n), "c", "left_semi").groupBy("c", "c2").agg(F.min(F.struct("doc_id", "line", "key")).alias("p"))
    wanted = first.groupBy("p.doc_id", "p.key").agg(F.collect_list(F.struct("p.line", "c", "c2")).alias("wanted"))
    found = _of_document(rows, bounded(cut(wanted), 128 * n)).select("doc_id", "text", "wanted")
    words = map_columns(found, "c bigint, c2 bigint, doc_id bigint, line int, words array<bigint>", make)
    return words.select("c", "c2", F.struct("doc_id", "line", "c").alias("place"), "words").repartition("c").dropDuplicates(["c", "c2"])


def _of_document(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` beside what ``other`` has of their document."""
    other = other.withColumnsRenamed({"doc_id": "other_id", "key": "other_key"})
    return rows.join(other, (F.col("key") == F.col("other_key")) & F.col("doc_id").eqNullSafe(F.col("other_id")), how)


def verified(pairs: DataFrame, lines: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The (c, c2) of those x of the pairs whose words are similar enough to the words of an earlier y."""
    words = words_of(cut(pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()), lines, rows)
    left = words.select(F.col("c").alias("x"), "c2", F.col("place").alias("x_place"), F.col("words").alias("xw"))
    right = words.select(F.col("c").alias("y"), F.col("place").alias("y_place"), F.col("words").alias("yw"))
    both = F.size(F.array_intersect("xw", "yw"))
    return pairs.join(left, "x").join(right, "y").where(F.col("y_place") < F.col("x_place")).where(both >= threshold * (F.size("xw") + F.size("yw") - both) - 1e-9).select(F.col("x").alias("c"), "c2").distinct()


def matched(pairs: DataFrame, lines: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """As ``verified``; each x (with n keys in common with y) is first held against the y with most in common, then against its others; up to ``FEW_PAIRS`` pairs are taken at once."""
    if pairs.count() <= FEW_PAIRS:
        return cut(verified(pairs.select("x", "y"), lines, rows, threshold))
    first = cut(pairs.groupBy("x").agg(F.max_by("y", F.struct("n", "y")).alias("y")))
    hits = cut(verified(first, lines, rows, threshold))
    others = cut(pairs.select("x", "y").join(hits.select(F.col("c").alias("x")), "x", "left_anti").join(first, ["x", "y"], "left_anti"))
    return hits if others.isEmpty() else cut(hits.unionByName(verified(others, lines, rows, threshold)))


def _first_of_each(listed: DataFrame) -> DataFrame:
    """One row for a key and class, with its earliest place."""
    once = listed.groupBy("word", "c").agg(F.min(F.struct("doc_id", "at")).alias("place"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    size = lambda shift: F.shiftright("place.at", shift).bitwiseAND(MOST)
    return once.select("word", "c", F.struct("place.doc_id", F.shiftright("place.at", 32).alias("line")).alias("place"), size(16).alias("n"), size(0).alias("pos"), "lo", "hi")


def against_all(open_: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(x, y, n): the classes of ``open_`` and all earlier ones under their keys that might match."""
    mine = lines.join(bounded(open_, 32 * open_.count()), "c", "left_semi")
    xs = cut(_first_of_each(postings_of(mine)))
    ys = _first_of_each(postings_of(lines, xs.select("word")))
    earlier = F.struct("y.place", "y.c") < F.struct("x.place", "x.c")
    met = xs.alias("x").join(ys.alias("y"), (F.col("x.word") == F.col("y.word")) & earlier & might_match_columns(threshold))
    return met.groupBy(F.col("x.c").alias("x"), F.col("y.c").alias("y")).agg(F.count("*").alias("n"))


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, line) of every line that an earlier line removes; key is a hash of doc_id and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), text_of().alias("text"))
    lines = cut(line_sets(rows, rarity(rows), threshold))
    found = cut(candidates(packed(lines), threshold).groupBy("x", "y").agg(F.count("*").alias("n")))
    pairs = found.where("y is not null")
    hits = matched(pairs, lines, rows, threshold)
    open_ = cut(found.where("y is null").select(F.col("x").alias("c")).join(hits, "c", "left_anti"))
    if not open_.isEmpty():
        more = cut(against_all(open_, lines, threshold).join(pairs.select("x", "y"), ["x", "y"], "left_anti"))
        hits = hits.unionByName(matched(more, lines, rows, threshold))
    # a class that is hit is led by its hit, others by their first line; what comes behind is removed
    members = lines.where("not copy").select("c", "c2", "doc_id", "line", "key", F.lit(True).alias("is_line"))
    led = members.unionByName(hits.distinct().withColumn("is_line", F.lit(False)), allowMissingColumns=True)
    behind = led.withColumn("rank", F.rank().over(Window.partitionBy("c", "c2").orderBy("is_line", "doc_id", "line", "key"))).where("is_line and rank > 1")
    return behind.select("doc_id", "key", "line").unionByName(lines.where("copy").select("doc_id", "key", "line"))


def deduplicate_lines(docs: DataFrame, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """The documents with all their columns and repeated lines taken out of text; with ``counted`` n_lines and n_removed follow, in place of columns of those names."""
    gone = cut(removed_lines(docs, threshold).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    size = gone.agg(F.coalesce(F.sum(64 + 4 * F.size("gone")), F.lit(0))).first()[0]
    # all other columns travel in one, so that none of their names can clash
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = _of_document(row, bounded(gone, size), "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    extra = [F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")] if counted else []
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if not counted or c.lower() not in ("n_lines", "n_removed")], *extra)
