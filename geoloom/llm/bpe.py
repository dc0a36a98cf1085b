"""Byte-level BPE encoding and decoding over a public vocabulary.

A text is cut into words by the vocabulary's pattern. A word is held as one
contiguous array of part ids (each id stands for the bytes up to the next part
boundary) beside an array with the rank of every adjacent pair. The encoder
scans the ranks for the minimum, deletes that boundary, and refreshes the ranks
of the two neighbours, until no pair has a rank. Words longer than
``SHORT_WORD`` bytes, where repeated scans would be quadratic, take the same
merges off a heap instead.

Edge cases: null text is empty text and gives no ids; the special token's
string in a text becomes its id, as the tokenizers library does; extra columns
are passed over; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_of

#: The pattern that cuts text into words for this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 60
SHORT_WORD = 256
#: Words whose ids a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes themselves, the rest from 256 upwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 32 | vocab[right], n)
            self.merged.append(vocab[left + right])
        self.words = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if len(word) > SHORT_WORD:
            return self._encode_long(word)
        rank, merged = self.rank.get, self.merged
        parts = [self.byte_id[b] for b in word]
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << 32 | parts[at + 1], NO_RANK)
        return tuple(parts)

    def _encode_long(self, word: bytes) -> tuple[int, ...]:
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            to = after[at]
            if to < n and (r := self.rank.get(parts[at] << 32 | parts[to])) is not None:
                heapq.heappush(heap, (r, at, parts[at], parts[to]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, at, left, right = heapq.heappop(heap)
            if not alive[at] or parts[at] != left or after[at] >= n or parts[after[at]] != right:
                continue
            gone = after[at]
            parts[at], alive[gone], after[at] = self.merged[r], False, after[gone]
            if after[at] < n:
                before[after[at]] = at
            if before[at] >= 0:
                offer(before[at])
            offer(at)
        return tuple(p for p, keep in zip(parts, alive, strict=True) if keep)

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        known, out = self.known, []
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = self.encode_word(word.encode())
                if len(word) <= SHORT_WORD:
                    known[word] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        if not self.cut_special or not any(s in text for s in self.special):
            return list(chain.from_iterable(self._plain(text)))
        out, at = [], 0
        for match in self.cut_special.finditer(text):
            out += chain.from_iterable(self._plain(text[at : match.start()]))
            out.append(self.special[match[0]])
            at = match.end()
        return out + list(chain.from_iterable(self._plain(text[at:])))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``doc_id``, ``text`` (null: empty), the array of ids, and the text decoded from them."""

    def make():
        bpe = load(vocabulary)

        def one(batch):
            found = [bpe.encode(t) for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "text": batch["text"], ids: found, decoded: [bpe.decode(x) for x in found]}

        return one

    return map_columns(_input(docs), f"doc_id bigint, text string, {ids} array<int>, {decoded} string", make)


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of every text; ids stay inside the task."""

    def make():
        bpe, sha = load(vocabulary), hashlib.sha256
        decimal = {i: str(i) for i in bpe.bytes_of}

        def one(batch):
            rows = []
            for text in batch["text"].to_pylist():
                found = bpe.encode(text)
                back = bpe.decode(found).encode()
                rows.append((len(found), sha(",".join(map(decimal.__getitem__, found)).encode()).hexdigest(), sha(back).hexdigest(), len(back)))
            n, ids, texts, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            return {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": texts, "n_bytes": size}

        return one

    return map_columns(_input(docs), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint", make)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
