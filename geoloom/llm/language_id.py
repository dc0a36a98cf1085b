"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A text's likelihood under a language sums over all segmentations into pieces;
as pieces do not cross word boundaries it is a product over words, and a
forward pass over the pieces that match in a word gives its factor. Matches come
from an Aho-Corasick automaton, and the forward pass runs for a whole batch of
new words at once, by end position. A worker remembers the words it has scored.

Probabilities are fitted by expectation maximisation on word counts of labelled
documents. The fit takes a bounded sample, ``SAMPLE`` documents a language,
chosen by a hash of text; everything else covers all rows.

Edge cases: text that is null or has no letter is ``und`` with score 0; ties go
to the language that sorts first; with no labelled documents every text is
``und``; documents without lang or text do not train; repeated rows count as
often as they occur; very long words are scored as a whole.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, map_columns, text_of

UNKNOWN, NONE = "und", 0.0
#: Labelled documents a language, about, that fit the probabilities.
SAMPLE = 3000
ROUNDS, CACHE_WORDS = 3, 300_000
WORDS = regex.compile(r"\p{L}+")
START = "▁"


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces without control and byte pieces, lower-cased and distinct."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    pieces = {model.id_to_piece(i).lower() for i in keep}
    return sorted(p for p in pieces if p and START not in p[1:])


class Lattice:
    """All piece matches in words. The last piece id stands for a letter that no piece spells."""

    def __init__(self, pieces: list[str]):
        self.size, self.automaton = len(pieces) + 1, ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word number, start, end (from 1) and piece of every match, ordered by end."""
        out_w, out_s, out_e, out_p = [], [], [], []
        for n, word in enumerate(words):
            marked = START + word
            for end, (length, piece) in self.automaton.iter(marked):
                out_w.append(n)
                out_s.append(end + 1 - length)
                out_e.append(end + 1)
                out_p.append(piece)
            if not self.single.issuperset(marked):
                for i, c in enumerate(marked):
                    if c not in self.single:
                        out_w.append(n)
                        out_s.append(i)
                        out_e.append(i + 1)
                        out_p.append(self.size - 1)
        w, s, e, p = (np.array(x, np.int64) for x in (out_w, out_s, out_e, out_p))
        order = np.argsort(e, kind="stable")
        return w[order], s[order], e[order], p[order]

    def forward(self, words: list[str], logs: np.ndarray, keep: bool = False):
        """log P(word) by language; with ``keep`` also the matches and forward values."""
        w, s, e, p = self.matches(words)
        ends = np.array([len(x) + 1 for x in words])
        base = np.concatenate([[0], np.cumsum(ends + 1)])
        alpha = np.full((base[-1], logs.shape[0]), -np.inf)
        alpha[base[:-1]] = 0.0
        at, start = base[w] + e, base[w] + s
        for lo, hi in _runs(e):
            values = alpha[start[lo:hi]] + logs[:, p[lo:hi]].T
            to, first = np.unique(at[lo:hi], return_index=True)  # ascending: matches come word by word
            alpha[to] = np.logaddexp.reduceat(values, first, axis=0)
        total = alpha[base[:-1] + ends]
        return (total, w, start, at, p, alpha, base, ends) if keep else total

    def expected(self, words: list[str], counts: np.ndarray, logs: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Expected piece counts (languages, pieces) of words with their count and language."""
        total, w, start, at, p, alpha, base, ends = self.forward(words, logs, keep=True)
        beta = np.full_like(alpha, -np.inf)
        beta[base[:-1] + ends] = 0.0
        offset = start - base[w]
        for lo, hi, order in _runs_down(offset):
            rows = order[lo:hi]
            rows = rows[np.argsort(start[rows], kind="stable")]
            values = beta[at[rows]] + logs[:, p[rows]].T
            to, first = np.unique(start[rows], return_index=True)
            beta[to] = np.logaddexp.reduceat(values, first, axis=0)
        own = language[w]
        share = np.exp(alpha[start, own] + logs[own, p] + beta[at, own] - total[w, own])
        out = np.zeros(logs.shape)
        np.add.at(out, (own, p), share * counts[w])
        return out


def _runs(values: np.ndarray):
    if len(values):
        edges = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *edges], [*edges, len(values)], strict=True)


def _runs_down(values: np.ndarray):
    order = np.argsort(-values, kind="stable")
    for lo, hi in _runs(values[order]):
        yield lo, hi, order


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(read_pieces(path))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def train(docs: DataFrame, vocabulary: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log probabilities (languages, pieces) from rows with text and lang."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, 0))
    code = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(y) for x, n in sizes.items() for y in (x, min(1.0, sample / n))])
    chosen = labelled.where((F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)) < share[F.col("lang")])

    def make_words():
        def one(batch):
            counts: dict[tuple[int, str], int] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                for word in words_of(text):
                    counts[key] = counts.get(key := (code[lang], word), 0) + 1
            return {"language": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

        return one

    counted = cut(map_columns(chosen, "language int, word string, n bigint", make_words).groupBy("language", "word").agg(F.sum("n").alias("n")))
    size = lattice(vocabulary).size
    logs = np.full((len(languages), size), -np.log(size))
    for _ in range(rounds):
        now = logs

        def make_expected(now=now):
            cells = lattice(vocabulary)

            def one(batch):
                words = batch["word"].to_pylist()
                found = cells.expected(words, np.array(batch["n"].to_pylist(), float), now, np.array(batch["language"].to_pylist(), int)) if words else np.zeros(now.shape)
                at = np.nonzero(found)
                return {"language": at[0].astype(np.int32), "piece": at[1].astype(np.int32), "n": found[at]}

            return one

        spread = map_columns(counted.repartition("word"), "language int, piece int, n double", make_expected)
        sums = np.full(now.shape, 0.05)
        for row in spread.groupBy("language", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            sums[row["language"], row["piece"]] += row["n"]
        logs = np.log(sums / sums.sum(axis=1, keepdims=True))
    return languages, logs


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, *keep: str) -> DataFrame:
    """The columns of ``keep``, lang_pred and score (the posterior of that language, 0 to 1)."""
    languages, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def make():
        cells, known, table = lattice(vocabulary), {}, shared.value
        rows = np.zeros((0, len(languages)))

        def one(batch):
            nonlocal rows
            found = [words_of(t) for t in batch["__text"].to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
                rows = rows[:0]
            new = list({w for words in found for w in words if w not in known}) if languages else []
            for i in range(0, len(new), 8192):
                some = new[i : i + 8192]
                known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
                rows = np.concatenate([rows, cells.forward(some, table)])
            lang, score = [], []
            for words in found:
                if not words or not languages:
                    lang.append(UNKNOWN)
                    score.append(NONE)
                    continue
                total = rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                lang.append(languages[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            return {f"k{i}": batch[f"k{i}"] for i in range(len(keep))} | {"lang_pred": lang, "score": score}

        return one

    # kept columns go under numbers, so that none of their names can clash
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], text_of().alias("__text"))
    found = map_columns(numbered, StructType(numbered.schema.fields[:-1] + StructType.fromDDL("lang_pred string, score double").fields), make)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
