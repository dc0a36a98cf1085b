"""Secret scan: patterns propose findings, a random forest removes false ones.

Candidates are long unbroken tokens and values assigned to a telling name. The
forest sees a candidate's length, transitions between character classes, the
share of it that dictionary words cover, the shares of its character classes,
entropy, the path it comes from and the words beside it. It is trained from
labelled findings; ``labelled_findings`` makes them from public key formats and
telling names where no reviewed ones are given, so the forest then spreads what
those rules know to findings that they don't reach, and no more.

The fit takes at most about ``TRAINING`` findings, by hash; the dictionary is
the ``DICTIONARY`` most frequent short words. All else covers all rows.

Edge cases: null text has no candidates; texts without candidates are reported
with zeros; overlapping candidates keep the first and longest; if all labels
agree, the forest is replaced by that label; documents equal in doc_id, text and
path are scanned once and each of their rows has the result; null doc_ids are like
any other; null paths are empty; extra columns are passed over; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, map_columns, row_key, text_of

TRAINING, DICTIONARY, TREES, DEPTH, SEED = 20_000, 4_000, 20, 7, 11
NAMES = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential")
#: The named branch takes a whole identifier that holds a telling name; the bare branch's value has '=' only as padding.
#: That something is assigned is looked at first: hardly any word passes, so few are searched for names.
CANDIDATE = re.compile(
    r"""(?i)(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++["']?\s*[:=])(?=[A-Za-z0-9_.-]*?(?:password|passwd|pwd|secret|token|api[_-]?key|[_-]key|auth|credential))[A-Za-z0-9_.-]++["']?\s*[:=]\s*["']?(?P<value>[^\s"',;]{6,})"""
    r"""|(?<![A-Za-z0-9+/_-])(?P<bare>[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?+)"""
)
#: Fixed public key formats. Bare hex digests are none: most are checksums and commit ids.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}|xox[abps]-[0-9A-Za-z-]{10,})$"
FEATURES = ["length", "transitions", "coverage", "upper", "lower", "digit", "other", "entropy", "named", "assigned", "quoted", "path_depth", "path_test", "before_length", "after_length", "before_known", "after_known"]


def char_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that non-overlapping dictionary words of three letters or more cover."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for size in range(min(10, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                covered, at = covered + size, at + size
                break
        else:
            at += 1
    return covered / len(value)


def describe(text: str, match: re.Match, path: str, words: frozenset[str]) -> tuple[int, int, str, str, list[float]]:
    name = "value" if match["value"] is not None else "bare"
    start, end = match.span(name)
    value, n = match[name], end - start
    kinds = [char_class(c) for c in value]
    share = [kinds.count(k) / len(kinds) for k in (2, 1, 0, 3)]
    entropy = -sum(c / len(kinds) * math.log2(c / len(kinds)) for c in Counter(value).values())
    before, after = text[max(0, start - 40) : start].split(), text[end : end + 40].split()
    last, following = (before[-1] if before else ""), (after[0] if after else "")
    beside = (text[max(0, start - 24) : start]).lower()
    row = [n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / len(kinds), coverage(value, words), *share, entropy, float(any(w in beside for w in NAMES)), float("=" in beside[-3:] or ":" in beside[-3:]), float(beside[-1:] in ("'", '"')), path.count("/"), float("test" in path.lower() or "example" in path.lower()), len(last), len(following), float(last.strip(".,;:!?").lower() in words), float(following.strip(".,;:!?").lower() in words)]
    return start, end, value, beside, [float(x) for x in row]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The most frequent words of three to ten letters, by count, then word."""
    words = F.explode(F.regexp_extract_all(lower_ascii(text_of()), F.lit(r"(?<!\p{L})\p{L}{3,10}(?!\p{L})"), F.lit(0)))
    counted = docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r["word"] for r in counted.orderBy(F.col("n").desc(), "word").limit(size).collect())


def identified(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, path and the key of what tells documents apart."""
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), where.alias("path"))
    return rows.withColumn("key", F.xxhash64(row_key(), "path"))


def candidates(docs: DataFrame, words: frozenset[str], path: str = "source") -> DataFrame:
    """doc_id, key, start, end, value, beside and features of every candidate, positions in code points; key is of doc_id, text and path."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        known = shared.value

        def one(batch):
            out: dict[str, list] = {c: [] for c in ("at", "start", "end", "value", "beside", "features")}
            for at, (text, place) in enumerate(zip(batch["text"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                for match in CANDIDATE.finditer(text):
                    for column, x in zip(out, (at, *describe(text, match, place, known)), strict=True):
                        out[column].append(x)
            at = pa.array(out.pop("at"), pa.int64())
            return out | {"doc_id": batch["doc_id"].take(at), "key": batch["key"].take(at)}

        return one

    return map_columns(identified(docs, path), "doc_id bigint, key bigint, start int, end int, value string, beside string, features array<double>", make)


def labelled_findings(found: DataFrame) -> DataFrame:
    """features and label: true for public key formats and mixed values assigned to a telling name."""
    named = found["beside"].rlike("(" + "|".join(NAMES) + r")s?([_-][a-z0-9_-]*|[0-9]*)[\"']?\s*[:=]\s*[\"']?$")
    mixed = found["value"].rlike("[0-9]") & found["value"].rlike("[A-Za-z]")
    return found.select("features", (found["value"].rlike(FORMATS) | (named & mixed)).cast("double").alias("label"))


def train(labelled: DataFrame, most: int = TRAINING):
    """A fitted forest, or the one label that all findings have (0.0 if there is none)."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return next(iter(sizes), 0.0)
    share = F.create_map(*[F.lit(float(x)) for k, n in sizes.items() for x in (k, min(1.0, most / len(sizes) / n))])
    some = cut(labelled.where(F.pmod(F.xxhash64("features"), F.lit(1 << 20)) / (1 << 20) < share[F.col("label")]).select(array_to_vector("features").alias("vector"), "label"))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    return forest.fit(some)


def judged(found: DataFrame, model) -> DataFrame:
    """``found`` with probability: how likely a finding is real."""
    if isinstance(model, float):
        return found.withColumn("probability", F.lit(model))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("probability", F.get(vector_to_array("probability"), 1)).select(*found.columns, "probability")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """doc_id, key, start, end, value, probability of the findings that the forest keeps, and all candidates with kept false."""
    found = cut(candidates(docs, dictionary(docs), path))
    out = judged(found, train(labelled_findings(found) if labelled is None else labelled))
    return out.withColumn("kept", F.col("probability") >= threshold).drop("features", "beside")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_candidates, n_secrets and the kept spans: one row for each row of docs."""
    once = scan(docs, **options).groupBy("doc_id", "key", "start", "end").agg(F.first("kept").alias("kept"))
    spans = F.filter(F.collect_list(F.when(F.col("kept"), F.struct("start", "end"))), lambda s: s.isNotNull())
    by_doc = once.groupBy("doc_id", "key").agg(F.count("*").alias("n_candidates"), F.count_if("kept").alias("n_secrets"), F.array_sort(spans).alias("spans"))
    ids = identified(docs, options.get("path", "source")).select("doc_id", "key")
    joined = ids.alias("i").join(by_doc.alias("r"), (F.col("i.key") == F.col("r.key")) & F.col("i.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    zero: Column = F.lit(0).cast("bigint")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select("i.doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"), F.coalesce(text, F.lit("")).alias("spans"))
