"""A corpus pipeline: every stage works on all that the one before it kept.

The stages are language identification (documents without any language go),
line dedup, near-duplicate removal (SimHash proposes, five-word Jaccard of 0.8
decides, and a prefix filter adds what SimHash misses), mixing of sources to
target weights, and BPE encoding with decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, language_id, line_dedup, mixing, near_copies
from geoloom.llm.common import crc_mod, cut, documents
from geoloom.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language, and sets lang to the predicted one."""
    pieces, columns = vocabulary("piece_bpe_32k.model"), docs.columns
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2), pieces)
    # columns go under numbers, so that none of their names can clash
    named = language_id.identify(docs, model, pieces, *columns).toDF(*[f"c{i}" for i in range(len(columns))], "found", "score")
    kept = named.where(F.col("found") != language_id.UNKNOWN)
    return kept.select(*[F.col("found" if c == "lang" else f"c{i}").alias(c) for i, c in enumerate(columns)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat or nearly repeat an earlier one; n_chars follows the text."""
    done = line_dedup.deduplicate_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("bigint"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicate(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights."""
    return mixing.mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests."""
    return bpe.encode_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_near), ("mixing", mix_sources), ("bpe", encode_bpe)]
#: SQL can't express the language model, the hashes and the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
