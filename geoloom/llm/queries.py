"""The registered queries of this subpackage: thin applications of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, lexical, line_dedup, mixing, mpeg_audio, pii, ppm, secret_scan, simhash, spelling, topk, vector_copies
from .common import crc_mod, documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate_lines(documents(spark, sf_dir), counted=True)
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    ready = docs.withColumn("held_out", crc_mod("doc_id", 4) == 2)
    pieces = vocabulary("piece_bpe_32k.model")
    model = language_id.train(ready.where(~F.col("held_out")), pieces)
    return language_id.identify(ready, model, pieces, "doc_id", "held_out")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.stored_digests(mpeg_audio.store_texts(documents(spark, sf_dir)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, distance=2)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_mixing, op3_bpe, op4_line_dedup, op5_ppm, op6_language, op7_pii, op8_secrets, op9_media, op10_simhash, op11_lexical, op12_vectors, op13_spelling, pipeline)
}

ORACLE_SQL = {
    "op1_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_lexical": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM documents
        ), postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
        sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM postings, corpus GROUP BY term
        ), items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark
        ), scored AS (
            SELECT item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
            FROM items JOIN postings p USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = p.doc_id, corpus
            GROUP BY item_id, p.doc_id
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
    # all links; the index finds them all on tables as small as these
    "op12_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), sized AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM usable WHERE list_inner_product(v, v) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
        reached AS (SELECT vec_id AS node, vec_id AS least FROM embeddings UNION SELECT b, least FROM reached JOIN links ON a = node),
        roots AS (SELECT node, min(least) AS component_id FROM reached GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
    """,
}
