import corpus_pipeline
import pytest
from geoloom.llm.queries import QUERIES
from pyspark.sql import functions as F

NAMES = "a.b all best_id block copies drawn end fp found id key k0 kind lang_pred line n n_lines n_removed path place row score size spans start taken target words __gone __row __row_key __text".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small table of documents with columns named as those that the operators use inside."""
    folder = str(tmp_path_factory.mktemp("clash"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs.select("*", *[F.lit("x").alias(c) for c in NAMES]).write.parquet(f"{folder}/documents.parquet")
    docs.write.parquet(f"{folder}/plain/documents.parquet")
    for name in ("benchmark", "embeddings"):
        other = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        other.select("*", *[F.lit("x").alias(c) for c in NAMES]).write.parquet(f"{folder}/{name}.parquet")
        other.write.parquet(f"{folder}/plain/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k.startswith("op")))
def test_queries(spark, folder, name):
    clashing, plain = (QUERIES[name](spark, d) for d in (folder, f"{folder}/plain"))
    assert clashing.columns == plain.columns
    assert sorted(map(repr, clashing.collect())) == sorted(map(repr, plain.collect()))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, plain = docs.columns, spark.read.parquet(f"{folder}/plain/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        clashing, expected = stage(spark, docs, folder), stage(spark, plain, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert clashing.columns == columns
            assert clashing.where(F.concat(*[F.col(f"`{c}`") for c in NAMES]) != "x" * len(NAMES)).isEmpty()
        own = clashing.select(*expected.columns)
        assert sorted(map(repr, own.collect())) == sorted(map(repr, expected.collect()))
