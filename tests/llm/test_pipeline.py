import corpus_pipeline
from geoloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "## 12", "en", None, 5)], docs.schema)
    docs, columns, sizes = docs.unionByName(odd), docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        assert docs.count() > 0
    assert sizes[1] == sizes[0] == sizes[2] and sizes[3] < sizes[2]
    assert spark.read.parquet(f"{tmp_path}/2").groupBy("doc_id").count().where("count > 1").isEmpty()


def test_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in QUERIES)] == []
