from geoloom.llm import common
from pyspark.sql import functions as F


def test_lower_and_crc(spark):
    import zlib

    row = spark.createDataFrame([(17, "AÄbZ")], "doc_id bigint, text string").select(common.crc_mod("doc_id", 7), common.lower_ascii(F.col("text"))).first()
    assert tuple(row) == (zlib.crc32(b"17") % 7, "aÄbz")
    assert "AÄbZ".encode().translate(common.LOWER) == "aÄbz".encode()
