"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Lower-cases A-Z only, for bytes.translate.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a function of texts gets at once: texts may be long, so they are few. Bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Bytes up to which a counted side is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(df: DataFrame) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset, as in local tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: its result is stored, so they are needed no more. The setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: compressed, and scans of it can share exchanges."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


cut_table = cut


def bounded(df: DataFrame, size: int) -> DataFrame:
    """``df``, to be broadcast if its counted bytes allow it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the number as text, modulo ``modulus`` (null: crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def row_key(doc: str = "doc_id", text: str = "text") -> Column:
    """Hash that tells documents under one doc_id apart."""
    return F.xxhash64(F.col(doc), text_of(text))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_LETTERS, LOWER_LETTERS)


def shards_for(total: int, per_shard: int, least: int = 1) -> int:
    """How many parts of about ``per_shard`` hold ``total``; grows with the data."""
    return max(least, -(-int(total or 0) // per_shard))


def give_memory_back() -> None:
    """Returns freed memory to the system: the worker process goes on to other tasks. Without glibc only Arrow's is returned."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_columns(df: DataFrame, schema: str | StructType, make: Callable, rows: int = BATCH_ROWS) -> DataFrame:
    """Arrow batches in, columns out.

    ``make()`` runs once a task and gives the function of a batch, or a pair of
    it and a function without arguments that gives what is left at the end. A
    function may give None for nothing. Arrow arrays that are passed through
    keep their nulls and full precision. A batch has at most ``rows`` rows. The
    session's bound of an Arrow batch in bytes is lowered, as texts may be long and
    the plan runs later; no result depends on it.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key) != f"{BATCH_BYTES}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def packed(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from results(batches)
        give_memory_back()

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        one, end = made if isinstance(made, tuple) else (made, lambda: None)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                if (out := one(whole.slice(start, rows))) is not None:
                    yield packed(out)
        if (out := end()) is not None:
            yield packed(out)

    return df.mapInArrow(run, schema)


def counting(parts: Callable[[pa.RecordBatch, dict], None], most: int, columns: Callable[[dict], dict]) -> Callable:
    """A ``make`` that counts over a whole task: ``parts`` adds a batch to a Counter, which goes out when it has ``most`` keys and at the end."""

    def make():
        counts: Counter = Counter()

        def flush():
            out = columns(counts) if counts else None
            counts.clear()
            return out

        def one(batch):
            parts(batch, counts)
            return flush() if len(counts) >= most else None

        return one, flush

    return make
