"""Written tables in the cluster's shared folder, and documents dealt into blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteline import session

#: Bytes of text in a block, on average: a block is held in a task's memory.
BLOCK_BYTES = 4 << 20
#: Rows in an Arrow batch; texts can be long.
BATCH_ROWS = 2048


def new_path(spark: SparkSession, name: str) -> str:
    return session.scratch(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def delete(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        session.delete(df.sparkSession, df.written_path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session has set something smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives the memory that a worker has freed back to the machine: workers outlive their tasks, and an executor keeps several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with what it has freed given back when a task's batches end."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return own


def unused(columns: list[str], name: str) -> str:
    """``name``, longer where a column has it already, in any case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for column names of any kind."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(schema.names)
        trim()

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(n_bytes: int, each: int = BLOCK_BYTES, least: int = 1) -> int:
    return max(least, -(-int(n_bytes) // each))


def fold(modulus: int = 5):
    """crc32 of the document's id, as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
