"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept.  All but the last return
the columns of ``documents``, whatever else these hold; the last returns the pieces of the packed sequences.
Empty tables give empty results.  Null and empty texts, and rows without a doc_id, stay until they are packed (as
their end id alone); rows that repeat a doc_id stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import decontam, jaccard, linededup, packing, store, toxicity


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by their language's threshold (0.5 without one), go; without labels of both kinds none does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return _same_columns(toxicity.kept(docs, labels), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the smallest only; n_chars follows the text."""
    out = linededup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _same_columns(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest doc_id stays, documents without words all stay."""
    return _same_columns(jaccard.kept(docs, 5, 80), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items without words are held by none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _same_columns(decontam.clean(docs, items), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as sequences of at most 2048 tokens."""
    return packing.pack(docs, "word_bpe_49k.json", 1, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage but the copies' could be stated in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.written(docs, "stage")
    return docs
