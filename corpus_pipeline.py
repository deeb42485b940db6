"""A training corpus from raw documents, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor
kept; ``run`` writes every stage's result as Parquet and reads it back for the next, so a
lost executor costs one stage at most. All but the last return the columns of documents;
where a stage changes a text, ``n_chars`` follows. Nulls, empty tables and repeated rows
are treated as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.line_dedup import dedup_lines
from fleetlens.llm.near_dedup import keep_one
from fleetlens.llm.packing import pack
from fleetlens.llm.packing_queries import CAPACITY, END_ID, tokenizer_path
from fleetlens.llm.quality import keep_good
from fleetlens.session import configure, materialize


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose source mostly does, go."""
    configure(spark)
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more sources share stay in one document."""
    configure(spark)
    return _recounted(dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    configure(spark)
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    configure(spark)
    return _recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in the sequences."""
    configure(spark)
    return pack(docs, tokenizer_path, END_ID, CAPACITY, content=F.crc32).select(
        "doc_id", "start", "length", F.col("content").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Near-duplicate classes and tokens are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
