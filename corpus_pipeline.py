"""A training corpus in five stages, from documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps with the columns of
``docs``; the last returns the packed pieces. Between stages rows are written as Parquet to the
shared folder and read again. Nulls, empty and repeated rows are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm.exact_dedup import drop_exact_duplicates
from stormframe.llm.mixing import emit_mix
from stormframe.llm.ngram_join import drop_near_duplicates
from stormframe.llm.packing import pack
from stormframe.llm.quality import THRESHOLD, fit_quality, with_quality
from stormframe.llm.queries import RANKS
from stormframe.session import stored

SCORE = "_quality_score"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from ``labels``, is at least the threshold."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, SCORE).where(F.col(SCORE) >= THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id``."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest ``doc_id``."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; some several times, some never."""
    return emit_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places; each copy of a document is packed."""
    return pack(docs, RANKS)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
