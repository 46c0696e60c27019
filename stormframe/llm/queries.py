"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm.bpe import decode, encode
from stormframe.llm.common import learnable
from stormframe.llm.exact_dedup import exact_duplicates
from stormframe.llm.fill_middle import restore, transform
from stormframe.llm.hnsw import search, usable_vectors
from stormframe.llm.language import fit_language, with_language
from stormframe.llm.licenses import license_scan
from stormframe.llm.mixing import mix_rates
from stormframe.llm.ngram_join import near_duplicates
from stormframe.llm.packing import pack
from stormframe.llm.phrases import collocations
from stormframe.llm.quality import THRESHOLD, fit_quality, with_quality
from stormframe.llm.sharding import shard_by_bytes
from stormframe.llm.suffix_dedup import remove_repeats
from stormframe.session import stored

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(usable_vectors(spark.read.parquet(f"{folder}/embeddings.parquet")), "vectors")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))


def license_path() -> Column:
    """Where a document lies: a tree of source and number, with files named LICENSE among others."""
    doc_id = F.col("doc_id")
    block = F.concat(F.lit("/b"), F.expr("doc_id div 1000").cast("string"), F.lit("/"))
    name = F.when(doc_id % 10 == 0, "LICENSE").otherwise(F.concat(doc_id.cast("string"), F.lit(".txt")))
    inner = F.when(doc_id % 50 == 0, F.lit("/LICENSE")).otherwise(F.concat(block, name))
    return F.concat(F.coalesce("source", F.lit("none")), inner)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = license_scan(documents(spark, folder), license_path())
    return scanned.withColumn("similarity", F.round("similarity", 6))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_rates(documents(spark, folder).select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (~learnable()).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit_language(docs, PIECES)
    predicted = with_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(documents(spark, folder))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = shard_by_bytes(documents(spark, folder))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), RANKS)


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = decode(encode(documents(spark, folder), WORD_BPE), WORD_BPE)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return restore(transform(documents(spark, folder))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_hnsw": op1_hnsw,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_bpe": op11_bpe,
    "op12_fill_middle": op12_fill_middle,
    "op13_phrases": op13_phrases,
}
