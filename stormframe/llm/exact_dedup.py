"""Exact duplicates, combined in three steps that a hot text cannot unbalance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stormframe.llm.common import join_groups, sha256, whole_text
from stormframe.session import stored

SALTS = 16


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)`` for each row of ``docs``.

    1. Each task merges equal texts it holds (the map side of the first aggregate).
    2. The partial groups meet by digest and salt, so a text that fills a third of the table is
       merged by ``salts`` tasks.
    3. The winners of the salts, at most ``salts`` a text, are merged by digest.

    Every step groups by the digest and the whole text, so texts that merely share a digest stay
    apart. The row with the largest ``doc_id`` stays; of several rows with that id, one. Null text
    is the empty text. A null ``doc_id`` loses to any other and stays only in a group without ids.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    keyed = rows.withColumn("digest", digest(F.col("text")))
    salted = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    )
    merged = salted.groupBy("digest", "text").agg(
        F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id")
    )
    groups = merged.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )
    groups = stored(groups, "digest_groups")
    # A digest of one text stands for that text. Where texts share one, they are told apart in full.
    single = groups.where("texts = 1").drop("texts")
    found = join_groups(keyed.select("doc_id", "digest"), single, "digest", "group_size")
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():
        found = found.join(shared, "digest", "left_anti")
        apart = keyed.join(shared, "digest", "left_semi")
        sizes = merged.join(shared, "digest", "left_semi")
        apart = apart.join(sizes, ["digest", "text"]).select(*found.columns)
        found = found.unionByName(apart)
    first = F.row_number().over(Window.partitionBy("keep_id", "doc_id", "digest").orderBy(F.lit(0)))
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only rows with the winning id are numbered, one or few a group.
    repeated = found.where(winner).withColumn("kept", first == 1)
    return repeated.unionByName(found.where(~winner).withColumn("kept", F.lit(False))).select(
        "doc_id", "keep_id", "group_size", "kept", "digest"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever those are called."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"), sha256(whole_text()).alias("digest"),
    )
    kept = exact_duplicates(docs).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")
    )
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    # Of rows with one id and text any stays; they are combined before they are shuffled.
    return joined.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")
