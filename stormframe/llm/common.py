"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.session import stored

#: A group is hot from this share of all rows on, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: ``monotonically_increasing_id`` keeps the partition above this bit and the row below it.
ROW_BITS = 33


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sha256(text: Column) -> Column:
    """32 bytes; half the size of the digest in hexadecimal."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that models may learn labels from: crc32 of the id's digits, mod 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """``df``, stored, with its 0-based place in ``order`` as ``name``.

    Rows are split by ranges of ``order``, sorted inside each range and written. Only one row
    count per range is brought together, so no task sees more than its range. Rows with equal
    keys are placed in any order, once, since the places are stored.
    """
    ranged = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    return _with_offsets(kept, F.count(F.lit(1)), {name: F.col("_at") % (1 << ROW_BITS)})


def _with_offsets(kept: DataFrame, total: Column, columns: dict[str, Column]) -> DataFrame:
    """Add what the ranges before a row hold. There is one row per range to broadcast."""
    spark = kept.sparkSession
    ranged = kept.withColumn("_range", F.shiftright("_at", ROW_BITS))
    totals = ranged.groupBy("_range").agg(total.alias("n")).orderBy("_range").collect()
    before, offsets = 0, []
    for row in totals:
        offsets.append((row["_range"], before))
        before += row["n"]
    table = spark.createDataFrame(offsets, "_range long, _before long")
    joined = ranged.join(F.broadcast(table), "_range", "left")
    added = {name: F.col("_before") + value for name, value in columns.items()}
    return joined.withColumns(added).drop("_range", "_before", "_at")


def running_total(df: DataFrame, order: Sequence[str | Column], size: str, name: str) -> DataFrame:
    """``df``, stored, with the total of ``size`` up to and including each row in ``order``."""
    fields = df.schema.add("_at", "long").add("_sum", "long")

    def add_up(frames):
        before = 0
        for frame in frames:
            sums = frame[size].cumsum() + before
            if len(frame):
                before = int(sums.iloc[-1])
            yield frame.assign(_sum=sums)

    ranged = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    summed = ranged.withColumn("_at", F.monotonically_increasing_id()).mapInPandas(add_up, fields)
    kept = stored(summed, name)
    return _with_offsets(kept, F.sum(size), {name: F.col("_sum")}).drop("_sum")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` with ``groups``, which has one row per ``key`` and its row count.

    Groups that hold more than ``HOT_SHARE`` of all rows number at most ``1 / HOT_SHARE``; those
    are broadcast, so their rows stay where they are. The others are joined by key. ``groups``
    must be a stored table: it is read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > HOT_SHARE * total)
    rest = groups.where(F.col(size) <= HOT_SHARE * total)
    packed = F.struct(*values).alias("_hot")
    joined = rows.join(F.broadcast(hot.select(key, packed)), key, "left")
    # A row of a hot group has its answer; without a key it meets nobody in the second join.
    cold_key = F.when(F.col("_hot").isNull(), F.col(key))
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns) % 1024)
    joined = joined.withColumns({"_cold": cold_key, "_spread": F.coalesce(spread, F.lit(-1))})
    rest = rest.select(
        F.col(key).alias("_cold"), F.lit(-1).cast("long").alias("_spread"), F.struct(*values).alias("_rest")
    )
    joined = joined.join(rest, ["_cold", "_spread"], "left")
    found = {v: F.coalesce(F.col(f"_hot.{v}"), F.col(f"_rest.{v}")) for v in values}
    return joined.select(*(F.col(c) for c in rows.columns), *(c.alias(v) for v, c in found.items()))
