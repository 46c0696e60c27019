"""Where rows lie in the files they were read from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL, START, PLACE = "_url", "_start", "_place"
#: Splits of files whose row counts are broadcast, at most.
BROADCAST_SPLITS = 100_000


def with_split(rows: DataFrame) -> DataFrame:
    """Rows of a file source with the file and the first byte of the split each was read from."""
    split = F.struct(F.col("_metadata.file_path").alias(URL), F.col("_metadata.file_block_start").alias(START))
    return rows.select("*", split.alias("_split")).select(*rows.columns, "_split.*")


def with_place(split: DataFrame) -> DataFrame:
    """Rows of :func:`with_split` with their number inside the split.

    A split is read from front to back by one task, so counting needs no shuffle.
    """
    at = [split.columns.index(c) for c in (URL, START)]
    schema = T.StructType([*split.schema, T.StructField(PLACE, T.LongType())])

    def count(batches):
        last, counted = None, 0
        for batch in batches:
            if not len(batch):
                continue
            url, start = (batch.column(i) for i in at)
            edge = pc.or_(pc.not_equal(url[1:], url[:-1]), pc.not_equal(start[1:], start[:-1]))
            firsts = np.flatnonzero(np.concatenate([[True], edge.to_numpy(zero_copy_only=False)]))
            sizes = np.diff(np.append(firsts, len(batch)))
            place = np.arange(len(batch)) - np.repeat(firsts, sizes)
            if (url[0], start[0]) == last:
                place[: sizes[0]] += counted
            last, counted = (url[-1], start[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], schema.names)

    return split.mapInArrow(count, schema)


def numbered_rows(rows: DataFrame, name: str = "rn") -> tuple[DataFrame, int]:
    """Rows of a file source with their 0-based number in file order, and how many there are.

    Files come in the order of their names. Rows are counted per split, and the window runs over
    those counts, one row per split; the rows themselves are neither sorted nor shuffled.
    """
    split = with_split(rows)
    counts = split.groupBy(URL, START).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(URL, START).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(URL, START, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    total = offsets.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits")).first()
    if total["splits"] <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    placed = with_place(split).join(offsets.drop("n"), [URL, START])
    numbered = placed.withColumn(name, F.col("_offset") + F.col(PLACE)).select(*rows.columns, name)
    return numbered, total["n"] or 0
