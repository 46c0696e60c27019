"""Windows as arrays: batches of samples in the shape that a training loop takes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stormframe.operators.ordered import POSITION

BATCH_SAMPLES = 64
BATCH = "batch"


class Batch(NamedTuple):
    """``x`` is ``(samples, steps, features)`` and ``y`` ``(samples,)``, both 32-bit; ``keys`` names series and number."""

    keys: tuple
    x: np.ndarray
    y: np.ndarray


def as_arrays(samples: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``x`` and ``y`` of a sequence table's rows, read where Arrow has them, without copies of one chunk.

    Raises unless every sample has the same shape and no missing part.
    """
    columns = {}
    for name in ("x", "y"):
        column = samples.column(name)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        columns[name] = column
    x, y = columns["x"], columns["y"]
    if not pa.types.is_floating(y.type) or x.null_count or y.null_count:
        raise ValueError("samples lack x or y")
    steps, rows = _one_length(x, "steps"), x.flatten()
    features, values = _one_length(rows, "features"), rows.flatten()
    if rows.null_count or values.null_count:
        raise ValueError("samples have missing values")
    flat = values.to_numpy(zero_copy_only=True).astype(np.float32, copy=False)
    return flat.reshape(len(x), steps, features), y.to_numpy(zero_copy_only=True).astype(np.float32, copy=False)


def _one_length(lists: pa.ListArray, what: str) -> int:
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"samples differ in shape: {sizes.min()}..{sizes.max()} {what}")
    return int(sizes[0]) if len(sizes) else 0


def numbered_batches(sequences: DataFrame, size: int = BATCH_SAMPLES, by: Sequence[str] = ()) -> DataFrame:
    """``sequences`` with the number of the batch that each sample belongs to, batches whole and in order.

    Batches hold ``size`` neighbouring samples of a series of ``by``, the last one the rest. They follow from
    the positions alone, so every run makes the same ones.
    """
    if size < 1:
        raise ValueError("a batch needs at least one sample")
    series = list(by)
    key = F.struct(*series) if series else F.lit(0)
    keyed = sequences.withColumn("_series", key)
    first = keyed.groupBy("_series").agg(F.min(POSITION).alias("_first"))
    batch = F.floor((F.col(POSITION) - F.col("_first")) / size).alias(BATCH)
    numbered = keyed.join(first, "_series").select(*sequences.columns, batch)
    return numbered.repartition(*series, BATCH).sortWithinPartitions(*series, BATCH, POSITION)


def batches_of(arrow: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[Batch]:
    """Batches of a partition of :func:`numbered_batches`; only one that Arrow has cut in two is put together."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def done() -> Iterator[Batch]:
        if held:
            yield Batch(last, *as_arrays(held[0] if len(held) == 1 else pa.Table.from_batches(held)))

    for rows in arrow:
        if not len(rows):
            continue
        names = [rows.column(k).to_pylist() for k in keys]
        found = list(zip(*names, strict=True))
        edges = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1]), len(found)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if held and found[start] != last:
                yield from done()
                held = []
            last = found[start]
            held.append(rows.slice(start, stop - start))
    yield from done()


def map_batches(
    sequences: DataFrame, function: Callable[[Batch], dict], schema: str,
    size: int = BATCH_SAMPLES, by: Sequence[str] = (),
) -> DataFrame:
    """One row per batch: what ``function`` makes of its arrays, as a value for each field of ``schema``."""
    keys = [*by, BATCH]

    def run(arrow):
        for batch in batches_of(arrow, keys):
            yield pa.RecordBatch.from_pylist([function(batch)], kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = [*by, BATCH, "x", "y"]
    numbered = numbered_batches(sequences, size, by).select(*columns)
    return numbered.mapInArrow(run, schema)
