"""Ordered execution without a one-partition sort.

A window over the whole series would send every row to one task. Instead each row gets a
block number that never decreases along the order and depends on the row alone. Then

1. small per-block summaries are aggregated map-side, before any shuffle of rows;
2. a window over the summaries (one row per block) works out what enters each block;
3. rows are shuffled once, by block, and finished inside their block.

Cuts between blocks come from a sample of the order keys, so a busy day, or one instant that
holds a third of all rows, is cut as finely as its row count asks for. The cuts only balance
the work: any cuts give the same result, and the same row always lands in the same block, so
a lost task can be replayed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormframe.config import SeriesOrder
from stormframe.functions.numeric import epoch_seconds

BLOCK = "_block"
PART = "_part"
SERIES = "_series"
BLOCK_ROWS = 4_000_000
SMALLEST_BLOCK = 1_000
SAMPLE_LIMIT = 2_000_000
HOT_SERIES_LIMIT = 500_000
#: Quantiles of the time that one scan takes, how exactly, and for how many blocks they do.
QUANTILES = 2_048
QUANTILE_ACCURACY = 20_000
QUANTILE_BLOCKS = 256
BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class BlockPlan:
    """Cut points for one table and order. Build it with :func:`plan_blocks`."""

    order: SeriesOrder
    rows: int
    time_range: tuple[float, float]
    tie_range: tuple[int, int]
    time_cuts: tuple[float, ...]
    tie_cuts: tuple[float, ...]
    hot: DataFrame | None = None
    measured: dict[str, int] = field(default_factory=dict)

    @property
    def divided(self) -> bool:
        """Whether any series spans more than one block, so that carries are needed."""
        return bool(self.time_cuts)

    @property
    def blocks(self) -> int:
        """Upper bound on the number of blocks, known from the cuts."""
        return len(self.time_cuts) + len(self.tie_cuts) + 1

    @property
    def group(self) -> list[str]:
        """Columns that identify one block of one series."""
        return [SERIES, BLOCK] if self.order.by else [BLOCK]

    def sequence(self) -> list[Column]:
        return [F.col(self.order.time), F.col(self.order.tiebreak)]

    def position(self) -> Column:
        """Order key as one comparable value."""
        return F.struct(*self.sequence())

    def window(self) -> WindowSpec:
        """Rows of one block of one series, in order."""
        part = [PART] if self.divided else []
        return Window.partitionBy(*part, *self.group).orderBy(*self.sequence())

    def partitions(self, df: DataFrame) -> int:
        """One partition a block, or as many as the session asks for if blocks are twice as many."""
        wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.blocks if self.blocks < 2 * wanted else wanted

    def place(self, blocked: DataFrame) -> DataFrame:
        """Shuffle rows for :meth:`window`, with blocks dealt out by number.

        Hashing a handful of blocks to as many partitions would leave some of them empty and
        others with two or three.
        """
        if not self.divided:
            return blocked
        return blocked.repartitionById(self.partitions(blocked), F.col(PART))

    def across_blocks(self) -> WindowSpec:
        """Block summaries of one series, in order; one row per block."""
        return Window.partitionBy(*self.group[:-1]).orderBy(BLOCK)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the columns that tell a row's block (and series) and its part of the shuffle."""
        out = df
        if self.order.by:
            out = out.withColumn(SERIES, F.struct(*self.order.by))
        if not self.divided:
            return out.withColumn(BLOCK, F.lit(-1 if self.order.by else 0).cast("long"))
        lead = F.lit(0.0)
        if self.hot is not None:
            out = out.join(self.hot, SERIES, "left")
            lead = F.col("_lead")
        out = out.withColumn("_code", lead + _fraction(_seconds(self.order), self.time_range))
        out = _bucketize(out, "_code", "_bucket", self.time_cuts)
        if self.tie_cuts:
            tie = _fraction(F.col(self.order.tiebreak).cast("double"), self.tie_range)
            out = out.withColumn("_tie", F.col("_bucket") + tie)
            out = _bucketize(out.drop("_bucket"), "_tie", "_bucket", self.tie_cuts)
        out = out.withColumn(BLOCK, F.coalesce(F.col("_bucket").cast("long"), F.lit(-1)))
        parts, part = self.partitions(df), F.col(BLOCK)
        if self.order.by:  # series that are not cut have no block number to go by
            part = F.when(part >= 0, part).otherwise(F.xxhash64(SERIES))
        out = out.withColumn(PART, F.pmod(part, F.lit(parts)).cast("int"))
        return out.drop("_code", "_tie", "_bucket", "_lead")

    def summarise(self, blocked: DataFrame, *aggregates: Column) -> DataFrame:
        """One row per block of every divided series."""
        if self.order.by:
            blocked = blocked.where(F.col(BLOCK) >= 0)
        return blocked.groupBy(*self.group).agg(*aggregates)

    def attach(self, blocked: DataFrame, summary: DataFrame) -> DataFrame:
        """Bring per-block values to the rows.

        The summary holds one row per block, so its size is known before it is built: up to
        ``BROADCAST_BYTES`` it is broadcast. Beyond that it is joined on the block.
        """
        if self.blocks * len(summary.columns) * 24 <= BROADCAST_BYTES:
            summary = F.broadcast(summary)
        return blocked.join(summary, self.group, "left")

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop(SERIES, BLOCK, PART)


def plan_blocks(
    df: DataFrame,
    order: SeriesOrder = SeriesOrder(),
    block_rows: int | None = None,
    counts: Mapping[str, Column] | None = None,
) -> BlockPlan:
    """Choose the cuts for ``df`` in one scan, which also takes ``counts`` for ``BlockPlan.measured``.

    Row count and quantiles of the time come from the same aggregate. Only more than ``QUANTILE_BLOCKS``
    blocks, or an instant that fills a block, take a second narrow scan for a sample of the keys.
    ``counts`` are aggregates that may be added up.

    With ``order.by`` set, only series larger than ``block_rows`` are cut; the others are
    already spread by their own key. ``block_rows`` defaults to a size that keeps one
    block within a task and uses every core on small inputs.
    """
    _require_integral(df, order.tiebreak)
    series = {SERIES: F.struct(*order.by)} if order.by else {}
    keys = df.withColumns({**series, "_s": _seconds(order), "_t": F.col(order.tiebreak)})
    measures = [column.alias(name) for name, column in (counts or {}).items()]
    stats = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_s").isNull() | F.col("_t").isNull()).alias("unplaced"),
        F.min("_s").alias("s0"),
        F.max("_s").alias("s1"),
        F.min("_t").alias("t0"),
        F.max("_t").alias("t1"),
    ]
    if order.by:
        plan, total = _plan_series(df, keys, [*stats, *measures], order, block_rows or BLOCK_ROWS, list(counts or {}))
    else:
        shares = F.array(*(F.lit(i / QUANTILES) for i in range(1, QUANTILES)))
        quantiles = F.percentile_approx("_s", shares, F.lit(QUANTILE_ACCURACY)).alias("quantiles")
        total = keys.agg(*stats, *measures, quantiles).first()
        _require_placed(total["unplaced"], order)
        blocks = _block_count(df, total["n"], block_rows)
        plan = _cut_at_quantiles(order, total, blocks)
        plan = plan or _cut(keys.withColumn("_lead", F.lit(0.0)), order, total, blocks, leads=1)
    return replace(plan, measured={"n": total["n"] or 0} | {name: total[name] or 0 for name in counts or {}})


def _cut_at_quantiles(order, total, blocks) -> BlockPlan | None:
    """Cuts on time alone, or nothing if they would leave blocks uneven."""
    time_range = (total["s0"] or 0.0, total["s1"] or 0.0)
    tie_range = (total["t0"] or 0, total["t1"] or 0)
    if blocks <= 1:
        return BlockPlan(order, total["n"] or 0, time_range, tie_range, (), ())
    if blocks > QUANTILE_BLOCKS:
        return None
    times = np.array(total["quantiles"])[np.arange(1, blocks) * QUANTILES // blocks - 1]
    if len(np.unique(times)) < len(times):
        return None
    span = max(time_range[1] - time_range[0], 1e-6)
    cuts = (times - time_range[0]) * 0.5 / span  # as _fraction has it
    return BlockPlan(order, total["n"], time_range, tie_range, tuple(cuts.tolist()), ())


def _plan_series(df, keys, stats, order, block_rows, measured) -> tuple[BlockPlan, Row]:
    sizes = keys.groupBy(SERIES).agg(*stats)
    overall = sizes.agg(
        *(F.sum(c).alias(c) for c in ("n", "unplaced", *measured)),
        *(F.min(c).alias(c) for c in ("s0", "t0")),
        *(F.max(c).alias(c) for c in ("s1", "t1")),
        F.count_if(F.col("n") > block_rows).alias("large"),
    ).first()
    _require_placed(overall["unplaced"] or 0, order)
    if not overall["large"]:
        return _cut(keys, order, overall, 0, leads=0), overall
    # At most rows / block_rows series can be this large, which bounds what is collected and
    # what is broadcast; a very long list is left to a plain join.
    large = sizes.where(F.col("n") > block_rows).select(SERIES, "n").toArrow()
    counts = large["n"].to_numpy()
    hot = df.sparkSession.createDataFrame(
        pa.table({SERIES: large[SERIES], "_lead": np.arange(len(counts), dtype=float)})
    )
    if len(counts) <= HOT_SERIES_LIMIT:
        hot = F.broadcast(hot)
    blocks = int(np.ceil(counts / block_rows).sum())
    plan = _cut(
        keys.join(hot, SERIES), order, overall, blocks, len(counts), hot, int(counts.sum())
    )
    return plan, overall


def _cut(keys, order, total, blocks, leads, hot=None, sampled_rows=None) -> BlockPlan:
    rows = total["n"] or 0
    time_range = (total["s0"] or 0.0, total["s1"] or 0.0)
    tie_range = (total["t0"] or 0, total["t1"] or 0)
    time_cuts, tie_cuts = [], []
    if blocks > 1:
        wanted = min(32 * blocks, max(SAMPLE_LIMIT, 4 * blocks))
        sample = (
            keys.sample(min(1.0, wanted / (sampled_rows or rows)), seed=42)
            .select(
                (F.col("_lead") + _fraction(F.col("_s"), time_range)).alias("code"),
                _fraction(F.col("_t").cast("double"), tie_range).alias("tie"),
            )
            .toArrow()
        )
        time_cuts, tie_cuts = _cut_points(
            sample["code"].to_numpy(), sample["tie"].to_numpy(), blocks, leads
        )
    return BlockPlan(
        order, rows, time_range, tie_range, tuple(time_cuts), tuple(tie_cuts), hot
    )


def _cut_points(code, tie, blocks, leads) -> tuple[list[float], list[float]]:
    """Cuts on time, and cuts on the tiebreak inside instants that fill whole blocks."""
    between_series = np.arange(1, leads, dtype=float)
    if code.size == 0:
        return between_series.tolist(), []
    ranks = np.lexsort((tie, code))
    picked = ranks[np.unique(np.arange(1, blocks) * code.size // blocks)]
    cut, cut_tie = code[picked], tie[picked]
    values, counts = np.unique(cut, return_counts=True)
    crowded = values[counts > 1]
    time_cuts = np.unique(
        np.concatenate([values, np.nextafter(crowded, np.inf), between_series])
    )
    if crowded.size == 0:
        return time_cuts.tolist(), []
    inside = np.isin(cut, crowded)
    bucket = np.searchsorted(time_cuts, cut[inside], side="right")
    tie_cuts = np.unique(
        np.concatenate([np.arange(1.0, time_cuts.size + 1), bucket + cut_tie[inside]])
    )
    return time_cuts.tolist(), tie_cuts.tolist()


def _bucketize(df: DataFrame, source: str, result: str, cuts) -> DataFrame:
    splits = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=splits, inputCol=source, outputCol=result).transform(df)


def _fraction(value: Column, bounds: tuple[float, float]) -> Column:
    """Value scaled into [0, 0.5]; never decreases as the value grows."""
    low, high = float(bounds[0]), float(bounds[1])
    return (value - F.lit(low)) * F.lit(0.5) / F.lit(max(high - low, 1e-6))


def _seconds(order: SeriesOrder) -> Column:
    return epoch_seconds(F.col(order.time))


def _block_count(df: DataFrame, rows: int, block_rows: int | None) -> int:
    if block_rows:
        return max(1, math.ceil(rows / block_rows))
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / BLOCK_ROWS), min(cores, rows // SMALLEST_BLOCK))


def _require_integral(df: DataFrame, tiebreak: str) -> None:
    if not isinstance(df.schema[tiebreak].dataType, T.IntegralType):
        raise TypeError(f"tiebreak column {tiebreak!r} must be integral")


def _require_placed(unplaced: int, order: SeriesOrder) -> None:
    if unplaced:
        raise ValueError(
            f"{unplaced} rows lack {order.time!r} or {order.tiebreak!r} and have no place in the order"
        )
