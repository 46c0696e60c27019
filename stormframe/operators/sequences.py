"""Sliding windows: each row is predicted from the ``window`` rows before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormframe.operators.ordered import POSITION

CHUNK_ROWS = 10_000


def sequence_windows(
    positioned: DataFrame,
    features: Sequence[str],
    target: str,
    window: int,
    time: str = "datetime",
    by: Sequence[str] = (),
    keep: Sequence[str] = (),
    chunk_rows: int | None = None,
) -> DataFrame:
    """One row per sample: ``target_ts``, ``y`` and ``x`` (window x features, 32-bit).

    ``positioned`` carries consecutive positions per series; ``by`` names what a window may
    not cross (the split, a series). Windows count rows and ignore time gaps.

    Positions are cut into chunks of equal size, whatever the times look like. The last
    ``window`` rows of a chunk are copied to the next one, so each chunk is finished alone
    after a single shuffle. A series of at most ``window`` rows gives no sample.
    """
    if window < 1:
        raise ValueError("window must be >= 1")
    # By default the copied rows are at most one in 64.
    chunk_rows = max(chunk_rows or max(CHUNK_ROWS, 64 * window), window)
    own = F.expr(f"{POSITION} div {chunk_rows}")
    at_end = F.col(POSITION) % chunk_rows >= chunk_rows - window
    rows = positioned.select(
        *dict.fromkeys([*by, *keep]),
        F.col(POSITION),
        F.col(time).alias("target_ts"),
        F.col(target).cast("float").alias("y"),
        F.array(*(F.col(f).cast("float") for f in features)).alias("_row"),
        own.alias("_own"),
        F.explode(F.when(at_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("_chunk"),
    )
    before = Window.partitionBy(*by, "_chunk").orderBy(POSITION).rowsBetween(-window, -1)
    return (
        rows.withColumn("x", F.collect_list("_row").over(before))
        .where((F.col("_own") == F.col("_chunk")) & (F.size("x") == window))
        .drop("_row", "_own", "_chunk")
    )


def require_windows(rows: int | Mapping[str, int], window: int) -> None:
    """Raise unless every series, by its known row count, gives a window.

    Lengths of features and target are compared where they are paired: ``read_aligned`` and
    ``align_features_target``.
    """
    if window < 1:
        raise ValueError("window must be >= 1")
    counts = rows if isinstance(rows, Mapping) else {"": rows}
    short = {name: n for name, n in counts.items() if n <= window}
    if short:
        told = ", ".join(f"{n} in {name}" if name else str(n) for name, n in short.items())
        raise ValueError(f"insufficient rows ({told}) for window length {window}")


def flatten_windows(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sequence table in long form: one row per window step, features as columns."""
    kept = [c for c in sequences.columns if c != "x"]
    return sequences.select(*kept, F.posexplode("x").alias("step", "_row")).select(
        *kept, "step", *(F.col("_row")[i].alias(f) for i, f in enumerate(features))
    )


def check_sequences(sequences: DataFrame) -> None:
    """Raise unless every sample has the same shape and no missing part.

    Types are checked on the schema; shapes take one aggregate over all rows.
    """
    types = dict(sequences.dtypes)
    if types.get("x") != "array<array<float>>" or types.get("y") != "float":
        raise ValueError(
            f"expected x array<array<float>> and y float, got {types.get('x')} and {types.get('y')}"
        )
    widths = F.transform("x", lambda row: F.size(row))
    shape = sequences.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"),
        F.min(F.size("x")).alias("short"),
        F.max(F.size("x")).alias("long"),
        F.min(F.array_min(widths)).alias("narrow"),
        F.max(F.array_max(widths)).alias("wide"),
    ).first()
    if shape["missing"]:
        raise ValueError(f"{shape['missing']} samples lack x or y")
    if shape["n"] and (shape["short"] != shape["long"] or shape["narrow"] != shape["wide"]):
        raise ValueError(
            f"samples differ in shape: {shape['short']}..{shape['long']} steps, "
            f"{shape['narrow']}..{shape['wide']} features"
        )


def align_features_target(
    x: DataFrame, y: DataFrame, keys: Sequence[str], check: bool = True
) -> DataFrame:
    """Pair features with targets one to one on the time key.

    ``check`` raises unless every key occurs once on each side. It aggregates the keys alone,
    combined before they are shuffled, so a key with many copies is not a hot spot.
    """
    if check:
        sides = x.select(*keys, F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(
            y.select(*keys, F.lit(0).alias("_x"), F.lit(1).alias("_y"))
        )
        found = (
            sides.groupBy(*keys)
            .agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
            .agg(
                F.sum("_x").alias("x_rows"),
                F.sum("_y").alias("y_rows"),
                F.count_if((F.col("_x") != 1) | (F.col("_y") != 1)).alias("bad"),
            )
            .first()
        )
        if found["bad"]:
            raise ValueError(
                f"features and target differ: {found['x_rows']} feature rows, "
                f"{found['y_rows']} target rows, {found['bad']} keys not paired one to one"
            )
    return x.join(y, list(keys), "inner")
