"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import free_name, numbered, whole_text
from stormframe.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Rates of up to so many sources are broadcast, if their names stay below NAME_BYTES together.
BROADCAST_SOURCES = 10_000
NAME_BYTES = 4_000_000
SALTS = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``(source, source_size, target, rate)`` per source, from ``(source, size)`` rows.

    Sources in code point order, null last, take the weights in turn. The total size is shared by
    weight; a share stops at ``cap`` times the source's size and the excess is shared again by
    weight among the others, until none is above its stop. Each round is one aggregate over the
    sources, and at least one source stops in it.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = numbered(per_source, order, "rank")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    table = stored(
        ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))),
        "sources",
    )
    stop = F.col("source_size") * F.lit(float(cap))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = stop <= F.col("weight") * F.lit(level)
        state = table.agg(
            F.count_if(full).alias("stopped"),
            F.sum(F.when(full, stop).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if state["stopped"] == stopped or not state["open"]:
            break
        stopped, level = state["stopped"], (total - state["taken"]) / state["open"]
    full = stop <= F.col("weight") * F.lit(level)
    target = F.when(full, stop).otherwise(F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") == 0, 0.0).when(full, F.lit(float(cap)))
    rate = rate.otherwise(target / F.col("source_size"))
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mix_rates(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    seed: str = SEED,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    A document is emitted ``floor(rate)`` times, and once more if a number in [0, 1) made from the
    seed and its ``doc_id`` is below the rate's fraction, so reruns and retries agree. Null and
    empty texts have size 0, a null source is a source of its own, rows that share an id share its
    number, and a total of zero gives no copies. Columns of ``docs`` with one of the four names
    are replaced.
    """
    size = word_count(whole_text()) if size is None else size
    own = ["size", "source_size", "target", "copies"]
    rest = docs.drop(*own)
    sized = rest.withColumn("size", size)
    rates = stored(source_targets(sized.select("source", "size"), weights, cap), "rates")
    small = rates.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    other, rate, salt, of = (free_name(docs, n) for n in ("_source", "rate", "_salt", "_of"))
    right = rates.select(
        F.col("source").alias(other), "source_size", "target", F.col("rate").alias(rate)
    )
    same = sized["source"].eqNullSafe(right[other])
    if small[0] <= BROADCAST_SOURCES and (small[1] or 0) <= NAME_BYTES:
        joined = sized.join(F.broadcast(right), same)
    else:
        # Each source's row is repeated per salt, so a source with a third of all rows is split.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        sized = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        right = right.withColumn(of, salts)
        joined = sized.join(right, (sized[salt] == right[of]) & sized["source"].eqNullSafe(right[other]))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    whole = F.floor(rate)
    extra = (number < F.col(rate) - whole).cast("long")
    return joined.withColumn("copies", whole + extra).select(*rest.columns, *own)


def emit_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with its own columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    mixed = mix_rates(docs.select("doc_id", "source", "text", row), **settings).where("copies > 0")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return mixed.select("row", each).select("row.*")
