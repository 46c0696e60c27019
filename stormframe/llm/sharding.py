"""Contiguous shards whose largest is as small as it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import join_groups, numbered, running_total, sha256, whole_text
from stormframe.session import stored

SHARDS = 8
#: Capacities tried in one round of the search.
TRIES = 32


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, tries: int = TRIES) -> tuple[int, list[int]]:
    """Smallest feasible capacity and where each shard ends, as totals of ``size`` so far.

    ``groups`` is a stored table with the running total ``upto`` and ``size`` of each atomic group
    in order. A capacity is feasible if the greedy walk, which fills a shard until the next group
    would not fit, needs no more than ``shards``. The walk needs one look-up per shard: the last
    total that is no larger than the shard's start plus the capacity. A round tries ``tries``
    capacities between the bounds at once, so a look-up is one aggregate with one number per
    capacity, and the number of rounds is the logarithm of the largest group to that base.
    """
    bounds = groups.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    total, largest = bounds["total"] or 0, bounds["largest"] or 0
    if not total:
        return 0, [0] * shards
    low = max(largest, -(-total // shards))
    high = max(low, -(-total // shards) + largest)

    def walk(capacities: list[int]) -> list[list[int]]:
        starts, cuts = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(shards):
            ends = [s + c for s, c in zip(starts, capacities, strict=True)]
            near = groups.where(F.col("upto").between(min(starts), max(ends)))
            found = near.agg(
                *(F.max(F.when(F.col("upto") <= e, F.col("upto"))).alias(f"c{i}") for i, e in enumerate(ends))
            ).first()
            starts = [s if f is None else f for s, f in zip(starts, found, strict=True)]
            for cut, start in zip(cuts, starts, strict=True):
                cut.append(start)
            if min(starts) == total:
                break
        return [c + [total] * (shards - len(c)) for c in cuts]

    best = walk([high])[0]
    while low < high:
        step = max(1, (high - low) // tries)
        capacities = list(range(low, high, step))
        walks = walk(capacities)
        feasible = [i for i, w in enumerate(walks) if w[-1] == total]
        if feasible:
            high, best = capacities[feasible[0]], walks[feasible[0]]
            low = capacities[feasible[0] - 1] + 1 if feasible[0] else high
        else:
            low = capacities[-1] + 1
    return high, best


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row of ``docs``.

    Size is the text's UTF-8 bytes plus 1. Rows with equal texts form an atomic group; groups are
    ordered by their smallest ``doc_id``, then by digest, and split so that the largest shard is
    as small as possible. ``slot`` counts from 0 in each shard, in that order. Null text has size
    1, and its own checksum 0, like the empty text it is grouped with. With fewer groups than
    shards the last shards stay empty. Rows with equal ids and texts get slots in any order.
    """
    text = whole_text()
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sha256(text).alias("digest"),
        ),
        "sizes",
    )
    groups = rows.groupBy("digest").agg(
        F.coalesce(F.min("doc_id"), F.lit(-(1 << 62))).alias("first_id"),
        F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("n"),
    )
    placed = stored(running_total(stored(groups, "groups"), ["first_id", "digest"], "size", "upto"), "placed")
    _, cuts = minimax_cuts(placed, shards)
    shard = sum((F.col("upto") > cut).cast("int") for cut in cuts[:-1]) if shards > 1 else F.lit(0)
    sharded = stored(placed.select("digest", "first_id", "n", shard.cast("int").alias("shard")), "shards")
    joined = join_groups(rows, sharded, "digest", "n").drop("n")
    order = ["shard", "first_id", "digest", F.col("doc_id").asc_nulls_first()]
    places = numbered(stored(joined, "rows"), order, "place")
    starts = {r["shard"]: r["start"] for r in places.groupBy("shard").agg(F.min("place").alias("start")).collect()}
    start: Column = F.lit(0)
    for k, first in starts.items():
        start = F.when(F.col("shard") == k, F.lit(first)).otherwise(start)
    return places.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - start).alias("slot"))
