"""Nearest vectors by inner product: one small-world graph per shard, shard results merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stormframe.session import stored

NEAREST = 20
SHARD_VECTORS = 8192
#: Queries that meet a shard in one task, so that a shard is sent as rarely, and those that walk it together: a
#: walk marks nodes seen, a byte for each query and node.
QUERY_BLOCK = 65_536
WALKERS = 4096
#: Links of a node on the base layer; half as many above.
LINKS = 32
CANDIDATES = 96
BEAM = 96
#: Each layer holds one in so many nodes of the layer below.
LAYER_RATIO = 32
BUILD_BLOCK = 256

INDEX = "shard int, node int, embedding array<double>, ids array<long>, layer int, links array<int>"
FOUND = "query_id long, vec_id long, score double"


def usable_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of rows that take part, one per ``vec_id``.

    Left out: null ids, null vectors, vectors with null or non-finite components, zero vectors,
    and vectors of another length than most have. Of rows that share an id the smallest vector,
    compared element by element, is used.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0.0))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").first()
    rows = rows.where(F.size("embedding") == (usual["length"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _links(lifted: np.ndarray, members: np.ndarray, width: int) -> np.ndarray:
    """Links of ``members`` among themselves: near ones not behind another link, and large products."""
    points = lifted[members]
    norms = (points * points).sum(1)
    links = np.full((len(members), width), -1, np.int32)
    count = min(CANDIDATES, len(members) - 1)
    if count < 1:
        return links
    for at in range(0, len(members), BUILD_BLOCK):
        block = points[at : at + BUILD_BLOCK]
        rows = np.arange(len(block))
        far = norms[None, :] - 2.0 * (block @ points.T)  # squared distance less a constant per row
        far[rows, at + rows] = np.inf
        near = np.argpartition(far, count - 1, axis=1)[:, :count]
        order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        own = np.take_along_axis(far, near, 1) + norms[at + rows, None]
        them = points[near]
        between = norms[near][:, :, None] + norms[near][:, None, :] - 2.0 * (them @ them.transpose(0, 2, 1))
        taken = np.zeros(near.shape, bool)
        for c in range(count):
            behind = (taken[:, :c] & (between[:, c, :c] < own[:, c, None])).any(1)
            taken[:, c] = ~behind & (taken[:, :c].sum(1) < width // 2)
        # Half of the places go to spread links, half to the largest products that are left: long
        # vectors are the answer to many queries but near to few vectors.
        half = min(width // 2, count)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :half]
        spread = np.where(np.take_along_axis(taken, rank, 1), np.take_along_axis(near, rank, 1), -1)
        product = block[:, :-1] @ points[:, :-1].T
        product[rows, at + rows] = -np.inf
        most = min(width, count)
        top = np.argpartition(-product, most - 1, axis=1)[:, :most]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(product, top, 1), axis=1, kind="stable"), 1)
        known = (top[:, :, None] == spread[:, None, :]).any(2)
        top = np.take_along_axis(top, np.argsort(known, axis=1, kind="stable"), 1)[:, : width - half]
        chosen = np.concatenate([spread, top], 1)
        links[at : at + len(block), : chosen.shape[1]] = np.where(chosen >= 0, members[chosen], -1)
    return links


def build_graph(vectors: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Top layer of each node, and per layer its members and their links (flat, -1 where unused).

    Vectors get one more component so that all have the same length; the nearest by distance are
    then the largest by inner product. ``chance`` in (0, 1] sets a node's layer.
    """
    squares = (vectors * vectors).sum(1)
    lifted = np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1)
    lifted = lifted.astype(np.float32)
    layer = np.floor(-np.log(chance) / np.log(LAYER_RATIO)).astype(int)
    layers = []
    for k in range(int(layer.max()) + 1):
        members = np.flatnonzero(layer >= k)
        layers.append((members, _links(lifted, members, LINKS if k == 0 else LINKS // 2)))
    return layer, layers


def search_graph(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes of the beam for each query, best first; -1 where there are fewer.

    All queries walk at once: in each round every query expands its best open nodes.
    """
    vectors, queries = vectors.astype(np.float32), queries.astype(np.float32)
    count, rows = len(queries), np.arange(len(queries))
    members, links = layers[-1]
    entry = np.full(count, members[0])
    best = queries @ vectors[members[0]]
    for members, links in layers[:0:-1]:
        place = np.full(len(vectors), -1)
        place[members] = np.arange(len(members))
        moving = np.ones(count, bool)
        while moving.any():
            at = np.flatnonzero(moving)
            near = links[place[entry[at]]]
            value = np.where(near >= 0, np.einsum("qld,qd->ql", vectors[near], queries[at]), -np.inf)
            pick = value.argmax(1)
            better = value[np.arange(len(at)), pick] > best[at]
            moving[at[~better]] = False
            entry[at[better]] = near[better, pick[better]]
            best[at[better]] = value[better, pick[better]]
    links = layers[0][1]
    beam = min(beam, len(vectors))
    nodes = np.full((count, beam), -1, np.int32)
    values = np.full((count, beam), -np.inf, np.float32)
    opened = np.zeros((count, beam), bool)
    seen = np.zeros((count, len(vectors)), bool)
    nodes[:, 0], values[:, 0], seen[rows, entry] = entry, best, True
    # The members of the upper layers are further entries, so separate groups are all reached.
    extra = layers[1][0] if len(layers) > 1 else np.zeros(0, int)
    if len(extra) and beam > 1:
        value = queries @ vectors[extra].T
        top = np.argsort(-value, axis=1, kind="stable")[:, : beam // 4]
        for c in range(min(top.shape[1], beam - 1)):
            node = extra[top[:, c]]
            fresh = ~seen[rows, node]
            nodes[fresh, c + 1], values[fresh, c + 1] = node[fresh], value[rows, top[:, c]][fresh]
            seen[rows, node] = True
    while True:
        open_value = np.where(opened | (nodes < 0), -np.inf, values)
        pick = np.argpartition(-open_value, min(3, beam - 1), axis=1)[:, :4]
        ready = np.take_along_axis(open_value, pick, 1) > -np.inf
        at = np.flatnonzero(ready.any(1))
        if not len(at):
            break
        np.put_along_axis(opened, pick, ready | np.take_along_axis(opened, pick, 1), 1)
        near = np.where(ready[at][:, :, None], links[np.where(ready[at], np.take_along_axis(nodes[at], pick[at], 1), 0)], -1)
        near = near.reshape(len(at), -1)
        near[(near >= 0) & seen[at[:, None], near]] = -1
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[np.broadcast_to(at[:, None], near.shape)[near >= 0], near[near >= 0]] = True
        value = np.where(near >= 0, np.einsum("qld,qd->ql", vectors[near], queries[at]), -np.inf)
        all_nodes = np.concatenate([nodes[at], near], 1)
        all_values = np.concatenate([values[at], value], 1)
        all_opened = np.concatenate([opened[at], np.zeros(near.shape, bool)], 1)
        keep = np.argpartition(-all_values, beam - 1, axis=1)[:, :beam]
        nodes[at] = np.take_along_axis(all_nodes, keep, 1)
        values[at] = np.take_along_axis(all_values, keep, 1)
        opened[at] = np.take_along_axis(all_opened, keep, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1)


def build_index(rows: DataFrame, nearest: int = NEAREST, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``INDEX`` rows, stored: a graph over the distinct vectors of each shard.

    Vectors go to shards by their hash, so equal ones share a node. A node keeps its ``nearest`` +
    1 smallest ids: any further id has that many rows of equal score before it in every result.
    """
    count = rows.count()
    shards = max(1, -(-count // shard_vectors))
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = (
        rows.withColumn("_rank", first).where(F.col("_rank") <= nearest + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    )

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda c: c.map(lambda v: v[0])).reset_index(drop=True)
        vectors = np.stack(frame["embedding"].to_numpy())
        first_id = np.array([v[0] for v in frame["ids"]]).astype(np.uint64)
        mixed = (first_id + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        chance = ((mixed >> np.uint64(11)).astype(float) + 1) / float(1 << 53)
        layer, layers = build_graph(vectors, chance)
        flat: list[list[np.ndarray]] = [[] for _ in range(len(frame))]
        for members, links in layers:
            for node, near in zip(members, links, strict=True):
                flat[node].append(near)
        frame["links"] = [np.concatenate(parts) for parts in flat]
        frame["layer"], frame["node"] = layer.astype(np.int32), np.arange(len(frame), dtype=np.int32)
        return frame[["shard", "node", "embedding", "ids", "layer", "links"]]

    return stored(nodes.groupBy("shard").applyInPandas(build, INDEX), "index")


def _layers_of(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    layer = frame["layer"].to_numpy()
    layers = [(np.arange(len(frame)), np.stack([v[:LINKS] for v in frame["links"]]))]
    half = LINKS // 2
    for k in range(1, int(layer.max()) + 1):
        members = np.flatnonzero(layer >= k)
        start = LINKS + (k - 1) * half
        layers.append((members, np.stack([v[start : start + half] for v in frame["links"].iloc[members]])))
    return layers


def search(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = BEAM,
           shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``nearest`` rows found for each query.

    ``rows`` and ``queries`` are ``(vec_id, embedding)`` as :func:`usable_vectors` gives them. A
    task holds one shard and one block of queries, and the index is sent once for each block. Scores
    are inner products of the original vectors in double precision, ties go to the smaller
    ``vec_id``, and a query does not find its own id. Fewer rows than ``nearest`` are all found;
    without any, the result is empty.
    """
    index = build_index(rows, nearest, shard_vectors)
    blocks = max(1, -(-queries.count() // query_block))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select("vec_id", "embedding", block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        graph = graph.sort_values("node").reset_index(drop=True)
        vectors = np.stack(graph["embedding"].to_numpy())
        asked = np.stack(queries["embedding"].to_numpy())
        layers = _layers_of(graph)
        parts = (asked[at : at + WALKERS] for at in range(0, len(asked), WALKERS))
        nodes = np.concatenate([search_graph(vectors, layers, part, beam) for part in parts])
        ids = graph["ids"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for query_id, vector, found in zip(queries["vec_id"], asked, nodes, strict=True):
            found = found[found >= 0]
            score = vectors[found] @ vector
            found_ids = np.concatenate([ids[n] for n in found])
            scores = np.repeat(score, [len(ids[n]) for n in found])
            other = found_ids != query_id
            found_ids, scores = found_ids[other], scores[other]
            best = np.lexsort((found_ids, -scores))[:nearest]
            out.append((found_ids[best], scores[best]))
        sizes = [len(found_ids) for found_ids, _ in out]
        found_ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": np.repeat(queries["vec_id"].to_numpy(), sizes), "vec_id": found_ids, "score": scores})

    found = spread.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(find, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
