"""Repeated passages: bytes covered by a string of a given length that also starts earlier.

Texts are cut into runs of neighbouring starting points that share an anchor: the k-gram of least
hash inside the string that begins there. Equal strings share their anchor, so an anchor that
occurs once, or always in the same surroundings, settles its starting points at once. Runs with
one anchor in different surroundings meet in blocks of text whose Burrows-Wheeler transform tells
which starting points share a common prefix of the full length. The starting points of anchors that
are too common for one block are told apart by their own strings.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import join_groups, numbered, partitions, sha256, whole_text
from stormframe.llm.shingles import mixed
from stormframe.session import stored

LENGTH = 100
#: Bytes of texts that a task looks at together; longer texts are cut, with overlap.
BLOCK_BYTES = 2_000_000
#: Bytes of runs in one transform, about; no anchor with more comes to a transform.
TRANSFORM_BYTES = 1_000_000
POSITION_BITS = 23
#: Common anchors (8 bytes each) that are broadcast, at most; more are joined.
BROADCAST_ANCHORS = 1_000_000

_SEED = np.random.default_rng(30)
_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_RUNS = "bucket int, hash binary, digest binary, doc_id binary, start binary, n binary"
_FOUND = "open boolean, hash long, doc_id long, start long, n long"


class _Sums:
    """Hashes of any substring of a block from its prefix sums."""

    def __init__(self, size: int):
        self.size = 0
        self._grow(size)

    def _grow(self, size: int) -> None:
        up = np.full(size, np.uint64(_BASE))
        down = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.up, self.down, self.size = np.multiply.accumulate(up), np.multiply.accumulate(down), size

    def of(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > self.size:
            self._grow(2 * len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=sums[1:])
        return sums


def anchored_runs(parts: list[bytes], length: int, powers: _Sums):
    """Runs of starting points with one anchor, over several texts at once.

    Returns, per run, its text's number, first start, number of starts, the anchor's hash and a
    digest of 16 bytes (two numbers) of everything from the first start to the end of the last string.
    Only the digest is taken for equality; anchors with one hash merely meet.
    """
    k = max(1, length // 3)
    window = length - k + 1
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    firsts = np.cumsum(sizes) - sizes
    sums = powers.of(data)
    grams = mixed((sums[k:] - sums[:-k]) * powers.down[: len(data) - k + 1])
    position = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (grams & ~low) | position  # ties go to the left
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), np.maximum(sizes - length + 1, 0))
    starts = np.arange(len(owner)) + (firsts - np.cumsum(np.maximum(sizes - length + 1, 0)) + np.maximum(sizes - length + 1, 0))[owner]
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    first, run_owner, place = starts[at], owner[at], anchor[at]
    view = memoryview(data)
    ends = (first + n - 1 + length).tolist()
    digests = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), ends, strict=True)])
    return run_owner, first - firsts[run_owner], n, grams[place], np.frombuffer(digests, "<u8").reshape(-1, 2)


def _parts(batches, length: int):
    """``(ids, offsets, parts)`` of about ``BLOCK_BYTES``; parts of one text overlap by length - 1."""
    ids, offsets, parts, held = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py().encode()
            for at in range(0, max(0, len(text) - length + 1), BLOCK_BYTES):
                part = text[at : at + BLOCK_BYTES + length - 1]
                if parts and held + len(part) > BLOCK_BYTES:
                    yield ids, offsets, parts
                    ids, offsets, parts, held = [], [], [], 0
                ids.append(doc_id.as_py())
                offsets.append(at)
                parts.append(part)
                held += len(part)
    if parts:
        yield ids, offsets, parts


def _earliest(hashes, digests, ids, starts):
    """Order by hash, digest and place; the first of each pair, and rows that repeat it later."""
    order = np.lexsort((starts, ids, digests[:, 1], digests[:, 0], hashes))
    h, d, i, s = hashes[order], digests[order], ids[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]).any(1)
    group = np.cumsum(new) - 1
    later = (i != i[new][group]) | (s != s[new][group])
    return order, new, later


def _found(opened: bool, hashes, ids, starts, n) -> pd.DataFrame:
    return pd.DataFrame({"open": opened, "hash": hashes.astype(np.int64), "doc_id": ids, "start": starts, "n": n.astype(np.int64)})


def _settle_runs(rows: DataFrame, length: int) -> DataFrame:
    """``_FOUND``: runs that repeat an earlier one, and runs that are still open."""
    buckets = 4 * partitions(rows)

    def cut(batches):
        powers = _Sums(BLOCK_BYTES + length)
        names = [f.split()[0] for f in _RUNS.split(", ")]
        for ids, offsets, parts in _parts(batches, length):
            owner, start, n, hashes, digests = anchored_runs(parts, length, powers)
            ids, start = np.array(ids, np.int64)[owner], start + np.array(offsets, np.int64)[owner]
            order, new, later = _earliest(hashes, digests, ids, start)
            keep = order[new]
            keep = keep[np.argsort(hashes[keep] % np.uint64(buckets), kind="stable")]
            bucket = (hashes[keep] % np.uint64(buckets)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            out = [(int(bucket[c[0]]), *(x[keep[c]] for x in (hashes, digests, ids, start)), n[keep[c]].astype(np.uint8 if length <= 255 else np.int64))
                   for c in np.split(np.arange(len(keep)), cuts) if len(c)]
            covered = order[later]
            if len(covered):  # settled already; without a hash they pass through
                out.append((int(ids[0] % buckets), np.zeros(0, np.uint64), np.zeros(0, np.uint64), ids[covered], start[covered],
                            n[covered].astype(np.uint8 if length <= 255 else np.int64)))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        width = np.uint8 if length <= 255 else np.int64

        def flat(rows, name, kind):
            return np.frombuffer(b"".join(rows[name]), kind)

        passed = frame["hash"].map(len) == 0
        done, runs = frame[passed], frame[~passed]
        out = [_found(False, np.zeros(len(flat(done, "doc_id", np.int64))), flat(done, "doc_id", np.int64), flat(done, "start", np.int64), flat(done, "n", width))]
        hashes, digests = flat(runs, "hash", np.uint64), flat(runs, "digest", np.uint64).reshape(-1, 2)
        ids, start, n = flat(runs, "doc_id", np.int64), flat(runs, "start", np.int64), flat(runs, "n", width)
        if len(hashes):
            order, new, later = _earliest(hashes, digests, ids, start)
            covered = order[later]
            out.append(_found(False, hashes[covered], ids[covered], start[covered], n[covered]))
            first = order[new]
            same = hashes[first][1:] == hashes[first][:-1]
            several = first[np.append(False, same) | np.append(same, False)]
            out.append(_found(True, hashes[several], ids[several], start[several], n[several]))
        return pd.concat(out)

    return rows.mapInArrow(cut, _RUNS).groupBy("bucket").applyInPandas(settle, _FOUND)


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes ordered by their first ``length`` symbols at least, by doubling; symbols below 512."""
    size = len(symbols)
    key, span = symbols.astype(np.int64), 1
    while span < 4:
        key = (key << (9 * span)) | np.append(key[span:], np.zeros(span, np.int64))[:size]
        span *= 2
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(size, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(new)
        if span >= length or rank[order[-1]] == size:
            return order
        key = rank * (size + 1) + np.append(rank[span:], np.zeros(span, np.int64))[:size]
        span *= 2


def long_prefix_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether a new class of ``length``-prefixes begins.

    ``symbols`` ends each part with 0. Intervals of suffixes that begin with a common string are
    extended by one symbol to the left, all of one string length before the next (breadth first).
    The right end of an extended interval is a border whose common prefix has just that many
    symbols, unless a shorter string has set it; then the interval need not be followed. Values
    therefore come in increasing order, and the walk stops at ``length``: borders never reached
    have a common prefix of at least that. Parts' ends are last symbols only: nothing is extended
    over them.
    """
    size = len(symbols)
    order = suffix_order(symbols, length)
    before = symbols[order - 1]  # the transform
    step = np.empty(size, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(size)
    border = np.zeros(size + 1, bool)
    border[[0, size]] = True
    ends = np.cumsum(np.bincount(symbols, minlength=512))
    starts = ends - np.bincount(symbols, minlength=512)
    there = ends > starts
    low, high = starts[there], ends[there]
    fresh = ~border[high]
    border[high] = True
    # The last symbol's interval reaches the end, as the empty string does, and is followed once.
    fresh[-1] = True
    low, high = low[fresh], high[fresh]
    for _ in range(1, length):
        if not len(low):
            break
        sizes = high - low
        total = int(sizes.sum())
        interval = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(total) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        symbol = before[at]
        inner = symbol > 0
        at, interval, symbol = step[at[inner]], interval[inner], symbol[inner]
        turn = np.argsort(at, kind="stable")
        at, interval, symbol = at[turn], interval[turn], symbol[turn]
        new = np.ones(len(at), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        low = at[new]
        high = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1 if len(at) else low
        fresh = ~border[high]
        low, high = low[fresh], high[fresh]
        border[high] = True
    return order, border[:size]


def _settle_open(runs: DataFrame, length: int) -> DataFrame:
    """``(doc_id, start, n)`` of open starting points whose string also starts earlier.

    ``runs`` has ``hash, doc_id, start, n, piece``.
    """

    def transform(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = frame["piece"].tolist()
        joined = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        sizes = np.array([len(p) for p in pieces])
        symbols = np.zeros(len(joined) + len(pieces), np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        symbols[np.arange(len(joined)) + owner] = joined
        order, new = long_prefix_classes(symbols, length)
        group = np.cumsum(new)
        counts = np.bincount(group)
        order, group = order[counts[group] > 1], group[counts[group] > 1]
        firsts = np.cumsum(sizes + 1) - (sizes + 1)
        piece = np.searchsorted(firsts, order, "right") - 1
        inside = order - firsts[piece]
        valid = inside < frame["n"].to_numpy()[piece]
        piece, inside, group = piece[valid], inside[valid], group[valid]
        ids, starts = frame["doc_id"].to_numpy()[piece], frame["start"].to_numpy()[piece] + inside
        turn = np.lexsort((starts, ids, group))
        ids, starts, group = ids[turn], starts[turn], group[turn]
        first = np.ones(len(group), bool)
        first[1:] = group[1:] != group[:-1]
        which = np.cumsum(first) - 1
        later = (ids != ids[first][which]) | (starts != starts[first][which])
        return pd.DataFrame({"doc_id": ids[later], "start": starts[later], "n": np.ones(int(later.sum()), np.int64)})

    total = runs.agg(F.sum(F.length("piece"))).first()[0] or 0
    blocks = max(1, -(-total // TRANSFORM_BYTES))
    blocked = runs.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)))
    return blocked.groupBy("block").applyInPandas(transform, "doc_id long, start long, n long")


def _settle_common(runs: DataFrame, length: int) -> DataFrame:
    """What ``_settle_open`` gives, for anchors whose runs do not fit one transform.

    Every starting point goes by the digest of its own string. Firsts are aggregated before they
    are shuffled and common strings are joined apart, so no task holds all places of a string.
    """
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at")
    points = runs.select("doc_id", "start", "piece", at).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"),
        F.substring("piece", (F.col("at") + 1).cast("int"), F.lit(length)).alias("string"),
    )
    points = points.where(F.length("string") == length).withColumn("string", sha256(F.col("string")))
    firsts = points.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.where(F.col("n") > 1), "firsts")
    later = join_groups(points, firsts, "string", "n").where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    )
    return later.select("doc_id", "start", F.lit(1).cast("long").alias("n"))


def _pieces(rows: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """``hash, doc_id, start, n, piece`` of open runs, stored; piece is their bytes."""
    per_doc = opened.groupBy("doc_id").agg(
        F.collect_list(F.struct("hash", "start", "n")).alias("runs")  # as many as the text is long, at most
    )

    def take(batches):
        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(c) for c in range(3)), strict=True):
                data, flat = text.as_py().encode(), runs.values
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                pieces = [data[s : s + m - 1 + length] for s, m in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat.field("hash"), pa.array([doc_id.as_py()] * len(flat), pa.int64()), flat.field("start"), flat.field("n"), pa.array(pieces, pa.binary())],
                    ["hash", "doc_id", "start", "n", "piece"],
                )

    joined = rows.join(per_doc, "doc_id").select("doc_id", "text", "runs")
    return stored(joined.mapInArrow(take, "hash long, doc_id long, start long, n long, piece binary"), "pieces")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for each row of ``docs``.

    Each byte is removed that is covered by a string of ``length`` bytes which also starts earlier:
    in a document of smaller ``doc_id``, or before in the same one. Overlaps count, and strings are
    judged on the input. ``spans`` are the maximal removed runs as (start, length) in bytes, and
    ``kept`` the other bytes, which need not be valid UTF-8. Null text is empty. Rows with a null
    ``doc_id`` match nothing and stay whole. Rows that share an id are separate documents, in the order
    of their texts. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    shared = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if shared.isEmpty():
        return _remove(docs.withColumn("row", F.col("doc_id")), length)
    # Then rows go by their place in the order, which is a number of their own.
    placed = numbered(docs.where(F.col("doc_id").isNotNull()), ["doc_id", "text"], "row")
    others = docs.where(F.col("doc_id").isNull()).withColumn("row", F.lit(None).cast("long"))
    return _remove(stored(placed.unionByName(others), "rows"), length)


def _remove(docs: DataFrame, length: int) -> DataFrame:
    """``remove_repeats`` of ``doc_id, text, row``; no two rows have one ``row``."""
    rows = docs.select(F.col("row").alias("doc_id"), "text")
    found = stored(_settle_runs(rows.where(F.col("doc_id").isNotNull()), length), "runs")
    pieces = _pieces(rows, found.where("open").select("hash", "doc_id", "start", "n"), length)
    sizes = pieces.groupBy("hash").agg(F.sum(F.length("piece")).alias("size"))
    common = stored(sizes.where(F.col("size") > TRANSFORM_BYTES).select("hash"), "common")
    number = common.count()
    marked = F.broadcast(common) if number <= BROADCAST_ANCHORS else common
    more = _settle_open(pieces.join(marked, "hash", "left_anti"), length)
    if number:
        more = more.unionByName(_settle_common(pieces.join(marked, "hash", "left_semi"), length))
    covered = found.where("not open").select("doc_id", "start", "n").unionByName(more)
    per_doc = covered.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))

    def cut(batches):
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                sizes.append(len(data))
                if not starts.is_valid:
                    spans.append([])
                    kept.append(data)
                    continue
                flat = starts.values
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + n - 1 + length, -1)
                gone = np.cumsum(depth)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = docs.join(per_doc.withColumnRenamed("doc_id", "row"), "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
