"""Packing token sequences with patterns fitted to the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import numbered, whole_text
from stormframe.session import stored

LIMIT = 2048
END_ID = 0
FIT_STEPS = 300
#: Shares of the fitted counts that are tried.
FITTED_SHARES = (1.0, 0.75, 0.5, 0.25)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Fixed values of the vocabulary: its special token, and what splits a text into words before merges.
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    ``path`` is a file of ranks; beside it lies the tokenizer's own JSON file of the same name. The
    name of a special token in a text is that token's id, as the tokenizer has it. A text that the
    encoder of ranks refuses, as it does a run of a million spaces, is encoded by the tokenizer.
    """

    def __init__(self, path: str, pattern: str = PATTERN, special: dict[str, int] = SPECIAL):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.path = path
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(str(Path(self.path).with_suffix(".json")))

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode(text, allowed_special="all")
        except ValueError:  # its regex ran out of stack
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """``PIECES`` of every row: its ids and ``end_id``, cut if there are more than ``limit``.

    ``tokenizer`` is the file of ranks, which every executor must have at that path, with the JSON
    file beside it.

    All pieces of a cut document hold ``limit`` ids but the first, which may hold fewer.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = RankEncoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = encoder.encode(text.as_py()) + end
                count = len(code) // 4
                start, stop = 0, count % limit or limit
                piece = 0
                while start < count:
                    crc = zlib.crc32(code[4 * start : 4 * stop])
                    out.append((doc_id, piece, start, stop - start, crc))
                    start, stop, piece = stop, stop + limit, piece + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(cut, PIECES)


def length_patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of up to three of ``lengths`` that fill ``limit`` exactly, 0 where unused."""
    there = np.zeros(limit + 1, bool)
    there[lengths] = True
    found = []
    if there[limit]:
        found.append([[limit, 0, 0]])
    low = lengths[lengths <= limit // 2]
    pair = low[there[limit - low]]
    found.append(np.stack([limit - pair, pair, 0 * pair], 1))
    for a in lengths[(lengths >= -(-limit // 3)) & (lengths < limit - 1)]:
        b = lengths[(lengths <= a) & (lengths < limit - a) & (2 * lengths >= limit - a)]
        b = b[there[limit - a - b]]
        found.append(np.stack([np.full_like(b, a), b, limit - a - b], 1))
    return np.concatenate([np.asarray(f, np.int64).reshape(-1, 3) for f in found])


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come nearest to the histogram.

    Accelerated projected gradient steps. Long pieces weigh more, as they are hardest to place.
    """
    size = len(histogram)
    used = patterns > 0
    weight = np.sqrt(np.arange(size) / (size - 1) + 0.1)

    def forward(x):
        total = np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), size)
        total[0] = 0
        return total * weight

    def back(r):
        return ((r * weight)[patterns] * used).sum(1)

    goal = histogram * weight
    x = np.zeros(len(patterns))
    probe = np.ones(len(patterns))
    for _ in range(8):  # the largest eigenvalue bounds the step
        probe = back(forward(probe / np.linalg.norm(probe)))
    step = 1.0 / (1.05 * np.linalg.norm(probe))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(forward(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_packing(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` whose lengths add up to ``histogram`` (``histogram[n]``: pieces of n).

    Where pieces above half of ``limit`` outnumber their partners, full patterns use up the short
    ones too soon; so smaller shares of the fitted counts are also tried, and the plan with the
    fewest sequences is taken, of equal ones that with the largest share.
    """
    if not histogram.any():
        return []
    patterns = length_patterns(np.flatnonzero(histogram), limit)
    fitted = fit_counts(patterns, histogram.astype(float)) if len(patterns) else np.zeros(0)
    plans = []
    for share in FITTED_SHARES:
        plan, left = round_patterns(histogram, patterns, share * fitted)
        plans.append(plan + best_fit(left, limit))
    return min(plans, key=lambda plan: sum(repeats for _, repeats in plan))


def round_patterns(
    histogram: np.ndarray, patterns: np.ndarray, fitted: np.ndarray
) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts, and what they leave of each length.

    Counts are rounded down; then those with the largest remainders get one more, until the total is that
    of the fit. A pattern repeats only as often as there are pieces for it.
    """
    left = histogram.astype(np.int64).copy()
    repeats: dict[int, int] = defaultdict(int)
    whole = np.floor(fitted).astype(np.int64)
    fraction = fitted - whole
    extra = int(round(float(fraction.sum())))
    large = np.flatnonzero(whole)
    for i, wanted, one_more in (
        *((i, int(whole[i]), False) for i in large[np.argsort(-fitted[large], kind="stable")].tolist()),
        *((i, 1, True) for i in np.argsort(-fraction, kind="stable").tolist()),
    ):
        if one_more and (not extra or not fraction[i]):
            break
        lengths = [int(n) for n in patterns[i] if n]
        need = {n: lengths.count(n) for n in lengths}
        times = min(wanted, *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            repeats[i] += times
            extra -= one_more
            for n, k in need.items():
                left[n] -= k * times
    return [(tuple(int(n) for n in patterns[i] if n), times) for i, times in repeats.items()], left


def best_fit(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece where it leaves the least room; equal pieces go together by count."""
    left = histogram
    plan: list[tuple[tuple[int, ...], int]] = []
    rooms: dict[int, list[list]] = defaultdict(list)  # by room left: [lengths, repeats]
    open_rooms = np.zeros(limit + 1, bool)
    for n in np.flatnonzero(left)[::-1]:
        count = int(left[n])
        while count:
            fits = np.flatnonzero(open_rooms[n:])
            if not len(fits):
                each = limit // int(n)
                whole, rest = divmod(count, each)
                for repeats, times in ((whole, each), (1, rest)):
                    if repeats and times:
                        room = limit - times * int(n)
                        rooms[room].append([(int(n),) * times, repeats])
                        open_rooms[room] = True
                break
            room = int(n) + int(fits[0])
            lengths, repeats = rooms[room].pop()
            taken = min(repeats, count)
            if repeats > taken:
                rooms[room].append([lengths, repeats - taken])
            open_rooms[room] = bool(rooms[room])
            rooms[room - int(n)].append([(*lengths, int(n)), taken])
            open_rooms[room - int(n)] = True
            count -= taken
    plan += [(tuple(p), r) for parts in rooms.values() for p, r in parts]
    return plan


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset``: where each piece lies.

    Pieces are stored and numbered by length, so the k-th piece of a length is known without
    bringing a length's pieces together. Only the histogram of lengths, ``limit`` numbers at most,
    reaches the driver; the plan made from it has a bound that depends on ``limit`` alone. Null and
    empty texts are one ``end_id`` each. Rows that share a ``doc_id`` are packed one by one; null
    ids and other columns change nothing. An empty table gives an empty result.
    """
    pieces = stored(token_pieces(docs, tokenizer, limit, end_id), "pieces")
    placed = numbered(pieces, ["length", "doc_id", "piece"], "place")
    histogram = np.zeros(limit + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    next_place = np.concatenate([[0], np.cumsum(histogram)[:-1]])
    slots, sequence = [], 0
    for lengths, repeats in plan_packing(histogram, limit):
        offset = 0
        for n in lengths:
            slots.append((int(next_place[n]), sequence, offset))
            next_place[n] += repeats
            offset += n
        sequence += repeats
    table = np.array(sorted(slots), np.int64).reshape(-1, 3)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def put(frames):
        starts, sequences, offsets = shared.value.T
        for frame in frames:
            place = frame.pop("place").to_numpy()
            at = np.searchsorted(starts, place, "right") - 1
            frame["sequence_id"] = sequences[at] + place - starts[at] if len(frame) else []
            frame["offset"] = offsets[at] if len(frame) else []
            yield frame

    return placed.select(*pieces.columns, "place").mapInPandas(
        put, f"{PIECES}, sequence_id long, offset long"
    )
