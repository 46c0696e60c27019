"""Distinct word shingles of many texts at once, as 64-bit numbers."""

from __future__ import annotations

import numpy as np

WORDS = 5
BLOCK_BYTES = 500_000
BLOCK_TEXTS = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; ASCII letters count as lower case, white space as ASCII's.

    A word's bytes are taken eight at a time, and what came before is spread over all bits and
    multiplied before the next eight are added. A word of up to eight bytes has a hash of its own.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    # Eight bytes from each place on; the numbers overlap and are not aligned.
    eights = np.ndarray(len(data), "<u8", joined + bytes(8), strides=(1,))
    sizes = ends - starts
    values = mixed(eights[starts] & _MASKS[np.minimum(sizes, 8)]) + mixed(sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > 8)
    done = 8
    while len(long):
        left = np.minimum(sizes[long] - done, 8)
        values[long] = mixed(values[long]) * _BASE + (eights[starts[long] + done] & _MASKS[left])
        done += 8
        long = long[sizes[long] > done]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(firsts, starts, "right") - 1
    return mixed(values), owner


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text one after the other, and how many each text has.

    A text with fewer words is one shingle; one without words has none.
    """
    values, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    total = np.zeros(max(0, len(values) - words + 1), np.uint64)
    for k in range(words):
        total += values[k : k + len(total)] * _PLACES[k]
    whole = owner[: len(total)] == owner[words - 1 :] if len(total) else np.zeros(0, bool)
    parts, owners = [mixed(total[whole])], [owner[: len(total)][whole]]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(owner, short)
        alone = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            there = counts[short] > k
            alone[there] += values[first[there] + k] * _PLACES[k]
        parts.append(mixed(alone ^ (counts[short].astype(np.uint64) * _PLACES[8])))
        owners.append(short)
        order = np.argsort(np.concatenate(owners), kind="stable")
        tokens, owner = np.concatenate(parts)[order], np.concatenate(owners)[order]
    else:
        tokens, owner = parts[0], owners[0]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for at, end in zip(bounds[:-1], bounds[1:], strict=True):
        tokens[at:end].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], np.bincount(owner[new], minlength=len(texts))


def blocks_of(batches, size: int = BLOCK_BYTES, texts: int = BLOCK_TEXTS):
    """Regroup ``(doc_id, text)`` Arrow batches into lists of about ``size`` bytes."""
    ids, found, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py().encode()
            if found and (held + len(text) > size or len(found) == texts):
                yield ids, found
                ids, found, held = [], [], 0
            ids.append(doc_id.as_py())
            found.append(text)
            held += len(text)
    if found:
        yield ids, found
