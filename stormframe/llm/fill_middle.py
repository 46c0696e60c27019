"""Fill-in-the-middle by piece tables.

A document is one descriptor over its own text, which is never changed. Cutting splits that
descriptor, an arrangement puts the parts in another order between descriptors over a second buffer
of sentinels, and a digest streams the bytes that the descriptors name, one after the other. The
inverse permutation of the parts found in an output gives the text back.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stormframe.llm.common import whole_text

SEED = "1"
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
#: Bytes of a text that are looked at together.
BLOCK_BYTES = 1 << 20

SENTINELS = b"<P><S><M>"
TEXT_BUFFER, SENTINEL_BUFFER = 0, 1
PREFIX, MIDDLE, SUFFIX = range(3)


class Piece(NamedTuple):
    """``length`` bytes of one buffer from ``start`` on."""

    buffer: int
    start: int
    length: int


#: Sentinel and part, in the order of the output.
ARRANGED = {
    "psm": ((b"<P>", PREFIX), (b"<S>", SUFFIX), (b"<M>", MIDDLE)),
    "spm": ((b"<S>", SUFFIX), (b"<P>", PREFIX), (b"<M>", MIDDLE)),
}

_PIECES = "array<struct<buffer:int,start:long,length:long>>"
_PIECE_TYPE = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
TRANSFORMED = (
    f"doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces {_PIECES}, "
    "output string, output_sha256 string"
)


def unit_starts(block: np.ndarray, letter_before: bool = False) -> np.ndarray:
    """Places in UTF-8 bytes where a run of ASCII letters or any other code point begins."""
    letter = ((block | 0x20) - np.uint8(97)) < 26
    begins = (block & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[:1] &= ~(letter[:1] & letter_before)
    return np.flatnonzero(begins)


class Units:
    """The units of one text, found block by block, so a very long text needs one block at a time."""

    def __init__(self, data: np.ndarray, block_bytes: int = BLOCK_BYTES):
        self.data, self.block_bytes = data, block_bytes
        self.kept = self._block(0) if len(data) <= block_bytes else None
        if self.kept is not None:
            self.before = np.array([0, len(self.kept)])
        else:
            blocks = range(0, len(data), block_bytes)
            self.before = np.cumsum([0, *(len(self._block(at)) for at in blocks)])

    def _block(self, at: int) -> np.ndarray:
        last = chr(self.data[at - 1]) if at else ""
        return unit_starts(self.data[at : at + self.block_bytes], last.isascii() and last.isalpha())

    @property
    def count(self) -> int:
        return int(self.before[-1])

    def start(self, unit: int) -> int:
        """The byte where a unit begins; the text's end for the one after the last."""
        if unit == self.count:
            return len(self.data)
        block = int(np.searchsorted(self.before, unit, "right")) - 1
        inside = self.kept if self.kept is not None else self._block(block * self.block_bytes)
        return block * self.block_bytes + int(inside[unit - self.before[block]])


def split(piece: Piece, *places: int) -> list[Piece]:
    """Cut a descriptor at byte places of its buffer, in ascending order."""
    edges = [piece.start, *places, piece.start + piece.length]
    return [Piece(piece.buffer, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Descriptors of the output: each part after its sentinel."""
    out = []
    for sentinel, part in ARRANGED[form]:
        out += [Piece(SENTINEL_BUFFER, SENTINELS.index(sentinel), len(sentinel)), parts[part]]
    return out


def disarrange(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that name its text: the parts between sentinels, put back in order.

    The text of an arranged output holds no sentinel, and a sentinel's end is never its beginning,
    so the first one found is the right one.
    """
    if form == "plain":
        return [Piece(TEXT_BUFFER, 0, len(output))]
    order = ARRANGED[form]
    at = [0]
    for sentinel, _ in order[1:]:
        at.append(output.index(sentinel, at[-1] + len(order[0][0])))
    edges = [*at, len(output)]
    parts: list[Piece | None] = [None] * len(order)
    for (sentinel, part), start, stop in zip(order, edges[:-1], edges[1:], strict=True):
        parts[part] = Piece(TEXT_BUFFER, start + len(sentinel), stop - start - len(sentinel))
    return parts


def streamed(pieces: list[Piece], text: memoryview) -> tuple[bytes, str]:
    """The bytes that descriptors name, and their digest."""
    buffers = (text, memoryview(SENTINELS))
    digest, slices = hashlib.sha256(), []
    for buffer, start, length in pieces:
        part = buffers[buffer][start : start + length]
        digest.update(part)
        slices.append(part)
    return b"".join(slices), digest.hexdigest()


def _numbers(doc_id: int | None, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _chars(data: np.ndarray, piece: Piece) -> int:
    return int(np.count_nonzero((data[piece.start : piece.start + piece.length] & 0xC0) != 0x80))


def transform_text(doc_id: int | None, text: bytes, seed: str = SEED) -> tuple:
    """One row of ``TRANSFORMED``."""
    data = np.frombuffer(text, np.uint8)
    units = Units(data)
    n = units.count
    one, two, plain, suffix_first = _numbers(doc_id, seed)
    whole = Piece(TEXT_BUFFER, 0, len(text))
    marked = any(sentinel in text for sentinel, _ in ARRANGED["psm"])
    if not text or marked or plain % 100 >= 100 - PLAIN_PERCENT:
        form, prefix, middle, pieces = "plain", None, None, [whole]
    else:
        form = "spm" if suffix_first % 100 < SUFFIX_FIRST_PERCENT else "psm"
        low, high = sorted((one % (n + 1), two % (n + 1)))
        parts = split(whole, units.start(low), units.start(high))
        prefix, middle = _chars(data, parts[PREFIX]), _chars(data, parts[MIDDLE])
        pieces = arrange(parts, form)
    output, digest = streamed(pieces, memoryview(text))
    return doc_id, n, form, prefix, middle, [p._asdict() for p in pieces], output, digest


def _texts(column: pa.Array):
    """The UTF-8 bytes of each value."""
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py()


def transform(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``TRANSFORMED`` for each row of ``docs``: its units, form, parts, output and digest.

    A text of ``n`` units (runs of ASCII letters, and any other code point by itself) is cut at
    two units drawn from the digest of ``seed`` and ``doc_id``. It stays plain if it is empty,
    holds a sentinel, or its draw says so; ``prefix_chars`` and ``middle_chars`` are null then.
    ``pieces`` is the output's piece table: buffer 0 is the text, buffer 1 ``SENTINELS``, places
    are bytes. Null text is empty, a null ``doc_id`` is drawn as ``null``, rows that share an id
    share its draws and are cut one by one. Other columns are ignored. An empty table gives an
    empty result.
    """
    kinds = [
        pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _PIECE_TYPE, pa.binary(), pa.string(),
    ]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [transform_text(i, t, seed) for i, t in zip(ids, _texts(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays = [a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(cut, TRANSFORMED)


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` with ``restored``, the text told from ``output`` and ``form`` alone, and its digest.

    Columns named ``restored`` and ``restored_sha256`` are replaced. A null output gives null; an
    output that lacks a sentinel of its form raises.
    """
    rows = transformed.drop("restored", "restored_sha256")
    added = [StructField(name, StringType()) for name in ("restored", "restored_sha256")]
    schema = StructType([*rows.schema, *added])
    form_at, output_at = rows.columns.index("form"), rows.columns.index("output")

    def back(batches):
        for batch in batches:
            forms = batch.column(form_at).to_pylist()
            texts, digests = [], []
            for form, output in zip(forms, _texts(batch.column(output_at)), strict=True):
                text, digest = (None, None) if output is None else streamed(disarrange(output, form), memoryview(output))
                texts.append(text)
                digests.append(digest)
            restored = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, restored, pa.array(digests, pa.string())], schema.names
            )

    return rows.mapInArrow(back, schema)
