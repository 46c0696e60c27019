"""Byte-pair encoding by speculation: propose, verify in arrays, repair what fails.

The longest vocabulary entry at each place proposes a word's tokens. Merging the word by ranks gives
the same tokens if no merge can cross the border of any two neighbours, which is checked for all
pairs at once along the right edge of one token's merge tree and the left edge of the other's.
Only words that hold a failing pair are merged by ranks, one merge after the other.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stormframe.llm.common import whole_text

#: Bytes of text that are encoded together, and words whose ids a task remembers.
BLOCK_BYTES = 1_000_000
CACHED_WORDS = 100_000
#: Failing words of up to so many bytes are merged together, longer ones one by one.
SHORT_WORD = 64
#: Symbols of a word: its bytes, the last one apart because it carries the word's end.
BYTES = 256
END = "</w>"
ENCODED = "doc_id long, ids binary"

# Fixed values of the tokenizer file: how it normalises and what it takes as a word.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point every text is in composed form and Unicode versions agree on classes.
SIMPLE = 0x300
WHITE = "\t-\r \x85\xa0"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves; the other bytes, in order, for the
    characters from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(BYTES, 2 * BYTES))
    return [chr(b if b in shown else next(others)) for b in range(BYTES)]


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == kind)


def _names(spec: dict) -> dict[int, bytes]:
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {i: t.encode() for t, i in (spec["model"]["vocab"] | special).items()}


@functools.lru_cache(2)
def token_names(path: str) -> dict[int, bytes]:
    """The name of each id of a tokenizer file, all that decoding needs."""
    with open(path, encoding="utf-8") as file:
        return _names(json.load(file))


class WordBpe:
    """The vocabulary of one tokenizer file, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["dropout"] or spec["decoder"]:
            raise ValueError(f"{path} is not a word vocabulary with {END}")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = _names(spec)
        self.size = max(self.names) + 1
        letters = byte_letters()
        self.base = np.array([vocab[c] for c in letters] + [vocab[c + END] for c in letters], np.int64)
        self._merges(vocab, model["merges"])
        self._trie(vocab, letters)
        self._words(spec)

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: How a token is made, and when: symbols are their own halves, and there from the start.
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[made], self.right[made] = left, right
        self.rank = np.full(self.size, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        self.made = made
        keys = left * self.size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merge_of = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made, strict=True))}
        #: The check of pairs rests on this: each merge makes one new token out of older ones.
        ranks = np.arange(len(made))
        self.ordered = bool(
            len(np.unique(made)) == len(made)
            and not np.isin(made, self.base).any()
            and (self.rank[left] < ranks).all()
            and (self.rank[right] < ranks).all()
        )

    def _trie(self, vocab: dict[str, int], letters: list[str]) -> None:
        symbol = {c: b for b, c in enumerate(letters)}
        edges: dict[int, int] = {}
        tokens = [-1]
        made = {*np.flatnonzero(self.rank >= 0).tolist(), *self.base.tolist()}
        for name, token in vocab.items():
            if token not in made:
                continue
            node = 0
            body = name.removesuffix(END)
            ended = body != name
            for i, c in enumerate(body):
                last = BYTES if ended and i == len(body) - 1 else 0
                node = edges.setdefault(node * 2 * BYTES + symbol[c] + last, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.children = np.array(list(edges.values()), np.int64)[order]
        self.tokens = np.array(tokens, np.int64)

    def _words(self, spec: dict) -> None:
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        known = spec["normalizer"] == NORMALIZER and steps and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
        letter, number = _class("L"), _class("N")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")
        # Three letters have code points beyond SIMPLE in their lower case.
        leaving = "".join(chr(c) for c in range(SIMPLE) if max(chr(c).lower()) >= chr(SIMPLE))
        self.unusual = re.compile(f"[{leaving}]|[^\x00-{chr(SIMPLE - 1)}]" if known else "")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens.

        Texts with characters beyond ``SIMPLE`` are normalised and split by the tokenizers library.
        """
        if not self.unusual.search(text):
            return self.word.findall(text.lower())
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in shown]

    def parts(self, text: str) -> list[str | int]:
        """Words, and ids of the special tokens that stand among them."""
        out: list[str | int] = []
        at = 0
        for mark in self.marks.finditer(text):
            out += self.words(text[at : mark.start()])
            out.append(self.special[mark.group()])
            at = mark.end()
        return out + self.words(text[at:])

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that begins at each place, and its length."""
        best, length = self.base[symbols], np.ones(len(symbols), np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            keys = node * (2 * BYTES) + symbols[at + depth]
            slot = np.searchsorted(self.edges, keys)
            slot[slot == len(self.edges)] = 0
            found = self.edges[slot] == keys
            at, node, depth = at[found], self.children[slot[found]], depth + 1
            token = self.tokens[node]
            there = token >= 0
            best[at[there]], length[at[there]] = token[there], depth
            inside = at + depth < len(symbols)
            at, node = at[inside], node[inside]
        return best, length

    def crossed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some merge crosses the border of each pair of neighbouring tokens.

        A symbol at the border is there from its own merge on until its parent's. Of all pairs that
        are there together, from the last back to the first, one that merges before either parent's
        merge crosses the border. Where both merges are the same one, the left place goes first.
        """
        out = np.zeros(len(left), bool)
        at = np.arange(len(left))
        a, b = left, right
        until_a = until_b = np.full(len(left), len(self.pair_keys), np.int64)
        while len(at):
            rank = self._rank_of(a, b)
            crossing = (rank < until_a) & (rank <= np.minimum(until_b, len(self.pair_keys) - 1))
            out[at[crossing]] = True
            back = self.rank[a] > self.rank[b]  # of equal tokens the left one was made first
            going = ~crossing & (np.where(back, self.rank[a], self.rank[b]) >= 0)
            at, a, b, back = at[going], a[going], b[going], back[going]
            until_a = np.where(back, self.rank[a], until_a[going])
            until_b = np.where(back, until_b[going], self.rank[b])
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return out

    def merged(self, symbols: np.ndarray) -> list[int]:
        """Tokens of one word by its merges, lowest rank first, and the leftmost of equal ones."""
        ids = self.base[symbols].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            merge = self.merge_of.get(ids[i] * self.size + ids[j])
            if merge:
                heapq.heappush(heap, (merge[0], i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.merge_of[a * self.size + b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t in ids if t >= 0]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which two tokens merge, past all ranks if they do not."""
        keys = left * self.size + right
        slot = np.searchsorted(self.pair_keys, keys)
        slot[slot == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[slot] == keys, self.pair_ranks[slot], len(self.pair_keys))

    def merged_together(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words, and the word of each; in every round each word makes one merge."""
        never = len(self.pair_keys)
        tokens, word = self.base[symbols], np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(tokens), never)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank_of(tokens[inner], tokens[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tokens):
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, firsts), np.diff(np.append(firsts, len(word))))
            going = least < never
            done.append((tokens[~going], word[~going]))
            tokens, word, rank, least = tokens[going], word[going], rank[going], least[going]
            at = np.flatnonzero(rank == least)
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost of each word
            tokens[at] = self.made[rank[at]]
            stays = np.ones(len(tokens), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one token to the left has gone for each earlier word
            tokens, word, rank = tokens[stays], word[stays], rank[stays]
            changed = np.concatenate([at, at - 1])
            changed = changed[changed >= 0]
            last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
            rank[changed] = never
            changed = changed[~last[changed]]
            rank[changed] = self._rank_of(tokens[changed], tokens[changed + 1])
        if not done:
            return tokens, word
        tokens, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return tokens[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[list[bytes], int]:
        """Ids of each word, and how many words had to be merged."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(w) for w in coded], np.int64)
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        symbols[ends - 1] += BYTES
        best, length = self.longest(symbols)
        reached = np.zeros(len(symbols), bool)
        at, stop = ends - sizes, ends
        while len(at):
            reached[at] = True
            at = at + length[at]
            inside = at < stop
            at, stop = at[inside], stop[inside]
        places = np.flatnonzero(reached)
        tokens, owner = best[places], np.searchsorted(ends, places, "right")
        inner = owner[1:] == owner[:-1]
        pairs, which = np.unique((tokens[:-1] * self.size + tokens[1:])[inner], return_inverse=True)
        bad = self.crossed(pairs // self.size, pairs % self.size)[which] if self.ordered else np.ones(int(inner.sum()), bool)
        failing = np.unique(owner[:-1][inner][bad])
        flat = tokens.astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        short = failing[sizes[failing] <= SHORT_WORD]
        picked = np.zeros(len(words), bool)
        picked[short] = True
        tokens, owner = self.merged_together(symbols[np.repeat(picked, sizes)], sizes[short])
        flat = tokens.astype("<u4").tobytes()
        bounds = (4 * np.searchsorted(owner, np.arange(len(short) + 1))).tolist()
        for w, a, b in zip(short.tolist(), bounds[:-1], bounds[1:], strict=True):
            out[w] = flat[a:b]
        for w in failing[sizes[failing] > SHORT_WORD].tolist():
            out[w] = np.array(self.merged(symbols[ends[w] - sizes[w] : ends[w]]), "<u4").tobytes()
        return out, len(failing)


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes texts with a memory of words that is emptied when it is full."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.bpe, self.cached_words = word_bpe(path), cached_words
        self.known: dict[str | int, bytes] = {}
        self.proposed = self.repaired = 0

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.bpe.parts(text) for text in texts]
        if len(self.known) > self.cached_words:
            self.known = {}
        new = set().union(*parts) - self.known.keys()
        marks = {p for p in new if isinstance(p, int)}
        self.known.update({m: np.array([m], "<u4").tobytes() for m in marks})
        words = list(new - marks)
        if words:
            ids, failing = self.bpe.encode_words(words)
            self.known.update(zip(words, ids, strict=True))
            self.proposed, self.repaired = self.proposed + len(words), self.repaired + failing
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def segments(text: str, size: int = BLOCK_BYTES):
    """Parts of about ``size`` characters, cut before a space, where no word or special token is cut."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop


def blocks(batches, size: int = BLOCK_BYTES):
    """``(ids, texts)`` of at most ``size`` characters, or one longer text, from ``(doc_id, text)`` batches."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if ids and held + len(text) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            held += len(text)
    if ids:
        yield ids, texts


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs``; ``ids`` are little-endian unsigned 32-bit numbers.

    ``tokenizer`` is a JSON file of the tokenizers library with a BPE model whose words end in
    ``</w>``, at that path on every executor. The ids are those of the library without added
    special tokens, truncation or padding; the name of a special token in a text is its id. Null
    and empty texts have no ids. Rows that share an id are encoded one by one, a null id stays
    null, other columns are ignored. An empty table gives an empty result.
    """

    def run(batches):
        encoder = Encoder(tokenizer)
        for ids, texts in blocks(batches):
            if len(texts) > 1:
                coded = encoder.encode(texts)
            else:
                coded = [b"".join(encoder.encode([part])[0] for part in segments(texts[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(coded, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, ENCODED)


def decode_ids(names: dict[int, bytes], ids: bytes) -> bytes:
    """Tokens' names with a space between; numbers that the vocabulary lacks are left out."""
    found = map(names.get, np.frombuffer(ids, "<u4").tolist())
    return b" ".join(n for n in found if n is not None)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded``, what the tokenizers library's ``decode`` gives with special tokens kept.

    ``encoded`` has ``ids`` as ``encode`` makes them. Null ids give null. A column ``decoded`` is replaced.
    """
    rows = encoded.drop("decoded")
    schema = StructType([*rows.schema, StructField("decoded", StringType())])
    at = rows.columns.index("ids")

    def run(batches):
        names = token_names(tokenizer)
        for batch in batches:
            found = (i.as_py() for i in batch.column(at))
            texts = [None if i is None else decode_ids(names, i) for i in found]
            decoded = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], schema.names)

    return rows.mapInArrow(run, schema)
