"""Frequent phrases of words, counted in subtrees of one suffix tree that is never built whole.

Suffixes (from each word to the end of its piece, four words at most) are parted by their first
words. A prefix with more suffixes than a group's budget of memory is extended by its next word,
so every group holds the suffixes of prefixes that fit. A group builds the subtrees of its prefixes
by itself, cut off at four words: sorted suffixes are the leaves, and a node's count is the
total of the leaves below it. A node above the prefixes, whose leaves lie in several groups, has
its partial counts added up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stormframe.llm.common import join_groups, whole_text
from stormframe.session import stored

WORDS = 4
MINIMUM = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of text whose suffixes a task sorts together.
BLOCK_BYTES = 6_000_000
#: Suffixes of a group, about: 24 bytes each, and some ten times as much while they are sorted.
GROUP_SUFFIXES = 1_000_000
#: Counters of prefixes per number of words: prefixes of one counter are extended together.
COUNTERS = 1 << 16
#: Bits of the filter that tells rare words; with more frequent words than bits it tells fewer of them.
FILTER_BITS = 1 << 26

# Fixed values of the contract: a piece ends at these, words are parted by these.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
_TABLE = bytes.maketrans(PIECE_ENDS + SPACES, b"\n" * len(PIECE_ENDS) + b" " * len(SPACES))

_NEXT_WORDS = re.compile(rb"(?: +[^ \n]+){0,%d}" % (WORDS - 1))

#: Level 0 counts words per language, level 1 each word, levels 2 and 3 the prefixes of a counter.
_LEVELS = "level int, lang string, word string, counter int, n long"
_SENT = "group long, leaves int, raw int, langs array<string>, packed binary"
_COUNTED = "lang string, phrase string, size int, n long, whole boolean"
#: Stands for the depth of a suffix that ends inside heavy prefixes.
_NEVER = WORDS + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, len(values))


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of prefixes with one more word."""
    return _mix(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def _place(prefix: np.ndarray, size: int) -> np.ndarray:
    return (prefix % np.uint64(size)).astype(np.int64)


def plain(text: bytes) -> bytes:
    """ASCII letters in lower case, piece ends as line ends, spaces and tabs as spaces."""
    return text.lower().translate(_TABLE)


def cuts(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """Parts of about ``size`` bytes of a plain text, and how many words at a part's end are not its own.

    A part that ends inside a piece is followed by the words that its last suffixes need.
    """
    at = 0
    while len(text) - at > size:
        places = [p for p in (text.find(b"\n", at + size), text.find(b" ", at + size)) if p >= 0]
        if not places:
            break
        stop = min(places)
        after = _NEXT_WORDS.match(text, stop).group()
        yield text[at:stop] + after, len(after.split())
        at = stop
    yield text[at:], 0


class Block:
    """The words of some plain texts as numbers, with the language and the piece each stands in."""

    def __init__(self, langs: list[str], texts: list[bytes], borrowed: list[int]):
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        spaced = [t.replace(b"\n", b" \n ") + b" \n" for t in texts]
        joined = pa.array([b" ".join(spaced)], pa.large_binary()).cast(pa.large_string())
        coded = pc.split_pattern(joined, " ").flatten().dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        if b"" in self.words:
            codes = codes[codes != self.words.index(b"")]
        self.codes, self.breaks = codes, codes == self.words.index(b"\n")
        # A text has the breaks of its piece ends and one more.
        ends = np.cumsum([t.count(b"\n") for t in spaced])
        at = np.flatnonzero(self.breaks)[ends - 1]
        self.lang_of = np.repeat([number[lang] for lang in langs], np.diff(at, prepend=-1))
        self.own = ~self.breaks
        for stop, count in zip(at.tolist(), borrowed, strict=True):
            self.own[stop - count : stop] = False
        self.word_hash, self.lang_hash = _hashes(self.words), _hashes([x.encode() for x in self.langs])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (language, word), their hashes, and the pair at each place."""
        keys, which = np.unique(self.lang_of * len(self.words) + self.codes, return_inverse=True)
        lang, word = keys // len(self.words), keys % len(self.words)
        return lang, word, _extended(self.lang_hash[lang], self.word_hash[word]), which

    def suffixes(self, fits: np.ndarray) -> np.ndarray:
        """All suffixes of two words or more that begin at words of the block's own.

        ``fits`` tells which places hold words that may be in a phrase; a suffix ends before any
        other. A row is a language and ``WORDS`` words, -1 after the end.
        """
        size = len(self.codes)
        rows = np.full((size, WORDS + 1), -1)
        rows[:, 0] = self.lang_of
        going = self.own.copy()
        for k in range(WORDS):
            stop = max(0, size - k)
            going[stop:] = False
            going[:stop] &= fits[k:]
            at = np.flatnonzero(going)
            rows[at, 1 + k] = self.codes[at + k]
        return rows[rows[:, 2] >= 0]

    def distinct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct suffixes, and how often each occurs."""
        # Language and two words make one number, the other two the next.
        base = len(self.words) + 1
        first = (rows[:, 0] * base + rows[:, 1] + 1) * base + rows[:, 2] + 1
        second = (rows[:, 3] + 1) * base + rows[:, 4] + 1
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        return rows[order[at]], np.diff(np.append(at, len(order)))

    def prefixes(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two and so on: hashes of the rows' prefixes, and which rows are that long."""
        prefix = self.lang_hash[rows[:, 0]]
        for k in range(1, WORDS + 1):
            there = rows[:, k] >= 0
            prefix = np.where(there, _extended(prefix, self.word_hash[rows[:, k]]), prefix)
            yield prefix, there


def read_blocks(batches, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of ``(lang, text)`` rows."""
    langs, texts, borrowed, held = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for part, count in cuts(plain(text.as_py().encode()), size):
                if texts and held + len(part) > size:
                    yield Block(langs, texts, borrowed)
                    langs, texts, borrowed, held = [], [], [], 0
                langs.append(lang.as_py())
                texts.append(part)
                borrowed.append(count)
                held += len(part) + 1
    if texts:
        yield Block(langs, texts, borrowed)


def _rows(level: int, lang: list, word: list | pa.Array, counter: list, n: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    columns = [[level] * len(n), lang, word, counter, n]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["level", "lang", "word", "counter", "n"]
    )


def count_words(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_LEVELS`` of ``(lang, text)`` rows, added up: words per language, each word, prefixes per counter."""

    size = COUNTERS

    def run(batches):
        counters = np.zeros((WORDS, size), np.int64)
        for block in read_blocks(batches, block_bytes):
            lang, word, hashes, which = block.pairs()
            n = np.bincount(which[block.own], minlength=len(lang))
            lang, word, n = lang[n > 0], word[n > 0], n[n > 0]
            names = pa.array(block.langs).take(pa.array(lang)).to_pylist()
            yield _rows(1, names, pa.array(block.words, pa.string()).take(pa.array(word)), [None] * len(n), n)
            total = np.bincount(lang, n, len(block.langs)).astype(np.int64)
            yield _rows(0, block.langs, [None] * len(total), [None] * len(total), total)
            prefix, going = hashes[which], block.own
            for k in range(2, WORDS):
                going = going[: len(prefix) - 1] & ~block.breaks[k - 1 :]
                prefix = _extended(prefix[:-1], block.word_hash[block.codes[k - 1 :]])
                counters[k] += np.bincount(_place(prefix[going], size), minlength=size)
        for k in range(2, WORDS):
            at = np.flatnonzero(counters[k])
            yield _rows(k, [None] * len(at), [None] * len(at), at.tolist(), counters[k][at])

    counted = rows.mapInArrow(run, _LEVELS)
    return counted.groupBy("level", "lang", "word", "counter").agg(F.sum("n").alias("n"))


def _heavy(counted: DataFrame, suffixes: int) -> np.ndarray:
    """For each number of words, which counters hold more suffixes than a group should."""
    one, size = counted.where("level = 1").select("lang", "word", "n"), COUNTERS

    def add_up(frames):
        total = np.zeros(size, np.int64)
        for frame in frames:
            prefix = _extended(*(_hashes([x.encode() for x in frame[c]]) for c in ("lang", "word")))
            np.add.at(total, _place(prefix, size), frame["n"].to_numpy())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"level": np.ones(len(at), np.int32), "counter": at.astype(np.int32), "n": total[at]})

    ones = one.mapInPandas(add_up, "level int, counter int, n long")
    more = counted.where("level > 1").select("level", "counter", "n")
    totals = ones.unionByName(more).groupBy("level", "counter").agg(F.sum("n").alias("n")).where(F.col("n") > suffixes)
    heavy = np.zeros((WORDS + 1, size), bool)
    for row in totals.select("level", "counter").collect():  # as many rows as there are counters, at most
        heavy[row["level"], row["counter"]] = True
    heavy[WORDS] = False
    return heavy


def _frequent_bits(words: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits with that of each ``(lang, word)`` set."""
    chunk, size = 1 << 16, FILTER_BITS

    def place(frames):
        for frame in frames:
            prefix = _extended(*(_hashes([x.encode() for x in frame[c]]) for c in ("lang", "word")))
            bit = _place(prefix, size)
            yield pd.DataFrame({"chunk": bit // chunk, "bit": (bit % chunk).astype(np.int32)}).drop_duplicates()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(chunk, bool)
        bits[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    placed = words.mapInPandas(place, "chunk long, bit int").distinct()
    packed = placed.groupBy("chunk").applyInPandas(pack, "chunk long, bits binary")
    out = np.zeros((size // chunk, chunk // 8), np.uint8)
    for row in packed.collect():  # as many bits as the filter has, at most
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def pack_leaves(leaves: np.ndarray, times: np.ndarray, depth: np.ndarray, names: list[str], words: np.ndarray):
    """A row of ``_SENT`` without its group: suffixes, counts, depths and the words they use, compressed.

    Suffixes are sorted and lie column by column, so that equal prefixes are runs.
    """
    used, codes = np.unique(leaves[:, 1:], return_inverse=True)
    langs, lang = np.unique(leaves[:, 0], return_inverse=True)
    ended = int(used[0] == -1)  # the end of a suffix, which is 0 among the codes
    codes = np.column_stack([lang, codes.reshape(len(leaves), WORDS) + 1 - ended]).astype("<i4")
    raw = codes.T.tobytes() + times.astype("<i8").tobytes() + depth.tobytes() + b"\n".join(words[used[ended:]])
    return len(leaves), len(raw), [names[i] for i in langs], pa.compress(raw, "zstd", asbytes=True)


def unpack_leaves(leaves: int, raw: int, packed: bytes):
    """Codes, counts, depths and words of ``pack_leaves``."""
    data = pa.decompress(packed, raw, "zstd", asbytes=True)
    wide = 4 * (WORDS + 1) * leaves
    codes = np.frombuffer(data, "<i4", (WORDS + 1) * leaves).reshape(WORDS + 1, leaves).T
    counts = np.frombuffer(data, "<i8", leaves, wide)
    depths = np.frombuffer(data, np.int8, leaves, wide + 8 * leaves)
    return codes, counts, depths, data[wide + 9 * leaves :].split(b"\n")


def _send(rows: DataFrame, bits: np.ndarray, heavy: np.ndarray, groups: int, block_bytes: int) -> DataFrame:
    """``_SENT``: the suffixes of each block for each group, with the words they use."""
    shared = rows.sparkSession.sparkContext.broadcast((bits, heavy))

    def run(batches):
        bits, heavy = shared.value
        for block in read_blocks(batches, block_bytes):
            _, _, hashes, which = block.pairs()
            bit = _place(hashes, 8 * len(bits))
            frequent = (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
            leaves, times = block.distinct(block.suffixes(frequent[which] & ~block.breaks))
            if not len(leaves):
                continue
            depth = np.full(len(leaves), _NEVER, np.int8)
            routed = np.zeros(len(leaves), np.uint64)
            for k, (prefix, there) in enumerate(block.prefixes(leaves), 1):
                routed = np.where(depth == _NEVER, prefix, routed)
                depth[there & (depth == _NEVER) & ~heavy[k][_place(prefix, heavy.shape[1])]] = k
            group = (routed >> np.uint64(20)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(group[order], prepend=np.uint64(groups))), len(order))
            words = np.array(block.words, object)
            out = [
                (int(group[order[a]]), *pack_leaves(leaves[order[a:b]], times[order[a:b]], depth[order[a:b]], block.langs, words))
                for a, b in zip(edges[:-1], edges[1:], strict=True)
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary()]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["group", "leaves", "raw", "langs", "packed"],
            )

    return rows.mapInArrow(run, _SENT)


def _unpacked(frame: pd.DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, words, and the leaves of all rows with one numbering: 0 for no word."""
    langs: dict[str, int] = {}
    words: dict[bytes, int] = {}
    leaves, counts, depths = [], [], []
    for row in frame.itertuples(index=False):
        codes, count, depth, used = unpack_leaves(row.leaves, row.raw, row.packed)
        lang_of = np.array([langs.setdefault(x, len(langs)) for x in row.langs])
        word_of = np.array([0, *(words.setdefault(w, len(words) + 1) for w in used)])
        leaves.append(np.column_stack([lang_of[codes[:, 0]], word_of[codes[:, 1:]]]))
        counts.append(count)
        depths.append(depth)
    names = ["", *(w.decode() for w in words)]
    return list(langs), names, np.concatenate(leaves), np.concatenate(counts), np.concatenate(depths)


def subtree_counts(frame: pd.DataFrame, minimum: int) -> pd.DataFrame:
    """``_COUNTED`` of one group: nodes of two words or more, with the totals of the leaves below.

    The sorted leaves are the subtrees: a node's leaves are neighbours. A node at or below its
    group's prefix is whole and left out below ``minimum``; one above it is counted in part.
    """
    langs, words, leaves, counts, depths = _unpacked(frame)
    base = len(words)
    order = np.lexsort((leaves[:, 3] * base + leaves[:, 4], (leaves[:, 0] * base + leaves[:, 1]) * base + leaves[:, 2]))
    leaves, counts, depths = leaves[order], counts[order], depths[order]
    out = []
    border = np.ones(len(leaves), bool)
    border[1:] = (leaves[1:, :2] != leaves[:-1, :2]).any(1)
    for size in range(2, WORDS + 1):
        border[1:] |= leaves[1:, size] != leaves[:-1, size]
        at = np.flatnonzero(border)
        n = np.add.reduceat(counts, at)
        whole = depths[at] <= size
        kept = (leaves[at, size] > 0) & (~whole | (n >= minimum))
        nodes = leaves[at[kept]]
        phrases = [" ".join([words[w] for w in node]) for node in nodes[:, 1 : size + 1].tolist()]
        names = [langs[x] for x in nodes[:, 0].tolist()]
        out.append(pd.DataFrame({"lang": names, "phrase": phrases, "size": size, "n": n[kept], "whole": whole[kept]}))
    return pd.concat(out)


def phrase_counts(
    docs: DataFrame, minimum: int = MINIMUM, group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, n)`` of all phrases of up to ``WORDS`` words that occur ``minimum`` times,
    and ``(lang, n)`` of all words; both are stored tables."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text().alias("text")
    )
    counted = count_words(rows, block_bytes)
    counted = stored(counted.where((F.col("level") != 1) | (F.col("n") >= minimum)), "prefixes")
    totals = counted.where("level = 0").select("lang", "n")
    words = counted.where("level = 1").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    heavy = _heavy(counted, group_suffixes)
    suffixes = words.agg(F.sum("n")).first()[0] or 0
    bits = _frequent_bits(counted.where("level = 1").select("lang", "word"))
    sent = _send(rows, bits, heavy, max(1, -(-suffixes // group_suffixes)), block_bytes)
    nodes = sent.groupBy("group").applyInPandas(lambda frame: subtree_counts(frame, minimum), _COUNTED)
    nodes = stored(nodes, "nodes")
    columns = ["lang", "phrase", "size", "n"]
    parts = nodes.where("not whole").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    longer = nodes.where("whole").select(*columns).unionByName(parts.where(F.col("n") >= minimum))
    return stored(words.unionByName(longer.select(*columns)), "phrases"), totals


def _key(phrase: str | Column) -> Column:
    """One value for language and phrase; a phrase has no tab."""
    return F.concat("lang", F.lit("\t"), phrase)


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of each phrase of two words or more, by its lowest-scoring cut.

    A cut after ``k`` words gives ``floor(scale * a / (l + r))``, in whole numbers of up to 38
    digits; of equal scores the smallest ``k`` counts. The parts of a phrase are phrases of
    ``counts`` as well. Parts that very many phrases share are looked up by broadcast.
    """
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.expr("substring_index(phrase, ' ', k)")
    rest = F.expr("substring_index(phrase, ' ', k - size)")
    parts = cut.withColumn(
        "part", F.explode(F.array(F.struct(_key(first).alias("key"), F.lit(0).alias("side")),
                                  F.struct(_key(rest).alias("key"), F.lit(1).alias("side"))))
    ).select("lang", "phrase", "a", "k", F.col("part.side").alias("side"), F.col("part.key").alias("key"))
    uses = parts.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    found = counts.select(_key("phrase").alias("key"), "n").join(uses, "key")
    looked = join_groups(parts, stored(found, "parts"), "key", "uses")
    sides = [F.max(F.when(F.col("side") == i, F.col("n"))).alias(c) for i, c in enumerate("lr")]
    cuts = looked.groupBy("lang", "phrase", "a", "k").agg(*sides)
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """``(lang, phrase)`` of phrases that lie in a longer one with at least ``percent`` of their count."""
    longer = counts.where("size > 2").withColumn("words", F.split("phrase", " "))
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
        " i -> array_join(slice(words, i, m), ' '))))"
    )
    inner = longer.select("lang", F.explode(spans).alias("phrase"), "n")
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    known = counts.where("size > 1").join(most, ["lang", "phrase"])
    wide = [F.col(c).cast("decimal(20,0)") for c in ("longer", "n")]
    return known.where(100 * wide[0] >= percent * wide[1]).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    minimum: int = MINIMUM,
    top: int = TOP,
    group_suffixes: int = GROUP_SUFFIXES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two to four words.

    Texts are split at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words;
    ASCII letters count as lower case. ``a`` is how often a phrase occurs inside pieces, at least
    ``minimum`` times, ``n`` the number of all words of its language. Its score is that of
    ``scored``; phrases ``covered`` by a longer one are left out. Order: score and ``a`` falling,
    then the phrase by bytes. A null ``lang`` is ``und``, together with that name itself; null and
    empty texts count nothing; every row counts, also repeated ones; other columns, ``doc_id``
    included, are ignored. An empty table gives an empty result.
    """
    counts, totals = phrase_counts(docs, minimum, group_suffixes, block_bytes)
    kept = scored(counts).join(covered(counts), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
