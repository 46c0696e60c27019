"""Language of a text by piece probabilities, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stormframe.llm.common import free_name, learnable, whole_text
from stormframe.session import stored

#: Rows per language that the model is fitted on, about; chosen by a hash of their ids.
ROWS_PER_LANGUAGE = 2000
SMOOTHING = 0.5
#: Probability of a character outside the vocabulary, the same in every language.
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Probabilities of words of up to so many letters are multiplied; those of longer ones, whose product may
#: be too small for a double, go by their logarithms.
SHORT_WORD = 32
#: Letters of words that are looked at together.
LATTICE_LETTERS = 60_000
CACHE_WORDS = 300_000
#: Runs whose new words are scored together; a longer text is scored by itself.
RUNS_AT_ONCE = 30_000
#: A letter, and the letters and marks that follow it.
RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN_RUNS = re.compile("[a-z]+")
WORD_START = "▁"
#: Enough for any character.
CHARACTER_BITS = 21


def runs_of(text: str) -> list[str]:
    text = text.lower()
    return PLAIN_RUNS.findall(text) if text.isascii() else RUNS.findall(text)


def word_groups(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words in groups of like length; long words are never with short ones."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end, longest = at, 0
        while end < len(order):
            size = len(words[order[end]]) + 1
            if end > at and (size * (end + 1 - at) > LATTICE_LETTERS or (longest <= SHORT_WORD + 1 < size)):
                break
            longest, end = size, end + 1
        yield order[at:end]
        at = end


def read_vocabulary(path: str) -> list[str]:
    """Pieces of the vocabulary file, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [model.id_to_piece(i) for i in plain]


class PieceTrie:
    """Vocabulary pieces as a table of steps: state and character to the next state."""

    def __init__(self, piece_ids: dict[str, int]):
        self.unknown = len(piece_ids)
        steps: dict[int, int] = {}
        ends = {0: -1}
        for piece, number in piece_ids.items():
            state = 0
            for character in piece:
                state = steps.setdefault(state << CHARACTER_BITS | ord(character), len(steps) + 1)
            ends[state] = number
        keys = np.fromiter(steps, np.int64, len(steps))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.next = np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.piece = np.full(len(steps) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def step(self, states: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``states`` have a step for their character, and where those lead."""
        key = states << CHARACTER_BITS | characters
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        there = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return there, self.next[at[there]]


class Lattice:
    """Every way to cut words into vocabulary pieces, as arrays ordered by where a piece ends."""

    def __init__(self, words: list[str], pieces: PieceTrie | dict[str, int], longest: int):
        trie = pieces if isinstance(pieces, PieceTrie) else PieceTrie(pieces)
        self.words = len(words)
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        letters = "".join(WORD_START + w for w in words).encode("utf-32-le")
        letters = np.frombuffer(letters, np.uint32).astype(np.int64)
        word = np.repeat(np.arange(self.words), self.sizes)
        start = np.arange(len(letters)) - (np.cumsum(self.sizes) - self.sizes)[word]
        # All places walk the vocabulary at once; those without a further step drop out.
        at, state, edges = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        for length in range(1, longest + 1):
            inside = start[at] + length <= self.sizes[word[at]]
            at, state = at[inside], state[inside]
            there, reached = trie.step(state, letters[at + length - 1])
            if length == 1:  # a character is always an edge, known or not
                piece = np.full(len(at), trie.unknown)
                known = trie.piece[reached]
                piece[there] = np.where(known >= 0, known, trie.unknown)
                edges.append(np.stack([start + 1, word, start, piece], 1))
            at, state = at[there], reached
            piece = trie.piece[state]
            if length > 1:
                whole = piece >= 0
                ends = start[at[whole]] + length
                edges.append(np.stack([ends, word[at[whole]], start[at[whole]], piece[whole]], 1))
            if not len(at):
                break
        table = np.concatenate(edges) if edges else np.zeros((0, 4), np.int64)
        self.table = table[np.argsort(table[:, 0], kind="stable")]
        steps = int(self.sizes.max()) if len(words) else 0
        self.bounds = np.searchsorted(self.table[:, 0], np.arange(1, steps + 2))

    def forward(self, chances: np.ndarray) -> np.ndarray:
        """``[position, word, language]``: summed probability of all ways to reach a position."""
        steps = len(self.bounds) - 1
        reach = np.zeros((steps + 1, self.words, chances.shape[1]))
        reach[0] = 1.0
        for end in range(1, steps + 1):
            part = self.table[self.bounds[end - 1] : self.bounds[end]]
            np.add.at(reach[end], part[:, 1], reach[part[:, 2], part[:, 1]] * chances[part[:, 3]])
        return reach

    def log_forward(self, logs: np.ndarray) -> np.ndarray:
        """``forward`` in logarithms."""
        reach = np.full((len(self.bounds), self.words, logs.shape[1]), -np.inf)
        reach[0] = 0.0
        for end in range(1, len(self.bounds)):
            part = self.table[self.bounds[end - 1] : self.bounds[end]]
            np.logaddexp.at(reach[end], part[:, 1], reach[part[:, 2], part[:, 1]] + logs[part[:, 3]])
        return reach

    @property
    def short(self) -> bool:
        return len(self.bounds) <= SHORT_WORD + 2

    def log_likelihood(self, chances: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros((0, chances.shape[1]))
        at = self.sizes, np.arange(self.words)
        return np.log(self.forward(chances)[at]) if self.short else self.log_forward(np.log(chances))[at]

    def expected_counts(self, chances: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations; ``times`` is ``[word, language]``."""
        if not self.short:
            return self._log_expected_counts(np.log(chances), times)
        reach = self.forward(chances)
        back = np.zeros_like(reach)
        words = np.arange(self.words)
        total = reach[self.sizes, words]
        back[self.sizes, words] = times / total
        counts = np.zeros_like(chances)
        for end in range(len(self.bounds) - 1, 0, -1):
            part = self.table[self.bounds[end - 1] : self.bounds[end]]
            flow = back[end, part[:, 1]] * chances[part[:, 3]]
            np.add.at(counts, part[:, 3], flow * reach[part[:, 2], part[:, 1]])
            np.add.at(back, (part[:, 2], part[:, 1]), flow)
        return counts

    def _log_expected_counts(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        reach = self.log_forward(logs)
        back = np.full_like(reach, -np.inf)
        words = np.arange(self.words)
        back[self.sizes, words] = -reach[self.sizes, words]
        counts = np.zeros_like(logs)
        for end in range(len(self.bounds) - 1, 0, -1):
            part = self.table[self.bounds[end - 1] : self.bounds[end]]
            flow = back[end, part[:, 1]] + logs[part[:, 3]]
            np.add.at(counts, part[:, 3], np.exp(flow + reach[part[:, 2], part[:, 1]]) * times[part[:, 1]])
            np.logaddexp.at(back, (part[:, 2], part[:, 1]), flow)
        return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    chances: np.ndarray  # [piece or unknown, language]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in one worker and remembers the words it has seen."""

    def __init__(self, model: LanguageModel, cache_words: int = CACHE_WORDS):
        self.model = model
        self.trie = PieceTrie({p: i for i, p in enumerate(model.pieces)})
        self.longest = max(map(len, model.pieces), default=1)
        self.cache_words = cache_words
        self.known: dict[str, int] = {}
        self.values = np.zeros((cache_words, len(model.languages)), np.float64)

    def _learn(self, words: list[str]) -> None:
        for group in word_groups(words):
            part = [words[i] for i in group]
            values = Lattice(part, self.trie, self.longest).log_likelihood(self.model.chances)
            first = len(self.known)
            if first + len(part) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values[: first + len(part)])])
            self.values[first : first + len(part)] = values
            self.known.update(zip(part, range(first, first + len(part)), strict=True))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability per text, for equal priors."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        held: list[tuple[int, list[str]]] = []
        count = 0
        for i, text in enumerate(texts if self.model.languages else []):
            runs = runs_of(text)
            if runs:
                held.append((i, runs))
                count += len(runs)
            if count >= RUNS_AT_ONCE:
                self._settle(held, names, scores)
                held, count = [], 0
        if held:
            self._settle(held, names, scores)
        return names, scores

    def _settle(self, held: list[tuple[int, list[str]]], names: list[str], scores: np.ndarray) -> None:
        """Fill in ``names`` and ``scores`` of some texts, whose new words are scored together."""
        sizes = [len(runs) for _, runs in held]
        if len(self.known) > self.cache_words - sum(sizes):
            self.known = {}
        known = self.known
        new = list(dict.fromkeys(r for _, runs in held for r in runs if r not in known))
        self._learn(new)
        found = np.fromiter((known[r] for _, runs in held for r in runs), np.int64, sum(sizes))
        logs = np.add.reduceat(self.values[found], np.cumsum(sizes) - sizes)
        best = logs.argmax(1)  # the first in code point order among equals
        for (i, _), k, log in zip(held, best, logs, strict=True):
            names[i] = self.model.languages[k]
            scores[i] = 1.0 / np.exp(log - log[k]).sum()


def fit_language(docs: DataFrame, vocabulary: str, rows: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit piece probabilities per language of ``docs``.

    Learns from rows with a language whose id's crc32 mod 4 is not 2; about ``rows`` of each
    language, by a hash of the id, and all rows of a language that has fewer. Pieces are first
    counted as the vocabulary's own tokenizer cuts the words; one round of expectation over all
    segmentations follows. What reaches the driver is a count per piece and language.
    """
    pieces = read_vocabulary(vocabulary)
    piece_ids = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    known = docs.where(learnable() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    per_language = known.groupBy("lang").count().orderBy("lang").collect()
    languages = [r["lang"] for r in per_language]
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*(F.lit(x) for r in per_language for x in (r["lang"], min(1.0, rows / r["count"]))))
    chance = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    sample = known.where(chance < F.element_at(share, F.col("lang")))

    def words(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, run) for run in runs_of(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"],
            )

    counted = (
        sample.select("lang", whole_text().alias("text")).mapInArrow(words, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    spread = stored(counted.repartition("word"), "words")  # a hash of the word, so no language is alone

    def first_counts(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for batch in batches:
            counts: Counter = Counter()
            langs, found, times = (c.to_pylist() for c in batch.columns)
            for lang, cut, n in zip(langs, model.encode(found, out_type=str, num_threads=1), times, strict=True):
                for piece in cut:
                    counts[lang, piece_ids.get(piece, -1)] += n
            yield _as_batch(counts)

    place = {lang: i for i, lang in enumerate(languages)}

    def chances_from(table: DataFrame) -> np.ndarray:
        counts = np.full((len(pieces), len(languages)), SMOOTHING)
        for r in table.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            if r["piece"] >= 0:
                counts[r["piece"], place[r["lang"]]] += r["n"]
        counts /= counts.sum(0)
        return np.concatenate([counts, np.full((1, len(languages)), UNKNOWN)])

    schema = "lang string, piece long, n double"
    start = docs.sparkSession.sparkContext.broadcast(chances_from(spread.mapInArrow(first_counts, schema)))

    def expected(batches):
        chances, trie = start.value, PieceTrie(piece_ids)
        for batch in batches:
            langs, found, times = (c.to_pylist() for c in batch.columns)
            total = np.zeros_like(chances)
            for group in word_groups(found):
                weights = np.zeros((len(group), len(languages)))
                for i, at in enumerate(group):
                    weights[i, place[langs[at]]] = times[at]
                total += Lattice([found[i] for i in group], trie, longest).expected_counts(chances, weights)
            rows, columns = np.nonzero(total[:-1] > 1e-9)
            yield _as_batch({(languages[c], int(r)): total[r, c] for r, c in zip(rows, columns, strict=True)})

    chances = chances_from(spread.mapInArrow(expected, schema))
    return LanguageModel(languages, pieces, chances)


def _as_batch(counts: dict) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         pa.array([float(n) for n in counts.values()], pa.float64())], ["lang", "piece", "n"],
    )


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of each whole text.

    Words are runs of letters with the marks that follow them, of any length. Texts without a letter,
    null and empty ones included, are ``und`` with score 0, and so is every text if no row could be
    learned from. Of equally likely languages the first in code point order wins. Columns of
    ``docs`` with one of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    text = free_name(rest, "_text")
    added = [StructField(text, StringType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType([*rest.schema, *added])

    def predict(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            names, scores = scorer.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names
            )

    return rest.withColumn(text, whole_text()).mapInArrow(predict, schema).drop(text)
