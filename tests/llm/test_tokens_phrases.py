"""Byte-pair encoding, fill-in-the-middle and phrases against plain versions."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormframe.llm import phrases
from stormframe.llm.bpe import Encoder, decode, decode_ids, encode, segments
from stormframe.llm.fill_middle import Units, disarrange, restore, streamed, transform, transform_text
from stormframe.llm.oracle import OP13
from stormframe.llm.phrases import collocations
from stormframe.llm.queries import documents, op11_bpe, op12_fill_middle

WORD_BPE = path("word_bpe_49k.json")


def ids(code):
    return np.frombuffer(code, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(WORD_BPE)


def odd_texts():
    pick = random.Random(1)
    points = [lambda: pick.randrange(1, 0x300), lambda: pick.randrange(32, 127), lambda: 39, lambda: 0x301,
              lambda: pick.randrange(0x300, 0xD800), lambda: pick.randrange(0xE000, 0x110000), lambda: 32]
    texts = ["".join(chr(pick.choice(points)()) for _ in range(pick.randrange(50))) for _ in range(4000)]
    texts += ["".join(pick.choices("abIt's'</w>d", k=pick.randrange(40))) for _ in range(4000)]
    texts += ["", "   ", "<|startoftext|>x<|endoftext|><|endoftext|", "\x1c\x1d a\x85b\xa0c", "İ Ⱥ Ⱦ Σς", "é é"]
    return texts + ["a" * 3000, "the" * 5000, "ab" * 2000 + "'S don'T", "x" + " " * 50_000 + "y"]


def test_encodes_and_decodes_as_the_library(library, encoder):
    texts = odd_texts()
    expected = library.encode_batch(texts, add_special_tokens=False)
    for text, coded, want in zip(texts, encoder.encode(texts), expected, strict=True):
        assert ids(coded) == want.ids, text[:80]
        assert decode_ids(encoder.bpe.names, coded).decode() == library.decode(want.ids, skip_special_tokens=False)
    assert 0 < encoder.repaired < encoder.proposed


def test_every_code_point_of_the_plain_path(library, encoder):
    texts = [f"{a}{chr(c)}{b}" for c in range(0x300) for a, b in (("", ""), ("a", "b"), ("!", "!"), ("1", " '"))]
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert [ids(c) for c in encoder.encode(texts)] == [e.ids for e in expected]


def test_pairs_are_crossed_exactly_where_merging_differs(encoder):
    bpe = encoder.bpe
    pick = np.random.default_rng(2)
    inner = [t for t, name in bpe.names.items() if not name.endswith((b"</w>", b"|>")) and t < 6000]
    left, right = pick.choice(inner, 4000), pick.choice(inner, 4000)
    left[:200] = right[:200]  # a token beside itself
    back = {c: b for b, c in enumerate(bpe.byte_of)}

    def symbols(token):
        return np.array([back[c] for c in bpe.names[token].decode()], np.int64)

    crossed = bpe.crossed(left, right)
    for a, b, found in zip(left.tolist(), right.tolist(), crossed.tolist(), strict=True):
        assert (bpe.merged(np.concatenate([symbols(a), symbols(b)])) != [a, b]) == found


def test_words_merged_together_and_alone_agree(encoder):
    pick = random.Random(3)
    words = ["".join(pick.choices("aelnst", k=pick.randint(1, 30))).encode() for _ in range(2000)]
    symbols = [np.frombuffer(w, np.uint8).astype(np.int64) for w in words]
    tokens, owner = encoder.bpe.merged_together(np.concatenate(symbols), np.array([len(w) for w in words]))
    for i, word in enumerate(symbols):
        assert tokens[owner == i].tolist() == encoder.bpe.merged(word)


def test_a_full_memory_and_segments_change_nothing(encoder):
    texts = odd_texts()[:300]
    small = Encoder(WORD_BPE, cached_words=5)
    assert [small.encode([t])[0] for t in texts] == encoder.encode(texts)
    long = " ".join(texts)
    assert "".join(segments(long, 100)) == long
    assert b"".join(encoder.encode([part])[0] for part in segments(long, 100)) == encoder.encode([long])[0]


def test_awkward_rows_are_encoded(spark, awkward, nothing, library):
    rows = decode(encode(awkward, WORD_BPE).withColumn("decoded", F.lit("replaced")), WORD_BPE).collect()
    plain = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    expected = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in plain]
    assert sorted(((r["doc_id"], ids(r["ids"])) for r in rows), key=repr) == sorted(expected, key=repr)
    texts = [(i, library.decode(e, skip_special_tokens=False)) for i, e in expected]
    assert sorted(((r["doc_id"], r["decoded"]) for r in rows), key=repr) == sorted(texts, key=repr)
    assert encode(nothing, WORD_BPE).count() == 0


def test_op11_equals_the_library(spark, testdata, library):
    rows = {r["doc_id"]: r for r in op11_bpe(spark, testdata).collect()}
    for doc in documents(spark, testdata).collect():
        want = library.encode(doc["text"] or "", add_special_tokens=False).ids
        row = rows.pop(doc["doc_id"])
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        decoded = library.decode(want, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert not rows


def plain_fim(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_transformed_texts(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choices("aZb <>PSM\né中\U0001f600", k=pick.randrange(30))) for _ in range(3000)]
    for i, text in enumerate(texts):
        row = transform_text(i, text.encode())
        n, form, prefix, middle, output = plain_fim(i, text)
        assert row[:5] == (i, n, form, prefix, middle)
        assert row[6].decode() == output and row[7] == hashlib.sha256(output.encode()).hexdigest()
        assert streamed(disarrange(row[6], form), memoryview(row[6]))[0].decode() == text


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_units_do_not_depend_on_blocks(size):
    text = "ab céd中EF\U0001f600gh12" * 5
    units = Units(np.frombuffer(text.encode(), np.uint8), size)
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert units.count == len(tokens)
    starts = np.cumsum([0] + [len(t.encode()) for t in tokens]).tolist()
    assert [units.start(i) for i in range(len(tokens) + 1)] == starts


def test_awkward_rows_are_transformed(spark, awkward, nothing):
    done = restore(transform(awkward).withColumn("restored", F.lit("replaced")))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in done.collect()]
    expected = [(r["doc_id"], *plain_fim(r["doc_id"], r["text"] or ""), r["text"] or "") for r in awkward.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert restore(transform(nothing)).count() == 0
    lost = transform(awkward).where("form = 'psm'").limit(1).withColumn("output", F.lit("no sentinels"))
    with pytest.raises(Exception, match="substring not found|subsection not found"):
        restore(lost).collect()


def test_op12_equals_the_plain_version(spark, testdata):
    rows = {r["doc_id"]: r for r in op12_fill_middle(spark, testdata).collect()}
    forms = Counter(r["form"] for r in rows.values())
    assert set(forms) == {"plain", "psm", "spm"}
    for doc in documents(spark, testdata).collect():
        row = rows.pop(doc["doc_id"])
        n, form, prefix, middle, output = plain_fim(doc["doc_id"], doc["text"] or "")
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, prefix, middle)
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()
    assert not rows


def plain_phrases(rows, minimum, top):
    counts, totals = Counter(), Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, n in totals.items():
        found = {p: a for (of, p), a in counts.items() if of == lang and a >= minimum}
        inner = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(a, inner.get(p[i : i + m], 0))
        scores = []
        for p, a in found.items():
            if len(p) > 1 and 100 * inner.get(p, 0) < 80 * a:
                cuts = [(int(Fraction(2_000_000 * a, found[p[:k]] + found[p[k:]])), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scores.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scores)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(seed=5, count=400):
    pick = random.Random(seed)
    vocabulary = ["a", "B", "b", "é", "long", " ", "zz"]
    rows = []
    for i in range(count):
        text = "".join(pick.choice(vocabulary) + pick.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(pick.randrange(30)))
        rows.append((pick.choice(["en", "en", "en", None, "fr", "und"]), text))
    return [*rows, ("en", None), ("de", ""), ("en", "same four words here " * 40), ("fr", "a b " * 300)]


@pytest.mark.parametrize(("suffixes", "size"), [(500_000, 6_000_000), (40, 150), (7, 11), (300, 64)])
def test_phrases_do_not_depend_on_groups_and_blocks(spark, monkeypatch, suffixes, size):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations(docs.withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")), 5, 40, suffixes, size)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 5, 40)


def test_a_filter_without_room_prunes_less_and_changes_nothing(spark, monkeypatch):
    rows = phrase_rows(6)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(phrases, "COUNTERS", 1)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations(docs, 8, 100, 10)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 8, 100)


def test_cuts_borrow_the_words_of_the_last_suffixes():
    text = phrases.plain(b"one two three four five six. seven eight nine")
    parts = list(phrases.cuts(text, 10))
    assert parts[0] == (b"one two three four five six", 3)
    block = phrases.Block(["x"] * len(parts), [p for p, _ in parts], [n for _, n in parts])
    whole = phrases.Block(["x"], [text], [0])

    def spelled(block):
        rows, times = block.distinct(block.suffixes(~block.breaks))
        return sorted((tuple(block.words[w] for w in row[1:] if w >= 0), int(n)) for row, n in zip(rows, times, strict=True))

    assert spelled(block) == spelled(whole)
    assert int(block.own.sum()) == 9


def test_awkward_rows_have_phrases(spark, awkward, nothing):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    got = sorted(tuple(r) for r in collocations(awkward, 2, 50).collect())
    assert got == plain_phrases(rows, 2, 50)
    assert collocations(nothing).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**18
    counts = [("x", "a", 1, 3 * big), ("x", "b", 1, 2 * big + 1), ("x", "a b", 2, big)]
    table = spark.createDataFrame(counts, "lang string, phrase string, size int, n long")
    row = phrases.scored(table).collect()
    assert [r["score"] for r in row] == [2_000_000 * big // (5 * big + 1)]


def test_ties_of_cuts_go_to_the_first(spark):
    counts = [("x", w, 1, 100) for w in "abc"] + [("x", "a b", 2, 90), ("x", "b c", 2, 90), ("x", "a b c", 3, 50)]
    table = spark.createDataFrame(counts, "lang string, phrase string, size int, n long")
    row = phrases.scored(table).where("phrase = 'a b c'").first()
    assert (row["l"], row["r"]) == (100, 90)


def test_sql_states_the_same_phrases():
    rows = phrase_rows(7)
    connection = duckdb.connect()
    connection.register("documents", pa.table({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(connection.sql(OP13).fetchall()) == plain_phrases(rows, 30, 2000)
