"""Inputs that a corpus may hold and that a method may trip over."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormframe.llm.bpe import encode
from stormframe.llm.exact_dedup import drop_exact_duplicates
from stormframe.llm.language import SMOOTHING, UNKNOWN, Lattice, fit_language, read_vocabulary, runs_of, with_language
from stormframe.llm.licenses import license_scan
from stormframe.llm.mixing import emit_mix, mix_rates
from stormframe.llm.ngram_join import drop_near_duplicates, near_duplicates, near_pairs
from stormframe.llm.packing import best_fit, fit_counts, length_patterns, plan_packing, round_patterns
from stormframe.llm.quality import BUCKETS, DIMENSIONS, NEIGHBOURS, fit_quality, trigram_counts, with_quality
from stormframe.llm.queries import PIECES, WORD_BPE
from stormframe.llm.shingles import word_hashes
from stormframe.llm.suffix_dedup import remove_repeats


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- long runs of one sign --------------------------------------------------------------


def test_license_scan_of_long_runs(spark):
    """Regular expressions of the JVM must neither recurse nor go back over such texts."""
    n = 300_000
    mit = "Released under the MIT License."
    texts = [
        f"{mit}{chr(10) * 1_000_000}end", f"license {'a.' * n}a", f"attribution{'-a' * n} license", "license" + " " * 1_000_000 + "x",
        "license " + "*" * 1_000_000, f"{mit}\n/*{' ' * n}x\n\n{mit}", "v" + "-" * n + " license", f"{mit}" + "\t\n" * n,
    ]
    docs = frame(spark, list(enumerate(texts))).repartition(4)
    found = {r["doc_id"]: r["license"] for r in license_scan(docs, F.concat(F.col("doc_id").cast("string"), F.lit(".c"))).collect()}
    assert found == {0: "mit", 1: None, 2: None, 3: None, 4: None, 5: "mit", 6: None, 7: "mit"}


def test_comment_ends_are_removed_as_before(spark):
    pick = random.Random(1)
    texts = ["".join(pick.choices([" ", "\t", "*", "/", "*/", "-->", "a", "\n"], k=pick.randrange(12))) for _ in range(4000)]
    from stormframe.llm.licenses import COMMENT_END

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.regexp_replace("t", COMMENT_END, "").alias("new"),
        F.regexp_replace("t", r"(?m)[ \t]*(?:\*+/|-->)[ \t]*$", "").alias("plain"),
    )
    assert rows.where("new != plain").isEmpty()


def test_license_rows_without_an_id(spark):
    rows = [(None, "Released under the MIT License.", "a/LICENSE"), (1, "text", "a/x"), (2, "Released under the MIT License.", "a/y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = {r["doc_id"]: (r["own_license"], r["inherited_license"]) for r in license_scan(docs, F.col("path")).collect()}
    assert found == {None: (None, None), 1: (None, None), 2: ("mit", None)}


def test_very_long_texts(spark):
    word = " ".join(f"w{i % 9973}x" for i in range(1_500_000))  # some 10 MB
    docs = frame(spark, [(1, word), (2, word + " end"), (3, "x" * 5_000_000), (4, " " * 3_000_000)]).repartition(4)
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert linked[1][0] == 9973 and linked[2] == (9974, 1) and linked[3] == (1, 3) and linked[4] == (0, 4)
    sizes = {r["doc_id"]: r["n"] for r in encode(docs, WORD_BPE).select("doc_id", (F.length("ids") / 4).alias("n")).collect()}
    assert sizes[3] > 0
    assert sizes[4] == 0


# --- hashes that a text may be made to break -----------------------------------------------


def thue_morse(letters):
    bits = [0]
    while len(bits) < letters:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("letters", [8, 16, 64, 128, 1024, 4096])
def test_words_of_a_kind_have_hashes_of_their_own(letters):
    values, _ = word_hashes([w.encode() for w in thue_morse(letters)])
    assert values[0] != values[1]


def test_word_hashes_do_not_collide_and_do_not_depend_on_place():
    pick = random.Random(2)
    words = list({"".join(pick.choices("ab", k=pick.randrange(1, 40))) for _ in range(20_000)})
    values, owner = word_hashes([" ".join(words).encode(), b"", "\t".join(reversed(words)).upper().encode()])
    assert len(set(values[owner == 0].tolist())) == len(words)
    assert values[owner == 2].tolist() == values[owner == 0][::-1].tolist()


def test_documents_of_such_words_are_not_linked(spark):
    one, two = thue_morse(1024)
    docs = frame(spark, [(1, f"{one} b c d e f"), (2, f"{two} b c d e f"), (3, f"{one} b c d e f")])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    text = {i: t * 2 for i, t in enumerate(thue_morse(128))}
    gone = {r["doc_id"]: r["spans"] for r in remove_repeats(frame(spark, list(text.items()))).collect()}
    plain = removed_plainly(list(text.items()), 100)
    assert {i: sum(s["length"] for s in spans) for i, spans in gone.items()} == {i: n for (i, _), n in plain.items()}


# --- rows that share an id ------------------------------------------------------------------


def removed_plainly(rows, length):
    """Removed bytes per ``(doc_id, text)``; rows of one id come in the order of their texts."""
    seen, out = set(), defaultdict(int)
    for doc_id, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                gone[at : at + length] = True
            seen.add(string)
        out[doc_id, text] += int(gone.sum())
    return dict(out)


def test_repeats_among_rows_that_share_an_id(spark):
    pick = random.Random(3)

    def passage():
        return "".join(pick.choices("abcdef ", k=320))

    a, b, c = passage(), passage(), passage()
    for rows in ([(1, a), (5, b + a), (5, "short")], [(1, a), (5, a + "zz"), (5, c)], [(5, b), (5, b), (5, a + b), (2, c), (2, c + a)]):
        found = Counter()
        for r in remove_repeats(frame(spark, rows)).collect():
            found[r["doc_id"], r["n_bytes"]] += sum(s["length"] for s in r["spans"])
        want = Counter()
        for (doc_id, text), n in removed_plainly(rows, 100).items():
            want[doc_id, len(text)] += n
        assert found == want


def test_near_duplicates_of_one_id_with_two_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (7, base + " more"), (7, "something else that is long enough here"), (9, "alone in the world of these texts")]
    results = [
        sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows).repartition(n)).collect())
        for n in (1, 3, 5)
    ]
    assert results[0] == results[1] == results[2] and len(results[0]) == 4


# --- all links of the join --------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def varied(seed, groups, copies):
    """Groups of near copies, more than a short list holds, with exact copies and awkward texts among them."""
    pick, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{pick.randrange(400)}" for _ in range(pick.randrange(20, 60))]
        for _ in range(copies):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                words[pick.randrange(len(words))] = f"x{pick.randrange(50)}"
            rows.append(" ".join(words))
    return [(i, t) for i, t in enumerate([*rows, None, "", "one two", "one two", "ONE  two"])]


@pytest.mark.parametrize(("seed", "groups", "copies"), [(1, 12, 4), (2, 3, 40), (3, 2, 9)])
def test_pairs_and_links_equal_brute_force(spark, seed, groups, copies):
    rows = varied(seed, groups, copies)
    sets = {i: shingle_set(t) for i, t in rows}
    links = defaultdict(set)
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links[a].add(b)
            links[b].add(a)
    least = {i: min((j for j, y in sets.items() if y == x), default=i) if x else i for i, x in sets.items()}
    want = {(a, b) for a in set(least.values()) for b in links[a] if least[b] == b and a < b and sets[a] != sets[b]}
    pairs, members = near_pairs(frame(spark, rows).repartition(4))
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want and want
    told = {r["doc_id"]: (r["n_shingles"], r["class_id"], r["n_links"]) for r in members.collect()}
    assert told == {i: (len(x), least[i], len(links[i])) for i, x in sets.items()}


# --- columns with the names that operators use inside -----------------------------------------


def test_clashing_names_are_kept(spark):
    names = ["_sha", "_first", "_id", "_digest", "_source", "_text", "_row", "_copy", "_salt", "_of", "rate", "row", "copy", "id", "digest", "kept_id"]
    base = " ".join(f"w{i}" for i in range(50))
    texts = [base, base, base + " x", "one more text of its own", None]
    docs = frame(spark, list(enumerate(texts))).withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    model, language = fit_quality(docs, labels), fit_language(docs, PIECES)

    def kept(result, ids=None):
        rows = result.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        if ids is not None:
            assert sorted({r["doc_id"] for r in rows}) == ids
        return rows

    assert drop_exact_duplicates(docs).columns == docs.columns
    kept(drop_exact_duplicates(docs), [1, 2, 3, 4])
    kept(drop_near_duplicates(docs), [0, 3, 4])
    kept(with_quality(docs, model), [0, 1, 2, 3, 4])
    kept(with_language(docs, language), [0, 1, 2, 3, 4])
    kept(mix_rates(docs), [0, 1, 2, 3, 4])
    assert emit_mix(docs).columns == docs.columns
    kept(emit_mix(docs))


# --- language: every segmentation, by hand ------------------------------------------------------


def segmentations(word):
    if not word:
        yield ()
    for end in range(1, len(word) + 1):
        for rest in segmentations(word[end:]):
            yield (word[:end], *rest)


def likelihood(word, chances, column):
    """Probability of a word, summed over all ways to cut it; unknown single characters have their own."""
    total = 0.0
    for cut in segmentations("▁" + word):
        product = 1.0
        for piece in cut:
            product *= chances.get(piece, [UNKNOWN] * 9 if len(piece) == 1 else [0.0] * 9)[column]
        total += product
    return total


def test_fit_and_prediction_equal_plain_sums(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat", "en"), ("the hat", "en"), ("le chat", "fr"), ("une", "fr"), ("la", "fr"), ("a cat", "en")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(docs, PIECES)

    import sentencepiece
    import zlib

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = read_vocabulary(PIECES)
    langs = ["en", "fr"]
    words = Counter((lang, w) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 for w in t.split())
    counts = {p: np.full(2, SMOOTHING) for p in pieces}
    for (lang, word), n in words.items():
        for piece in tokenizer.encode(word, out_type=str):
            counts[piece][langs.index(lang)] += n
    total = sum(counts.values())
    start = {p: c / total for p, c in counts.items()}
    counts = {p: np.full(2, SMOOTHING) for p in pieces}
    for (lang, word), n in words.items():
        column = langs.index(lang)
        whole = likelihood(word, start, column)
        for cut in segmentations("▁" + word):
            product = math.prod(start[p][column] if p in start else (UNKNOWN if len(p) == 1 else 0.0) for p in cut)
            for piece in cut:
                if piece in counts:
                    counts[piece][column] += n * product / whole
    total = sum(counts.values())
    want = np.array([counts[p] / total for p in pieces])
    assert model.languages == langs and model.pieces == pieces
    np.testing.assert_allclose(model.chances[:-1], want, rtol=1e-6)

    final = dict(zip(pieces, want))
    for text in ("the chat", "une hat", "zé"):
        logs = np.array([sum(math.log(likelihood(w, final, k)) for w in text.split()) for k in range(2)])
        row = with_language(frame(spark, [(1, text)]), model).first()
        assert row["lang_pred"] == langs[int(logs.argmax())]
        assert row["score"] == pytest.approx(1 / np.exp(logs - logs.max()).sum(), rel=1e-6)


def test_long_words_are_one_word():
    """Logarithms give what products give, and no word is cut."""
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "bab"])}
    chances = np.random.default_rng(4).dirichlet(np.ones(6), 2).T
    chances = np.concatenate([chances, np.full((1, 2), UNKNOWN)])
    short = Lattice(["ab" * 10, "abba", "axb"], pieces, 3)
    products = np.log(short.forward(chances)[short.sizes, np.arange(3)])
    logs = short.log_forward(np.log(chances))[short.sizes, np.arange(3)]
    np.testing.assert_allclose(products, logs)
    times = np.array([[1.0, 2.0], [0.0, 3.0], [1.0, 0.0]])
    np.testing.assert_allclose(short.expected_counts(chances, times), short._log_expected_counts(np.log(chances), times), atol=1e-9)
    long = Lattice(["ab" * 4000], pieces, 3).log_likelihood(chances)
    assert np.isfinite(long).all() and (long < -1000).all()
    joined = Lattice(["ab" * 8, "abab" * 12], pieces, 3)
    np.testing.assert_allclose(joined.log_likelihood(chances), joined.log_forward(np.log(chances))[joined.sizes, np.arange(2)])


def test_runs_are_letters_with_their_marks():
    assert runs_of("½ ² ③ 12 _ !") == []
    assert runs_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert runs_of("Été x1y") == ["été", "x", "y"]
    assert runs_of("ABC-def") == ["abc", "def"]
    assert runs_of("́a") == ["a"]


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(i, "word und wort", "de") for i in range(8)], "doc_id long, text string, lang string")
    model = fit_language(docs, PIECES)
    rows = with_language(frame(spark, [(1, "½"), (2, "² ③ 44"), (3, None), (4, "हिन्दी"), (5, "字" * 500)]), model).collect()
    assert [r["lang_pred"] for r in sorted(rows, key=lambda r: r["doc_id"])] == ["und", "und", "und", "de", "de"]


# --- quality: neighbours and votes by hand -------------------------------------------------------


def test_scores_equal_plain_neighbours(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choices("abcdefgh " if i % 2 else "uvwxyz .", k=pick.randrange(40, 200))) for i in range(160)]
    docs = frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    import zlib

    known = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = trigram_counts([t.encode() for t in texts], BUCKETS).astype(float)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    weighted = np.log1p(counts) * idf
    weighted /= np.linalg.norm(weighted, axis=1, keepdims=True)
    axes = np.linalg.svd(weighted[known], full_matrices=False)[2][:DIMENSIONS].T
    latent = np.log1p(counts) @ (idf[:, None] * axes)
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    scores = {r["doc_id"]: r["score"] for r in with_quality(docs, fit_quality(docs, labels)).collect()}
    for i in range(len(texts)):
        near = sorted(((float(latent[i] @ latent[k]), k % 2) for k in known), reverse=True)[:NEIGHBOURS]
        weights = [(max(c, 0.0), label) for c, label in near]
        assert scores[i] == pytest.approx(sum(w * label for w, label in weights) / sum(w for w, _ in weights), abs=2e-3)


# --- packing: what comes from patterns -----------------------------------------------------------


@pytest.mark.parametrize(("seed", "pieces"), [(1, 3000), (2, 12_000)])
def test_most_sequences_of_several_pieces_are_fitted_patterns(seed, pieces):
    limit = 512
    lengths = np.minimum(np.random.default_rng(seed).geometric(1 / 150, pieces) + 3, limit)
    histogram = np.bincount(lengths, minlength=limit + 1)
    patterns = length_patterns(np.flatnonzero(histogram), limit)
    fitted = fit_counts(patterns, histogram.astype(float))
    plan, left = round_patterns(histogram, patterns, fitted)
    rest = best_fit(left, limit)
    used = np.zeros(limit + 1, np.int64)
    for parts, repeats in plan + rest:
        assert sum(parts) <= limit
        np.add.at(used, list(parts), repeats)
    assert (used == histogram).all()
    several = sum(r for p, r in plan + rest if len(p) > 1)
    assert sum(r for p, r in plan if len(p) > 1) > several / 2
    total = sum(r for _, r in plan_packing(histogram, limit))
    assert total <= 1.01 * np.ceil((histogram * np.arange(limit + 1)).sum() / limit)
