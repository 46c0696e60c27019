"""Each corpus operator against a plain version, and on awkward and empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from stormframe.llm import ngram_join, sharding, suffix_dedup
from stormframe.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from stormframe.llm.hnsw import search, usable_vectors
from stormframe.llm.language import Lattice, fit_language, with_language
from stormframe.llm.licenses import license_scan
from stormframe.llm.mixing import emit_mix, mix_rates
from stormframe.llm.packing import RankEncoder, pack, plan_packing
from stormframe.llm.quality import fit_quality, with_quality
from stormframe.llm.queries import PIECES, RANKS
from stormframe.llm.suffix_dedup import long_prefix_classes, remove_repeats


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def texts_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


# --- exact duplicates -------------------------------------------------------------------


def test_exact_duplicates(awkward, nothing):
    groups = defaultdict(list)
    for doc_id, text in texts_of(awkward):
        groups[text].append(doc_id)
    found = rows_of(exact_duplicates(awkward))
    want = [(i, max(ids, key=lambda x: -1 if x is None else x), len(ids)) for ids in groups.values() for i in ids]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == Counter(want)
    assert sum(r["kept"] for r in found) == len(groups)
    kept = drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)
    assert exact_duplicates(nothing).count() == 0


def test_exact_duplicates_compare_whole_texts(awkward):
    """With a digest that all texts share, groups are the same."""
    weak = exact_duplicates(awkward, digest=lambda text: F.unhex(F.lit("00")))
    strong = exact_duplicates(awkward)
    columns = ["doc_id", "keep_id", "group_size"]
    assert Counter(map(tuple, weak.select(*columns).collect())) == Counter(map(tuple, strong.select(*columns).collect()))


# --- repeated passages ------------------------------------------------------------------


def plain_repeats(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        out[doc_id] = (int(gone.sum()), np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("length", [12, 100])
def test_remove_repeats(spark, length):
    parts = [" ".join(words(k, 30)) for k in range(6)]
    texts = [parts[i % 6] + str(i) + parts[(i * 5 + 1) % 6] for i in range(30)]
    texts += ["ab" * 400, "ü" * 250, "", texts[0], texts[0][:-3] + "?"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (sum(s["length"] for s in r["spans"]), bytes(r["kept"])) for r in remove_repeats(frame, length).collect()}
    assert found == plain_repeats(enumerate(texts), length)


@pytest.mark.parametrize("size", [60, 99])
def test_remove_repeats_of_a_common_line(spark, monkeypatch, size):
    """A line that stands in many surroundings, some of them alike, does not meet in one transform."""
    line = "\n" + " ".join(words(11, 60))[:size] + "\n"
    texts = [" ".join(words(100 + i, 40)) + " ".join(words(900 + i % 7, 4)) + line + " ".join(words(500 + i % 90, 40)) for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    plain = suffix_dedup.long_prefix_classes

    def guarded(symbols, length):
        assert len(symbols) < 12_000
        return plain(symbols, length)

    monkeypatch.setattr(suffix_dedup, "TRANSFORM_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "long_prefix_classes", guarded)
    found = {r["doc_id"]: (sum(s["length"] for s in r["spans"]), bytes(r["kept"])) for r in remove_repeats(frame).collect()}
    assert found == plain_repeats(enumerate(texts), 100)


def test_remove_repeats_awkward(awkward, nothing):
    found = rows_of(remove_repeats(awkward))
    assert len(found) == awkward.count()
    # Rows that share an id are documents of their own, in the order of their texts.
    rows = sorted((i, t) for i, t in texts_of(awkward) if i is not None)
    numbered = plain_repeats([(k, t) for k, (_, t) in enumerate(rows)], 100)
    want = Counter((i, numbered[k][1]) for k, (i, _) in enumerate(rows))
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in found if r["doc_id"] is not None) == want
    (lone,) = (t for i, t in texts_of(awkward) if i is None)
    assert [(r["spans"], bytes(r["kept"]).decode()) for r in found if r["doc_id"] is None] == [([], lone)]
    assert remove_repeats(nothing).count() == 0


def test_long_prefix_classes():
    pick = np.random.default_rng(0)
    for length in (2, 3, 5):
        symbols = np.concatenate([np.append(pick.integers(1, 3, 9), 0) for _ in range(12)])
        order, new = long_prefix_classes(symbols, length)
        whole = [i for i in order if i + length <= len(symbols) and (symbols[i : i + length] > 0).all()]
        group = dict(zip(order, np.cumsum(new), strict=True))
        for i in whole:
            for j in whole:
                same = (symbols[i : i + length] == symbols[j : j + length]).all()
                assert same == (group[i] == group[j])


# --- near duplicates --------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and part[a] != part[b]:
                    part[a] = part[b] = min(part[a], part[b])
                    changed = True
    return {i: (len(s), part[i]) for i, s in sets.items()}


@pytest.mark.parametrize("small_list", [0, 3, 16])
def test_near_duplicates(spark, monkeypatch, small_list):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", small_list)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    base = words(7, 90)
    texts = []
    for k in range(45):  # edits at growing distance, so that links form chains
        copy = list(base)
        for e in range(k % 9):
            copy[(11 * k + 17 * e) % 90] = f"edit{k}x{e}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(50 + k, 40)) for k in range(5)] + ["a b", "A  b", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame).collect()}
    assert found == plain_components((i, t or "") for i, t in enumerate(texts))


def test_near_duplicates_awkward(awkward, nothing):
    rows = [(i, t) for i, t in texts_of(awkward) if i is not None]
    want = plain_components(rows)
    for r in rows_of(ngram_join.near_duplicates(awkward)):
        assert r["doc_id"] is None or (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = ngram_join.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id is null").count() == 1
    assert ngram_join.near_duplicates(nothing).count() == 0


# --- mixing -----------------------------------------------------------------------------


def test_mixing(awkward, nothing):
    mixed = mix_rates(awkward)
    assert mixed.count() == awkward.count() and "size" in mixed.columns
    rows = rows_of(mixed)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    total = {r["source"]: r["source_size"] for r in rows}
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(total.values()))
    assert all(targets[s] <= 3 * total[s] + 1e-6 for s in total)
    emitted = emit_mix(awkward)
    assert emitted.columns == awkward.columns and emitted.count() == sum(r["copies"] for r in rows)
    assert Counter(r["doc_id"] for r in rows_of(emitted)) == Counter(r["doc_id"] for r in rows_of(emit_mix(awkward)))
    assert mix_rates(nothing).count() == 0


# --- sharding ---------------------------------------------------------------------------


def plain_capacity(sizes, shards):
    def needed(capacity):
        count, room = 1, capacity
        for s in sizes:
            if s > room:
                count, room = count + 1, capacity
            room -= s
        return count

    capacity = max(sizes)
    while needed(capacity) > shards:
        capacity += 1
    return capacity


def test_sharding(awkward, nothing):
    found = rows_of(sharding.shard_by_bytes(awkward, 4))
    texts = texts_of(awkward)
    groups = defaultdict(list)
    for doc_id, text in texts:
        groups[text].append(-(1 << 62) if doc_id is None else doc_id)
    ordered = sorted(groups, key=lambda t: min(groups[t]))
    capacity = plain_capacity([len(groups[t]) * (len(t.encode()) + 1) for t in ordered], 4)
    load = Counter()
    for r in found:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == capacity
    for shard in load:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    by_crc = defaultdict(set)
    for r in found:
        by_crc[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_crc.values())
    assert {r["text_crc32"] for r in found} == {zlib.crc32(t.encode()) for _, t in texts}
    assert sharding.shard_by_bytes(nothing).count() == 0


# --- packing ----------------------------------------------------------------------------


def test_packing(awkward, nothing):
    found = rows_of(pack(awkward, RANKS, 64))
    encoder = RankEncoder(RANKS)
    want = Counter()
    for doc_id, text in texts_of(awkward):
        code = encoder.encode(text) + b"\0\0\0\0"
        start, stop, piece = 0, (len(code) // 4) % 64 or 64, 0
        while start < len(code) // 4:
            want[doc_id, piece, start, stop - start, zlib.crc32(code[4 * start : 4 * stop])] += 1
            start, stop, piece = stop, stop + 64, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(nothing, RANKS).count() == 0


def test_ranks_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" ".join(words(9, 300)), "Émile  said:\n\n 'tis 12%\t ", "", " x ", "日本 語", "a <|endoftext|>\n b<|end"):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        assert RankEncoder(RANKS).encode(text) == ids.tobytes()


def test_packing_encodes_long_runs_of_whitespace(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["x" + " " * 1_100_000 + "a", "é <|endoftext|>" + "\n" * 1_500_000 + "b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows_of(pack(docs, RANKS))}
    want = {}
    for doc_id, text in enumerate(texts):
        code = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        stops = range(len(code) % 2048 or 2048, len(code) + 1, 2048)
        for piece, stop in enumerate(stops):
            start = max(0, stop - 2048) if piece else 0
            want[doc_id, piece] = (start, stop - start, zlib.crc32(code[start:stop].tobytes()))
    assert found == want


def test_plan_packing_uses_every_piece():
    histogram = np.random.default_rng(1).integers(0, 40, 129)
    histogram[0] = 0
    plan = plan_packing(histogram, 128)
    used = np.zeros(129, int)
    for lengths, repeats in plan:
        assert sum(lengths) <= 128
        for n in lengths:
            used[n] += repeats
    assert (used == histogram).all()
    # No two pieces above half of the limit share a sequence.
    assert sum(r for _, r in plan) <= 1.02 * max((histogram * np.arange(129)).sum() / 128, histogram[65:].sum())


# --- nearest vectors --------------------------------------------------------------------


def test_search_recall(spark):
    pick = np.random.default_rng(3)
    vectors = pick.normal(size=(1500, 16)) * pick.uniform(0.2, 2, (1500, 1))
    vectors[700:760] = vectors[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, rows[0][1]), (2004, [None] * 16), rows[8]]
    table = usable_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"))
    found = rows_of(search(table, table.where("vec_id % 20 = 0"), shard_vectors=400, query_block=30))
    hits = total = 0
    for i in range(0, 1500, 20):
        score = vectors @ vectors[i]
        best = [j for j in np.lexsort((np.arange(1500), -score)) if j != i][:20]
        mine = sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r["vec_id"] != i for r in mine)
        assert np.allclose([r["score"] for r in mine], [score[r["vec_id"]] for r in mine])
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 20
    assert hits / total >= 0.9
    few = usable_vectors(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert search(few, few).count() == 6
    none = usable_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert search(none, none).count() == 0


# --- quality and language ---------------------------------------------------------------


def test_quality(spark, awkward, nothing):
    good = [(i, " ".join(words(i, 60)), i) for i in range(80)]
    junk = [(i, " ".join(w + "###" for w in words(i, 60)), i) for i in range(80, 160)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    held = [r for r in rows_of(with_quality(docs, model)) if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all((r["score"] >= 0.7) == (r["doc_id"] < 80) for r in held)
    assert all(0 <= r["score"] <= 1 for r in rows_of(with_quality(awkward, model)))
    assert with_quality(nothing, fit_quality(nothing, labels)).count() == 0
    assert {r["score"] for r in rows_of(with_quality(awkward, fit_quality(nothing, labels)))} == {0.5}


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    chances = np.array([[0.2], [0.3], [0.1], [0.25], [0.15], [1e-7]])
    found = np.exp(Lattice(["ab", "b"], pieces, 2).log_likelihood(chances))
    assert found[0, 0] == pytest.approx(0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.15 * 0.1)
    assert found[1, 0] == pytest.approx(0.2 * 0.1)
    counts = Lattice(["ab"], pieces, 2).expected_counts(chances, np.array([[1.0]]))
    assert counts[3, 0] == pytest.approx(0.2 * 0.25 / found[0, 0])


def test_lattice_holds_every_piece():
    pieces = {p: i for i, p in enumerate(["▁", "a", "ab", "abc", "▁ab", "c", "bca", "𝒂b"])}
    found = ["abcab", "", "zabca", "𝒂b", "c"]
    edges = set()
    for w, word in enumerate(found):
        marked = "▁" + word
        for start in range(len(marked)):
            edges.add((start + 1, w, start, pieces.get(marked[start], len(pieces))))
            for end in range(start + 2, min(len(marked), start + 3) + 1):
                if marked[start:end] in pieces:
                    edges.add((end, w, start, pieces[marked[start:end]]))
    lattice = Lattice(found, pieces, 3)
    assert set(map(tuple, lattice.table.tolist())) == edges and len(lattice.table) == len(edges)
    assert (np.diff(lattice.table[:, 0]) >= 0).all()
    assert Lattice([], pieces, 3).log_likelihood(np.ones((9, 2))).shape == (0, 2)


def test_language(spark, awkward, nothing):
    rows = [(i, " ".join(words(i, 40)), "x") for i in range(60)]
    rows += [(i, " ".join(words(i, 40)).translate(str.maketrans("abcdefghij", "klmnopqrst")), "y") for i in range(60, 120)]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in rows_of(with_language(docs, model)))
    found = {r["doc_id"]: r["lang_pred"] for r in rows_of(with_language(awkward, model))}
    assert found[0] == found[1] == found[15] == "und" and found[3] in ("x", "y")
    assert with_language(nothing, model).count() == 0
    assert {r["lang_pred"] for r in rows_of(with_language(awkward, fit_language(nothing, PIECES)))} == {"und"}


# --- licences ---------------------------------------------------------------------------


def test_license_scan(spark, awkward, nothing):
    rows = [
        (1, "a/LICENSE", "Text.\nReleased under the MIT License.\nMore."), (2, "a/b/c/x.py", "no notice"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/x.py", "Licensed under CC BY-NC 4.0."),
        (5, "z/x.py", None), (6, None, "copyright nobody"), (7, "ab/x.py", "x"), (8, "a/b", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r["doc_id"]: (r["own_license"], r["inherited_license"], r["inherited_from"], r["license"]) for r in rows_of(license_scan(docs, F.col("path")))}
    assert found[1] == ("mit", "mit", "a", "mit")
    assert found[2] == (None, "apache-2.0", "a/b", "apache-2.0")
    assert found[4] == ("cc-by-nc-4.0", "mit", "a", "cc-by-nc-4.0")
    assert found[5] == found[6] == found[7] == (None, None, None, None)
    assert found[8] == (None, "mit", "a", "mit")
    scanned = rows_of(license_scan(awkward, F.col("source")))
    assert len(scanned) == awkward.count() and {r["license"] for r in scanned if r["doc_id"] == 14} == {"mit"}
    assert license_scan(nothing, F.col("source")).count() == 0


def test_license_scan_of_headers_and_files(spark):
    """Wrapped headers in comments, full licence files, SPDX identifiers, and versions."""
    import textwrap

    from stormframe.llm.license_headers import HEADERS
    from stormframe.llm.licenses import TEXTS

    def comment(text, first, mark, last):
        lines = [line for part in text.split("\n\n") for line in (*textwrap.wrap(part, 60), "")]
        return first + "".join(f"{mark}{line}".rstrip() + "\n" for line in lines) + last + "int main() { return 0; }\n"

    rows, want = [], []
    for license, text in HEADERS:
        holder = "Copyright 2020 Some Body\n\n" + text
        for style in (("/*\n", " * ", " */\n"), ("", "# ", ""), ("", "", "\n"), ("/*\n", "", "*/\n")):
            rows.append(comment(holder, *style))
            want.append(license)
    mit = (TEXTS / "mit.txt").read_text().replace("MIT License\n", "MIT License\n\nCopyright (c) 2021 A. Person")
    for license, text in [("mit", comment(mit, "/*\n", " * ", " */\n")), ("mit", "SPDX-License-Identifier: MIT"),
                          ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nx"),
                          ("gpl-2.0", "# SPDX-License-Identifier: GPL-2.0-only"), ("mit", "MIT License"), ("apache-2.0", "Apache License"),
                          ("mit", " ".join(mit[mit.index("Permission") :].split("\n\n")[0].split())),
                          (None, HEADERS[3][1].replace("version 2", "version 1")), (None, "We sell a licence for parking.")]:
        rows.append(text)
        want.append(license)
    paths = [f"d{i}/x.c" for i in range(len(rows))]
    for file in sorted(TEXTS.glob("*.txt")):
        text = mit if file.stem == "mit" else file.read_text()
        rows += [text, "\n".join(textwrap.fill(part, 50) for part in text.split("\n\n"))]
        want += [file.stem] * 2
        paths += [f"{file.stem}/LICENSE", f"{file.stem}/wrapped/COPYING.txt"]
    docs = spark.createDataFrame(list(zip(range(len(rows)), paths, rows, strict=True)), "doc_id long, path string, text string")
    found = {r["doc_id"]: r["license"] for r in rows_of(license_scan(docs, F.col("path")))}
    assert [(paths[i], rows[i][:80], want[i], found[i]) for i in range(len(rows)) if want[i] != found[i]] == []
