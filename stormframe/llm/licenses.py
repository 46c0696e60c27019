"""License notices by TF-IDF cosine, and licences that directories pass down."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.llm.common import join_groups, sha256, whole_text
from stormframe.llm.license_headers import HEADERS, TITLES
from stormframe.session import stored

# Usual wordings of public licence notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the Apache License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("mpl-2.0", "This source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "Released into the public domain under CC0 1.0."),
]
#: A sentence with one of these may be a notice.
CUES = ["licen", "copyright", "spdx", "permission is hereby", "redistribution and use", "public domain"]
THRESHOLD = 0.7
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: The same for Java, whose regular expressions recurse into a repeated group unless it is possessive. Here and
#: below a repeated group is always followed by what it cannot hold, so giving nothing back changes no match.
JAVA_TERM = TERM.replace(")*", ")*+")
LICENSE_FILE = r"^(?:licen[sc]e|copying|notice|unlicense)(?:[.-].*)?$"
#: Full texts, named by their licence.
TEXTS = Path(__file__).with_name("license_texts")
MARK = r"""(?:/\*+!?|\*+/?|//+!?|#+!?|--+>?|;+|%+|<!--|\"\"\"|'''|dnl\b|rem\b)"""
#: The end of a comment at the end of a line. Runs of blanks and stars are tried from their first sign only.
COMMENT_END = r"(?m)(?:(?<![ \t])[ \t]++(?:\*++/|-->)|(?<!\*)\*++/|-->)[ \t]*+$"
#: Lines that name a holder, not a licence.
HOLDER = r"(?m)^[ \t]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|\[|<)|\(c\)|©).*|all rights reserved\.?[ \t]*)$"
VERSION = r"(?:\bv(?:ersion|\.)?|\bcc[ -]by(?:-[a-z]{2})*+|\battribution(?:-[a-z]+)*+|\bcc0)[ ,\n-]*+([0-9]+(?:\.[0-9]+)?)"
NAME = r"\bgnu (?:[a-z]+ )?general public|\battribution(?:-[a-z]+)*+|\bcc[ -]by(?:-[a-z]{2})*+"
#: What ``NAME`` finds first in texts of licences whose wordings are close.
NAMES = {
    "gpl": ["gnu general public"],
    "lgpl": ["gnu lesser general public"],
    "agpl": ["gnu affero general public"],
    "cc-by": ["attribution", "cc by", "cc-by"],
    "cc-by-sa": ["attribution-sharealike", "cc by-sa", "cc-by-sa"],
    "cc-by-nc": ["attribution-noncommercial", "cc by-nc", "cc-by-nc"],
}
SPDX = "spdx-license-identifier:"


def _has_cue(text: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(text, F.lit(cue))
    return found


def notice_sentences(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentence)``: lower-case sentences of whole texts that hold a cue."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text()).alias("text"))
    lines = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    rows = rows.where(_has_cue(F.col("text"))).select("doc_id", F.explode(lines).alias("sentence"))
    return rows.where(_has_cue(F.col("sentence")))


def _unmarked(text: Column) -> Column:
    """Lower-case text without comment marks and holders; an empty line where a block ends.

    A comment and what is not one are separate blocks; an empty line inside a comment ends none.
    """
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, rf"(?m)^[ \t]*{MARK}[ \t]*", "\x01")
    text = F.regexp_replace(text, COMMENT_END, "")
    text = F.regexp_replace(text, r"(?m)^(\x01.*)\n(?!\x01)", "$1\n\n")
    text = F.regexp_replace(text, r"(?m)^((?!\x01).*)\n(?=\x01)", "$1\n\n")
    text = F.regexp_replace(text, r"\n[ \t]*(?=\n)", "\n")
    return F.regexp_replace(F.regexp_replace(text, "(?m)^\x01[ \t]*", " "), HOLDER, " ")


def _joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def notice_units(docs: DataFrame, path: Column) -> DataFrame:
    """``(doc_id, file, unit)``: header blocks, their sentences, and licence files as a whole.

    Lines are joined across wraps. ``file`` is true of whole files named like a licence file.
    """
    named = F.rlike(F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)), F.lit(LICENSE_FILE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("named"), F.lower(whole_text()).alias("text"))
    rows = rows.where(_has_cue(F.col("text"))).withColumn("text", _unmarked(F.col("text")))
    files = rows.where("named").select("doc_id", F.lit(True).alias("file"), _joined(F.col("text")).alias("unit"))
    blocks = rows.select("doc_id", F.explode(F.split("text", r"\n(?: *+\n)++")).alias("block"))
    blocks = blocks.where(_has_cue(F.col("block"))).select("doc_id", _joined(F.col("block")).alias("block"))
    sentences = F.split(F.regexp_replace("block", r"([.!?]) ", "$1\n"), "\n")
    units = F.explode(F.array_distinct(F.array_append(sentences, F.col("block"))))
    parts = blocks.select("doc_id", F.lit(False).alias("file"), units.alias("unit"))
    return files.unionByName(parts).where(_has_cue(F.col("unit")))


def spdx_licenses(docs: DataFrame, licenses: list[str]) -> DataFrame:
    """``(doc_id, license)`` of SPDX identifiers, each name of an expression apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(whole_text()).alias("text"))
    rows = rows.where(F.contains("text", F.lit(SPDX)))
    lines = F.explode(F.regexp_extract_all("text", F.lit(SPDX + r"[ \t]*([^\r\n]*)"), F.lit(1))).alias("line")
    names = F.explode(F.regexp_extract_all("line", F.lit(r"[a-z0-9][a-z0-9.+-]*"), F.lit(0))).alias("name")
    known = rows.select("doc_id", lines).select("doc_id", names)
    known = known.select("doc_id", F.regexp_replace("name", r"(?:-only|-or-later|\+)$", "").alias("license"))
    return known.where(F.col("license").isin(licenses)).distinct()


def _terms(rows: DataFrame, key: str) -> DataFrame:
    term = F.explode(F.regexp_extract_all(key, F.lit(JAVA_TERM), F.lit(0))).alias("term")
    return rows.select(key, term).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _weighted(terms: DataFrame, idf: DataFrame, total: int, key: str) -> DataFrame:
    rare = F.coalesce(F.col("idf"), F.log(F.lit(1.0 + total)) + 1.0)
    rows = terms.join(idf, "term", "left").withColumn("weight", F.col("tf") * rare)
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rows.select(key, "term", "weight").join(norms, key)


def match_templates(sentences: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(sentence, n, license, similarity)`` of each distinct sentence near a template, stored.

    ``sentences`` has one row per occurrence. Equal sentences are counted first and compared once.
    Document frequencies count every occurrence in the corpus. Of equally near licences the first
    in alphabetical order is taken. Templates number a few, so they are broadcast.
    """
    counted = stored(sentences.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")), "sentences")
    total = counted.agg(F.sum("n")).first()[0] or 0
    terms = stored(_terms(counted, "sentence"), "terms")
    frequency = terms.join(counted, "sentence").groupBy("term").agg(F.sum("n").alias("df"))
    idf = frequency.select("term", (F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = stored(idf, "idf")
    lowered = templates.select("license", F.lower("text").alias("template"))
    wanted = _weighted(_terms(lowered.select("template").distinct(), "template"), idf, total, "template")
    wanted = wanted.join(lowered.distinct(), "template").select(
        "template", "license", "term", F.col("weight").alias("t_weight"), F.col("norm").alias("t_norm")
    )
    products = (
        _weighted(terms, idf, total, "sentence").join(F.broadcast(wanted), "term")
        .groupBy("sentence", "license", "template")
        .agg((F.sum(F.col("weight") * F.col("t_weight")) / (F.first("norm") * F.first("t_norm"))).alias("cosine"))
    )
    best = products.groupBy("sentence").agg(
        F.max(F.struct(F.round("cosine", 9).alias("cosine"), _descending("license"))).alias("best")
    )
    best = best.where(F.col("best.cosine") >= threshold).select(
        "sentence", F.col("best.cosine").alias("similarity"), F.col("best.license").alias("license")
    )
    return stored(best.join(counted, "sentence"), "matches")


def _version(text: Column) -> Column:
    """The first version a text states, without ``.0``; empty if none."""
    return F.regexp_replace(F.regexp_extract(text, VERSION, 1), r"\.0$", "")


def _family(license: Column) -> Column:
    return F.regexp_replace(license, r"-[0-9.]+$", "")


def _agrees(text: Column, license: Column) -> Column:
    """Whether the first version and name that a text states, if any, are those of ``license``."""
    version, own = _version(text), F.regexp_replace(F.regexp_extract(license, r"-([0-9.]+)$", 1), r"\.0$", "")
    agrees = (version == "") | (own == "") | (version == own)
    name = F.regexp_extract(text, NAME, 0)
    for family, names in NAMES.items():
        agrees = agrees & ((_family(license) != family) | (name == "") | name.isin(names))
    return agrees


def match_whole(units: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(digest, n, license, similarity)`` of each distinct ``unit`` near a whole template, stored.

    ``units`` has ``digest`` and ``unit``. Document frequencies are those of the templates. A
    template is not taken for a text that states another version or name, nor for one that states
    no version if the templates hold several. Templates number a few, so they are broadcast.
    """
    counted = units.groupBy("digest").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "units")
    texts = templates.select("license", F.lower("text").alias("template"), _family(F.col("license")).alias("family")).distinct()
    several = texts.groupBy("family").agg((F.count_distinct("license") > 1).alias("several"))
    texts = stored(texts.join(several, "family"), "templates")
    template_terms = stored(_terms(texts.select("template").distinct(), "template"), "template_terms")
    total = texts.select("template").distinct().count()
    frequency = template_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stored(frequency.select("term", (F.log(F.lit(1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    wanted = _weighted(template_terms, idf, total, "template").join(texts, "template").select(
        F.xxhash64("template", "license").alias("template"), "license", "several", "term",
        F.col("weight").alias("t_weight"), F.col("norm").alias("t_norm"),
    )
    term = F.explode(F.regexp_extract_all("unit", F.lit(JAVA_TERM), F.lit(0))).alias("term")
    terms = counted.select("digest", term).groupBy("digest", "term").agg(F.count(F.lit(1)).alias("tf"))
    products = (
        _weighted(stored(terms, "terms"), idf, total, "digest").join(F.broadcast(wanted), "term")
        .groupBy("digest", "license", "several", "template")
        .agg((F.sum(F.col("weight") * F.col("t_weight")) / (F.first("norm") * F.first("t_norm"))).alias("cosine"))
    )
    near = products.where(F.round("cosine", 9) >= threshold).join(counted, "digest")
    near = near.where(_agrees(F.col("unit"), F.col("license")) & (~F.col("several") | (_version(F.col("unit")) != "")))
    best = near.groupBy("digest", "n").agg(
        F.max(F.struct(F.round("cosine", 9).alias("cosine"), _descending("license"))).alias("best")
    )
    return stored(best.select("digest", "n", F.col("best.cosine").alias("similarity"), F.col("best.license").alias("license")), "whole")


def _descending(name: str) -> Column:
    """A pair that is larger the earlier ``name`` stands in alphabetical order."""
    flipped = F.translate(name, "abcdefghijklmnopqrstuvwxyz0123456789-.", "zyxwvutsrqponmlkjihgfedcba9876543210/,")
    return F.struct(flipped.alias("flipped"), F.col(name).alias("name")).alias("license")


def directory(path: str) -> Column:
    """The directory of a path, without a slash at its end; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def license_scan(docs: DataFrame, path: Column, templates: DataFrame | None = None) -> DataFrame:
    """Licence of each row of ``docs``: its own notice, else that of the nearest directory above.

    Returns ``(doc_id, path, own_license, similarity, inherited_license, inherited_from, license)``.
    A file's own licence is that of its sentence, header block or SPDX identifier nearest to a
    template; a licence file that is near a template as a whole has that licence. A directory's licence comes
    from files there named like a licence file that have one of their own, from the smallest
    ``doc_id`` of them. The nearest directory at or above a file passes its licence down;
    ``inherited_from`` is that directory and is given for files with an own licence too. Null texts
    have no notice, a null path lies in the top directory, rows that share a ``doc_id`` share their
    notices, a row without one has no notice of its own and passes none down, and empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    whole = whole_templates(spark) if templates is None else templates
    templates = default_templates(spark) if templates is None else templates
    found = stored(notice_sentences(docs), "notices")
    matched = match_templates(found.select("sentence"), templates)
    matched = matched.where(_agrees(F.col("sentence"), F.col("license.name")))
    # Common notices are groups of any size; they are told apart before they are joined.
    own = join_groups(found, matched, "sentence", "n").where(F.col("license").isNotNull())
    own = own.select("doc_id", F.lit(False).alias("file"), "similarity", "license")
    units = stored(notice_units(docs, path).withColumn("digest", sha256(F.col("unit"))), "blocks")
    matched = match_whole(units, whole)
    near = join_groups(units.drop("unit"), matched, "digest", "n").where(F.col("license").isNotNull())
    named = spdx_licenses(docs, [r["license"] for r in whole.select("license").distinct().collect()])
    named = named.select("doc_id", F.lit(False).alias("file"), F.lit(1.0).alias("similarity"), _descending("license"))
    own = own.unionByName(near.select(own.columns)).unionByName(named)
    own = own.groupBy("doc_id").agg(
        F.max(F.struct("file", "similarity", F.col("license.flipped"), F.col("license.name"))).alias("own")
    )
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"))
    files = files.join(own, "doc_id", "left").select(
        "doc_id", "path", directory("path").alias("directory"),
        F.col("own.name").alias("own_license"), F.col("own.similarity").alias("similarity"),
    )
    files = stored(files, "files")
    named = F.rlike(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.lit(LICENSE_FILE))
    given = files.where(named & F.col("own_license").isNotNull()).groupBy("directory").agg(
        F.min(F.struct("doc_id", "own_license")).alias("first")
    )
    given = given.select(F.col("directory").alias("above"), F.col("first.own_license").alias("inherited_license"))
    # Only distinct directories climb the tree, not the files in them.
    folders = files.groupBy("directory").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    climbed = folders.select("directory", F.explode(F.array_distinct(above)).alias("above"))
    # The top directory stands above all others; how many a directory stands above is counted first.
    below = stored(climbed.groupBy("above").agg(F.count(F.lit(1)).alias("below")).join(given, "above"), "given")
    met = join_groups(climbed, below, "above", "below").where(F.col("inherited_license").isNotNull())
    nearest = met.groupBy("directory").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "inherited_license")).alias("near")
    )
    passed = folders.join(nearest, "directory", "left").select(
        "directory", "n", F.col("near.inherited_license").alias("inherited_license"),
        F.col("near.above").alias("inherited_from"),
    )
    joined = join_groups(files, stored(passed, "passed"), "directory", "n")
    return joined.select(
        "doc_id", "path", "own_license", "similarity", "inherited_license", "inherited_from",
        F.coalesce("own_license", "inherited_license").alias("license"),
    )


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def whole_templates(spark: SparkSession) -> DataFrame:
    """Titles, headers, their first paragraphs and full texts, and the notices."""
    texts = [(p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt"))]
    heads = [(license, text.split("\n\n")[0]) for license, text in HEADERS]
    # A licence without a header of its own is put whole, or by its grant, above the code.
    grants = [(name, part) for name, text in texts if name in ("mit", "bsd-3-clause")
              for part in text.split("\n\n") if re.match("Permission is hereby|Redistribution and use", part)]
    return spark.createDataFrame([*TEMPLATES, *TITLES, *HEADERS, *heads, *texts, *grants], "license string, text string")
