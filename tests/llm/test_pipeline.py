"""The registered queries against SQL, and the pipeline stage by stage."""

import hashlib
import math
import re
from collections import Counter

import pytest
from compare import database, difference
from test_operators import plain_components

import corpus_pipeline
from __spark_entry__ import queries
from stormframe.llm.mixing import CAP, SEED, WEIGHTS
from stormframe.llm.oracle import ORACLE
from stormframe.llm.packing import RankEncoder
from stormframe.llm.quality import THRESHOLD, fit_quality
from stormframe.llm.queries import QUERIES, RANKS

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    actual = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(actual, database(FOLDER).sql(ORACLE[name]).df()) is None


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == columns
        kept.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count()
        if name != "mixing":
            assert docs.count() <= before
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name in ("exact_dedup", "near_dedup"):
            assert docs.select("text").distinct().count() == docs.count()
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.where("piece = 0").count() == before


def plain_mix(rows):
    """Copies of each ``doc_id``: shares by weight, what a capped source leaves goes to the others."""
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    turns = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(turns)}
    target, free = {}, set(total)
    while free:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in free) for s in free}
        over = {s for s in free if share[s] >= CAP * total[s]}
        if not over:
            target |= share
            break
        target |= {s: CAP * total[s] for s in over}
        free -= over
    copies = Counter()
    for r in rows:
        rate = target[r["source"]] / total[r["source"]] if total[r["source"]] else 0.0
        number = int(hashlib.md5(f"{SEED}:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        copies[r["doc_id"]] += math.floor(rate) + (number < rate - math.floor(rate))
    return +copies


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))

    def quality(rows):
        return Counter(r["doc_id"] for r in rows if model.scores([(r["text"] or "").encode()])[0] >= THRESHOLD)

    def exact(rows):
        last = {}
        for r in rows:
            last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", r["doc_id"]))
        return Counter(last.values())

    def near(rows):
        return Counter(i for i, (_, part) in plain_components((r["doc_id"], r["text"] or "") for r in rows).items() if i == part)

    plain = {"quality": quality, "exact_dedup": exact, "near_dedup": near, "mixing": plain_mix}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        whole = {r["doc_id"]: r for r in before}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = docs.collect()
        assert Counter(r["doc_id"] for r in kept) == plain[name](before), name
        assert all(r == whole[r["doc_id"]] for r in kept), name
    encoder = RankEncoder(RANKS)
    tokens = Counter()
    for r in kept:
        tokens[r["doc_id"]] += len(encoder.encode(r["text"] or "")) // 4 + 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    found = Counter()
    for r in packed:
        found[r["doc_id"]] += r["length"]
    assert found == tokens
    assert Counter(corpus_pipeline.run(spark, FOLDER).collect()) == Counter(packed)
