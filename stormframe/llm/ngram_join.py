"""Near duplicates: documents whose sets of word shingles are alike."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stormframe.llm.common import numbered, partitions, whole_text
from stormframe.llm.components import components
from stormframe.llm.shingles import blocks_of, mixed, shingle_sets
from stormframe.session import stored

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Up to so many ids (8 bytes each) are broadcast to pick documents; more are joined.
BROADCAST_IDS = 1_000_000
#: Bits of a shingle that are counted inside a bucket; the bucket stands for others.
COUNTED_BITS = 40
SEVERAL = 0xFFFF
#: Tokens of more documents are compared block by block instead of pair by pair.
SMALL_LIST = 16
BLOCK_DOCS = 256
#: Tokens of two blocks that are multiplied at once, and those put in order at once.
COLUMNS = 8192
TOKENS_AT_ONCE = 200_000

_TALLY = (
    "bucket int, block long, low binary, high binary, place binary, "
    "doc_ids binary, sizes binary, digests binary, shared binary"
)
_PROFILE = "doc_id long, n_shingles long, digest binary, shared long"
_SETS = "doc_id long, n long, tokens binary"


def _profiles(docs: DataFrame) -> DataFrame:
    """``_PROFILE`` per row: set size, digest of the set and how many shingles other rows have too.

    This is the rarest-first order in its coarsest form: a shingle that nobody else has comes
    first. Blocks of texts count their own shingles; one entry per shingle and block, five bytes
    and a place, goes to the bucket of its hash, so a shingle of a third of all rows is one entry
    per block. Buckets tell blocks which of their entries are shared. Equal counted bits of two
    shingles only let a row through that is looked at in full later.
    """
    buckets = 4 * partitions(docs)

    def count(batches):
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks_of(batches)):
            tokens, sizes = shingle_sets(texts)
            owner = np.repeat(np.arange(len(texts)), sizes)
            digests, at = [], 0
            for n in sizes:
                digests.append(hashlib.blake2b(tokens[at : at + n].tobytes(), digest_size=16).digest())
                at += n
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            alone = first & np.append(first[1:], True)
            shared = np.bincount(owner[~alone], minlength=len(texts))
            place = np.where(alone, owner, SEVERAL)[first].astype(np.uint16)
            tokens = tokens[first]
            bucket = ((tokens >> np.uint64(COUNTED_BITS)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, place = bucket[order], tokens[order], place[order]
            low = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            high = ((tokens >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(bucket))
            block = (task << 32) + k
            rows = [
                (int(bucket[s]), block, low[s:e].tobytes(), high[s:e].tobytes(), place[s:e].tobytes(), None, None, None, None)
                for s, e in zip(starts, ends, strict=True) if e > s
            ]
            known = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            rows.append((block % buckets, block, None, None, None, known.tobytes(), sizes.astype(np.int64).tobytes(),
                         b"".join(digests), shared.astype(np.int64).tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _TALLY.split(", ")])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        entries = frame[frame["low"].notna()]
        passed = frame[frame["low"].isna()]
        if not len(entries):
            return passed
        sizes = [len(p) // 2 for p in entries["place"]]
        low = np.frombuffer(b"".join(entries["low"]), np.uint32).astype(np.uint64)
        high = np.frombuffer(b"".join(entries["high"]), np.uint8).astype(np.uint64)
        place = np.frombuffer(b"".join(entries["place"]), np.uint16)
        row = np.repeat(np.arange(len(sizes)), sizes)
        value = (high << np.uint64(32)) | low
        order = np.argsort(value, kind="stable")
        value, place, row = value[order], place[order], row[order]
        same = value[1:] == value[:-1]
        shared = (np.append(False, same) | np.append(same, False)) & (place != SEVERAL)
        row, place = row[shared], place[shared]
        order = np.argsort(row, kind="stable")
        row, place = row[order], place[order]
        bounds = np.searchsorted(row, np.arange(len(sizes) + 1))
        told = pd.DataFrame({"block": entries["block"].to_numpy(), "bucket": -1})
        told["place"] = [place[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        told = told[bounds[1:] > bounds[:-1]]
        return pd.concat([passed, told]).reindex(columns=frame.columns).astype(object).where(lambda f: f.notna(), None)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        block = frame[frame["doc_ids"].notna()].iloc[0]
        ids = np.frombuffer(block["doc_ids"], np.int64)
        told = b"".join(p for p in frame["place"] if p is not None)
        shared = np.frombuffer(block["shared"], np.int64) + np.bincount(np.frombuffer(told, np.uint16), minlength=len(ids))
        digests = [block["digests"][16 * i : 16 * i + 16] for i in range(len(ids))]
        known = pd.array(ids, "Int64")
        known[ids == -(1 << 63)] = pd.NA
        return pd.DataFrame({"doc_id": known, "n_shingles": np.frombuffer(block["sizes"], np.int64), "digest": digests, "shared": shared})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    tally = rows.mapInArrow(count, _TALLY).groupBy("bucket").applyInPandas(compare, _TALLY)
    return tally.groupBy("block").applyInPandas(gather, _PROFILE)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``_SETS`` of the documents in ``ids(doc_id)``, stored."""

    def sets(batches):
        for ids_of, texts in blocks_of(batches):
            tokens, sizes = shingle_sets(texts)
            ends = np.cumsum(sizes)
            parts = [tokens[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "n", "tokens"]
            )

    def compared(found: DataFrame) -> DataFrame:
        """One set per id: of several texts with one id that with the least set, so that reruns agree."""
        return found.groupBy("doc_id").agg(F.min(F.struct("n", "tokens")).alias("set")).select("doc_id", "set.*")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    few = ids.count() <= BROADCAST_IDS
    picked = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return stored(compared(picked.mapInArrow(sets, _SETS)), "sets")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(token, doc_id, n, first, second)``, stored: prefix tokens under each order.

    The first order puts rarer tokens first, the second goes by a hash alone, so the two have little in
    common. Under either, a set's prefix has as many tokens as must hold one of the overlap with any
    partner. Tokens of one set alone can be no overlap: they stand at the front of the first order,
    where they and their room are left out, and are not written for the second.
    """

    def tokens_of(batches):
        for batch in batches:
            size = batch.column("n").to_numpy()
            # About TOKENS_AT_ONCE tokens are ordered together.
            group = np.cumsum(size) // TOKENS_AT_ONCE
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group)) + 1):
                if len(rows):
                    yield ordered(batch.slice(rows[0], len(rows)))

    def ordered(batch):
        sizes = batch.column("n").to_numpy()
        values = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((mixed(values.view(np.uint64)), owner))
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owner[order]]
        n = sizes[owner]
        second = rank <= n - (n * percent + 99) // 100
        ids = batch.column("doc_id").to_numpy()[owner]
        return pa.RecordBatch.from_arrays(
            [pa.array(values), pa.array(second), pa.array(ids), pa.array(n)], ["token", "second", "doc_id", "n"]
        )

    rows = sets.mapInArrow(tokens_of, "token long, second boolean, doc_id long, n long")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_doc = Window.partitionBy("doc_id")
    kept = F.floor((F.col("n") * percent + 99) / 100)
    # The n - kept + 1 first tokens, less those of this set alone.
    room = F.count(F.lit(1)).over(by_doc) - kept + 1
    ranked = rows.join(often, "token").select(
        "token", "doc_id", "n", "second", (F.row_number().over(by_doc.orderBy("df", "token")) <= room).alias("first")
    )
    return stored(ranked.where("first or second"), "prefixes")


def _verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, stored.

    Pairs were found by prefix tokens of the first order. They must share one of the second, too,
    before their sets are fetched and compared in full.
    """
    second = prefixes.where("second").groupBy("doc_id").agg(F.collect_list("token").alias("tokens"))
    second = stored(second, "second")
    for side in ("a", "b"):
        pairs = pairs.join(second.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"prefix_{side}")), side)
    likely = stored(pairs.where(F.arrays_overlap("prefix_a", "prefix_b")).select("a", "b"), "likely")

    def link(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    full = likely
    for side in ("a", "b"):
        full = full.join(sets.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    return stored(full.select("a", "b", "tokens_a", "tokens_b").mapInArrow(link, "a long, b long"), "links")


def _short_list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of documents in different parts that share a token of few documents."""
    left = rows.select("token", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"))
    right = rows.select("token", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"))
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    apart = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & sizes
    return left.join(right, "token").where(apart).select("a", "b").distinct()


def _long_list_links(
    rows: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int, every: bool = False
) -> DataFrame:
    """``(a, b)``, stored: links between parts among documents that share a token of many.

    Documents are put in blocks of ``BLOCK_DOCS``, those with one centre and of like size
    together. Two blocks meet if a token's list has documents of both whose sizes may link. A task
    holds two blocks; it hands on no pairs, only links that join parts still apart in it, or
    ``every`` link.
    """
    docs = rows.groupBy("doc_id").agg(
        F.min("centre").alias("centre"), F.first("n").alias("n"), F.first("part").alias("part")
    )
    placed = numbered(stored(docs, "open_docs"), ["centre", "n", "doc_id"], "place")
    placed = placed.select("doc_id", "n", "part", F.expr(f"place div {BLOCK_DOCS}").alias("block"))
    lists = rows.select("token", "doc_id").join(placed, "doc_id").groupBy("token", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("lo"), F.max("part").alias("hi")
    )
    lists = stored(lists, "lists")
    other = lists.select("token", *(F.col(c).alias(f"{c}_2") for c in lists.columns[1:]))
    meet = (
        (F.col("block") <= F.col("block_2"))
        & ((F.col("lo") != F.col("hi_2")) | (F.col("hi") != F.col("lo_2")))
        & (F.col("most") * 100 >= F.col("least_2") * percent)
        & (F.col("most_2") * 100 >= F.col("least") * percent)
    )
    meetings = stored(lists.join(other, "token").where(meet).select("block", "block_2").distinct(), "meetings")
    prefix = prefixes.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("first"), F.col("token"))).alias("first"),
        F.collect_list(F.when(F.col("second"), F.col("token"))).alias("second"),
    )
    full = stored(placed.join(prefix, "doc_id").join(sets.select("doc_id", "tokens"), "doc_id"), "open_sets")
    sides = meetings.select("block", "block_2", F.explode(F.array_distinct(F.array("block", "block_2"))).alias("side"))
    held = sides.join(full.withColumnRenamed("block", "side"), "side")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        inner = frame["block"].iloc[0] == frame["block_2"].iloc[0]
        one = frame if inner else frame[frame["side"] == frame["block"]]
        two = frame if inner else frame[frame["side"] == frame["block_2"]]
        maybe = np.ones((len(one), len(two)), bool)
        for order in ("first", "second"):
            maybe &= _overlaps([np.asarray(v) for v in one[order]], [np.asarray(v) for v in two[order]]) > 0
        part_1, part_2 = one["part"].to_numpy(), two["part"].to_numpy()
        maybe &= part_1[:, None] != part_2[None, :]
        found = []
        if maybe.any():
            both = _overlaps(*([np.frombuffer(t, np.int64) for t in side["tokens"]] for side in (one, two)))
            union = one["n"].to_numpy()[:, None] + two["n"].to_numpy()[None, :] - both
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for i, j in zip(*np.nonzero(maybe & (100 * both >= percent * union)), strict=True):
                if every:
                    a, b = sorted((int(one["doc_id"].iloc[i]), int(two["doc_id"].iloc[j])))
                    if not inner or i < j:
                        found.append((a, b))
                    continue
                x, y = root(int(part_1[i])), root(int(part_2[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((int(one["doc_id"].iloc[i]), int(two["doc_id"].iloc[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return stored(held.groupBy("block", "block_2").applyInPandas(compare, "a long, b long"), "block_links")


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each set of ``one`` with each of ``two``, some thousand tokens at a time."""
    owner_1, owner_2 = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (one, two))
    values_1, values_2 = (np.concatenate(s) if len(s) else np.zeros(0, np.int64) for s in (one, two))
    common = np.intersect1d(values_1, values_2)
    out = np.zeros((len(one), len(two)), np.int64)
    places = []
    for values, owner in ((values_1, owner_1), (values_2, owner_2)):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for start in range(0, len(common), COLUMNS):
        tables = []
        for (at, owner), rows in zip(places, (len(one), len(two)), strict=True):
            cut = slice(*np.searchsorted(at, [start, start + COLUMNS]))
            table = np.zeros((rows, min(COLUMNS, len(common) - start)), np.float32)
            table[owner[cut], at[cut] - start] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _alike(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows that may link, rows that cannot, classes of equal sets with their smallest id, and those ids' sets."""
    profile = stored(_profiles(docs), "profiles")
    kept = F.floor((F.col("n_shingles") * percent + 99) / 100)
    may = (F.col("n_shingles") > 0) & (F.col("shared") >= kept) & F.col("doc_id").isNotNull()
    alive = profile.where(may)
    classes = stored(alive.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    sets = _sets(docs, classes.select(F.col("class_id").alias("doc_id")))
    return alive, profile.where(~F.coalesce(may, F.lit(False))), classes, sets


def near_pairs(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links between classes of equal sets, and which rows are in which class.

    Returns ``(a, b)``, class ids with ``a < b``, each pair once; and ``(doc_id, n_shingles, class_id,
    n_links)`` for each row, where ``n_links`` counts the other rows it links with, equal ones
    included. A class id is the smallest ``doc_id`` of the class. Rows with a null ``doc_id`` or without
    words link with nothing; rows that share an id are one document, as ``near_duplicates`` has it.
    """
    alive, alone, classes, sets = _alike(docs, percent)
    prefixes = _prefixes(sets, percent)
    first = prefixes.where("first").select("token", "doc_id", "n", F.col("doc_id").alias("part"))
    lists = first.groupBy("token").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = first.join(lists.select("token", "centre", (F.col("df") > SMALL_LIST).alias("long_list")), "token")
    rows = stored(rows, "lists_of_tokens")
    few = _verified(_short_list_pairs(rows.where("not long_list"), percent), prefixes, sets, percent)
    many = _long_list_links(rows.where("long_list"), prefixes, sets, percent, every=True)
    pairs = stored(few.unionByName(many).distinct(), "pairs")

    members = alive.select("doc_id", "n_shingles", "digest").join(classes, "digest").drop("digest")
    members = stored(members, "members")
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("rows"))
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    linked = pairs.unionByName(turned).join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(F.sum("rows").alias("others"))
    links = sizes.join(linked.withColumnRenamed("a", "class_id"), "class_id", "left").select(
        "class_id", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    nothing = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return pairs, members.join(links, "class_id").select("doc_id", "n_shingles", "class_id", "n_links").unionByName(nothing)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Components are those of the link graph; ``component_id`` is the smallest ``doc_id`` in it.
    Rows with equal sets are one class, and classes are compared by their smallest id. A token's
    classes are first all paired with the smallest of them. Classes that are still apart are then
    compared from the same prefixes: pair by pair where a token has few, and in pairs of blocks
    where it has many, so a group of k classes costs about k rows, and no link between parts is
    lost. Rows without words, null texts included, have no shingles and stand alone. A
    null ``doc_id`` takes part in nothing and stays alone. Rows that share an id are one document: if
    their texts differ, the one with the least set is compared, and the others follow it. Other
    columns are ignored.
    """
    alive, alone, classes, sets = _alike(docs, percent)
    prefixes = _prefixes(sets, percent)
    first = prefixes.where("first")
    centre = first.groupBy("token").agg(F.min("doc_id").alias("a"))
    stars = first.join(centre, "token").where("doc_id != a")
    stars = stars.select("a", F.col("doc_id").alias("b")).distinct()
    links = _verified(stars, prefixes, sets, percent)
    joined = stored(components(links), "joined")

    place = joined.withColumnRenamed("component_id", "part")
    apart = first.join(place, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    apart = stored(apart.select("token", "doc_id", "n", "part"), "apart")
    spread = apart.groupBy("token").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("df")
    )
    spread = spread.where("lo < hi").select("token", "centre", (F.col("df") > SMALL_LIST).alias("long_list"))
    open_rows = stored(apart.join(spread, "token"), "open")
    few = _short_list_pairs(open_rows.where("not long_list"), percent)
    more = _verified(few, prefixes, sets, percent)
    many = _long_list_links(open_rows.where("long_list"), prefixes, sets, percent)
    linked = components(links.unionByName(more).unionByName(many))

    by_class = classes.join(linked.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    by_class = by_class.select("digest", F.coalesce("component_id", "class_id").alias("component_id"))
    members = alive.select("doc_id", "n_shingles", "digest").join(by_class, "digest").drop("digest")
    return members.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows with a null ``doc_id`` stay.
    """
    found = near_duplicates(docs, percent)
    dropped = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
