"""Windows as arrays, against the rows they are made of."""

import numpy as np
import pyarrow as pa
import pytest

from stormframe.operators.batches import as_arrays, batches_of, map_batches, numbered_batches

SCHEMA = "split string, rn long, x array<array<float>>, y float"


def samples(spark, sizes, steps=3, features=2):
    rows = [
        (split, 10 + i, [[float(100 * i + 10 * s + f) for f in range(features)] for s in range(steps)], float(i))
        for split, n in sizes.items() for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def teller():
    """A function of its own, so that it travels to the workers as it is."""
    return lambda batch: {"split": batch.keys[0], "batch": batch.keys[1], "n": len(batch.x), "first": float(batch.x[0, 0, 0]), "last": float(batch.x[-1, -1, -1]),
                          "kind": f"{batch.x.dtype} {batch.y.dtype} {batch.x.shape[1:]}"}


@pytest.mark.parametrize("arrow_rows", [10_000, 7])
def test_batches_are_whole_and_in_order(spark, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    try:
        found = map_batches(
            samples(spark, {"train": 23, "val": 4, "test": 1}), teller(),
            "split string, batch long, n long, first double, last double, kind string", size=5, by=["split"],
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {(r["split"], r["batch"]): (r["n"], r["first"], r["last"]) for r in found}
    want = {}
    for split, n in (("train", 23), ("val", 4), ("test", 1)):
        for b in range(-(-n // 5)):
            end = min(n, 5 * b + 5)
            want[split, b] = (end - 5 * b, 500.0 * b, 100.0 * (end - 1) + 21)
    assert sizes == want
    assert {r["kind"] for r in found} == {"float32 float32 (3, 2)"}


def test_arrays_share_the_memory_of_arrow():
    x = pa.array([[[1.0, 2.0]], [[3.0, 4.0]], [[5.0, 6.0]]], pa.list_(pa.list_(pa.float32())))
    rows = pa.RecordBatch.from_arrays([x, pa.array([1, 2, 3], pa.float32())], ["x", "y"])
    values = x.values.values.to_numpy()
    for part, first in ((rows, 0), (rows.slice(1, 2), 1)):
        found, y = as_arrays(part)
        assert np.shares_memory(found, values) and found.shape == (3 - first, 1, 2)
        assert found[0, 0, 0] == 1.0 + 2 * first and y[0] == 1 + first
        assert not found.flags.owndata


@pytest.mark.parametrize(
    ("x", "y"),
    [([[[1.0]], [[1.0], [2.0]]], [1.0, 2.0]), ([[[1.0]], [[1.0, 2.0]]], [1.0, 2.0]), ([[[1.0]], None], [1.0, 2.0]),
     ([[[1.0]], [[None]]], [1.0, 2.0]), ([[[1.0]], [[2.0]]], [1.0, None])],
)
def test_uneven_or_missing_samples_raise(x, y):
    rows = pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.float32()))), pa.array(y, pa.float32())], ["x", "y"])
    with pytest.raises(ValueError):
        as_arrays(rows)


def test_empty_and_bad_sizes(spark):
    empty = samples(spark, {"train": 3}).where("false")
    assert numbered_batches(empty, 4, ["split"]).count() == 0
    assert map_batches(empty, teller(), "split string", by=["split"]).count() == 0
    assert list(batches_of(iter([]), ["batch"])) == []
    with pytest.raises(ValueError, match="at least one"):
        numbered_batches(empty, 0)
    assert numbered_batches(samples(spark, {"train": 9}), 4).agg({"batch": "max"}).first()[0] == 2
