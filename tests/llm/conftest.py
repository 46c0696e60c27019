import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, size string, score string, place string"


def words(seed: int, count: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefghij", k=pick.randint(1, 6))) for _ in range(count)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, short, long, equal and nearly equal texts; null ids, repeated rows, clashing names."""
    base, passage = words(1, 120), " ".join(words(2, 60))
    near = [*base[:60], "changed", *base[61:]]
    texts = [
        None, "", "   \t\n ", "one two", "One\tTWO", " ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(),
        " ".join(words(3, 40)) + " " + passage, passage + " " + " ".join(words(4, 50)), "é" * 300, "x" * 5000,
        " ".join(words(5, 6000)), "Released under the MIT License.", "###*** 12345 !!!",
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", 1, "d", "z", "s", "p") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one two three four five six", "de", "s1", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
