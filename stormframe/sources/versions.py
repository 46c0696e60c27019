"""Tables that are replaced in one step, on storage that only knows files.

A write goes to a folder of its own, ``version=<n>``. It counts from the moment its pointer,
``_versions/<n>.json``, is there, which is one small file, written last. A run that dies before that leaves the
earlier version as it was; the next run removes what it left. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from stormframe.sources.files import Storage

#: Versions that stay: the current one, and the one that running readers may still use.
KEPT = 2
_POINTERS, _VERSION = "_versions", "version"


class Versions:
    """The versions of what lies in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.storage = spark, folder.rstrip("/"), Storage(spark)

    def _numbers(self) -> list[int]:
        names = self.storage.names(f"{self.folder}/{_POINTERS}")
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")]

    def exists(self) -> bool:
        return bool(self._numbers())

    def _pointer(self, number: int) -> str:
        return f"{self.folder}/{_POINTERS}/{number:09d}.json"

    def place(self, number: int) -> str:
        return f"{self.folder}/{_VERSION}={number}"

    def parts(self, number: int | None = None) -> dict[str, list[int]]:
        """Which versions hold each part; the only part of a whole table is the empty name."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no version in {self.folder}")
        return json.loads(self.storage.read(self._pointer(numbers[-1] if number is None else number)))

    def current(self) -> str:
        """The folder of the current version, for a version that was written as a whole."""
        return self.place(self.parts()[""][0])

    def replace(self, write: Callable[[str], object]) -> str:
        """Let ``write`` fill a new folder, and make it the current version."""
        number = self._begin()
        write(self.place(number))
        self._commit(number, {"": [number]})
        return self.place(number)

    def replace_parts(self, df: DataFrame, by: Sequence[str], append: bool = False, **options: str) -> bool:
        """Make the partitions of ``df`` replace those of the same values; the others stay.

        ``append`` puts them beside those instead. Returns whether ``df`` had any row.
        """
        number = self._begin()
        df.write.options(**options).partitionBy(*by).parquet(self.place(number))
        found = [""]
        for _ in by:
            found = [
                f"{part}/{name}".lstrip("/")
                for part in found
                for name in self.storage.names(f"{self.place(number)}/{part}") if "=" in name
            ]
        if not found:
            self.storage.remove(self.place(number))
            return False
        parts = self.parts() if self.exists() else {}
        self._commit(number, parts | {part: [*(parts.get(part, []) if append else []), number] for part in found})
        return True

    def read_parts(self) -> DataFrame:
        """All partitions, each from the versions that hold it."""
        places = [f"{self.place(number)}/{part}" for part, numbers in self.parts().items() for number in numbers]
        return self.spark.read.option("basePath", self.folder).parquet(*places).drop(_VERSION)

    def _begin(self) -> int:
        number = max(self._numbers(), default=0) + 1
        self.storage.remove(self.place(number))
        return number

    def _commit(self, number: int, parts: dict[str, int]) -> None:
        self.storage.publish(self._pointer(number), json.dumps(parts))
        numbers = self._numbers()
        used = {f"{_VERSION}={v}" for n in numbers[-KEPT:] for held in self.parts(n).values() for v in held}
        for n in numbers[:-KEPT]:
            self.storage.remove(self._pointer(n))
        for name in self.storage.names(self.folder):
            if name.startswith(f"{_VERSION}=") and name not in used:
                self.storage.remove(f"{self.folder}/{name}")


def latest(spark: SparkSession, folder: str) -> str:
    """The folder of the current version of a whole that was replaced as one."""
    return Versions(spark, folder).current()


def write_whole(df: DataFrame, path: str) -> None:
    """Replace a table; readers see the old one until the new one is complete."""
    Versions(df.sparkSession, path).replace(df.write.parquet)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """A table that was replaced as one; a folder without versions is read as it is."""
    versions = Versions(spark, path)
    return spark.read.parquet(versions.current() if versions.exists() else path)


def write_parts(df: DataFrame, path: str, by: Sequence[str], append: bool = False, **options: str) -> bool:
    """Replace the partitions that ``df`` has; readers see all old ones until all new ones are complete."""
    return Versions(df.sparkSession, path).replace_parts(df, by, append, **options)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A table of parts; a folder without versions, like a table inside one, is read as it is."""
    versions = Versions(spark, path)
    return versions.read_parts() if versions.exists() else spark.read.parquet(path)
