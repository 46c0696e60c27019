"""Incremental ingest of landed files, with a ledger that tells what became of each.

The file source of Structured Streaming lists new files and keeps in its checkpoint which ones it has
handed on. A batch is a bounded list of files; their lines are read by one Spark job. A file that
cannot be read, or that holds no observation, is rejected with the reason and does not hold up the
others; it is tried again once it has changed.

A batch becomes visible by one small file, ``ledger/<batch>.json``: it lists the batch's files and
names the folder of their rows, and is written last. A batch that died before that has left nothing
that a reader sees, and its repetition starts over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import batched
from typing import NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.sources.files import Storage
from stormframe.sources.fixed_width import FILE_BITS, numbered_lines, parse_lines

TAKEN, REJECTED, VANISHED = "taken", "rejected", "vanished"
LEDGER = (
    "batch string, file long, path string, size long, modified_ms long, "
    "status string, reason string, n_rows long, folder string"
)
# Fixed values of Spark's binary file source.
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
#: How much of an error's text the ledger keeps.
REASON_CHARS = 500
_GLOB_SIGNS = re.compile(r"([\\\[\]{}*?])")


class Landed(NamedTuple):
    """One file: its name as Spark reads it and as row metadata spells it, and its state."""

    path: str
    url: str
    size: int
    modified_ms: int


def _states(files: DataFrame) -> DataFrame:
    """Columns of ``Landed``; the content is not read."""
    return files.select(
        "path", F.col("_metadata.file_path").alias("url"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("modified_ms"),
    )


def landed_files(spark: SparkSession, folder: str, name_glob: str = "*.dat", files_per_batch: int = 1000) -> DataFrame:
    """Stream of new files, or parts of yearly folders."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES)
    reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return _states(reader.load(f"{folder}/{name_glob}"))


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """``LEDGER`` rows of all batches, also of files that were tried several times."""
    if not Storage(spark).names(f"{table}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{table}/ledger")


def file_states(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of the ledger per file."""
    rows = read_ledger(spark, table)
    return rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "file").alias("last")).select("last.*")


def read_landed(spark: SparkSession, table: str) -> DataFrame:
    """Observations of all batches in the ledger."""
    folders = [
        r["folder"] for r in read_ledger(spark, table).where("n_rows > 0").select("folder").distinct().collect()
    ]
    if not folders:
        raise FileNotFoundError(f"no file has been taken into {table}")
    places = [f"{table}/{folder}" for folder in folders]
    return spark.read.option("basePath", f"{table}/data").parquet(*places).drop("batch")


class Ingest:
    """Takes batches of landed files into ``table``."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table, self.storage = spark, table, Storage(spark)

    def take(self, files: list[Landed]) -> None:
        """Read the files and commit their rows and ledger entries.

        Files that the ledger has as taken, or as rejected in this very state, are left alone, so a
        repeated batch does nothing. The batch is named after its first file's number.
        """
        files = self._undecided(files)
        if not files:
            return
        first = (read_ledger(self.spark, self.table).agg(F.max("file")).first()[0] or 0) + 1
        batch = f"{first:012d}"
        numbers = {f.url: first + i for i, f in enumerate(files)}
        folder = f"data/batch={batch}"
        good, lost = self._written(files, numbers, f"{self.table}/{folder}")
        counts = self._rows_per_file(f"{self.table}/{folder}") if good else {}
        silent = [f for f in good if not counts.get(numbers[f.url])]
        lines = self._line_counts(silent)
        entries = []
        for f in files:
            rows = counts.get(numbers[f.url], 0)
            if f.url in lost:
                status, reason = lost[f.url]
            elif rows:
                status, reason = TAKEN, None
            else:
                status, reason = REJECTED, f"no observation in {lines.get(f.url, 0)} lines"
            entries.append({
                "batch": batch, "file": numbers[f.url], "path": f.path, "size": f.size, "modified_ms": f.modified_ms,
                "status": status, "reason": reason, "n_rows": rows, "folder": folder if rows else None,
            })
        self.storage.publish(f"{self.table}/ledger/{batch}.json", "".join(json.dumps(e) + "\n" for e in entries))

    def _undecided(self, files: list[Landed]) -> list[Landed]:
        these = self.spark.createDataFrame([(f.path,) for f in files] or [("",)], "path string")
        known = file_states(self.spark, self.table).join(F.broadcast(these), "path").collect()  # one row per file
        states = {r["path"]: r for r in known}

        def decided(f: Landed) -> bool:
            row = states.get(f.path)
            return row is not None and (
                row["status"] == TAKEN
                or (row["status"] == REJECTED and (row["size"], row["modified_ms"]) == (f.size, f.modified_ms))
            )

        return [f for f in files if not decided(f)]

    def _written(self, files: list[Landed], numbers: dict[str, int], folder: str):
        """Write the observations of all files that can be read, and tell why the others cannot.

        The error of a failed read names its file. Any other error is raised: it says nothing about
        the files, and the batch has to be run again.
        """
        good, lost = list(files), {}
        while good:
            try:
                self._observations(good, numbers).write.mode("overwrite").partitionBy("year").parquet(folder)
                break
            except (PySparkException, Py4JJavaError) as error:
                named = unreadable(error, good)
                if not named:
                    raise
                good = [f for f in good if f.url not in named]
                lost |= named
        return good, lost

    def _lines(self, files: list[Landed]) -> DataFrame:
        return self.spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").text(
            [_GLOB_SIGNS.sub(r"\\\1", f.path) for f in files]
        )

    def _observations(self, files: list[Landed], numbers: dict[str, int]) -> DataFrame:
        known = self.spark.createDataFrame([(url, n) for url, n in numbers.items()], "url string, file long")
        lines = numbered_lines(self._lines(files), F.broadcast(known))  # one row per file of the batch
        return parse_lines(lines, keep=["file_name", "line_id"]).withColumn("year", F.year("datetime"))

    def _rows_per_file(self, folder: str) -> dict[int, int]:
        file = F.shiftright("line_id", FILE_BITS).alias("file")
        rows = self.spark.read.schema("line_id long").parquet(folder).groupBy(file).count()
        return {r["file"]: r["count"] for r in rows.collect()}

    def _line_counts(self, files: list[Landed]) -> dict[str, int]:
        if not files:
            return {}
        rows = self._lines(files).groupBy(F.col("_metadata.file_path").alias("url")).count().collect()
        return {r["url"]: r["count"] for r in rows}


def unreadable(error: Exception, files: Iterable[Landed]) -> dict[str, tuple[str, str]]:
    """The files that a failed read names, each with its status and the error's text."""
    text = str(error)
    if "FAILED_READ_FILE" not in text:
        return {}
    at = text.index("FAILED_READ_FILE")
    status = VANISHED if "FILE_NOT_EXIST" in text[at : at + 40] else REJECTED
    named = re.search(r"reading file (\S+?)\.?\s", text[at:] + " ")
    place = named.group(1).replace(":///", ":/") if named else ""  # as row metadata spells it
    reason = text[at:].split("\n\tat ")[0][:REASON_CHARS]
    return {f.url: (status, reason) for f in files if place in (f.url, f.path)}


def _changed(spark: SparkSession, table: str, storage: Storage) -> Iterator[str]:
    """Paths of files that were not taken and have changed since."""
    waiting = file_states(spark, table).where(F.col("status") != TAKEN)
    for row in waiting.orderBy("file").toLocalIterator():
        now = storage.state(row["path"])
        if now and (row["status"] == VANISHED or now != (row["size"], row["modified_ms"])):
            yield row["path"]


def _overlooked(spark: SparkSession, pattern: str, table: str, storage: Storage) -> Iterator[Landed]:
    """Files that the ledger lacks: empty ones, which the file source does not hand on."""
    urls = spark.read.format("binaryFile").load(pattern).inputFiles()
    names = [(unquote(url).replace(":///", ":/"), url.replace(":///", ":/")) for url in urls]
    if not names:
        return
    listed = spark.createDataFrame(names, "path string, url string")
    for row in listed.join(read_ledger(spark, table).select("path"), "path", "left_anti").toLocalIterator():
        now = storage.state(row["path"])
        if now:
            yield Landed(row["path"], row["url"], *now)


def ingest_landed(
    spark: SparkSession,
    folder: str,
    table: str,
    progress: str,
    name_glob: str = "*.dat",
    files_per_batch: int = 1000,
) -> None:
    """Take all files of ``folder`` that are new, or were rejected and have changed, into ``table``.

    ``progress`` is the checkpoint folder of this ingest and must be kept between runs. Each file's
    rows are taken once: a file that was taken and is changed afterwards is not read again.
    Rows get ``file_name`` and ``line_id``: the file's number in the ledger and the line's place in
    it, so ``line_id`` is unique in the table. ``read_landed`` reads the rows, ``read_ledger`` the
    files. An empty file is rejected for having no observation.
    """
    ingest = Ingest(spark, table)

    def take(batch: DataFrame, _: int) -> None:
        ingest.take([Landed(*row) for row in batch.collect()])  # files_per_batch rows

    stream = landed_files(spark, folder, name_glob, files_per_batch)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    for part in batched(_overlooked(spark, f"{folder}/{name_glob}", table, ingest.storage), files_per_batch):
        ingest.take(list(part))
    for part in batched(_changed(spark, table, ingest.storage), files_per_batch):
        paths = [_GLOB_SIGNS.sub(r"\\\1", path) for path in part]
        found = spark.read.format("binaryFile").load(paths)
        ingest.take([Landed(*row) for row in _states(found).collect()])
