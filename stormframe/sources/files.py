"""Small files and folders on whatever storage Spark reads, by Hadoop's file system."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class FileState(NamedTuple):
    size: int
    modified_ms: int


class Storage:
    """What the driver does with single files: states, listings, small texts and removal.

    Only bookkeeping goes this way; rows are read and written by Spark.
    """

    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext
        self._hadoop = self._context._jvm.org.apache.hadoop

    def _open(self, path: str):
        place = self._hadoop.fs.Path(path)
        return place.getFileSystem(self._context._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        files, place = self._open(path)
        return files.exists(place)

    def state(self, path: str) -> FileState | None:
        """Size and time of a file, or nothing if there is none."""
        files, place = self._open(path)
        if not files.exists(place):
            return None
        status = files.getFileStatus(place)
        return FileState(status.getLen(), status.getModificationTime())

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        files, place = self._open(folder)
        if not files.exists(place):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(place))

    def read(self, path: str) -> str:
        files, place = self._open(path)
        stream = files.open(place)
        try:
            return self._context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a small file that readers see whole or not at all; raise if it is there already."""
        files, place = self._open(path)
        if files.exists(place):
            raise FileExistsError(path)
        folder, name = path.rsplit("/", 1)
        draft = self._hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not files.rename(draft, place):
            files.delete(draft, False)
            raise FileExistsError(path)

    def remove_on_exit(self, folder: str) -> None:
        """Create a folder that goes, with all it holds, when the driver ends."""
        files, place = self._open(folder)
        files.mkdirs(place)
        files.deleteOnExit(place)

    def move(self, source: str, target: str) -> None:
        """Give a file another name; raise if that is taken."""
        files, place = self._open(target)
        if files.exists(place) or not files.rename(self._hadoop.fs.Path(source), place):
            raise FileExistsError(target)

    def remove(self, path: str) -> None:
        """Remove a file or a folder with all it holds, if it is there."""
        files, place = self._open(path)
        files.delete(place, True)
