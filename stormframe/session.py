"""Session helpers for the benchmark and the tests, and named storage for stages."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from stormframe.sources.files import Storage

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_stages: dict[str, list[str]] = {}


def local_session(cpus: int = 8, name: str = "stormframe") -> SparkSession:
    """Session for a single machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Call-site capture for error messages costs more than building the plans does.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    ``SparkContext.setCheckpointDir`` names it as well. All executors must see that folder, so a session
    on a cluster has to name it. A session of one process (``local[n]``) may leave it out and then uses
    a temporary folder of its own. The new folder is removed when the driver ends; ``drop_stages``
    removes all of them before.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or _context_folder(spark)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        named = _own_folder(spark.sparkContext.applicationId)
    folder = f"{named.rstrip('/')}/stormframe-{uuid.uuid4().hex}"
    Storage(spark).remove_on_exit(folder)
    _stages.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def drop_stages(spark: SparkSession) -> None:
    """Remove what queries of this application have stored so far. Their results must not be used any more."""
    storage = Storage(spark)
    for folder in _stages.pop(spark.sparkContext.applicationId, []):
        storage.remove(folder)


def _context_folder(spark: SparkSession) -> str | None:
    """What ``SparkContext.setCheckpointDir`` was given."""
    found = spark.sparkContext.getCheckpointDir()
    return found.rsplit("/", 1)[0] if found else None


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"stormframe-{application}-")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back.

    Later readers prune columns and push filters into the scan, and a lost executor does not
    replay what came before.
    """
    target = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
