"""Yearly fixed-width files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.config import FIXED_WIDTH_FIELDS, REQUIRED_COLUMNS, SENTINELS
from stormframe.functions.numeric import bare_double, drop_sentinels, hour_timestamp, without_blanks
from stormframe.sources.places import PLACE, START, URL, with_place, with_split

TIME_PARTS = ("year", "doy", "hour")
# A yearly file, or a folder of its parts.
NAME_IN_PATH = r"([^/]*\d{4}\.[^/.]+)(?:/[^/]*)?$"
YEAR_IN_NAME = r"(\d{4})\.[^.]+$"

#: A line's id holds its file's number above its place, which fits these bits.
FILE_BITS = 40
#: Names of files that are broadcast with their numbers, at most.
BROADCAST_URL_BYTES = 16_000_000
#: Keys of a manifest that are broadcast, at most.
BROADCAST_KEYS = 100_000


def parse_lines(
    lines: DataFrame,
    keep: Sequence[str] = (),
    sentinels: Iterable[float] | Mapping[str, Iterable[float]] = SENTINELS,
    fields: Mapping[str, tuple[int, int]] = FIXED_WIDTH_FIELDS,
    text: str = "value",
) -> DataFrame:
    """Observations from lines of text; ``keep`` carries columns of ``lines`` along.

    Fill numbers are dropped from every field, the time parts too, so by default day 99 of a
    year has no rows and real values of 9.9 or 99 are lost. Pass a map from field to
    fill numbers to narrow that. Lines without a possible date are dropped.
    """
    per_field = sentinels if isinstance(sentinels, Mapping) else dict.fromkeys(fields, list(sentinels))
    # Slicing bytes is direct, while slicing text would walk the line for every field.
    raw = F.col(text).cast("binary")
    texts = {name: F.substring(raw, start + 1, end - start).cast("string") for name, (start, end) in fields.items()}
    bare = lines.select(*keep, *(without_blanks(field).alias(name) for name, field in texts.items()))
    numbers = bare.select(*keep, *(bare_double(F.col(name)).alias(name) for name in fields))
    parsed = numbers.withColumns(
        {name: drop_sentinels(F.col(name), per_field.get(name, ())) for name in fields}
    )
    stamped = parsed.withColumn("datetime", hour_timestamp(*(F.col(p) for p in TIME_PARTS)))
    return stamped.where(F.col("datetime").isNotNull()).select(*REQUIRED_COLUMNS, *keep)


def read_years(
    spark: SparkSession,
    folder: str,
    start_year: int,
    end_year: int,
    name_glob: str = "*.dat",
) -> DataFrame:
    """Observations of the files whose name ends in a year of the range, ends included.

    A year may also be a folder of parts, ``2020.dat/part-...``. One scan over all of them; the
    test on the name prunes files before they are opened, and absent years are simply not there.
    A file that vanishes before it is read raises, and so does a folder without any match.
    ``line_id`` is made of the file's number among all files of the folder and the line's place in
    it; it serves as tiebreak once the observations are written.
    """
    if start_year > end_year:
        raise ValueError(f"start year {start_year} is after end year {end_year}")
    year = F.regexp_extract(landed_name(), YEAR_IN_NAME, 1).try_cast("int")
    lines = spark.read.text(f"{folder}/{name_glob}")
    urls = sorted(url.replace(":///", ":/") for url in lines.inputFiles())  # as row metadata spells them
    files = spark.createDataFrame([(url, i) for i, url in enumerate(urls)], "url string, file long")
    if sum(map(len, urls)) <= BROADCAST_URL_BYTES:
        files = F.broadcast(files)
    numbered = numbered_lines(lines.where(year.between(start_year, end_year)), files)
    return parse_lines(numbered, keep=["file_name", "line_id"]).withColumn("year", F.year("datetime"))


def numbered_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``value, file_name, line_id`` of lines as the text source reads them.

    ``files`` gives each ``url`` its number. A line's place is the first byte of its split plus its
    number in the split: a line has a byte at least, so places are unique in a file, and they grow
    along it. Splits are read from front to back, so counting needs no shuffle.
    """
    placed = with_place(with_split(lines).withColumn("file_name", landed_name(F.col(URL))))
    line_id = F.shiftleft("file", FILE_BITS) + F.col(START) + F.col(PLACE)
    return placed.join(files, placed[URL] == files["url"]).select("value", "file_name", line_id.alias("line_id"))


def landed_name(url: Column | None = None) -> Column:
    """Name of the yearly file, or of the folder of parts, that a line comes from."""
    return F.regexp_extract(F.col("_metadata.file_path") if url is None else url, NAME_IN_PATH, 1)


def years_between(start: str, end: str) -> tuple[int, int]:
    """Years of two ISO dates; the start must lie before the end."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first >= last:
        raise ValueError(f"start {start} must be before end {end}")
    return first.year, last.year


def in_years(df: DataFrame, start_year: int, end_year: int, time: str = "datetime") -> DataFrame:
    return df.where(F.year(time).between(start_year, end_year))


def parsed_range(observations: DataFrame) -> DataFrame:
    """Rows and time range per file."""
    return observations.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("datetime").alias("first_time"),
        F.max("datetime").alias("last_time"),
    )


def new_rows(landed: DataFrame, manifest: DataFrame, key: str = "year") -> DataFrame:
    """Landed rows whose key the manifest does not list yet.

    The manifest holds one row per ingested key. Up to ``BROADCAST_KEYS`` distinct keys are
    broadcast, so landed rows stay where they are; more are joined by key.
    """
    taken = manifest.select(key).distinct()
    few = taken.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return landed.join(F.broadcast(taken) if few else taken, key, "left_anti")
