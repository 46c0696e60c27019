"""Lenient parsing of numbers and time parts, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.config import SENTINELS


# Spellings of infinity that are read, without a sign.
INFINITIES = ("inf", "Inf", "infinity", "Infinity")
_SIGNED = [sign + name for sign in ("", "+", "-") for name in INFINITIES]
# White space around a number.
BLANKS = " \t\n\x0b\f\r"


def without_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def bare_double(bare: Column) -> Column:
    """Text without blanks around it to double; unparseable or NaN text gives NULL.

    The cast alone would also read Java's type suffixes (``1.0d``), hexadecimal numbers and other
    spellings of infinity. A decimal number ends in a digit or a point and has no ``x``; those
    bytes are tested, without a regular expression. ``bare`` is named several times and should be a
    column that is there, not an expression.
    """
    ends = F.instr(F.lit("0123456789."), F.substring(bare, -1, 1)) > 0
    decimal = ends & ~F.contains(bare, F.lit("x")) & ~F.contains(bare, F.lit("X"))
    return F.when(decimal | bare.isin(_SIGNED), bare.try_cast("double"))


def lenient_double(text: Column) -> Column:
    """Text to double; blank, unparseable or NaN text gives NULL."""
    return bare_double(without_blanks(text))


def nan_to_null(number: Column) -> Column:
    """One representation of "missing": NaN becomes NULL."""
    return F.when(~F.isnan(number), number)


def with_missing_as_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN as NULL in the floating-point columns, all or those of ``columns``."""
    wanted = set(df.columns if columns is None else columns)
    floats = [name for name, kind in df.dtypes if kind in ("float", "double") and name in wanted]
    return df.withColumns({name: nan_to_null(F.col(name)) for name in floats}) if floats else df


def drop_sentinels(number: Column, sentinels: Iterable[float] = SENTINELS) -> Column:
    """Fill numbers become NULL; the match is numeric, whatever the spelling was."""
    values = [float(s) for s in sentinels]
    return F.when(~number.isin(values), number) if values else number


def hour_timestamp(year: Column, day_of_year: Column, hour: Column) -> Column:
    """Timestamp without zone from year, day of year and hour; NULL for an impossible date.

    Parts are truncated to whole numbers. Day 366 of a common year and hour 24 are impossible.
    """
    y, d, h = (part.try_cast("int") for part in (year, day_of_year, hour))
    first = F.make_date(F.when(y.between(1, 9999), y), F.lit(1), F.lit(1))
    day = F.date_add(first, F.when(d.between(1, 366), d) - 1)
    in_day = F.make_dt_interval(F.lit(0), F.when(h.between(0, 23), h))
    return F.when(F.year(day) == y, day.cast("timestamp_ntz") + in_day)


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, exact to the microsecond, as double.

    Works on the wall clock, so the session time zone plays no part.
    """
    since = time.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return since.cast("interval second").cast("decimal(18,6)").cast("double")


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours between two zone-less timestamps, as double."""
    elapsed = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    return elapsed.cast("interval second").cast("decimal(18,6)").cast("double") / F.lit(3600.0)


def name_from_file(path: Column, suffix: str) -> Column:
    """Name before ``suffix`` and the extension: the model name of a prediction file or folder."""
    return F.regexp_extract(path, rf"([^/]*?){suffix}\.[^./]+(?:/|$)", 1)
