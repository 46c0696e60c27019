"""JSON payloads that are an array of arrays: a header, then rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.functions.numeric import bare_double, without_blanks

TIME_COLUMN = "time_tag"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload per file. A payload is one JSON document, so a file is not split."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def header_columns(payloads: DataFrame, payload: str = "payload") -> list[str]:
    """Names found in the headers, sorted: a distinct over header names, not over rows."""
    names = (
        _non_empty(payloads, payload)
        .select(F.explode(F.col("_table")[0]).alias("name"))
        .distinct()
        .orderBy("name")
    )
    return [row["name"] for row in names.collect()]


def parse_payloads(
    payloads: DataFrame,
    columns: Sequence[str] | None = None,
    payload: str = "payload",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of the payloads as typed columns; the header says where each column is.

    ``time_tag`` is read strictly and a bad value raises. Every other column is read
    leniently as a number. Payloads without a row give nothing, and a malformed one raises. ``columns`` saves the
    job that looks the names up.
    """
    names = list(columns or header_columns(payloads, payload))
    rows = _non_empty(payloads, payload).select(
        *keep,
        F.col("_table")[0].alias("_header"),
        F.explode(F.slice("_table", 2, F.size("_table") - 1)).alias("_row"),
    )
    cells = rows.select(*keep, *(_cell(name).alias(name) for name in names))
    return cells.select(*keep, *(_typed(name).alias(name) for name in names))


def rejected_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Payloads that are not an array of arrays; :func:`parse_payloads` raises on them."""
    return payloads.where(F.col(payload).isNotNull() & _table_or_null(payload).isNull())


def _table_or_null(payload: str) -> Column:
    return F.from_json(payload, "array<array<string>>")


def _non_empty(payloads: DataFrame, payload: str) -> DataFrame:
    broken = F.raise_error(F.concat(F.lit("malformed payload: "), F.left(payload, F.lit(80))))
    table = F.when(F.col(payload).isNotNull(), F.coalesce(_table_or_null(payload), broken.cast("array<array<string>>")))
    return payloads.withColumn("_table", table).where(F.size("_table") >= 2)


def _cell(name: str) -> Column:
    """The text of a column, as its header says where it is."""
    at = F.array_position("_header", F.lit(name))
    text = F.when(at > 0, F.try_element_at("_row", at.cast("int")))
    return text if name == TIME_COLUMN else without_blanks(text)


def _typed(name: str) -> Column:
    cell = F.col("`" + name.replace("`", "``") + "`")
    return cell.cast("timestamp_ntz") if name == TIME_COLUMN else bare_double(cell)
