import gzip
import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stormframe.config import FEATURES, SPLITS
from stormframe.functions.numeric import (
    drop_sentinels,
    epoch_seconds,
    hour_timestamp,
    hours_between,
    lenient_double,
    name_from_file,
)
from stormframe.plans.prepare import aligned_windows
from stormframe.sources.files import Storage
from stormframe.sources.fixed_width import (
    in_years,
    new_rows,
    parse_lines,
    parsed_range,
    read_years,
    years_between,
)
from stormframe.sources.header_json import header_columns, parse_payloads, read_payloads
from stormframe.sources.tables import (
    read_observations_csv,
    read_aligned,
    read_predictions,
    write_observations,
)
from stormframe.sources.versions import read_parts

from stormframe.streaming.ingest import file_states, ingest_landed, read_landed, read_ledger

FIELDS = {"year": (0, 4), "doy": (4, 8), "hour": (8, 11), "bt": (36, 42), "bz": (78, 84),
          "density": (123, 129), "speed": (129, 135), "dst": (225, 231)}


def line(year=2020, doy=1, hour=0, bt="5.0", bz="-1.5", density="3.2", speed="400.", dst="-12"):
    text = [" "] * 231
    for name, value in zip(FIELDS, (year, doy, hour, bt, bz, density, speed, dst)):
        start, end = FIELDS[name]
        text[start:end] = str(value).rjust(end - start)
    return "".join(text)


def parse(spark, *lines, **options):
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    return parse_lines(frame, **options).orderBy("datetime").collect()


def test_plain_line(spark):
    (row,) = parse(spark, line(2021, 60, 13))
    assert row.asDict() == {
        "datetime": datetime(2021, 3, 1, 13), "bt": 5.0, "bz_gsm": -1.5, "speed": 400.0,
        "density": 3.2, "dst": -12.0,
    }


@pytest.mark.parametrize("fill", ["9999", "999.9", "9999.", "99", "9.9", "-999.9", "9.999", "99999"])
def test_fill_numbers_are_missing(spark, fill):
    (row,) = parse(spark, line(bt=fill, speed=fill, dst=fill))
    assert (row["bt"], row["speed"], row["dst"]) == (None, None, None)
    assert row["bz_gsm"] == -1.5


@pytest.mark.parametrize("text", ["abc", "", "1.0d", "2f", "nan", "1_0", "--5", "0x1"])
def test_bad_text_is_missing(spark, text):
    (row,) = parse(spark, line(density=text))
    assert row["density"] is None


@pytest.mark.parametrize(
    "parts",
    [dict(hour=24), dict(year=2021, doy=366), dict(doy=0), dict(doy=367), dict(doy=99),
     dict(year="abcd"), dict(year=9999), dict(hour=-1), dict(hour="")],
)
def test_impossible_dates_are_dropped(spark, parts):
    assert parse(spark, line(**parts)) == []


def test_numbers_are_those_of_the_plain_pattern(spark):
    number = re.compile(r"\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI]nf(?:inity)?))\s*", re.ASCII)
    pick = random.Random(8)
    texts = ["".join(pick.choices("01259.+-eE xXdDfFpninfity\t", k=pick.randrange(7))) for _ in range(6000)]
    texts += ["inf", "-Inf", "+infinity", "INF", "iNf", "Infinity", "NaN", "0x1p3", "0X10", "1.0d", "5f", " 7 ", "\u00a07", "1_0", "٣"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lenient_double(F.col("t")).alias("v")).collect()
    for row in rows:
        match = number.fullmatch(row["t"])
        assert row["v"] == (float(match.group(1)) if match else None), repr(row["t"])


def test_days_of_the_year(spark):
    cases = [(y, d, h) for y in (0, 1, 1900, 2000, 2019, 2020, 9999, 10000, -5) for d in (-1, 0, 1, 60, 365, 366, 367) for h in (-1, 0, 23, 24)]
    rows = spark.createDataFrame([tuple(map(float, c)) for c in cases], "y double, d double, h double")
    for r in rows.select("*", hour_timestamp(F.col("y"), F.col("d"), F.col("h")).alias("t")).collect():
        y, d, h = int(r["y"]), int(r["d"]), int(r["h"])
        days = 366 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 365
        valid = 1 <= y <= 9999 and 1 <= d <= days and 0 <= h <= 23
        assert r["t"] == (datetime(y, 1, 1) + timedelta(days=d - 1, hours=h) if valid else None)


def test_leap_day_and_narrower_sentinels(spark):
    (row,) = parse(spark, line(2020, 366, 23))
    assert row["datetime"] == datetime(2020, 12, 31, 23)
    (row,) = parse(spark, line(doy=99, bt="9.9"), sentinels={"speed": [9999.0]})
    assert (row["datetime"], row["bt"]) == (datetime(2020, 4, 8), 9.9)


def test_short_and_empty_lines(spark):
    (row,) = parse(spark, "", line()[:50])
    assert (row["bt"], row["dst"]) == (5.0, None)


def test_timestamp_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        (row,) = parse(spark, line(2021, 73, 2))  # this hour does not exist in New York
        assert row["datetime"] == datetime(2021, 3, 14, 2)
        seconds = spark.range(1).select(
            epoch_seconds(F.lit("2021-03-14 02:30:00.000001").cast("timestamp_ntz")).alias("s")
        ).first()["s"]
        assert seconds == 1615689000.000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numeric_helpers(spark):
    frame = spark.createDataFrame([(" 1e3 ", "a/b/forest_test_predictions.csv")], "t string, f string")
    row = frame.select(
        lenient_double(F.col("t")).alias("n"),
        lenient_double(F.lit("-inf")).alias("inf"),
        drop_sentinels(F.lit(9.90)).alias("fill"),
        name_from_file(F.col("f"), "_test_predictions").alias("name"),
        hour_timestamp(F.lit(2020.0), F.lit(32.0), F.lit(5.0)).alias("t"),
        hours_between(
            F.lit("2020-01-02 00:30:00").cast("timestamp_ntz"), F.lit("2020-01-01").cast("timestamp_ntz")
        ).alias("h"),
    ).first()
    assert (row["n"], row["inf"], row["fill"], row["name"]) == (1000.0, float("-inf"), None, "forest")
    assert (row["t"], row["h"]) == (datetime(2020, 2, 1, 5), 24.5)


def land(folder, year, days=3):
    text = "\n".join(line(year, d + 1, h) for d in range(days) for h in range(24))
    (folder / f"{year}.dat").write_text(text + "\n")


def test_read_years(spark, tmp_path):
    for year in (2018, 2019, 2021):
        land(tmp_path, year)
    (tmp_path / "notes.txt").write_text("not data")
    loaded = read_years(spark, str(tmp_path), 2019, 2022)
    ranges = {r["file_name"]: r for r in parsed_range(loaded).collect()}
    assert set(ranges) == {"2019.dat", "2021.dat"}
    assert ranges["2019.dat"]["n_rows"] == 72
    assert ranges["2021.dat"]["last_time"] == datetime(2021, 1, 3, 23)
    assert loaded.select("line_id").distinct().count() == 144
    assert in_years(loaded, 2021, 2021).count() == 72
    assert read_years(spark, str(tmp_path), 1990, 1991).isEmpty()


def test_year_arguments(spark):
    assert years_between("2000-01-01", "2026-02-02") == (2000, 2026)
    with pytest.raises(ValueError):
        years_between("2020-01-01", "2020-01-01")
    with pytest.raises(ValueError):
        read_years(spark, "/nowhere", 2021, 2020)


def test_new_rows(spark):
    landed = spark.createDataFrame([(2020, 1), (2021, 2), (2021, 3)], "year int, v int")
    manifest = spark.createDataFrame([(2020,), (2020,)], "year int")
    assert sorted(r["v"] for r in new_rows(landed, manifest).collect()) == [2, 3]


class Landing:
    """A landing folder with its table, and what ingesting leaves in them."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.table, self.progress = spark, *(folder / n for n in ("landing", "table", "progress"))
        self.folder.mkdir()

    def ingest(self, progress=None):
        ingest_landed(self.spark, str(self.folder), str(self.table), str(progress or self.progress), files_per_batch=2)

    def years(self):
        rows = read_landed(self.spark, str(self.table)).groupBy("year").count().collect()
        return {r["year"]: r["count"] for r in rows}

    def states(self):
        rows = file_states(self.spark, str(self.table)).collect()
        return {r["path"].rsplit("/", 1)[1]: r["status"] for r in rows}


@pytest.fixture()
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def test_incremental_ingest_takes_each_file_once(spark, landing):
    land(landing.folder, 2020)
    landing.ingest()
    assert landing.years() == {2020: 72}
    landing.ingest()
    assert landing.years() == {2020: 72}
    land(landing.folder, 2021)
    landing.ingest()
    assert landing.years() == {2020: 72, 2021: 72}
    landing.ingest(progress=landing.progress.with_name("lost"))  # every file is handed on again
    assert landing.years() == {2020: 72, 2021: 72}
    assert read_ledger(spark, str(landing.table)).count() == 2


def test_broken_files_do_not_hold_up_others(spark, landing):
    for year in (2020, 2021):
        land(landing.folder, year)
    (landing.folder / "2022.dat").mkdir()
    broken = landing.folder / "2022.dat" / "part.gz"
    broken.write_bytes(b"not compressed at all")
    (landing.folder / "2023.dat").write_text("no\ndata\n")
    (landing.folder / "2024.dat").write_text("")
    landing.ingest()
    assert landing.years() == {2020: 72, 2021: 72}
    assert landing.states() == {
        "2020.dat": "taken", "2021.dat": "taken", "part.gz": "rejected", "2023.dat": "rejected", "2024.dat": "rejected",
    }
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in file_states(spark, str(landing.table)).collect()}
    assert "FAILED_READ_FILE" in reasons["part.gz"]
    assert reasons["2023.dat"] == "no observation in 2 lines"
    assert reasons["2024.dat"] == "no observation in 0 lines"

    landing.ingest()
    assert read_ledger(spark, str(landing.table)).count() == 5  # what has not changed is not tried again
    text = "\n".join(line(2022, 1, h) for h in range(24)) + "\n"
    broken.write_bytes(gzip.compress(text.encode()))
    (landing.folder / "2024.dat").write_text(line(2024, 5, 5))
    landing.ingest()
    assert landing.years() == {2020: 72, 2021: 72, 2022: 24, 2024: 1}
    assert landing.states()["part.gz"] == "taken"
    ids = read_landed(spark, str(landing.table)).agg(F.count(F.lit(1)), F.count_distinct("line_id")).first()
    assert ids[0] == ids[1] == 169


def test_uncommitted_batches_are_not_seen(spark, landing, monkeypatch):
    land(landing.folder, 2020)
    monkeypatch.setattr(Storage, "publish", lambda *_: (_ for _ in ()).throw(OSError("the driver died")))
    with pytest.raises(Exception, match="the driver died"):
        landing.ingest()
    with pytest.raises(FileNotFoundError):
        landing.years()
    monkeypatch.undo()
    landing.ingest()
    assert landing.years() == {2020: 72}


def test_an_error_that_names_no_file_is_raised(spark, landing, monkeypatch):
    land(landing.folder, 2020)
    monkeypatch.setattr("stormframe.streaming.ingest.parse_lines", lambda lines, **_: lines.select(F.raise_error(F.lit("odd")).alias("datetime")))
    with pytest.raises(Exception, match="odd"):
        landing.ingest()
    assert not landing.table.joinpath("ledger").exists()


def test_line_ids_hold_file_and_place(spark, tmp_path):
    land(tmp_path, 2020)
    (tmp_path / "2021.dat").write_text((line(2021, 1, 1) + "\n") * 5000)  # equal lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = read_years(spark, str(tmp_path), 2020, 2021)
        found = rows.agg(F.count(F.lit(1)), F.count_distinct("line_id")).first()
        assert found[0] == found[1] == 5072
        again = read_years(spark, str(tmp_path), 2021, 2021)
        assert again.exceptAll(rows).isEmpty() and again.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- JSON ---------------------------------------------------------------------------


def payloads(spark, *tables):
    return spark.createDataFrame([(json.dumps(t),) for t in tables], "payload string")


def test_payload_rows(spark):
    frame = payloads(
        spark,
        [["time_tag", "bt", "bz"], ["2024-01-01 00:00:00.000", "1.5", None], ["2024-01-01 00:01:00", "x", 2]],
        [["bz", "time_tag"], ["7", "2024-01-02 00:00:00"]],
    )
    assert header_columns(frame) == ["bt", "bz", "time_tag"]
    rows = [tuple(r) for r in parse_payloads(frame).orderBy("time_tag").collect()]
    assert rows == [
        (1.5, None, datetime(2024, 1, 1)),
        (None, 2.0, datetime(2024, 1, 1, 0, 1)),
        (None, 7.0, datetime(2024, 1, 2)),
    ]


def test_payload_without_rows(spark):
    frame = payloads(spark, [["time_tag", "bt"]], [])
    assert parse_payloads(frame, ["time_tag", "bt"]).count() == 0


def test_bad_time_tag_raises(spark):
    frame = payloads(spark, [["time_tag", "bt"], ["yesterday", "1"]])
    with pytest.raises(PySparkException):
        parse_payloads(frame, ["time_tag", "bt"]).collect()


def test_payload_files(spark, tmp_path):
    table = [["time_tag", "bt"], ["2024-01-01 00:00:00", "1"], ["2024-01-01 01:00:00", "2"]]
    (tmp_path / "mag.json").write_text(json.dumps(table, indent=1))
    assert parse_payloads(read_payloads(spark, str(tmp_path))).count() == 2


# --- tables -------------------------------------------------------------------------


def test_observation_csv(spark, tmp_path):
    path = tmp_path / "combined.csv"
    path.write_text(
        "datetime,bt,bz_gsm,speed,density,dst\n2020-01-01 00:00:00,1.0,,400.0,NaN,-5\n"
    )
    row = read_observations_csv(spark, str(path)).first()
    assert row["datetime"] == datetime(2020, 1, 1)
    assert (row["bz_gsm"], row["density"], row["dst"]) == (None, None, -5.0)


def test_empty_table_is_not_written(spark, tmp_path):
    frame = spark.createDataFrame([(datetime(2020, 5, 1), 1.0)], "datetime timestamp_ntz, bt double")
    assert write_observations(frame, str(tmp_path / "t"))
    assert not write_observations(frame.limit(0), str(tmp_path / "none"))
    assert write_observations(frame, str(tmp_path / "t"))
    assert read_parts(spark, str(tmp_path / "t")).count() == 1
    assert write_observations(frame, str(tmp_path / "t"), append=True)
    assert read_parts(spark, str(tmp_path / "t")).count() == 2
    assert not list((tmp_path / "none").glob("version*"))
    assert read_parts(spark, str(tmp_path / "t")).first()["year"] == 2020


def test_prediction_files_of_two_folders(spark, tmp_path):
    for folder, model in (("one", "linear_regression"), ("two", "random_forest")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{model}_test_predictions.csv").write_text(
            f"model,y_true,y_pred\n{model},1.0,0.5\n{model},2.0,2.5\n"
        )
    (tmp_path / "one" / "other.csv").write_text("a\n1\n")
    folders = [str(tmp_path / f) for f in ("one", "two")]
    found = read_predictions(spark, folders).groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in found} == {"linear_regression": 2, "random_forest": 2}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_predictions(spark, [str(tmp_path / "empty")])


def write_pair(folder, split, x_rows, y_rows):
    """Aligned files in two and three parts; times of the two sides differ on purpose."""
    for name, n, columns, cuts in (("X", x_rows, FEATURES, 2), ("y", y_rows, ("target",), 3)):
        (folder / f"{name}_{split}.csv").mkdir(parents=True)
        edges = [n * i // cuts for i in range(cuts + 1)]
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            rows = [f"2020-01-0{1 if name == 'y' else 2} {i // 60:02d}:{i % 60:02d}:00," + ",".join([str(i)] * len(columns)) for i in range(a, b)]
            (folder / f"{name}_{split}.csv" / f"part-{part}.csv").write_text("\n".join([",".join(["datetime", *columns]), *rows]) + "\n")


def test_aligned_files_are_paired_by_row(spark, tmp_path):
    write_pair(tmp_path, "train", 700, 700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        table, rows = read_aligned(spark, str(tmp_path), "train", FEATURES, "target")
        found = table.orderBy("rn").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == len(found) == 700
    assert all(r["rn"] == r["target"] == r["bt"] == r["density"] == i for i, r in enumerate(found))
    assert found[0]["datetime"] == datetime(2020, 1, 1)


def test_aligned_files_of_unequal_length_raise(spark, tmp_path):
    write_pair(tmp_path, "val", 10, 9)
    with pytest.raises(ValueError, match="same length: 10 and 9 rows"):
        read_aligned(spark, str(tmp_path), "val", FEATURES, "target")


def test_strict_windows(spark, tmp_path):
    for split, rows in zip(SPLITS, (20, 12, 11)):
        write_pair(tmp_path, split, rows, rows)
    windows = aligned_windows(spark, str(tmp_path), 10, FEATURES, "target")
    sizes = {r["split"]: r["count"] for r in windows.groupBy("split").count().collect()}
    assert sizes == {"train": 10, "val": 2, "test": 1}
    first = windows.where("split = 'val'").orderBy("rn").first()
    assert [step[0] for step in first["x"]] == list(range(10)) and first["y"] == 10.0
    with pytest.raises(ValueError, match=r"insufficient rows \(11 in test\) for window length 11"):
        aligned_windows(spark, str(tmp_path), 11, FEATURES, "target")
    with pytest.raises(ValueError, match="window must be >= 1"):
        aligned_windows(spark, str(tmp_path), 0, FEATURES, "target")
