"""Registered queries: ``name -> (spark, folder) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.config import (
    BASELINE_FEATURES,
    DERIVED_WEIGHTS,
    FEATURES,
    INDEX_WEIGHTS,
    MEASUREMENTS,
    TARGET,
    SeriesOrder,
    Settings,
)
from stormframe.functions.severity import (
    NORM_COLUMNS,
    auroral_latitude,
    severity_class,
    severity_rank,
    with_derived_features,
    with_norms,
    with_severity_index,
)
from stormframe.operators import conditioning, metrics, quality, regression
from stormframe.operators.blocks import plan_blocks
from stormframe.operators.ordered import chronological_split, fill_missing, with_position
from stormframe.operators.scaling import Scaler, scaler_statistics
from stormframe.operators.sequences import (
    align_features_target,
    flatten_windows,
    sequence_windows,
)
from stormframe.operators.window_regression import fit_on_windows, predict_on_windows
from stormframe.plans import prepare as preparation
from stormframe.plans.baselines import evaluate, persistence_predictions
from stormframe.session import shared_folder, stored
from stormframe.sources import tables
from stormframe.sources.events import solar_wind
from stormframe.sources.fixed_width import in_years, new_rows, parse_lines, parsed_range
from stormframe.sources.header_json import parse_payloads

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ("datetime", "event_id")
BY_USER = SeriesOrder(by=("user_id",))
WINDOW = 24
SHORT_STEP_HOURS = 0.125


def r9(column: str | Column) -> Column:
    """Means of short decimals can end in exactly half a unit of the sixth place."""
    return F.round(column, 9)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def limited(spark: SparkSession, folder: str) -> DataFrame:
    return conditioning.within_limits(solar_wind(spark, folder))


def derived(spark: SparkSession, folder: str) -> DataFrame:
    return with_derived_features(limited(spark, folder))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Conditioned rows with position and split.

    The conditioned rows are stored before they are counted, as in :func:`prepare`, because
    fits and counts read them again.
    """
    conditioned = preparation.condition(solar_wind(spark, folder))
    rows = stored(conditioned.rows, "conditioned")
    return preparation.split_table(preparation.Conditioned(rows, conditioned.plan))


# --- severity -----------------------------------------------------------------------


def severity_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, mean index and lowest latitude per class, over filled rows inside the limits."""
    conditioned = preparation.condition(solar_wind(spark, folder))
    return (
        conditioned.rows.groupBy("storm_severity_class")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            r9(F.avg(TARGET)).alias("mean_index"),
            F.min("auroral_latitude_deg").alias("min_latitude"),
        )
        .withColumn("class_rank", severity_rank(F.col("storm_severity_class")).cast("long"))
        .orderBy("class_rank")
    )


def normalise_all(spark: SparkSession, folder: str) -> DataFrame:
    return with_norms(solar_wind(spark, folder)).select("event_id", *NORM_COLUMNS)


def severity_index(spark: SparkSession, folder: str) -> DataFrame:
    table = with_severity_index(solar_wind(spark, folder), INDEX_WEIGHTS)
    return table.select("event_id", *NORM_COLUMNS, TARGET)


def severity_index_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    return with_derived_features(solar_wind(spark, folder)).select(
        "event_id", TARGET, "storm_severity_class", "auroral_latitude_deg"
    )


def severity_class_query(spark: SparkSession, folder: str) -> DataFrame:
    # The value scale reaches past both ends of the bins, so the edges are exercised.
    index = F.col("value") / F.lit(200.0) - F.lit(0.05)
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", severity_class(index).alias("storm_severity_class")
    )


def auroral_latitude_query(spark: SparkSession, folder: str) -> DataFrame:
    index = F.col("value") / F.lit(200.0) - F.lit(0.05)
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", auroral_latitude(index).alias("auroral_latitude_deg")
    )


# --- sources ------------------------------------------------------------------------


def yearly_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed-width lines spelled from ``events``, with fill numbers, bad text and bad dates."""
    event = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("long")

    def put(text: Column, width: int) -> Column:
        return F.lpad(text, width, " ")

    def decimal(number: Column) -> Column:
        whole = F.floor(number / 100).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((number % 100).cast("string"), 2, "0"))

    year = F.lit(2019) + event % 7
    doy = F.lit(1) + event % 366
    hour = F.when(event % 50 == 0, F.lit(24)).otherwise(F.hour("ts"))
    bt = F.when(F.col("event_type") == "error", "999.9").otherwise(decimal(cents % 10000))
    bz = F.concat(F.lit("-"), decimal(cents % 1000 + 1))
    density = F.when(event % 7 == 0, "abc").otherwise(decimal(cents % 5000))
    speed = F.when(F.col("event_type") == "signup", "9999.").otherwise(
        (F.lit(300) + cents % 700).cast("string")
    )
    dst = (F.lit(-1) - cents % 300).cast("string")
    line = F.concat(
        put(year.cast("string"), 4), put(doy.cast("string"), 4), put(hour.cast("string"), 3),
        F.lit(" " * 25), put(bt, 6), F.lit(" " * 36), put(bz, 6), F.lit(" " * 39),
        put(density, 6), put(speed, 6), F.lit(" " * 90), put(dst, 6),
    )
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.concat(year.cast("string"), F.lit(".dat")).alias("file_name"), line.alias("value")
    )


def parsed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines are stored before they are parsed, as landed files would be."""
    landed = stored(yearly_lines(spark, folder), "lines")
    return parse_lines(landed, keep=["event_id", "file_name"])


def fixed_width_parse(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_lines(spark, folder).drop("file_name")


def parsed_file_range(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_range(parsed_lines(spark, folder))


def year_range_load(spark: SparkSession, folder: str) -> DataFrame:
    return in_years(parsed_lines(spark, folder).drop("file_name"), 2020, 2023)


def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of days that the manifest, here the days with a missing speed, does not list."""
    landed = stored(parsed_lines(spark, folder), "landed").withColumns(
        {"year": F.year("datetime").cast("long"), "day": F.to_date("datetime")}
    )
    manifest = landed.where(F.col("speed").isNull()).select("day")
    return new_rows(landed, manifest, key="day").select("year", "event_id", "datetime", "dst")


def json_header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of up to 50 rows, since ``event_id`` is unique; text, nulls and numbers mixed."""
    value = F.col("value")
    speed = F.when(F.col("event_type") == "error", "n/a").otherwise(value.cast("string"))
    bt = F.when(F.col("event_id") % 7 == 0, None).otherwise((value / F.lit(4.0)).cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    row = F.array(stamp, F.col("event_id").cast("string"), bt, speed)
    header = F.array(*(F.lit(c) for c in ("time_tag", "event_id", "bt", "speed")))
    payloads = (
        spark.read.parquet(f"{folder}/events.parquet")
        .select(F.expr("event_id div 50").alias("batch"), row.alias("row"), header.alias("header"))
        .groupBy("batch")
        .agg(
            F.to_json(
                F.concat(F.array(F.first("header")), F.collect_list("row"))
            ).alias("payload")
        )
    )
    return parse_payloads(payloads, columns=["time_tag", "event_id", "bt", "speed"])


# --- conditioning -------------------------------------------------------------------


def drop_missing_query(spark: SparkSession, folder: str) -> DataFrame:
    table = conditioning.model_columns(solar_wind(spark, folder), ["event_id"])
    return conditioning.drop_missing(table, MEASUREMENTS)


def physical_limits(spark: SparkSession, folder: str) -> DataFrame:
    return limited(spark, folder)


def fill_gaps(spark: SparkSession, folder: str) -> DataFrame:
    table = conditioning.model_columns(solar_wind(spark, folder), ["event_id"])
    plan = plan_blocks(table)
    return plan.clean(fill_missing(plan.assign(table), plan, MEASUREMENTS))


def fill_gaps_by_user(spark: SparkSession, folder: str) -> DataFrame:
    table = solar_wind(spark, folder)
    plan = plan_blocks(table, BY_USER)
    return plan.clean(fill_missing(plan.assign(table), plan, MEASUREMENTS))


# --- reports ------------------------------------------------------------------------


def continuity_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.continuity_report(solar_wind(spark, folder))


def continuity_report_short(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps longer than a few minutes."""
    return quality.continuity_report(solar_wind(spark, folder), max_step_hours=SHORT_STEP_HOURS)


def continuity_report_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quality.continuity_report(solar_wind(spark, folder), BY_USER), "max_gap_hours")


def missing_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_report(solar_wind(spark, folder).drop("user_id", "event_id"))


def outlier_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.outlier_report(solar_wind(spark, folder))


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.validation_report(solar_wind(spark, folder))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = quality.run_summary(splits(spark, folder), WINDOW)
    return summary.withColumn("feature_names", F.array_join("feature_names", ","))


def training_gate(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gate_checks(quality.run_summary(splits(spark, folder), WINDOW))


# --- order, split, scale ------------------------------------------------------------


def chronological_split_query(spark: SparkSession, folder: str) -> DataFrame:
    return splits(spark, folder).select(*KEYS, "rn", "split")


def position_by_user(spark: SparkSession, folder: str) -> DataFrame:
    table = solar_wind(spark, folder).select("user_id", *KEYS)
    plan = plan_blocks(table, BY_USER)
    positioned = chronological_split(with_position(plan.assign(table), plan))
    return plan.clean(positioned)


def prepared_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        splits(spark, folder)
        .groupBy("split", "storm_severity_class")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            r9(F.avg(TARGET)).alias("mean_index"),
            r9(F.avg("auroral_latitude_deg")).alias("mean_latitude"),
            F.min("datetime").alias("first_time"),
            F.max("datetime").alias("last_time"),
        )
    )


def scaler_fit(spark: SparkSession, folder: str) -> DataFrame:
    statistics = scaler_statistics(splits(spark, folder), [*FEATURES, TARGET])
    return rounded(statistics, *statistics.columns)


def scale_splits(spark: SparkSession, folder: str) -> DataFrame:
    table = splits(spark, folder)
    scaled = Scaler.fit(table, [*FEATURES, TARGET]).transform(table)
    return rounded(scaled.select(*KEYS, "split", "dst", *FEATURES, TARGET), *FEATURES, TARGET)


def unscale(spark: SparkSession, folder: str) -> DataFrame:
    """One standard deviation above each value, back in physical units."""
    table = splits(spark, folder)
    scaler = Scaler.fit(table, [*FEATURES, TARGET])
    above = scaler.transform(table).withColumns({c: F.col(c) + F.lit(1.0) for c in (*FEATURES, TARGET)})
    return rounded(scaler.inverse(above).select(*KEYS, *FEATURES, TARGET), *FEATURES, TARGET)


# --- windows ------------------------------------------------------------------------


def as_doubles(windows: DataFrame) -> DataFrame:
    floats = [name for name, kind in windows.dtypes if kind == "float"]
    return windows.withColumns({c: F.col(c).cast("double") for c in floats}).withColumn(
        "step", F.col("step").cast("long")
    )


def sequence_windows_query(spark: SparkSession, folder: str) -> DataFrame:
    table = splits(spark, folder)
    windows = sequence_windows(table, FEATURES, TARGET, WINDOW)
    return as_doubles(flatten_windows(windows, FEATURES))


def sequence_windows_by_split(spark: SparkSession, folder: str) -> DataFrame:
    windows = preparation.split_windows(splits(spark, folder))
    return as_doubles(flatten_windows(windows, FEATURES))


def sequence_windows_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that stay inside one user's series."""
    table = with_derived_features(solar_wind(spark, folder)).select("user_id", *KEYS, *FEATURES, TARGET)
    plan = plan_blocks(table, BY_USER)
    positioned = plan.clean(with_position(plan.assign(table), plan))
    windows = sequence_windows(positioned, FEATURES, TARGET, WINDOW, by=["user_id"])
    return as_doubles(flatten_windows(windows, FEATURES))


def align_features_target_query(spark: SparkSession, folder: str) -> DataFrame:
    table = derived(spark, folder)
    return align_features_target(
        table.select(*KEYS, *FEATURES), table.select(*KEYS, TARGET), KEYS
    )


# --- forecasts and metrics ----------------------------------------------------------


def persistence_forecast(spark: SparkSession, folder: str) -> DataFrame:
    table = derived(spark, folder).select(*KEYS, TARGET)
    return persistence_predictions(table).drop("model")


def two_index_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The index with one set of weights as a prediction of the index with the other."""
    table = limited(spark, folder)
    truth = with_severity_index(table, DERIVED_WEIGHTS).withColumnRenamed(TARGET, "y_true")
    return with_severity_index(truth, INDEX_WEIGHTS).select(
        F.lit("index_weights").alias("model"), "y_true", F.col(TARGET).alias("y_pred")
    )


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    table = metrics.regression_metrics(two_index_predictions(spark, folder))
    return rounded(table, "rmse", "mae", "r2")


def persistence_metrics(spark: SparkSession, folder: str) -> DataFrame:
    table = derived(spark, folder).select(*KEYS, TARGET)
    return rounded(metrics.regression_metrics(persistence_predictions(table)), "rmse", "mae", "r2")


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    table = derived(spark, folder).select(*KEYS, TARGET)
    compared = evaluate(two_index_predictions(spark, folder), table)
    return rounded(compared, "rmse", "mae", "r2")


def timeseries_head(spark: SparkSession, folder: str) -> DataFrame:
    table = derived(spark, folder).select(*KEYS, TARGET)
    return conditioning.first_rows(table, 500)


def scatter_bins(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.scatter_bins(two_index_predictions(spark, folder))


def truth_vs_prediction(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.truth_vs_prediction(two_index_predictions(spark, folder))


def chronological_sort(spark: SparkSession, folder: str) -> DataFrame:
    return conditioning.in_time_order(solar_wind(spark, folder))


# --- stored tables ------------------------------------------------------------------


def stored_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Observations written as CSV and read back with the declared schema."""
    target = f"{shared_folder(spark)}/combined.csv"
    stamps = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    table = conditioning.model_columns(solar_wind(spark, folder))
    table.write.option("header", "true").options(**stamps).csv(target)
    return tables.read_observations_csv(spark, target, **stamps)


def stored_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations written by year; the filter prunes the other years."""
    target = f"{shared_folder(spark)}/observations"
    tables.write_observations(parsed_lines(spark, folder).drop("file_name"), target)
    stored = tables.read_parts(spark, target).where(F.col("year").between(2020, 2022))
    return stored.withColumn("year", F.col("year").cast("long"))


def stored_split(spark: SparkSession, folder: str) -> DataFrame:
    """One split of the stored table, read with pruned partitions and columns."""
    target = f"{shared_folder(spark)}/tabular"
    tables.write_splits(splits(spark, folder), target)
    return tables.read_split(spark, target, "val", FEATURES, keys=KEYS)


def stored_sequences(spark: SparkSession, folder: str) -> DataFrame:
    target = f"{shared_folder(spark)}/sequences"
    windows = preparation.split_windows(splits(spark, folder), Settings(window=WINDOW))
    tables.write_sequences(windows, target, WINDOW)
    stored = tables.read_sequences(spark, target, "test").drop("split", "window")
    return as_doubles(flatten_windows(stored, FEATURES))


def stored_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of two models in two folders, found by name and compared."""
    target = shared_folder(spark)
    two_index = two_index_predictions(spark, folder)
    naive = persistence_predictions(derived(spark, folder).select(*KEYS, TARGET))
    for place, name, table in (("a", "index_weights", two_index), ("b", "persistence", naive)):
        table.select("model", "y_true", "y_pred").write.option("header", "true").csv(
            f"{target}/{place}/{name}{tables.PREDICTION_SUFFIX}.csv"
        )
    found = tables.read_predictions(spark, [f"{target}/{p}" for p in ("a", "b", "none")])
    return rounded(metrics.model_comparison(found), "rmse", "mae", "r2")


# --- models -------------------------------------------------------------------------


def gram_matrix(spark: SparkSession, folder: str) -> DataFrame:
    table = regression.gram_matrix(derived(spark, folder), BASELINE_FEATURES, TARGET)
    return rounded(table, "total", places=2)


def _fit_and_predict(spark, folder, names, keys=KEYS) -> DataFrame:
    table = splits(spark, folder).select(*KEYS, "split", *BASELINE_FEATURES, TARGET)
    models = {n: m for n, m in regression.baseline_models().items() if n in names}
    fitted = regression.fit_models(models, table.where(F.col("split") == "train"), KEYS)
    return regression.predict(fitted, table.where(F.col("split") == "test"), keys=keys)


def linear_regression_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_fit_and_predict(spark, folder, ["linear_regression"]), "y_true", "y_pred")


def random_forest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    predictions = _fit_and_predict(spark, folder, ["random_forest"], keys=())
    return rounded(metrics.model_comparison(predictions), "rmse", "mae", "r2")


def linear_on_window(spark: SparkSession, folder: str) -> DataFrame:
    """A linear model on 24 steps of all features, fitted on train and scored on every test window."""
    table = splits(spark, folder)
    train, test = (table.where(F.col("split") == s) for s in ("train", "test"))
    model = fit_on_windows(train, FEATURES, TARGET, WINDOW)
    return rounded(predict_on_windows(model, test), "y_true", "y_pred")


QUERIES: dict[str, Query] = {
    "severity_summary": severity_summary,
    "normalise_all": normalise_all,
    "severity_index": severity_index,
    "severity_index_wrapper": severity_index_wrapper,
    "severity_class": severity_class_query,
    "auroral_latitude": auroral_latitude_query,
    "fixed_width_parse": fixed_width_parse,
    "parsed_file_range": parsed_file_range,
    "year_range_load": year_range_load,
    "incremental_ingest": incremental_ingest,
    "json_header_rows": json_header_rows,
    "drop_missing": drop_missing_query,
    "physical_limits": physical_limits,
    "fill_gaps": fill_gaps,
    "fill_gaps_by_user": fill_gaps_by_user,
    "continuity_report": continuity_report,
    "continuity_report_short": continuity_report_short,
    "continuity_report_by_user": continuity_report_by_user,
    "missing_report": missing_report,
    "outlier_report": outlier_report,
    "validation_report": validation_report,
    "run_summary": run_summary,
    "training_gate": training_gate,
    "chronological_split": chronological_split_query,
    "position_by_user": position_by_user,
    "prepared_split_summary": prepared_split_summary,
    "scaler_fit": scaler_fit,
    "scale_splits": scale_splits,
    "unscale": unscale,
    "sequence_windows": sequence_windows_query,
    "sequence_windows_by_split": sequence_windows_by_split,
    "sequence_windows_by_user": sequence_windows_by_user,
    "align_features_target": align_features_target_query,
    "persistence_forecast": persistence_forecast,
    "regression_metrics": regression_metrics,
    "persistence_metrics": persistence_metrics,
    "model_comparison": model_comparison,
    "timeseries_head": timeseries_head,
    "scatter_bins": scatter_bins,
    "truth_vs_prediction": truth_vs_prediction,
    "chronological_sort": chronological_sort,
    "stored_csv": stored_csv,
    "stored_observations": stored_observations,
    "stored_split": stored_split,
    "stored_sequences": stored_sequences,
    "stored_predictions": stored_predictions,
    "gram_matrix": gram_matrix,
    "linear_regression_predictions": linear_regression_predictions,
    "random_forest_metrics": random_forest_metrics,
    "linear_on_window": linear_on_window,
}

