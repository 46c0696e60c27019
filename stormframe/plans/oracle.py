"""The registered queries in DuckDB SQL, written independently of the Spark plans.

Each statement works on whole tables with plain global windows. Literals are cast to DOUBLE
and the order of operands matches, so row-wise results are equal to the bit; aggregates are
rounded on both sides.
"""

from __future__ import annotations

from stormframe.config import CONDITIONING_LIMITS, DERIVED_WEIGHTS, INDEX_WEIGHTS, REPORT_LIMITS
from stormframe.plans.queries import SHORT_STEP_HOURS, WINDOW

ORDER = "ORDER BY datetime, event_id"
MEASURES = ("bt", "bz_gsm", "speed", "density", "dst")
FEATURES = ("bt", "bz_gsm", "speed", "density")

WIND = """wind AS (
  SELECT ts AS datetime, event_id, user_id,
    CASE WHEN event_type = 'error' THEN NULL ELSE value / 10.0::DOUBLE END AS bt,
    CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN NULL
         ELSE 10.0::DOUBLE - value / 4.0::DOUBLE END AS bz_gsm,
    300.0::DOUBLE + value * 4.0::DOUBLE AS speed,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.1::DOUBLE + value / 3.0::DOUBLE END AS density,
    20.0::DOUBLE - value * 1.5::DOUBLE AS dst
  FROM events)"""


def d(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def rnd(expression: str, places: int = 6) -> str:
    """Rounded, with negative zero written as zero."""
    r = f"round({expression}, {places})"
    return f"CASE WHEN {r} = 0 THEN 0::DOUBLE ELSE {r} END"


def filled(partition: str = "") -> str:
    past = f"({partition} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"({partition} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    columns = ",\n    ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {past}, "
        f"first_value({c} IGNORE NULLS) OVER {whole}) AS {c}"
        for c in MEASURES
    )
    return f"filled AS (\n  SELECT datetime, event_id, user_id,\n    {columns}\n  FROM wind)"


def limited(source: str) -> str:
    tests = " AND ".join(
        f"{c} BETWEEN {d(low)} AND {d(high)}" for c, (low, high) in CONDITIONING_LIMITS.items()
    )
    return f"limited AS (SELECT * FROM {source} WHERE {tests})"


def clipped(x: str, low: float, high: float) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN "
        f"(least(greatest({x}, {d(low)}), {d(high)}) - {d(low)}) / {d(high - low)} END"
    )


def normed(source: str) -> str:
    south = "CASE WHEN bz_gsm IS NOT NULL THEN abs(least(bz_gsm, 0.0::DOUBLE)) END"
    return f"""normed AS (
  SELECT *,
    {clipped("abs(dst)", 0, 300)} AS dst_norm,
    {clipped(f"({south})", 0, 20)} AS bz_norm,
    {clipped("bt", 0, 30)} AS bt_norm,
    {clipped("speed", 300, 800)} AS speed_norm,
    {clipped("density", 1, 50)} AS density_norm
  FROM {source})"""


def index_of(weights) -> str:
    names = ("dst_norm", "bz_norm", "bt_norm", "speed_norm", "density_norm")
    return " + ".join(f"{d(w)} * {n}" for w, n in zip(weights, names))


def class_of(x: str) -> str:
    return f"""CASE WHEN {x} < 0 THEN NULL
      WHEN {x} <= {d(0.15)} THEN 'quiet' WHEN {x} <= {d(0.30)} THEN 'minor'
      WHEN {x} <= {d(0.50)} THEN 'moderate' WHEN {x} <= {d(0.75)} THEN 'severe'
      WHEN {x} <= {d(1.0)} THEN 'extreme' END"""


def latitude_of(x: str) -> str:
    lat = f"({d(67)} - {d(22)} * {x})"
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({lat}, {d(45)}), {d(67)}) END"


def derived(source: str, weights=DERIVED_WEIGHTS) -> str:
    x = "storm_severity_index"
    return f"""{normed(source)},
indexed AS (SELECT *, {index_of(weights)} AS {x} FROM normed),
derived AS (
  SELECT *, {class_of(x)} AS storm_severity_class, {latitude_of(x)} AS auroral_latitude_deg
  FROM indexed)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


UNFILLED = with_(WIND, limited("wind"), derived("limited"))

SPLITS = with_(
    WIND,
    filled(),
    limited("filled"),
    derived("limited"),
    f"""counted AS (
  SELECT *, row_number() OVER ({ORDER}) - 1 AS rn, count(*) OVER () AS n FROM derived)""",
    """splits AS (
  SELECT *, CASE
    WHEN rn < n - floor(n * 0.15::DOUBLE) - floor(n * 0.15::DOUBLE) THEN 'train'
    WHEN rn < n - floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM counted)""",
)

SCALED_COLUMNS = (*FEATURES, "storm_severity_index")
SCALER = "scaler AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_scale" for c in SCALED_COLUMNS
) + " FROM splits WHERE split = 'train')"

# --- fixed-width lines: what each field must read as, from the values it was spelled from ----

FILLS = "9999, 999.9, 999.99, 999999, 99999, 99, 9.9, -999.9, 9999999, 999999.99, 9.999"


def known(x: str) -> str:
    return f"CASE WHEN ({x}) NOT IN ({FILLS}) THEN ({x}) END"


PARSED = f"""spelled AS (
  SELECT *, round(value * 100)::BIGINT AS cents, 2019 + event_id % 7 AS y,
    1 + event_id % 366 AS doy
  FROM events),
dated AS (
  SELECT *, make_date(y, 1, 1) + (doy - 1)::INTEGER AS day
  FROM spelled WHERE doy <> 99 AND event_id % 50 <> 0),
parsed AS (
  SELECT day + to_hours(hour(ts)) AS datetime, y::BIGINT AS year, event_id,
    {known("CASE WHEN event_type <> 'error' THEN (cents % 10000) / 100.0::DOUBLE END")} AS bt,
    -((cents % 1000 + 1) / 100.0::DOUBLE) AS bz_gsm,
    CASE WHEN event_type <> 'signup' THEN (300 + cents % 700)::DOUBLE END AS speed,
    {known("CASE WHEN event_id % 7 <> 0 THEN (cents % 5000) / 100.0::DOUBLE END")} AS density,
    (-1 - cents % 300)::DOUBLE AS dst
  FROM dated WHERE year(day) = y)"""


# --- reports -------------------------------------------------------------------------------


def pct(part: str, whole: str, places: int) -> str:
    return (
        f"round_even(CASE WHEN {whole} > 0 THEN ({part}) / ({whole})::DOUBLE * 100.0::DOUBLE "
        f"ELSE 0.0::DOUBLE END, {places})"
    )


def nulls(c: str) -> str:
    return f"count(*) FILTER ({c} IS NULL)"


def outside(c: str) -> str:
    low, high = REPORT_LIMITS[c]
    return f"count(*) FILTER ({c} < {d(low)} OR {c} > {d(high)})"


OBSERVED = ("datetime", *MEASURES)
ALL_NULLS = "(" + " + ".join(nulls(c) for c in OBSERVED) + ")"
ALL_COLUMNS = ("datetime", "event_id", "user_id", *MEASURES)
ALL_COLUMNS_NULLS = "(" + " + ".join(nulls(c) for c in ALL_COLUMNS) + ")"

MISSING = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {nulls(c)} AS null_count, "
    f"{pct(nulls(c), 'count(*)', 2)} AS null_pct FROM wind"
    for c in OBSERVED
) + (
    f"\nUNION ALL SELECT '*', {ALL_NULLS}, {pct(ALL_NULLS, '(count(*) * 6)', 2)} FROM wind"
)

OUTLIERS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {outside(c)} AS outliers, "
    f"{pct(outside(c), f'count({c})', 3)} AS outlier_pct FROM wind"
    for c in REPORT_LIMITS
)


def steps(partition: str = "") -> str:
    return f"""steps AS (SELECT *,
  date_diff('microsecond', lag(datetime) OVER ({partition} {ORDER}), datetime)
    / 1000000.0::DOUBLE / 3600.0::DOUBLE AS h FROM wind)"""


GAPS = """count(*) FILTER (h > 1) AS num_gaps,
  coalesce({max_gap}, 0.0::DOUBLE) AS max_gap_hours,
  round_even(count(*) FILTER (h > 1) / count(*)::DOUBLE, 4) AS gap_fraction"""
SHORT_GAPS = GAPS.replace("(h > 1)", f"(h > {SHORT_STEP_HOURS})")


def validation(partition: str = "") -> str:
    longest = "max(h) FILTER (h > 1)"
    return with_(WIND, steps(partition)) + "SELECT count(*) AS total_records,\n  " + ",\n  ".join(
        [f"{pct(ALL_COLUMNS_NULLS, f'(count(*) * {len(ALL_COLUMNS)})', 2)} AS missing_pct"]
        + [f"{pct(nulls(c), 'count(*)', 2)} AS {c}_missing_pct" for c in ALL_COLUMNS]
        + [f"{outside(c)} AS {c}_outliers" for c in REPORT_LIMITS]
        + [f"{pct(outside(c), f'count({c})', 3)} AS {c}_outlier_pct" for c in REPORT_LIMITS]
        + [GAPS.format(max_gap=rnd(longest) if partition else longest)]
    ) + "\nFROM steps"



SAMPLES = (
    "sizes AS (SELECT "
    + ", ".join(
        f"greatest(count(*) FILTER (split = '{s}') - {WINDOW}, 0) AS {s}_samples"
        for s in ("train", "val", "test")
    )
    + " FROM splits)"
)

# --- windows -------------------------------------------------------------------------------


def windows(within: str, window: int = WINDOW, keep_split: bool = True) -> str:
    features = ", ".join(f"f.{c}::FLOAT::DOUBLE AS {c}" for c in FEATURES)
    extra = ", t.split" if within and keep_split else ""
    return SPLITS + f"""SELECT t.datetime AS target_ts, t.rn, t.storm_severity_index::FLOAT::DOUBLE AS y,
  s.step::BIGINT AS step, {features}{extra}
FROM splits t CROSS JOIN (SELECT unnest(range({window})) AS step) s
JOIN splits f ON f.rn = t.rn - {window} + s.step
WHERE t.rn >= {window} {within}"""




def inside_split(window: int) -> str:
    return f"""AND EXISTS (
  SELECT 1 FROM splits e WHERE e.rn = t.rn - {window} AND e.split = t.split)"""


# --- metrics -------------------------------------------------------------------------------

METRICS = f"""{rnd("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))")} AS rmse,
  {rnd("avg(abs(y_true - y_pred))")} AS mae,
  {rnd("1 - sum((y_true - y_pred) * (y_true - y_pred)) / (count(*) * var_pop(y_true))")} AS r2"""

TWO_INDEX = f"""two_index AS (
  SELECT 'index_weights' AS model, {index_of(DERIVED_WEIGHTS)} AS y_true,
    {index_of(INDEX_WEIGHTS)} AS y_pred FROM normed)"""

NAIVE = f"""naive AS (
  SELECT 'persistence' AS model, datetime, event_id, storm_severity_index AS y_true,
    lag(storm_severity_index) OVER ({ORDER}) AS y_pred
  FROM derived QUALIFY row_number() OVER ({ORDER}) > 1)"""

GRAM_NAMES = ("1", "bz_gsm", "speed", "density", "storm_severity_index")


def gram() -> str:
    value = {c: c for c in GRAM_NAMES} | {"1": "1.0::DOUBLE"}
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS column_name, "
        f"{rnd(f'sum({value[a]} * {value[b]})', 2)} AS total FROM derived"
        for i, a in enumerate(GRAM_NAMES)
        for b in GRAM_NAMES[i:]
    )


# --- least squares by Cramer's rule on centred moments -------------------------------------


def det3(m) -> str:
    return (
        f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
        f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
        f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    )


def least_squares(source: str, xs, y: str, det) -> str:
    """CTEs ending in ``fit``: one row with the means ``m_*`` and coefficients ``b_*``."""
    cov = {(a, b): f"c_{min(a, b)}_{max(a, b)}" for a in xs for b in (*xs, y)}
    means = ", ".join(f"avg({c}) AS m_{c}" for c in (*xs, y))
    moments = ", ".join(
        f"avg(({a} - m_{a}) * ({b} - m_{b})) AS {name}"
        for name, (a, b) in {v: k for k, v in cov.items()}.items()
    )
    matrix = [[cov[a, b] for b in xs] for a in xs]
    solved = []
    for j, x in enumerate(xs):
        swapped = [[cov[a, y] if k == j else matrix[i][k] for k in range(len(xs))] for i, a in enumerate(xs)]
        solved.append(f"{det(swapped)} / {det(matrix)} AS b_{x}")
    kept = ", ".join(f"m_{c}" for c in (*xs, y))
    return f"""means AS (SELECT {means} FROM {source} WHERE split = 'train'),
moments AS (SELECT {", ".join(f"any_value(m_{c}) AS m_{c}" for c in (*xs, y))}, {moments}
  FROM {source}, means WHERE split = 'train'),
fit AS (SELECT {kept}, {", ".join(solved)} FROM moments)"""


def fitted(xs, y: str) -> str:
    return f"m_{y} + " + " + ".join(f"b_{x} * ({x} - m_{x})" for x in xs)


BASELINE = ("bz_gsm", "speed", "density")

def window_least_squares(window: int) -> str:
    """CTEs for a linear model on all steps: moments of the windows, solved by Gauss-Jordan elimination.

    Column ``0`` of ``inputs`` is the target, ``1`` and so on are the inputs, oldest step first.
    """
    width = len(FEATURES) * window
    values = " UNION ALL ".join(
        f"SELECT rn, split, {i} AS f, {c}::FLOAT::DOUBLE AS v FROM splits" for i, c in enumerate(FEATURES)
    )
    return f"""long AS ({values}),
samples AS (
  SELECT t.rn, t.split, t.datetime AS target_ts, t.storm_severity_index::FLOAT::DOUBLE AS y FROM splits t
  WHERE EXISTS (SELECT 1 FROM splits e WHERE e.rn = t.rn - {window} AND e.split = t.split)),
inputs AS (
  SELECT s.split, s.rn, (v.rn - s.rn + {window}) * {len(FEATURES)} + v.f + 1 AS i, v.v
  FROM samples s JOIN long v ON v.split = s.split AND v.rn BETWEEN s.rn - {window} AND s.rn - 1
  UNION ALL SELECT split, rn, 0, y FROM samples),
centre AS (SELECT i, avg(v) AS m FROM inputs WHERE split = 'train' GROUP BY i),
centred AS (SELECT rn, i, v - m AS v FROM inputs JOIN centre USING (i) WHERE split = 'train'),
products AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS p FROM centred a JOIN centred b USING (rn)
  WHERE a.i > 0 GROUP BY ALL),
matrix AS (
  SELECT list(line ORDER BY i) AS m
  FROM (SELECT i, list(p ORDER BY CASE WHEN j = 0 THEN {width + 1} ELSE j END) AS line FROM products GROUP BY i)),
solving AS (
  SELECT 1 AS k, m FROM matrix
  UNION ALL
  SELECT k + 1, list_transform(range(1, {width + 1}), lambda i: list_transform(range(1, {width + 2}), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
  FROM solving WHERE k <= {width}),
solved AS (
  SELECT i, m[i][{width + 1}] AS b FROM (SELECT m FROM solving WHERE k = {width + 1}), range(1, {width + 1}) AS r(i)),
scored AS (
  SELECT rn, (SELECT m FROM centre WHERE i = 0) + sum(b * (v - m)) AS y_pred
  FROM inputs JOIN solved USING (i) JOIN centre USING (i) WHERE split = 'test' GROUP BY rn)"""


def chain(prefix: str, *parts: str) -> str:
    """More CTEs after a WITH clause."""
    return prefix.rstrip() + ",\n" + ",\n".join(parts) + "\n"


INDEX_RANGE = "(value / 200.0::DOUBLE - 0.05::DOUBLE)"
DERIVED_COLUMNS = "storm_severity_index, storm_severity_class, auroral_latitude_deg"
NORMS = "dst_norm, bz_norm, bt_norm, speed_norm, density_norm"
OBSERVATION = "datetime, bt, bz_gsm, speed, density, dst"

ORACLE: dict[str, str] = {
    "severity_summary": SPLITS + f"""SELECT storm_severity_class, count(*) AS n_rows,
  {rnd("avg(storm_severity_index)", 9)} AS mean_index, min(auroral_latitude_deg) AS min_latitude,
  CASE storm_severity_class WHEN 'quiet' THEN 0 WHEN 'minor' THEN 1 WHEN 'moderate' THEN 2
    WHEN 'severe' THEN 3 WHEN 'extreme' THEN 4 END::BIGINT AS class_rank
FROM derived GROUP BY storm_severity_class""",
    "normalise_all": with_(WIND, normed("wind")) + f"SELECT event_id, {NORMS} FROM normed",
    "severity_index": with_(WIND, derived("wind", INDEX_WEIGHTS))
    + f"SELECT event_id, {NORMS}, storm_severity_index FROM derived",
    "severity_index_wrapper": with_(WIND, derived("wind"))
    + f"SELECT event_id, {DERIVED_COLUMNS} FROM derived",
    "severity_class": f"SELECT event_id, {class_of(INDEX_RANGE)} AS storm_severity_class FROM events",
    "auroral_latitude": f"SELECT event_id, {latitude_of(INDEX_RANGE)} AS auroral_latitude_deg FROM events",
    "fixed_width_parse": with_(PARSED) + f"SELECT {OBSERVATION}, event_id FROM parsed",
    "parsed_file_range": with_(PARSED) + """SELECT year::VARCHAR || '.dat' AS file_name,
  count(*) AS n_rows, min(datetime) AS first_time, max(datetime) AS last_time
FROM parsed GROUP BY year""",
    "year_range_load": with_(PARSED)
    + f"SELECT {OBSERVATION}, event_id FROM parsed WHERE year BETWEEN 2020 AND 2023",
    "incremental_ingest": with_(
        PARSED, "manifest AS (SELECT DISTINCT datetime::DATE AS day FROM parsed WHERE speed IS NULL)"
    )
    + """SELECT year, event_id, datetime, dst FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.day = p.datetime::DATE)""",
    "json_header_rows": """SELECT ts AS time_tag, event_id::DOUBLE AS event_id,
  CASE WHEN event_id % 7 <> 0 THEN value / 4.0::DOUBLE END AS bt,
  CASE WHEN event_type <> 'error' THEN value END AS speed
FROM events""",
    "drop_missing": with_(WIND) + f"""SELECT {OBSERVATION}, event_id FROM wind
WHERE bt IS NOT NULL AND bz_gsm IS NOT NULL AND speed IS NOT NULL
  AND density IS NOT NULL AND dst IS NOT NULL""",
    "physical_limits": with_(WIND, limited("wind")) + "SELECT * FROM limited",
    "fill_gaps": with_(WIND, filled()) + f"SELECT {OBSERVATION}, event_id FROM filled",
    "fill_gaps_by_user": with_(WIND, filled("PARTITION BY user_id")) + "SELECT * FROM filled",
    "continuity_report": with_(WIND, steps())
    + f"SELECT {GAPS.format(max_gap='max(h) FILTER (h > 1)')} FROM steps",
    "continuity_report_short": with_(WIND, steps())
    + f"SELECT {SHORT_GAPS.format(max_gap=f'max(h) FILTER (h > {SHORT_STEP_HOURS})')} FROM steps",
    "continuity_report_by_user": with_(WIND, steps("PARTITION BY user_id"))
    + f"SELECT user_id, {GAPS.format(max_gap=rnd('max(h) FILTER (h > 1)'))} FROM steps GROUP BY user_id",
    "missing_report": with_(WIND) + MISSING,
    "outlier_report": with_(WIND) + OUTLIERS,
    "validation_report": validation(),
    "run_summary": chain(SPLITS, SAMPLES) + f"""SELECT *, {WINDOW}::BIGINT AS sequence_length,
  4::BIGINT AS n_features, 'bt,bz_gsm,speed,density' AS feature_names,
  'storm_severity_index' AS target_name FROM sizes""",
    "training_gate": chain(SPLITS, SAMPLES) + """SELECT 'train_samples' AS check, train_samples >= 1000 AS passed FROM sizes
UNION ALL SELECT 'val_samples', val_samples >= 200 FROM sizes
UNION ALL SELECT 'test_samples', test_samples >= 200 FROM sizes
UNION ALL SELECT 'sequence_length', min(step) = 0 AND max(step) > 0 FROM """
    + f"(SELECT unnest(range({WINDOW})) AS step) "
    + "UNION ALL SELECT 'n_features', count(*) = 4 FROM (SELECT unnest(['bt', 'bz_gsm', 'speed', 'density']))",
    "chronological_split": SPLITS + "SELECT datetime, event_id, rn, split FROM splits",
    "position_by_user": with_(
        WIND,
        f"""counted AS (SELECT user_id, datetime, event_id,
  row_number() OVER (PARTITION BY user_id {ORDER}) - 1 AS rn,
  count(*) OVER (PARTITION BY user_id) AS n_rows FROM wind)""",
    )
    + """SELECT *, CASE
  WHEN rn < n_rows - floor(n_rows * 0.15::DOUBLE) - floor(n_rows * 0.15::DOUBLE) THEN 'train'
  WHEN rn < n_rows - floor(n_rows * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM counted""",
    "prepared_split_summary": SPLITS + f"""SELECT split, storm_severity_class, count(*) AS n_rows,
  {rnd("avg(storm_severity_index)", 9)} AS mean_index,
  {rnd("avg(auroral_latitude_deg)", 9)} AS mean_latitude,
  min(datetime) AS first_time, max(datetime) AS last_time
FROM splits GROUP BY split, storm_severity_class""",
    "scaler_fit": chain(SPLITS, SCALER) + "SELECT " + ", ".join(
        f"{rnd(f'{c}_{part}')} AS {c}_{part}" for c in SCALED_COLUMNS for part in ("mean", "scale")
    ) + " FROM scaler",
    "scale_splits": chain(SPLITS, SCALER) + "SELECT datetime, event_id, split, dst, " + ", ".join(
        f"{rnd(f'({c} - {c}_mean) / {c}_scale')} AS {c}" for c in SCALED_COLUMNS
    ) + " FROM splits, scaler",
    "unscale": chain(SPLITS, SCALER) + "SELECT datetime, event_id, " + ", ".join(
        f"{rnd(f'{c} + {c}_scale')} AS {c}" for c in SCALED_COLUMNS
    ) + " FROM splits, scaler",
    "sequence_windows": windows(""),
    "sequence_windows_by_split": windows(inside_split(WINDOW)),
    "sequence_windows_by_user": with_(
        WIND,
        derived("wind"),
        f"""placed AS (SELECT *, storm_severity_index AS ssi,
  row_number() OVER (PARTITION BY user_id {ORDER}) - 1 AS rn FROM derived)""",
    )
    + """SELECT t.user_id, t.rn, t.datetime AS target_ts, t.ssi::FLOAT::DOUBLE AS y, s.step::BIGINT AS step,
  """ + ", ".join(f"f.{c}::FLOAT::DOUBLE AS {c}" for c in FEATURES) + f"""
FROM placed t CROSS JOIN (SELECT unnest(range({WINDOW})) AS step) s
JOIN placed f ON f.user_id = t.user_id AND f.rn = t.rn - {WINDOW} + s.step
WHERE t.rn >= {WINDOW}""",
    "align_features_target": UNFILLED + """SELECT x.datetime, x.event_id, x.bt, x.bz_gsm, x.speed, x.density,
  y.storm_severity_index FROM derived x JOIN derived y USING (datetime, event_id)""",
    "persistence_forecast": chain(UNFILLED, NAIVE) + "SELECT datetime, event_id, y_true, y_pred FROM naive",
    "regression_metrics": with_(WIND, limited("wind"), normed("limited"), TWO_INDEX)
    + f"SELECT {METRICS} FROM two_index",
    "persistence_metrics": chain(UNFILLED, NAIVE) + f"SELECT {METRICS} FROM naive",
    "model_comparison": chain(UNFILLED, NAIVE, TWO_INDEX) + f"""SELECT model, {METRICS} FROM (
  SELECT model, y_true, y_pred FROM naive UNION ALL SELECT model, y_true, y_pred FROM two_index)
GROUP BY model""",
    "timeseries_head": UNFILLED
    + f"SELECT datetime, event_id, storm_severity_index FROM derived {ORDER} LIMIT 500",
    "scatter_bins": with_(WIND, limited("wind"), normed("limited"), TWO_INDEX)
    + """SELECT floor(y_true / 0.05::DOUBLE)::BIGINT AS true_bin,
  floor(y_pred / 0.05::DOUBLE)::BIGINT AS pred_bin, count(*) AS points FROM two_index GROUP BY 1, 2""",
    "truth_vs_prediction": with_(WIND, limited("wind"), normed("limited"), TWO_INDEX)
    + "SELECT y_true, y_pred FROM two_index",
    "chronological_sort": with_(WIND) + f"SELECT * FROM wind {ORDER}",
    "stored_csv": with_(WIND) + f"SELECT {OBSERVATION} FROM wind",
    "stored_observations": with_(PARSED)
    + f"SELECT {OBSERVATION}, event_id, year FROM parsed WHERE year BETWEEN 2020 AND 2022",
    "stored_split": SPLITS + f"""SELECT datetime, event_id, {", ".join(FEATURES)}, storm_severity_index
FROM splits WHERE split = 'val'""",
    "stored_sequences": windows(f"{inside_split(WINDOW)} AND t.split = 'test'", keep_split=False),
    "stored_predictions": chain(UNFILLED, NAIVE, TWO_INDEX) + f"""SELECT model, {METRICS} FROM (
  SELECT model, y_true, y_pred FROM naive UNION ALL SELECT model, y_true, y_pred FROM two_index)
GROUP BY model""",
    "gram_matrix": UNFILLED + gram(),
    "linear_regression_predictions": chain(
        SPLITS, least_squares("splits", BASELINE, "storm_severity_index", det3)
    )
    + f"""SELECT 'linear_regression' AS model, datetime, event_id,
  {rnd("storm_severity_index")} AS y_true, {rnd(fitted(BASELINE, "storm_severity_index"))} AS y_pred
FROM splits, fit WHERE split = 'test'""",
    "landed_years": with_(PARSED) + f"""SELECT {OBSERVATION}, year::VARCHAR || '.dat' AS file_name, year
FROM parsed WHERE year BETWEEN 2020 AND 2023""",
    "landed_twice": with_(PARSED)
    + f"SELECT {OBSERVATION}, year::VARCHAR || '.dat' AS file_name, year FROM parsed",
    "landed_with_failures": with_(PARSED) + """SELECT year::VARCHAR || '.dat' AS file_name, count(*) AS n_rows,
  count(*) AS line_ids, min(datetime) AS first_time, max(datetime) AS last_time,
  CASE year WHEN 2021 THEN 'rejected,taken' ELSE 'taken' END AS tried, 'taken' AS status,
  count(*) AS ledger_rows
FROM parsed WHERE year BETWEEN 2019 AND 2021 GROUP BY year""",
    "rejected_payloads": """SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN 'not json' ELSE '{"bt": 1}' END AS payload
FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0""",
    "aligned_files": SPLITS + f"""SELECT split, datetime, {", ".join(FEATURES)}, storm_severity_index,
  row_number() OVER (PARTITION BY split ORDER BY rn) - 1 AS rn FROM splits""",
    "aligned_windows": f"""SELECT * REPLACE (rn - min(rn) OVER (PARTITION BY split) + {WINDOW} AS rn)
FROM ({windows(inside_split(WINDOW))})""",
    "window_batches": f"""SELECT split, batch, count(DISTINCT rn) AS samples, count(DISTINCT step) AS steps,
  {", ".join(f"{rnd(f'sum({c})', 3)} AS {c}" for c in FEATURES)},
  {rnd(f"sum(CASE WHEN step = {WINDOW - 1} THEN {' + '.join(FEATURES)} END)", 3)} AS last_step,
  {rnd(f"sum(CASE WHEN step = 0 THEN y END)")} AS y
FROM (SELECT *, (rn - min(rn) OVER (PARTITION BY split)) // 64 AS batch FROM ({windows(inside_split(WINDOW))}))
GROUP BY split, batch""",
    "run_summary_by_user": with_(
        WIND,
        filled("PARTITION BY user_id"),
        limited("filled"),
        """counted AS (SELECT user_id, count(*) AS n, floor(count(*) * 0.15::DOUBLE)::BIGINT AS part
  FROM limited GROUP BY user_id)""",
    )
    + f"""SELECT sum(greatest(n - 2 * part - {WINDOW}, 0))::BIGINT AS train_samples,
  sum(greatest(part - {WINDOW}, 0))::BIGINT AS val_samples, sum(greatest(part - {WINDOW}, 0))::BIGINT AS test_samples,
  {WINDOW}::BIGINT AS sequence_length, 4::BIGINT AS n_features,
  'bt,bz_gsm,speed,density' AS feature_names, 'storm_severity_index' AS target_name FROM counted""",
    "validation_report_by_user": validation("PARTITION BY user_id"),
    "prepared_validation": validation("PARTITION BY user_id"),
    "prepared_summary": chain(SPLITS, SAMPLES) + f"""SELECT *, {WINDOW}::BIGINT AS sequence_length,
  4::BIGINT AS n_features, (SELECT count(*) FROM splits) AS tabular_rows,
  train_samples + val_samples + test_samples AS sequence_rows FROM sizes""",
    "test_split_metrics": chain(
        SPLITS,
        SCALER,
        least_squares("splits", BASELINE, "storm_severity_index", det3),
        f"""tested AS (
  SELECT storm_severity_index AS y, {fitted(BASELINE, "storm_severity_index")} AS linear,
    lag(storm_severity_index) OVER ({ORDER}) AS naive, storm_severity_index_mean AS m, storm_severity_index_scale AS s
  FROM splits, fit, scaler WHERE split = 'test')""",
    )
    + f"""SELECT model, {METRICS} FROM (
  SELECT 'linear_regression' AS model, (y - m) / s AS y_true, (linear - m) / s AS y_pred FROM tested
  UNION ALL SELECT 'persistence', (y - m) / s, (naive - m) / s FROM tested WHERE naive IS NOT NULL)
GROUP BY model""",
    "stored_forest": chain(SPLITS, SCALER) + f"""SELECT datetime, event_id,
  {rnd("(storm_severity_index - storm_severity_index_mean) / storm_severity_index_scale")} AS y_true,
  100::BIGINT AS trees, true AS same FROM splits, scaler WHERE split = 'test'""",
    "tree_cell_means": SPLITS + f"""SELECT datetime, event_id, {rnd('''avg(storm_severity_index) OVER (PARTITION BY
    least(floor((10.0::DOUBLE - bz_gsm) / 4.0::DOUBLE), 3),
    least(floor((speed - 300.0::DOUBLE) / 50.0::DOUBLE), 3),
    least(floor(density / 5.0::DOUBLE), 3))''')} AS y_pred
FROM splits WHERE split = 'train'""",
    "linear_on_all_windows": f"""SELECT step, {", ".join(f"{rnd(f'avg(y * {c})', 5)} AS {c}" for c in FEATURES)}
FROM ({windows(inside_split(WINDOW))}) WHERE split = 'train' GROUP BY step""",
    "linear_on_window": chain(SPLITS, window_least_squares(WINDOW)).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT target_ts, {rnd("y")} AS y_true, {rnd("y_pred")} AS y_pred FROM samples JOIN scored USING (rn)""",
}
