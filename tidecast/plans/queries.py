"""One query per operator over the whole derived series table, each with its SQL where there is one."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import LAG_NAMES, MONTH_NAMES, PREDICTORS
from tidecast.functions.expressions import is_finite, linear_score, month_flags, target_horizon, target_series
from tidecast.operators import (
    evaluate,
    features,
    forecast,
    increments,
    quality,
    reference_tables,
    registry,
    selection,
    sketches,
    split,
)
from tidecast.operators.fit import WIDE_CANDIDATES, fit_models, fit_one_series, target_status, trend_models
from tidecast.operators.impute import impute
from tidecast.plans import oracle as sql
from tidecast.plans import pipeline
from tidecast.schemas import KEYS
from tidecast.sources import bucketed, tables, wide_csv
from tidecast.sources.sales_series import MAX_SERIES_ROWS, sales_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BOUND = {"max_rows": MAX_SERIES_ROWS}
# Used to run the path for series of unknown length on the short series at hand.
SPLIT = {"max_rows": None, "chunk_rows": 40}
STRETCH = 1.2345678


def query(oracle: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Fixed digits for results that depend on the order of summation; no negative zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def single(df: DataFrame, *columns: str) -> DataFrame:
    """Values of fitted models to the digits of single precision, which two ways of fitting share.

    The values keep their units. They are stretched by a factor while they are cut, because whole cents
    and halves of them would often lie just between two numbers of single precision.
    """
    plain = {c: F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.col(c)) for c in columns}
    return df.withColumns({c: (x * STRETCH).cast("float").cast("double") / STRETCH + 0.0 for c, x in plain.items()})


def r1(expression: str, name: str) -> str:
    plain = f"CASE WHEN abs({expression}) < 1e-6 THEN 0.0 ELSE {expression} END"
    return f"CAST(CAST(({plain}) * {STRETCH}e0 AS FLOAT) AS DOUBLE) / {STRETCH}e0 + 0.0 AS {name}"


# Sources

@query(f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, time_index, tourism FROM time_series")
def time_series(spark, sf_dir):
    return sales_series(spark, sf_dir)


@query(f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, time_index, tourism FROM time_series")
def time_series_stored(spark, sf_dir):
    path = tables.staging_path(spark, "time_series")
    tables.append_time_series(sales_series(spark, sf_dir), path)
    return tables.read_time_series(spark, path)


WIDE = """
wide AS (
  SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 15.0) AS INTEGER) AS step,
         l_returnflag || l_linestatus AS kind, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY 1, 2),
kinds(kind, series_id) AS (VALUES ('AF', 'm1'), ('AO', 'm2'), ('NF', 'm3'), ('NO', 'm4'), ('RF', 'm5'), ('RO', 'm6')),
placed AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS pos FROM (SELECT DISTINCT step FROM wide) s)
"""
KINDS = {"AF": "m1", "AO": "m2", "NF": "m3", "NO": "m4", "RF": "m5", "RO": "m6"}


def wide_sales(spark, sf_dir):
    """One row per 15-day step, one column per kind of line item; the calendar bounds the rows."""
    step = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 15)
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select(step.cast("int").alias("step"), F.concat("l_returnflag", "l_linestatus").alias("kind"), "l_quantity")
        .groupBy("step")
        .pivot("kind", list(KINDS))
        .agg(F.sum("l_quantity"))
        .withColumnsRenamed(KINDS)
    )


@query(
    f"WITH {WIDE} SELECT series_id, 'in' AS sample_type, step AS time_index, quantity AS tourism "
    "FROM wide JOIN kinds USING (kind) WHERE quantity IS NOT NULL"
)
def unpivot(spark, sf_dir):
    return wide_csv.unpivot_wide(wide_sales(spark, sf_dir), "step", "in")


# Six files: three frequencies, by the letter in front of the series ids, and two samples with different rows.
SAMPLE_STEP = 100
WIDE_FILES = """
samples AS (
  SELECT w.step, kind, quantity, CASE WHEN w.step < 100 THEN 'in' ELSE 'oos' END AS sample_type,
         CASE WHEN w.step < 100 THEN pos ELSE pos - (SELECT count(*) FROM placed WHERE step < 100) END AS pos
  FROM wide w JOIN placed p ON w.step = p.step),
files(freq, skipped) AS (VALUES ('m', 3), ('q', 3), ('y', 2))
"""


def wide_files(spark, sf_dir):
    """CSV folders of several ordered part files, each with its header."""
    path, paths = tables.staging_path(spark, "wide"), []
    wide = tables.staged(wide_sales(spark, sf_dir), "wide")
    for freq, name in (("m", "monthly"), ("q", "quarterly"), ("y", "yearly")):
        renamed = wide.withColumnsRenamed({k: freq + k[1:] for k in KINDS.values()})
        for sample_type, kept in (("in", F.col("step") < SAMPLE_STEP), ("oos", F.col("step") >= SAMPLE_STEP)):
            rows = renamed.where(kept).repartitionByRange(3, "step").sortWithinPartitions("step").drop("step")
            paths.append(f"{path}/{name}_{sample_type}.csv")
            rows.write.option("header", True).csv(paths[-1])
    return paths


@query(
    f"WITH {WIDE}, {WIDE_FILES} SELECT freq || substr(series_id, 2) AS series_id, sample_type, "
    "CAST(pos - skipped AS INTEGER) AS time_index, quantity AS tourism "
    "FROM samples JOIN kinds USING (kind) CROSS JOIN files WHERE quantity IS NOT NULL AND pos >= skipped"
)
def wide_csv_ingest(spark, sf_dir):
    return wide_csv.read_wide_csv(spark, wide_files(spark, sf_dir))


@query(
    f"WITH {WIDE}, {WIDE_FILES} SELECT freq || substr(series_id, 2) AS series_id, sample_type, "
    "CAST(pos AS INTEGER) AS time_index, quantity AS tourism "
    "FROM samples JOIN kinds USING (kind) CROSS JOIN files WHERE quantity IS NOT NULL"
)
def wide_csv_ingest_kept(spark, sf_dir):
    return wide_csv.read_wide_csv(spark, wide_files(spark, sf_dir), metadata="keep")


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, time_index, tourism FROM time_series "
    "WHERE lower(sample_type) = 'in'"
)
def series_extract(spark, sf_dir):
    return selection.series_extract(sales_series(spark, sf_dir), "in")


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, time_index, count(*) AS rows FROM time_series "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1"
)
def key_uniqueness(spark, sf_dir):
    return quality.duplicate_keys(sales_series(spark, sf_dir), KEYS["time_series"])


@query(
    "SELECT l_suppkey, l_shipdate, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
)
def key_duplicates(spark, sf_dir):
    return quality.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_suppkey", "l_shipdate"])


@query(f"WITH {sql.TIME_SERIES} SELECT sample_type, count(*) AS rows, count(DISTINCT series_id) AS series "
       "FROM time_series GROUP BY sample_type")
def sql_over_series(spark, sf_dir):
    return tables.run_sql(
        spark,
        "SELECT sample_type, count(*) AS rows, count(DISTINCT series_id) AS series "
        "FROM {time_series} GROUP BY sample_type",
        time_series=sales_series(spark, sf_dir),
    )


# Reference tables and profiles

@query(f"WITH {sql.TIME_SERIES}, {sql.MAX_TIME} SELECT * FROM max_time")
def max_time(spark, sf_dir):
    return reference_tables.max_time(sales_series(spark, sf_dir))


UNIFIED_SQL = (
    f"WITH {sql.TIME_SERIES}, {sql.UNIFIED} "
    "SELECT series_id, sample_type, time_index, CAST(new_time_index AS INTEGER) AS new_time_index, tourism FROM unified"
)


@query(UNIFIED_SQL)
def unified_axis(spark, sf_dir):
    return reference_tables.unified_axis(sales_series(spark, sf_dir), **BOUND)


@query(UNIFIED_SQL)
def unified_axis_joined(spark, sf_dir):
    return reference_tables.unified_axis(sales_series(spark, sf_dir))


SEASONAL_SQL = (
    f"WITH {sql.TIME_SERIES}, {sql.UNIFIED} SELECT series_id, sample_type, "
    "CAST(new_time_index AS INTEGER) AS new_time_index, tourism, lag_12, lag_4, lag_1 FROM seasonal"
)


@query(SEASONAL_SQL)
def seasonal_lags(spark, sf_dir):
    return reference_tables.seasonal_lags(sales_series(spark, sf_dir), **BOUND)


@query(SEASONAL_SQL)
def seasonal_lags_split(spark, sf_dir):
    return reference_tables.seasonal_lags(sales_series(spark, sf_dir), **SPLIT)


SCALE_SQL = f"WITH {sql.TIME_SERIES}, {sql.UNIFIED} SELECT series_id, {r('error', 5, 'error')} FROM scale_factor"


@query(SCALE_SQL)
def scale_factor(spark, sf_dir):
    return rounded(reference_tables.scale_factor(sales_series(spark, sf_dir), **BOUND), 5, "error")


@query(SCALE_SQL)
def scale_factor_split(spark, sf_dir):
    return rounded(reference_tables.scale_factor(sales_series(spark, sf_dir), **SPLIT), 5, "error")


@query(
    f"WITH {sql.TIME_SERIES}, {sql.IN_ROWS}, lagged AS ("
    f"SELECT series_id, tourism - lag(tourism, {sql.SEASON}) OVER (PARTITION BY series_id ORDER BY time_index) AS d "
    f"FROM in_rows) SELECT series_id, {r('avg(abs(d))', 5, 'error')} FROM lagged GROUP BY series_id"
)
def scale_factor_in_sample(spark, sf_dir):
    ts = sales_series(spark, sf_dir)
    return rounded(reference_tables.scale_factor(ts, in_sample_only=True, **BOUND), 5, "error")


@query(
    f"WITH {sql.TIME_SERIES}, p AS (SELECT left(series_id, 1) AS series_type, sample_type, time_index, "
    "stddev_samp(tourism) AS s, avg(tourism) AS a FROM time_series WHERE time_index < 20 GROUP BY 1, 2, 3) "
    f"SELECT series_type, sample_type, time_index, {r('s', 5, 'tourism_stddev')}, {r('a', 5, 'tourism_avg')}, "
    f"{r('a - s', 5, 'lower')}, {r('a + s', 5, 'upper')} FROM p"
)
def similarity_profile(spark, sf_dir):
    profile = selection.similarity_profile(sales_series(spark, sf_dir))
    return rounded(profile, 5, "tourism_stddev", "tourism_avg", "lower", "upper")


@query(
    f"WITH {sql.TIME_SERIES}, p AS (SELECT left(series_id, 1) AS series_type, sample_type, time_index, "
    "stddev_samp(tourism) AS s, avg(tourism) AS a FROM time_series WHERE time_index < 20 "
    "AND series_id LIKE '%q%' AND sample_type LIKE '%oos%' GROUP BY 1, 2, 3) "
    f"SELECT series_type, sample_type, time_index, {r('s', 5, 'tourism_stddev')}, {r('a', 5, 'tourism_avg')}, "
    f"{r('a - s', 5, 'lower')}, {r('a + s', 5, 'upper')} FROM p"
)
def similarity_profile_one_kind(spark, sf_dir):
    profile = selection.similarity_profile(sales_series(spark, sf_dir), "oos", "q")
    return rounded(profile, 5, "tourism_stddev", "tourism_avg", "lower", "upper")


# Reference tables brought up to date by three appended batches, against the SQL over all rows.
BATCHES = ["sample_type = 'in' AND time_index < 40", "sample_type = 'in' AND time_index >= 40", "sample_type = 'oos'"]


def appended_state(spark, sf_dir):
    ts, state = tables.staged(sales_series(spark, sf_dir), "time_series"), None
    for batch in BATCHES:
        state = tables.staged(increments.add_rows(state, ts.where(batch), **BOUND), "series-state")
    return state


@query(SCALE_SQL)
def scale_factor_appended(spark, sf_dir):
    return rounded(increments.scale_factor_of(appended_state(spark, sf_dir)), 5, "error")


@query(f"WITH {sql.TIME_SERIES}, {sql.MAX_TIME} SELECT * FROM max_time")
def max_time_appended(spark, sf_dir):
    return increments.max_time_of(appended_state(spark, sf_dir))


@query(
    f"WITH {sql.TIME_SERIES}, p AS (SELECT left(series_id, 1) AS series_type, sample_type, time_index, "
    "stddev_samp(tourism) AS s, avg(tourism) AS a FROM time_series WHERE time_index < 20 GROUP BY 1, 2, 3) "
    f"SELECT series_type, sample_type, time_index, {r('s', 4, 'tourism_stddev')}, {r('a', 4, 'tourism_avg')}, "
    f"{r('a - s', 4, 'lower')}, {r('a + s', 4, 'upper')} FROM p"
)
def similarity_profile_appended(spark, sf_dir):
    """Batches by series here, so that points of the profile are in all of them."""
    ts, state = tables.staged(sales_series(spark, sf_dir), "time_series"), None
    for part in range(3):
        batch = ts.where(F.pmod(F.xxhash64("series_id"), F.lit(3)) == part)
        state = tables.staged(increments.add_to_profile(state, batch), "profile-state")
    return rounded(increments.similarity_profile_of(state), 4, "tourism_stddev", "tourism_avg", "lower", "upper")


GRID_SQL = (
    f"WITH {sql.TIME_SERIES}, {sql.HORIZON_LIST} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, "
    "series_id || '_' || CAST(horizon AS VARCHAR) AS target "
    f"FROM (SELECT DISTINCT series_id FROM time_series) s JOIN horizon_list ON horizon <= {sql.MAX_H}"
)


@query(GRID_SQL)
def target_grid(spark, sf_dir):
    return selection.target_grid(sales_series(spark, sf_dir))


@query(f"SELECT target, series_id, horizon FROM ({GRID_SQL}) g")
def target_parse(spark, sf_dir):
    target = F.col("target")
    return selection.target_grid(sales_series(spark, sf_dir)).select(
        "target", target_series(target).alias("series_id"), target_horizon(target).alias("horizon")
    )


# Features

FUTURE_SQL = (
    f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, time_index, count(*) OVER (PARTITION BY series_id, "
    "sample_type ORDER BY time_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future_record_count "
    "FROM time_series"
)


@query(FUTURE_SQL)
def future_count(spark, sf_dir):
    return features.future_counts(sales_series(spark, sf_dir), **BOUND)


@query(FUTURE_SQL)
def future_count_split(spark, sf_dir):
    return features.future_counts(sales_series(spark, sf_dir), **SPLIT)


LAG_SQL = (
    f"WITH {sql.TIME_SERIES}, {sql.LAG_FEATURES} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, "
    f"observation_id, target, {sql.LAG_LIST}, future_record_count FROM lag_features"
)


@query(LAG_SQL)
def lag_features(spark, sf_dir):
    return features.lag_features(sales_series(spark, sf_dir), **BOUND).drop(*MONTH_NAMES)


@query(LAG_SQL)
def lag_features_split(spark, sf_dir):
    return features.lag_features(sales_series(spark, sf_dir), **SPLIT).drop(*MONTH_NAMES)


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, observation_id, {sql.MONTHS} "
    "FROM (SELECT *, time_index AS observation_id FROM time_series) t"
)
def month_onehot(spark, sf_dir):
    return sales_series(spark, sf_dir).select(
        "series_id", "sample_type", F.col("time_index").alias("observation_id"), *month_flags(F.col("time_index"))
    )


TRAIN_COLUMNS = (
    "SELECT series_id, CAST(horizon AS INTEGER) AS horizon, observation_id, target, "
    f"{sql.LAG_LIST}, {sql.MONTHS}, future_record_count"
)


@query(f"WITH {sql.TIME_SERIES}, {sql.TRAIN} {TRAIN_COLUMNS} FROM train")
def train_features(spark, sf_dir):
    return features.train_features(sales_series(spark, sf_dir), **BOUND)


@query(
    f"WITH {sql.TIME_SERIES}, {sql.LAG_FEATURES} {TRAIN_COLUMNS} FROM lag_features "
    f"WHERE lag_12 IS NOT NULL AND future_record_count > {sql.MAX_H}"
)
def train_features_by_frequency(spark, sf_dir):
    return features.train_features(sales_series(spark, sf_dir), "by_frequency", **BOUND)


@query(sql.inference("validation"))
def inference_features_validation(spark, sf_dir):
    return features.inference_features(sales_series(spark, sf_dir), "validation")


@query(sql.inference("oos"))
def inference_features_oos(spark, sf_dir):
    return features.inference_features(sales_series(spark, sf_dir), "oos")


@query(sql.inference("validation", first_horizon=0))
def inference_features_from_zero(spark, sf_dir):
    return features.inference_features(sales_series(spark, sf_dir), "validation", first_horizon=0)


@query(f"WITH {sql.TIME_SERIES}, {sql.IN_ROWS}, {sql.VALIDATION_ACTUALS} SELECT * FROM actuals")
def validation_actuals(spark, sf_dir):
    return selection.validation_actuals(sales_series(spark, sf_dir))


def _oos_sql(kept: str) -> str:
    return (
        f"WITH {sql.TIME_SERIES}, {sql.MAX_TIME} SELECT series_id, "
        "CAST(time_index + max_time AS INTEGER) AS time_index, tourism FROM time_series "
        f"JOIN max_time USING (series_id) WHERE sample_type = 'oos' AND {kept}"
    )


@query(_oos_sql("time_index < CASE WHEN left(series_id, 1) = 'm' THEN 24 ELSE 1 END"))
def oos_actuals(spark, sf_dir):
    return selection.oos_actuals(sales_series(spark, sf_dir))


@query(_oos_sql("time_index > CASE WHEN left(series_id, 1) = 'm' THEN 2 ELSE 1 END"))
def oos_actuals_shifted(spark, sf_dir):
    return selection.oos_actuals(sales_series(spark, sf_dir), phase_shift=True)


@query(f"WITH {sql.TIME_SERIES}, {sql.MAX_TIME}, {sql.OOS_ACTUALS} SELECT * FROM actuals")
def oos_observations(spark, sf_dir):
    return selection.oos_observations(sales_series(spark, sf_dir))


# Imputation and split

GAPS = """
gaps AS (
  SELECT series_id, sample_type, time_index,
         CASE WHEN time_index % 13 = 5 THEN '-' ELSE CAST(time_index AS VARCHAR) END AS target,
         CASE WHEN time_index % 7 = 3 THEN 'idk' WHEN time_index % 11 = 4 THEN 'inf'
              WHEN time_index % 17 = 6 THEN 'nan' ELSE CAST(time_index * 37 % 101 AS VARCHAR) END AS near,
         CASE WHEN time_index % 5 = 1 THEN ' idk ' ELSE CAST(time_index * 53 % 89 AS VARCHAR) END AS far
  FROM time_series),
numbers AS (
  SELECT series_id, sample_type, time_index, TRY_CAST(target AS DOUBLE) AS target,
         TRY_CAST(near AS DOUBLE) AS near, TRY_CAST(trim(far) AS DOUBLE) AS far FROM gaps),
medians AS (
  SELECT series_id, sample_type, median(CASE WHEN NOT isnan(near) THEN near END) AS near_median,
         median(far) AS far_median FROM numbers GROUP BY series_id, sample_type)
"""
IMPUTE_SQL = (
    f"WITH {sql.TIME_SERIES}, {GAPS} SELECT series_id, sample_type, time_index, target, "
    "CASE WHEN near IS NULL OR isnan(near) OR isinf(near) THEN near_median ELSE near END AS near, "
    "coalesce(far, far_median) AS far FROM numbers JOIN medians USING (series_id, sample_type) "
    "WHERE target IS NOT NULL"
)


def gappy_rows(spark, sf_dir):
    t = F.col("time_index")
    text = lambda c: c.cast("string")
    return sales_series(spark, sf_dir).select(
        "series_id",
        "sample_type",
        "time_index",
        F.when(t % 13 == 5, "-").otherwise(text(t)).alias("target"),
        F.when(t % 7 == 3, "idk").when(t % 11 == 4, "inf").when(t % 17 == 6, "nan")
        .otherwise(text(t * 37 % 101)).alias("near"),
        F.when(t % 5 == 1, " idk ").otherwise(text(t * 53 % 89)).alias("far"),
    )


@query(IMPUTE_SQL)
def impute_median(spark, sf_dir):
    return impute(gappy_rows(spark, sf_dir), ["series_id", "sample_type"], ["near", "far"], "target")


@query(IMPUTE_SQL)
def impute_median_large_groups(spark, sf_dir):
    """The same in many ranges of values, so that most groups lie in several."""
    return impute(gappy_rows(spark, sf_dir), ["series_id", "sample_type"], ["near", "far"], "target", parts=400)


@query(
    f"WITH {sql.TIME_SERIES} SELECT left(series_id, 1) AS series_type, sample_type, 'tourism' AS \"column\", count(*) AS rows, "
    "1 AS within FROM time_series GROUP BY 1, 2"
)
def median_sketch_error(spark, sf_dir):
    """Whether the medians of sketches, merged from three tables of them, keep the stated rank error."""
    keys, columns = ["series_type", "sample_type"], ["tourism"]
    rows = sales_series(spark, sf_dir).withColumn("series_type", F.substring("series_id", 1, 1))
    rows = tables.staged(rows, "time_series")
    part = F.pmod(F.xxhash64("series_id"), F.lit(3)).alias("part")
    parts = tables.staged(sketches.median_sketches(rows.select("*", part), [*keys, "part"], columns), "sketches")
    merged = sketches.merge_sketches(parts, keys, columns)
    errors = sketches.rank_errors(rows, tables.staged(sketches.sketched_medians(merged, keys, columns), "medians"), keys, columns)
    return errors.select(*keys, "column", "rows", (F.col("error") <= sketches.RANK_ERROR[800]).cast("int").alias("within"))


@query(
    f"WITH {sql.TIME_SERIES}, {GAPS}, own AS (SELECT series_id, sample_type, time_index, target, "
    "CASE WHEN left(series_id, 1) = 'q' THEN NULL ELSE near END AS near, far FROM numbers WHERE target IS NOT NULL), "
    "own_medians AS (SELECT series_id, sample_type, median(CASE WHEN NOT isnan(near) THEN near END) AS near_median, "
    "median(far) AS far_median FROM (SELECT series_id, sample_type, far, CASE WHEN left(series_id, 1) = 'q' THEN NULL "
    "ELSE near END AS near FROM numbers) n GROUP BY series_id, sample_type) "
    "SELECT series_id, sample_type, time_index, target, "
    "CASE WHEN near IS NULL OR isnan(near) OR isinf(near) THEN near_median ELSE near END AS near, "
    "coalesce(far, far_median) AS far FROM own JOIN own_medians USING (series_id, sample_type)"
)
def impute_all_missing_group(spark, sf_dir):
    """Quarterly series have no `near` at all: their rows stay, with NULL."""
    missing = F.when(F.col("series_id").startswith("q"), F.lit("idk")).otherwise(F.col("near"))
    rows = gappy_rows(spark, sf_dir).withColumn("near", missing)
    return impute(rows, ["series_id", "sample_type"], ["near", "far"], "target")


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, time_index AS observation_id, "
    "CASE WHEN substr(md5(series_id || '|' || CAST(time_index AS VARCHAR)), 1, 2) >= 'c0' "
    "THEN 'validation' ELSE 'train' END AS purpose FROM time_series WHERE sample_type = 'in'"
)
def split_rows(spark, sf_dir):
    rows = selection.in_sample(sales_series(spark, sf_dir))
    return rows.select(
        "series_id",
        F.col("time_index").alias("observation_id"),
        split.purpose(F.col("series_id"), F.col("time_index")).alias("purpose"),
    )


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, sample_type, "
    "sum(CASE WHEN isfinite(tourism) THEN 1 ELSE 0 END) AS finite_rows FROM time_series GROUP BY 1, 2"
)
def finite_values(spark, sf_dir):
    return sales_series(spark, sf_dir).groupBy("series_id", "sample_type").agg(
        F.sum(F.when(is_finite(F.col("tourism")), 1).otherwise(0)).alias("finite_rows")
    )


# Models with one predictor, which SQL can fit too

def one_predictor_models(spark, sf_dir, predictor, **options):
    return fit_models(sales_series(spark, sf_dir), [predictor], ("ols",), **{**BOUND, **options})


def _line(fitted, predictor):
    slope = F.get("coef", F.lit(1 + PREDICTORS.index(predictor)))
    out = fitted.select(
        "series_id", "horizon", "target", F.get("coef", F.lit(0)).alias("intercept"), slope.alias("slope"),
        "n_train", "train_mae", "validation_mae",
    )
    return single(out, "intercept", "train_mae", "validation_mae", "slope")


def _line_sql(predictor):
    return (
        f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models(predictor)} SELECT series_id, "
        f"CAST(horizon AS INTEGER) AS horizon, target_id AS target, {r1('a', 'intercept')}, {r1('b', 'slope')}, "
        f"n_train, {r1('train_mae', 'train_mae')}, {r1('validation_mae', 'validation_mae')} FROM models"
    )


# With two or three rows of nearly equal lags the intercept is the difference of huge numbers, so
# only the slope and the training error are compared here.
LAG_LINE_SQL = (
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models('lag_12')} SELECT series_id, "
    f"CAST(horizon AS INTEGER) AS horizon, {r1('b', 'slope')}, n_train, {r('train_mae', 3, 'train_mae')} FROM models"
)


def _lag_line(fitted):
    slope = F.get("coef", F.lit(1 + PREDICTORS.index("lag_12")))
    out = fitted.select("series_id", "horizon", slope.alias("slope"), "n_train", "train_mae")
    return single(rounded(out, 3, "train_mae"), "slope")


@query(LAG_LINE_SQL)
def fit_one_lag(spark, sf_dir):
    return _lag_line(one_predictor_models(spark, sf_dir, "lag_12"))


@query(LAG_LINE_SQL)
def fit_one_lag_split(spark, sf_dir):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    return _lag_line(fit_models(ts, ["lag_12"], ("ols",), chunk_rows=60))


# The same series with values missing by a rule, and far above zero.
GAPPY_SERIES = sql.TIME_SERIES.replace("time_series AS (", "full_series AS (") + """,
time_series AS (
  SELECT series_id, sample_type, time_index,
         CASE WHEN sample_type = 'oos' THEN tourism WHEN time_index % 29 = 7 THEN NULL
              WHEN time_index % 31 = 8 THEN 'nan'::DOUBLE WHEN time_index % 37 = 9 THEN 'inf'::DOUBLE ELSE tourism END AS tourism
  FROM full_series)
"""
GAPPY_TRAIN = f"""{sql.LAG_FEATURES},
usable AS (SELECT *, CASE WHEN substr(md5(series_id || '|' || CAST(observation_id AS VARCHAR)), 1, 2) >= 'c0'
                         THEN 'validation' ELSE 'train' END AS purpose
           FROM lag_features
           WHERE lag_12 IS NOT NULL AND future_record_count > 24 AND target IS NOT NULL AND isfinite(target)),
fills AS (SELECT series_id, horizon, coalesce(median(CASE WHEN NOT isnan(lag_1) THEN lag_1 END), 0) AS fill
          FROM usable GROUP BY series_id, horizon),
train AS (SELECT u.* REPLACE (CASE WHEN lag_1 IS NOT NULL AND isfinite(lag_1) THEN lag_1 ELSE fill END AS lag_1)
          FROM usable u JOIN fills f ON u.series_id = f.series_id AND u.horizon = f.horizon)
"""


def _lag_fit_sql(series, train):
    """Slopes to six digits: on a high level the engine's own regression keeps about nine."""
    return (
        f"WITH {series}, {train}, {sql.models('lag_1')} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, "
        f"{r('b', 6, 'slope')}, n_train, {r('train_mae', 3, 'train_mae')} FROM models"
    )


def _lag_fit(ts):
    fitted = fit_models(tables.staged(ts, "time_series"), ["lag_1"], ("ols",), **BOUND)
    slope = F.get("coef", F.lit(1 + PREDICTORS.index("lag_1")))
    out = fitted.select("series_id", "horizon", slope.alias("slope"), "n_train", "train_mae")
    return rounded(rounded(out, 3, "train_mae"), 6, "slope")


@query(_lag_fit_sql(GAPPY_SERIES, GAPPY_TRAIN))
def fit_with_gaps(spark, sf_dir):
    """NULL, NaN and infinite values: rows are chosen by horizon, other lags filled by medians."""
    t, inside = F.col("time_index"), F.col("sample_type") == "in"
    gappy = (
        F.when(~inside, F.col("tourism")).when(t % 29 == 7, F.lit(None)).when(t % 31 == 8, float("nan"))
        .when(t % 37 == 9, float("inf")).otherwise(F.col("tourism"))
    )
    return _lag_fit(sales_series(spark, sf_dir).withColumn("tourism", gappy))


@query(
    _lag_fit_sql(
        sql.TIME_SERIES.replace("time_series AS (", "full_series AS (")
        + ", time_series AS (SELECT * REPLACE (1e6 + tourism / 1e5 AS tourism) FROM full_series)",
        sql.TRAIN,
    )
)
def fit_high_level(spark, sf_dir):
    """A small spread on a high level still has its slope."""
    raised = F.lit(1e6) + F.col("tourism") / F.lit(1e5)
    return _lag_fit(sales_series(spark, sf_dir).withColumn("tourism", raised))


@query(_line_sql("observation_id"))
def fit_trend(spark, sf_dir):
    return _line(one_predictor_models(spark, sf_dir, "observation_id"), "observation_id")


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN} SELECT series_id, {r1('regr_slope(target, observation_id)', 'slope')}, "
    f"{r1('regr_intercept(target, observation_id)', 'intercept')}, count(*) AS rows "
    "FROM train WHERE horizon = 1 GROUP BY series_id"
)
def trend_model(spark, sf_dir):
    trend = trend_models(sales_series(spark, sf_dir), **BOUND)
    return single(trend, "slope", "intercept")


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.HORIZON_LIST}, grid AS ({GRID_SQL.split(', ' + sql.HORIZON_LIST)[1].strip()}) "
    "SELECT g.series_id, g.horizon, CASE WHEN n > 0 THEN 'fitted' ELSE 'no_training_rows' END AS status "
    "FROM grid g LEFT JOIN (SELECT series_id, horizon, count(*) AS n FROM train WHERE purpose = 'train' GROUP BY 1, 2) t "
    "ON g.series_id = t.series_id AND g.horizon = t.horizon"
)
def fit_status(spark, sf_dir):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    return target_status(ts, fit_models(ts, ["lag_12"], ("ols",), **BOUND))


def bucketed_series(spark, sf_dir):
    """The series table stored by series id, in buckets that grow with it."""
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    path = tables.staging_path(spark, "bucketed-series")
    return spark.table(bucketed.write_bucketed(ts, path, bucketed.buckets_for(ts.count())))


@query(f"SELECT * FROM ({_line_sql('observation_id')}) m WHERE series_id = 'm1'", name="fit_one_series")
def fit_single_series(spark, sf_dir):
    """All horizons of one series out of the whole table."""
    fitted = fit_one_series(bucketed_series(spark, sf_dir), "M1", predictors=["observation_id"], candidates=("ols",), **BOUND)
    return _line(fitted, "observation_id")


@query(
    f"WITH {sql.TIME_SERIES} SELECT series_id, time_index, tourism FROM time_series "
    "WHERE sample_type = 'in' AND series_id = 'q3'"
)
def series_extract_one(spark, sf_dir):
    return selection.series_extract(bucketed_series(spark, sf_dir), "IN", "Q3")


# Registry

def stored_models(spark, sf_dir, runs=("observation_id",), create_date=None):
    """A registry filled by one fit run per predictor, on the whole series table."""
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    store = pipeline.new_registry(spark)
    for predictor in runs:
        pipeline.fit_and_store(store, ts, [predictor], ("ols",), create_date=create_date, **BOUND)
    return ts, store


TWO_RUNS = f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models('lag_12', 'first')}, {sql.models('observation_id', 'second')}"
ONE_RUN = f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models('observation_id')}"


@query(
    f"{TWO_RUNS} SELECT target_id AS target, 1 AS model_id, 'lag_12' AS predictor FROM first "
    "UNION ALL SELECT target_id, 2, 'observation_id' FROM second"
)
def predictor_lookup(spark, sf_dir):
    _, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    return registry.predictor_names(store.read("predictors")).select(
        "target", "model_id", F.array_join("predictors", ",").alias("predictor")
    )


@query(
    f"{TWO_RUNS} SELECT target_id AS target, 2 AS model_id, {r1('a', 'intercept')}, {r1('b', 'slope')} FROM second"
)
def latest_model(spark, sf_dir):
    _, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    slope = F.get("coef", F.lit(1 + PREDICTORS.index("observation_id")))
    models = registry.latest_models(store.read("model_storage"))
    models = models.select("target", "model_id", F.get("coef", F.lit(0)).alias("intercept"), slope.alias("slope"))
    return single(models, "intercept", "slope")


@query(
    f"{TWO_RUNS} SELECT f.target_id AS target, CASE WHEN f.validation_mae < s.validation_mae THEN 1 ELSE 2 END AS model_id "
    "FROM first f JOIN second s ON f.target_id = s.target_id "
    "WHERE f.validation_mae IS NOT NULL AND s.validation_mae IS NOT NULL"
)
def best_model(spark, sf_dir):
    _, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    best = registry.best_models(store.read("model_storage"), store.read("fit_performance"))
    return best.select("target", "model_id")


@query(f"{TWO_RUNS} SELECT g.target, CASE WHEN m.target_id IS NULL THEN 1 ELSE 3 END AS model_id FROM "
       f"(SELECT DISTINCT series_id || '_1' AS target FROM time_series) g LEFT JOIN second m ON m.target_id = g.target")
def next_model_id(spark, sf_dir):
    ts, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    targets = selection.target_grid(ts).where("horizon = 1").select("target")
    return registry.next_model_ids(targets, store.read("model_storage"))


@query(
    f"{ONE_RUN} SELECT target_id AS target, 1 AS model_id, p.purpose, 'neg_mean_absolute_error' AS loss_function, "
    f"{r1('p.v', 'performance')} FROM models CROSS JOIN LATERAL "
    "(SELECT 'train' AS purpose, -train_mae AS v UNION ALL SELECT 'validation', -validation_mae) p WHERE p.v IS NOT NULL"
)
def fit_performance(spark, sf_dir):
    _, store = stored_models(spark, sf_dir)
    return single(store.read("fit_performance"), "performance")


@query(f"{ONE_RUN} SELECT target_id AS target, 1 AS model_id, DATE '2020-02-29' AS create_date FROM models")
def model_dates(spark, sf_dir):
    _, store = stored_models(spark, sf_dir, create_date="2020-02-29")
    return store.read("models")


RECORDS_SQL = (
    f"{ONE_RUN}, records AS (SELECT m.target_id, t.* FROM train t JOIN models m "
    "ON t.series_id = m.series_id AND t.horizon = m.horizon)"
)


@query(f"{RECORDS_SQL} SELECT target_id AS target, 1 AS model_id, purpose, observation_id FROM records")
def record_ids(spark, sf_dir):
    _, store = stored_models(spark, sf_dir)
    return store.read("record_ids")


@query(
    f"{RECORDS_SQL} SELECT target_id, CAST(horizon AS INTEGER) AS horizon, observation_id, target, {sql.LAG_LIST} "
    "FROM records WHERE purpose = 'train'"
)
def train_records(spark, sf_dir):
    ts, store = stored_models(spark, sf_dir)
    rows = evaluate.train_records(ts, store.read("record_masks"), **BOUND)
    return rows.select("target_id", "horizon", "observation_id", "target", *LAG_NAMES)


TRAIN_RECORDS_SQL = (
    f"{RECORDS_SQL} SELECT target_id, CAST(horizon AS INTEGER) AS horizon, observation_id, target, {sql.LAG_LIST} "
    "FROM records WHERE purpose = 'train'"
)


def co_located_records(spark, sf_dir):
    """Series and record masks stored by series id, and the training records joined inside the buckets."""
    session = bucketed.co_located_session(spark)
    ts, store = stored_models(spark, sf_dir)
    buckets = bucketed.buckets_for(ts.count())
    series_path, masks_path = (tables.staging_path(spark, n) for n in ("bucketed-series", "bucketed-masks"))
    series = bucketed.write_bucketed(ts, series_path, buckets)
    masks = bucketed.write_bucketed(
        store.read("record_masks"), masks_path, buckets, order=("series_id", "observation_id")
    )
    return evaluate.train_records(session.table(series), session.table(masks), **BOUND)


@query(TRAIN_RECORDS_SQL)
def train_records_bucketed(spark, sf_dir):
    rows = co_located_records(spark, sf_dir)
    return rows.select("target_id", "horizon", "observation_id", "target", *LAG_NAMES)


@query(
    f"{RECORDS_SQL} SELECT r.series_id, CAST(r.horizon AS INTEGER) AS horizon, 1 AS model_id, observation_id, "
    f"{r1('a + b * observation_id', 'score')}, {r1('a + b * observation_id - target', 'error')} FROM records r JOIN models m "
    "ON r.target_id = m.target_id WHERE purpose = 'train'"
)
def train_residuals(spark, sf_dir):
    ts, store = stored_models(spark, sf_dir)
    scores = evaluate.recorded_scores(ts, store.read("record_masks"), pipeline.current_models(store), **BOUND)
    residuals = evaluate.train_residuals(scores)
    return single(residuals, "score", "error")


@query(
    f"{RECORDS_SQL} SELECT m.target_id AS target, 1 AS model_id, purpose, {r1('-avg(abs(target - a - b * observation_id))', 'repeated')}, "
    "1 AS passed FROM records r JOIN models m ON r.target_id = m.target_id GROUP BY m.target_id, purpose"
)
def evaluate_fit(spark, sf_dir):
    ts, store = stored_models(spark, sf_dir)
    models = pipeline.current_models(store)
    scores = evaluate.recorded_scores(ts, store.read("record_masks"), models, **BOUND)
    checked = evaluate.evaluate_fit(scores, None, store.read("fit_performance"), models)
    return single(
        checked.select("target", "model_id", "purpose", "repeated", F.col("pass").cast("int").alias("passed")),
        "repeated",
    )


@query(
    f"{RECORDS_SQL} SELECT target_id AS target, 1 AS model_id, purpose, count(*) AS rows, 1 AS passed FROM records GROUP BY 1, 2, 3"
)
def fingerprint_check(spark, sf_dir):
    """The training rows, read again in another order, are the ones the models were fitted on."""
    ts, store = stored_models(spark, sf_dir)
    again = registry.fingerprints(ts.repartition(7, "tourism"), store.read("record_masks"), **BOUND)
    checked = evaluate.changed_rows(store.read("fingerprints"), again)
    return checked.withColumn("passed", F.col("pass").cast("int")).drop("pass")


# A row is touched by a change at step 30 if it is that row or has it among the twelve lags of its horizon.
@query(
    f"{RECORDS_SQL} SELECT target_id AS target, 1 AS model_id, purpose, count(*) AS rows, "
    "CAST(NOT bool_or(observation_id = 30 OR observation_id - horizon - 30 BETWEEN 1 AND 12) AS INTEGER) AS passed "
    "FROM records GROUP BY 1, 2, 3"
)
def fingerprint_changed(spark, sf_dir):
    """One value of each series changed after the fit fails exactly the models that used it."""
    ts, store = stored_models(spark, sf_dir)
    changed = (F.col("sample_type") == "in") & (F.col("time_index") == 30)
    ts = ts.withColumn("tourism", F.when(changed, F.col("tourism") + 0.01).otherwise(F.col("tourism")))
    checked = evaluate.changed_rows(store.read("fingerprints"), registry.fingerprints(ts, store.read("record_masks"), **BOUND))
    return checked.withColumn("passed", F.col("pass").cast("int")).drop("pass")


# Scoring and forecasts

def line_models(spark, sf_dir, predictor="observation_id"):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    fitted = fit_models(ts, [predictor], ("ols",), **BOUND).withColumn("model_id", F.lit(1))
    return ts, tables.staged(fitted, "models")


@query(
    f"{ONE_RUN} SELECT t.series_id, CAST(t.horizon AS INTEGER) AS horizon, observation_id, "
    f"{r1('a + b * observation_id', 'score')} FROM train t JOIN models m ON t.series_id = m.series_id AND t.horizon = m.horizon"
)
def batch_score(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    scored = forecast.scored_features(ts, models, **BOUND)
    return single(scored.select("series_id", "horizon", "observation_id", "score"), "score")


@query(
    f"{TWO_RUNS} SELECT t.series_id, CAST(t.horizon AS INTEGER) AS horizon, 2 AS model_id, observation_id, "
    f"{r1('a + b * observation_id', 'score')} FROM train t JOIN second m ON t.series_id = m.series_id AND t.horizon = m.horizon"
)
def score_by_predictors(spark, sf_dir):
    """The newest models, through the list of predictors stored for them."""
    ts, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    newest = registry.latest_models(store.read("model_storage"))
    models = registry.scoring_models(forecast.aligned_coefficients(newest, store.read("predictors")))
    scores = forecast.train_scores(ts, models, **BOUND)
    return single(scores.select("series_id", "horizon", "model_id", "observation_id", "score"), "score")


# Of stored coefficients for all predictors only these three count, since only they are listed.
LISTED = ["lag_2", "observation_id", "month_5"]


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, 1 AS model_id, observation_id, "
    + r("7.0 + 0.25 * lag_2 + 3.0 * observation_id + CASE WHEN observation_id % 12 = 5 THEN 50.0 ELSE 0.0 END", 5, "score")
    + " FROM train"
)
def score_by_listed_predictors(spark, sf_dir):
    """Models with more coefficients than listed predictors: the others are left out of the score."""
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    coef = F.array(*map(F.lit, [7.0, *FIXED_COEF[1:]]))
    models = selection.target_grid(ts).select("target", F.lit(1).alias("model_id"), coef.alias("coef"))
    names = F.transform(F.array(*map(F.lit, LISTED)), lambda name: F.concat(F.lit(" "), name))
    listed = models.select("target", "model_id", F.posexplode(names).alias("predictor_index", "predictor"))
    aligned = registry.scoring_models(forecast.aligned_coefficients(models, listed))
    scores = forecast.train_scores(ts, aligned, **BOUND)
    return rounded(scores.select("series_id", "horizon", "model_id", "observation_id", "score"), 5, "score")


@query(
    f"{TWO_RUNS} SELECT t.series_id, CAST(t.horizon AS INTEGER) AS horizon, 1 AS model_id, observation_id, "
    f"{r('a + b * lag_12', 3, 'score')} FROM train t JOIN first m ON t.series_id = m.series_id AND t.horizon = m.horizon"
)
def score_model_id(spark, sf_dir):
    """A chosen model of each target instead of the newest."""
    ts, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    models = registry.scoring_models(store.read("model_storage").where("model_id = 1"))
    scores = forecast.train_scores(ts, models, **BOUND)
    return rounded(scores.select("series_id", "horizon", "model_id", "observation_id", "score"), 3, "score")


@query(
    f"{ONE_RUN}, counted AS (SELECT 'model_storage' AS name, count(*) AS rows FROM models UNION ALL "
    "SELECT 'predictors', count(*) FROM models UNION ALL SELECT 'models', count(*) FROM models UNION ALL "
    "SELECT 'fit_performance', count(train_mae) + count(validation_mae) FROM models UNION ALL "
    "SELECT 'fingerprints', count(train_mae) + count(validation_mae) FROM models UNION ALL "
    "SELECT 'record_ids', count(*) FROM train t JOIN models m ON t.series_id = m.series_id AND t.horizon = m.horizon) "
    "SELECT name, rows, 0 AS duplicates FROM counted"
)
def registry_keys(spark, sf_dir):
    """Rows of the registry tables and how many key values occur more than once."""
    _, store = stored_models(spark, sf_dir)
    checks = [
        store.read(name)
        .groupBy(*KEYS[name])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicates"))
        .select(F.lit(name).alias("name"), "rows", F.col("duplicates").cast("int").alias("duplicates"))
        for name in store_tables()
    ]
    return reduce(DataFrame.unionAll, checks)


def store_tables():
    return [name for name in KEYS if name != "time_series"]


# The model search: two candidates over the same folds as SQL can fit them.
SEARCH_SQL = f"""WITH {sql.TIME_SERIES}, {sql.TRAIN},
folded AS (SELECT *, CAST('0x' || substr(md5(series_id || '|' || CAST(observation_id AS VARCHAR)), 3, 4) AS INTEGER) % 3 AS fold,
                  CASE {sql.SEASON} - horizon % {sql.SEASON} {" ".join(f"WHEN {k} THEN lag_{k}" for k in range(1, 13))} END AS season
           FROM train WHERE purpose = 'train'),
lines AS (SELECT f.series_id, f.horizon, g.fold,
                 CASE WHEN min(observation_id) < max(observation_id) THEN regr_slope(target, observation_id) ELSE 0 END AS b,
                 CASE WHEN min(observation_id) < max(observation_id) THEN regr_intercept(target, observation_id) ELSE avg(target) END AS a
          FROM folded f JOIN (VALUES (0), (1), (2)) g(fold) ON f.fold <> g.fold GROUP BY 1, 2, 3),
naive AS (SELECT series_id, horizon, avg(abs(season - target)) AS cv, count(*) AS n FROM folded GROUP BY 1, 2),
trend AS (SELECT f.series_id, f.horizon, CASE WHEN count(*) = count(a) THEN avg(abs(a + b * observation_id - target)) END AS cv
          FROM folded f LEFT JOIN lines l ON f.series_id = l.series_id AND f.horizon = l.horizon AND f.fold = l.fold GROUP BY 1, 2)
SELECT n.series_id, CAST(n.horizon AS INTEGER) AS horizon, n AS n_train,
       CASE WHEN t.cv < n.cv - 1e-6 THEN 'trend' ELSE 'naive' END AS family, {r1('CASE WHEN t.cv < n.cv THEN t.cv ELSE n.cv END', 'cv_mae')}
FROM naive n JOIN trend t ON n.series_id = t.series_id AND n.horizon = t.horizon"""


@query(SEARCH_SQL)
def fit_search(spark, sf_dir):
    """The chosen candidate of each target and its cross-validated error."""
    fitted = fit_models(sales_series(spark, sf_dir), candidates=("naive", "trend"), **BOUND).where("n_train > 0")
    return single(fitted.select("series_id", "horizon", "n_train", "family", "cv_mae"), "cv_mae")


# Two predictors have closed forms: ridge by the inverse of a 2 x 2 matrix, lasso by the column with the
# larger correlation and then, if its residual still pulls enough, both. A fold's model leaves it out.
LINEAR_SQL = f"""WITH {sql.TIME_SERIES}, {sql.TRAIN},
folded AS (SELECT series_id, horizon, target AS y, lag_1 AS x1, lag_12 AS x2,
                  CAST('0x' || substr(md5(series_id || '|' || CAST(observation_id AS VARCHAR)), 3, 4) AS INTEGER) % 3 AS fold
           FROM train WHERE purpose = 'train'),
moments AS (SELECT f.series_id, f.horizon, g.fold, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay,
                CASE WHEN min(x1) < max(x1) THEN stddev_pop(x1) END AS s1, CASE WHEN min(x2) < max(x2) THEN stddev_pop(x2) END AS s2,
                covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
         FROM folded f JOIN (VALUES (0), (1), (2)) g(fold) ON f.fold <> g.fold GROUP BY 1, 2, 3),
scaled AS (SELECT *, coalesce(c12 / (s1 * s2), 0) AS rho, coalesce(c1 / s1, 0) AS r1, coalesce(c2 / s2, 0) AS r2 FROM moments),
chosen AS (SELECT *, abs(r1) >= abs(r2) * (1 - 1e-9) AS one, 0.1 * greatest(abs(r1), abs(r2)) AS pen FROM scaled),
alone AS (SELECT *, CASE WHEN one THEN r1 ELSE r2 END AS rj, CASE WHEN one THEN r2 ELSE r1 END AS rk FROM chosen),
pulled AS (SELECT *, rk - rho * sign(rj) * (abs(rj) - pen) AS pull FROM alone),
slopes AS (
  SELECT series_id, horizon, fold, a1, a2, ay, one, s1, s2,
         (1.1 * r1 - rho * r2) / (1.21 - rho * rho) AS ridge1, (1.1 * r2 - rho * r1) / (1.21 - rho * rho) AS ridge2,
         CASE WHEN abs(pull) <= pen * (1 + 1e-9) THEN sign(rj) * (abs(rj) - pen)
              ELSE (rj - pen * sign(rj) - rho * (rk - pen * sign(pull))) / (1 - rho * rho) END AS bj,
         CASE WHEN abs(pull) <= pen * (1 + 1e-9) THEN 0
              ELSE (rk - pen * sign(pull) - rho * (rj - pen * sign(rj))) / (1 - rho * rho) END AS bk
  FROM pulled),
lines AS (SELECT series_id, horizon, fold, a1, a2, ay, coalesce(ridge1 / s1, 0) AS ridge1, coalesce(ridge2 / s2, 0) AS ridge2,
                 coalesce(CASE WHEN one THEN bj ELSE bk END / s1, 0) AS lasso1,
                 coalesce(CASE WHEN one THEN bk ELSE bj END / s2, 0) AS lasso2
          FROM slopes),
errors AS (SELECT f.series_id, f.horizon, count(*) AS n, count(*) = count(ay) AS whole,
                  avg(abs(ay + ridge1 * (x1 - a1) + ridge2 * (x2 - a2) - y)) AS ridge,
                  avg(abs(ay + lasso1 * (x1 - a1) + lasso2 * (x2 - a2) - y)) AS lasso
           FROM folded f LEFT JOIN lines l ON f.series_id = l.series_id AND f.horizon = l.horizon AND f.fold = l.fold GROUP BY 1, 2)
SELECT series_id, CAST(horizon AS INTEGER) AS horizon, n AS n_train,
       CASE WHEN whole AND lasso < ridge * (1 - 1e-9) THEN 'lasso:0.1' ELSE 'ridge:0.1' END AS family,
       {r1("CASE WHEN NOT whole THEN CAST('inf' AS DOUBLE) WHEN lasso < ridge * (1 - 1e-9) THEN lasso ELSE ridge END", 'cv_mae')}
FROM errors"""


@query(LINEAR_SQL)
def fit_search_linear(spark, sf_dir):
    """As `fit_search`, between a ridge and a lasso on two predictors."""
    fitted = fit_models(sales_series(spark, sf_dir), ["lag_1", "lag_12"], ("ridge:0.1", "lasso:0.1"), **BOUND)
    return single(fitted.where("n_train > 0").select("series_id", "horizon", "n_train", "family", "cv_mae"), "cv_mae")


@query(LINEAR_SQL)
def fit_search_linear_split(spark, sf_dir):
    """The same in chunks, as series of unknown length are fitted."""
    ts = sales_series(spark, sf_dir)
    fitted = fit_models(ts, ["lag_1", "lag_12"], ("ridge:0.1", "lasso:0.1"), **SPLIT)
    return single(fitted.where("n_train > 0").select("series_id", "horizon", "n_train", "family", "cv_mae"), "cv_mae")


@query(
    f"{ONE_RUN} SELECT t.series_id, CAST(t.horizon AS INTEGER) AS horizon, 1 AS model_id, observation_id, target, "
    f"{r1('a + b * observation_id', 'score')} FROM train t JOIN models m ON t.series_id = m.series_id AND t.horizon = m.horizon"
)
def train_scores(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    return single(forecast.train_scores(ts, models, **BOUND), "score")


# Fixed coefficients, set by hand: 0.5, 0.25 and 0.125 of the three nearest lags, 3 per time step,
# and 10 times the month number.
FIXED_SQL = "0.5 * lag_1 + 0.25 * lag_2 + 0.125 * lag_3 + 3.0 * observation_id + 10.0 * (observation_id % 12)"
FIXED_COEF = [0.0, 3.0, 0.5, 0.25, 0.125] + [0.0] * 9 + [10.0 * m for m in range(12)]


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, observation_id, "
    f"{r(FIXED_SQL, 5, 'score')} FROM train"
)
def score_fixed_model(spark, sf_dir):
    rows = features.train_features(sales_series(spark, sf_dir), **BOUND)
    coef = F.array(*map(F.lit, FIXED_COEF))
    score = linear_score(coef, F.col("observation_id"), [F.col(n) for n in LAG_NAMES])
    return rounded(rows.select("series_id", "horizon", "observation_id", score.alias("score")), 5, "score")


def _forecast_sql(pred_type, tail):
    return f"WITH {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models('observation_id')}, {sql.anchors(pred_type)}, {sql.DIRECT} {tail}"


DIRECT_TAIL = (
    "SELECT series_id, CAST(horizon AS INTEGER) AS horizon, time_index, " + r1("score", "score") + " FROM direct"
)


@query(_forecast_sql("validation", DIRECT_TAIL))
def direct_forecast_validation(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    out = forecast.direct_forecast(ts, models, "validation")
    return single(out.select("series_id", "horizon", "time_index", "score"), "score")


@query(_forecast_sql("oos", DIRECT_TAIL))
def direct_forecast_oos(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    out = forecast.direct_forecast(ts, models, "oos")
    return single(out.select("series_id", "horizon", "time_index", "score"), "score")


@query(
    f"{TWO_RUNS}, {sql.anchors('oos')}, best AS (SELECT f.series_id, f.horizon, "
    "CASE WHEN f.validation_mae < s.validation_mae THEN 1 ELSE 2 END AS model_id, f.a AS a1, f.b AS b1, s.a AS a2, s.b AS b2 "
    "FROM first f JOIN second s ON f.target_id = s.target_id "
    "WHERE f.validation_mae IS NOT NULL AND s.validation_mae IS NOT NULL) "
    "SELECT b.series_id, CAST(horizon AS INTEGER) AS horizon, model_id, CAST(anchor_time + horizon AS INTEGER) AS time_index, "
    + r("CASE WHEN model_id = 1 THEN a1 + b1 * lag_12 ELSE a2 + b2 * (anchor_time + horizon) END", -1, "score")
    + " FROM best b JOIN anchors n ON b.series_id = n.series_id"
)
def forecast_best_model(spark, sf_dir):
    """Each target is forecast by whichever of its stored models scored best on validation rows.

    To tens of values near a million: a line through a few nearly equal lags has few certain digits.
    """
    ts, store = stored_models(spark, sf_dir, ("lag_12", "observation_id"))
    best = registry.best_models(store.read("model_storage"), store.read("fit_performance"))
    out = forecast.direct_forecast(ts, registry.scoring_models(best), "oos")
    return rounded(out.select("series_id", "horizon", "model_id", "time_index", "score"), -1, "score")


def _recursive_sql(pred_type, feed, tail, extra=""):
    return (
        f"WITH RECURSIVE {sql.TIME_SERIES}, {sql.TRAIN}, {sql.models('lag_1')}, {sql.anchors(pred_type)}, "
        f"{sql.recursive(feed)}{extra} {tail}"
    )


RECURSIVE_TAIL = (
    "SELECT series_id, CAST(horizon AS INTEGER) AS horizon, CAST(anchor_time + horizon AS INTEGER) AS time_index, "
    + r1("now", "score") + " FROM recursive"
)


@query(_recursive_sql("validation", "aligned", RECURSIVE_TAIL))
def recursive_forecast_validation(spark, sf_dir):
    ts, models = line_models(spark, sf_dir, "lag_1")
    out = forecast.recursive_forecast(ts, models, "validation")
    return single(out.select("series_id", "horizon", "time_index", "score"), "score")


@query(_recursive_sql("oos", "immediate", RECURSIVE_TAIL))
def recursive_forecast_immediate(spark, sf_dir):
    ts, models = line_models(spark, sf_dir, "lag_1")
    out = forecast.recursive_forecast(ts, models, "oos", feed="immediate")
    return single(out.select("series_id", "horizon", "time_index", "score"), "score")


# Evaluation

def _mase_sql(scores, pairing="step = horizon"):
    return (
        f"SELECT f.series_id, count(*) AS steps, {r1('avg(abs(tourism - score))', 'mae')}, "
        f"{r1('avg(abs(tourism - score)) / any_value(error)', 'mase')} FROM {scores} f "
        f"JOIN actuals a ON f.series_id = a.series_id AND {pairing} "
        "JOIN scale_factor s ON f.series_id = s.series_id GROUP BY f.series_id"
    )


def _rounded_mase(df):
    return single(df, "mae", "mase")


def _scores(ts):
    return reference_tables.scale_factor(ts, **BOUND)


@query(
    f"WITH {sql.TIME_SERIES}, {sql.UNIFIED}, {sql.IN_ROWS}, {sql.VALIDATION_ACTUALS}, {sql.anchors('validation')}, "
    f"{sql.HORIZON_LIST}, naive AS (SELECT a.series_id, h.horizon, CASE {sql.SEASON.replace('series_id', 'a.series_id')} - h.horizon % {sql.SEASON.replace('series_id', 'a.series_id')} "
    + " ".join(f"WHEN {k} THEN lag_{k}" for k in range(1, 13))
    + f" END AS score FROM anchors a JOIN horizon_list h ON h.horizon <= {sql.MAX_H.replace('series_id', 'a.series_id')} "
    "JOIN (SELECT series_id, max(pos) AS n FROM in_rows GROUP BY 1) z ON z.series_id = a.series_id "
    "AND h.horizon <= z.n - 37) "
    + _mase_sql("naive")
)
def seasonal_naive_mase(spark, sf_dir):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    models = fit_models(ts, candidates=("naive",), **BOUND).withColumn("model_id", F.lit(1))
    forecasts = forecast.direct_forecast(ts, models, "validation")
    return _rounded_mase(evaluate.mase(forecasts, selection.validation_actuals(ts), _scores(ts)))


@query(_forecast_sql("validation", ", ".join(["", sql.UNIFIED, sql.VALIDATION_ACTUALS]) + _mase_sql("direct")))
def mase_direct(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    forecasts = forecast.direct_forecast(ts, models, "validation")
    return _rounded_mase(evaluate.mase(forecasts, selection.validation_actuals(ts), _scores(ts)))


@query(_forecast_sql("oos", ", ".join(["", sql.UNIFIED, sql.OOS_ACTUALS]) + _mase_sql("direct")))
def mase_direct_oos(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    forecasts = forecast.direct_forecast(ts, models, "oos")
    return _rounded_mase(evaluate.mase(forecasts, selection.oos_observations(ts), _scores(ts)))


@query(
    _forecast_sql(
        "oos",
        f", {sql.UNIFIED}, numbered AS (SELECT series_id, tourism, "
        "row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS step FROM time_series "
        "WHERE sample_type = 'oos' AND time_index > CASE WHEN left(series_id, 1) = 'm' THEN 2 ELSE 1 END), "
        "actuals AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM numbered) "
        "SELECT f.series_id, any_value(n) AS actuals, "
        + r1(f"CASE WHEN any_value(n) = any_value({sql.MAX_H.replace('series_id', 'f.series_id')}) THEN avg(abs(tourism - score)) / any_value(error) END", "mase")
        + " FROM direct f JOIN actuals a ON f.series_id = a.series_id AND step = horizon "
        "JOIN scale_factor s ON f.series_id = s.series_id GROUP BY f.series_id",
    )
)
def mase_by_position(spark, sf_dir):
    ts, models = line_models(spark, sf_dir)
    forecasts = forecast.direct_forecast(ts, models, "oos")
    actuals = selection.oos_actuals(ts, phase_shift=True)
    return single(evaluate.mase_by_position(forecasts, actuals, _scores(ts)), "mase")


@query(
    _recursive_sql(
        "validation", "aligned", _mase_sql("(SELECT series_id, horizon, now AS score FROM recursive)"),
        f", {sql.UNIFIED}, {sql.VALIDATION_ACTUALS}",
    )
)
def mase_recursive(spark, sf_dir):
    ts, models = line_models(spark, sf_dir, "lag_1")
    forecasts = forecast.recursive_forecast(ts, models, "validation")
    return _rounded_mase(evaluate.mase(forecasts, selection.validation_actuals(ts), _scores(ts)))


DIFF_SQL = _recursive_sql(
    "validation",
    "aligned",
    "",
    f", {sql.UNIFIED}, {sql.VALIDATION_ACTUALS}, "
    "direct AS (SELECT a.series_id, m.horizon, a + b * lag_1 AS score FROM anchors a JOIN models m ON a.series_id = m.series_id), "
    "scored AS (SELECT 'd' AS method, series_id, horizon, score FROM direct UNION ALL "
    "SELECT 'r', series_id, horizon, now FROM recursive), "
    "mases AS (SELECT method, f.series_id, avg(abs(tourism - score)) / any_value(error) AS mase FROM scored f "
    "JOIN actuals a ON f.series_id = a.series_id AND step = horizon JOIN scale_factor s ON f.series_id = s.series_id "
    "GROUP BY method, f.series_id), "
    "diffs AS (SELECT d.series_id, d.mase AS direct, r.mase AS recursive, d.mase - r.mase AS diff FROM mases d "
    "JOIN mases r ON d.series_id = r.series_id WHERE d.method = 'd' AND r.method = 'r')",
)


@query(
    f"{DIFF_SQL} SELECT series_id, {r1('direct', 'direct')}, {r1('recursive', 'recursive')}, {r1('diff', 'diff')} FROM diffs"
)
def mase_diff(spark, sf_dir):
    ts, models = line_models(spark, sf_dir, "lag_1")
    return single(pipeline.compare_methods(ts, models, "validation", **BOUND), "direct", "recursive", "diff")


@query(
    f"{DIFF_SQL} SELECT count(diff) AS series, {r1('sum(diff)', 'total')}, {r1('avg(diff)', 'mean')}, "
    f"{r1('median(diff)', 'median')} FROM diffs"
)
def mase_diff_summary(spark, sf_dir):
    ts, models = line_models(spark, sf_dir, "lag_1")
    differences = tables.staged(pipeline.compare_methods(ts, models, "validation", **BOUND), "differences")
    return single(evaluate.difference_summary(differences), "total", "mean", "median")


@query(
    f"{ONE_RUN} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, 1 AS model_id, {r1('validation_mae', 'error_bound')} "
    "FROM models WHERE validation_mae IS NOT NULL"
)
def error_bounds(spark, sf_dir):
    _, store = stored_models(spark, sf_dir)
    models = registry.latest_models(store.read("model_storage"))
    bounds = evaluate.error_bounds(models, store.read("fit_performance"))
    return single(bounds, "error_bound")


@query(
    _forecast_sql(
        "oos",
        ", ".join(["", sql.MAX_TIME, sql.OOS_ACTUALS])
        + f"SELECT f.series_id, a.step, f.time_index, tourism, {r1('score', 'score')}, "
        f"{r1('score - validation_mae', 'lower')}, {r1('score + validation_mae', 'upper')} FROM direct f "
        "JOIN actuals a ON f.series_id = a.series_id AND step = horizon JOIN models m ON f.series_id = m.series_id "
        "AND f.horizon = m.horizon WHERE validation_mae IS NOT NULL",
    )
)
def forecast_bands(spark, sf_dir):
    ts, store = stored_models(spark, sf_dir)
    models = pipeline.current_models(store)
    bands = evaluate.forecast_bands(
        forecast.direct_forecast(ts, models, "oos"),
        selection.oos_observations(ts),
        evaluate.error_bounds(models, store.read("fit_performance")),
    )
    return single(bands, "score", "lower", "upper")


# Whole runs with all 25 predictors and model selection; SQL cannot fit these

@query()
def fit_direct(spark, sf_dir):
    return fit_models(sales_series(spark, sf_dir), **BOUND)


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN} SELECT series_id, CAST(horizon AS INTEGER) AS horizon, "
    "count(CASE WHEN purpose = 'train' THEN 1 END) AS n_train, count(CASE WHEN purpose = 'validation' THEN 1 END) AS n_validation "
    "FROM train GROUP BY 1, 2"
)
def fit_direct_counts(spark, sf_dir):
    """Every target with rows gets a model from the search over all predictors; the rows it used."""
    return fit_models(sales_series(spark, sf_dir), **BOUND).select("series_id", "horizon", "n_train", "n_validation")


@query()
def fit_direct_wide(spark, sf_dir):
    """The search with sparse and outlier-resistant candidates as well."""
    return fit_models(sales_series(spark, sf_dir), candidates=WIDE_CANDIDATES, **BOUND)


@query()
def fit_losses(spark, sf_dir):
    fitted = fit_models(sales_series(spark, sf_dir), **BOUND).withColumn("model_id", F.lit(1))
    return registry.loss_rows(fitted)


@query()
def evaluate_fit_all_predictors(spark, sf_dir):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    store = pipeline.new_registry(spark)
    pipeline.fit_and_store(store, ts, **BOUND)
    models = pipeline.current_models(store)
    scores = evaluate.recorded_scores(ts, store.read("record_masks"), models, **BOUND)
    return evaluate.evaluate_fit(scores, None, store.read("fit_performance"), models)


@query(
    f"WITH {sql.TIME_SERIES}, {sql.TRAIN} SELECT series_id || '_' || CAST(horizon AS VARCHAR) AS target, 1 AS model_id, purpose, "
    "1 AS passed FROM train GROUP BY 1, 2, 3"
)
def evaluate_fit_all_passed(spark, sf_dir):
    """The refit check on all predictors: every target and purpose with rows is checked, and passes."""
    checked = evaluate_fit_all_predictors(spark, sf_dir)
    return checked.select("target", "model_id", "purpose", F.col("pass").cast("int").alias("passed"))


def full_models(spark, sf_dir):
    ts = tables.staged(sales_series(spark, sf_dir), "time_series")
    fitted = fit_models(ts, **BOUND).withColumn("model_id", F.lit(1))
    return ts, tables.staged(fitted, "models")


@query()
def mase_validation_all_predictors(spark, sf_dir):
    ts, models = full_models(spark, sf_dir)
    return pipeline.compare_methods(ts, models, "validation", **BOUND)


@query()
def mase_oos_all_predictors(spark, sf_dir):
    ts, models = full_models(spark, sf_dir)
    return pipeline.compare_methods(ts, models, "oos", **BOUND)


@query()
def mase_summary_all_predictors(spark, sf_dir):
    ts, models = full_models(spark, sf_dir)
    differences = tables.staged(pipeline.compare_methods(ts, models, "validation", **BOUND), "differences")
    return evaluate.difference_summary(differences)
