"""Forecast errors, MASE, error bands, residuals and the check of stored against repeated losses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import FIT_TOLERANCE, LOSS
from tidecast.functions.expressions import (
    lag_columns,
    max_horizon,
    month_flags,
    target_horizon,
    target_id,
    target_series,
)
from tidecast.operators.forecast import models_by_series, with_score
from tidecast.operators.impute import exact_medians
from tidecast.operators.registry import PURPOSES, has_bit, losses, per_horizon_of, recorded_rows
from tidecast.operators.selection import paired_by_position
from tidecast.sources.tables import shuffled


def compare(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts with the actual value of the same series and step."""
    return (
        forecasts.withColumnRenamed("horizon", "step")
        .join(shuffled(actuals.select("series_id", "step", "tourism")), ["series_id", "step"])
        .withColumn("error", F.abs(F.col("tourism") - F.col("score")))
    )


def mase(forecasts: DataFrame, actuals: DataFrame, scale_factor: DataFrame) -> DataFrame:
    """Mean absolute error over the steps with an actual value, over the series' scale factor.

    NULL where the scale factor is 0.
    """
    errors = (
        compare(forecasts, actuals)
        .groupBy("series_id")
        .agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("steps"))
    )
    return errors.join(shuffled(scale_factor.withColumnRenamed("error", "scale_factor")), "series_id").select(
        "series_id", "steps", "mae", F.try_divide("mae", "scale_factor").alias("mase")
    )


def mase_by_position(forecasts: DataFrame, actuals: DataFrame, scale_factor: DataFrame) -> DataFrame:
    """As `mase`, pairing the n-th actual with the n-th forecast whatever their times are.

    It has a value only where a series has as many actuals as forecasts.
    """
    numbered = paired_by_position(actuals)
    lengths = numbered.groupBy("series_id").agg(F.count(F.lit(1)).alias("actuals"))
    scores = mase(forecasts, numbered, scale_factor).join(shuffled(lengths), "series_id")
    matches = F.col("actuals") == max_horizon(F.col("series_id"))
    return scores.select(
        "series_id", "actuals", F.when(matches, F.col("mase")).alias("mase")
    )


def mase_difference(direct: DataFrame, recursive: DataFrame) -> DataFrame:
    """Per series: direct minus recursive MASE; below 0 the direct forecast is better."""
    return direct.select("series_id", F.col("mase").alias("direct")).join(
        shuffled(recursive.select("series_id", F.col("mase").alias("recursive"))), "series_id"
    ).withColumn("diff", F.col("direct") - F.col("recursive"))


def difference_summary(differences: DataFrame) -> DataFrame:
    """Count, sum, mean and median of the differences over all series.

    `differences` is read several times, so it should be a stored table.
    """
    everything = differences.select(F.lit(1).alias("all"), "diff")
    sums = everything.groupBy("all").agg(
        F.count("diff").alias("series"), F.sum("diff").alias("total"), F.avg("diff").alias("mean")
    )
    medians = exact_medians(everything, ["all"], ["diff"]).withColumnRenamed("diff", "median")
    return sums.join(medians, "all").drop("all")


def error_bounds(models: DataFrame, fit_performance: DataFrame, loss_function: str = LOSS) -> DataFrame:
    """Expected absolute error per horizon, from the validation score of the given models."""
    return (
        models.select("target", "model_id")
        .join(shuffled(losses(fit_performance, "validation", loss_function)), ["target", "model_id"])
        .select(
            target_series(F.col("target")).alias("series_id"),
            target_horizon(F.col("target")).alias("horizon"),
            "model_id",
            F.abs("performance").alias("error_bound"),
        )
    )


def forecast_bands(forecasts: DataFrame, actuals: DataFrame, bounds: DataFrame) -> DataFrame:
    """Forecast, actual and the band of one error bound around the forecast."""
    return (
        compare(forecasts, actuals)
        .join(shuffled(bounds.select("series_id", F.col("horizon").alias("step"), "error_bound")), ["series_id", "step"])
        .select(
            "series_id",
            "step",
            "time_index",
            "tourism",
            "score",
            (F.col("score") - F.col("error_bound")).alias("lower"),
            (F.col("score") + F.col("error_bound")).alias("upper"),
        )
    )


def train_records(
    ts: DataFrame, masks: DataFrame, purpose: str | None = "train", max_rows: int | None = None
) -> DataFrame:
    """Feature rows the stored models were fitted on, with target_id, model_id and purpose.

    `purpose` picks train or validation rows, None takes both.
    """
    if purpose is not None and purpose.lower() not in PURPOSES:
        raise ValueError(f"purpose must be one of {PURPOSES} or None, not {purpose!r}")
    kinds = PURPOSES if purpose is None else [purpose.lower()]
    parts = F.array(*[F.struct(F.lit(kind).alias("purpose"), F.col(kind).alias("mask")) for kind in kinds])
    rows = recorded_rows(ts, masks, max_rows).select("series_id", "model_id", "time_index", "tourism", "lags", F.inline(parts))
    rows = per_horizon_of(rows)
    return rows.select(
        target_id(F.col("series_id"), F.col("horizon")).alias("target_id"),
        "series_id",
        "horizon",
        "model_id",
        "purpose",
        F.col("time_index").alias("observation_id"),
        F.col("tourism").alias("target"),
        *lag_columns(F.col("lags"), F.col("horizon")),
        *month_flags(F.col("time_index")),
    )


def recorded_scores(ts: DataFrame, masks: DataFrame, models: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Scores of exactly the rows stored for each of `models`, one model per target, with their purpose.

    A series' models are joined before the horizons are multiplied out, and only those that used a row
    are written out for it.
    """
    chosen = models.select("series_id", "model_id").distinct()
    own = masks.join(shuffled(chosen), ["series_id", "model_id"], "left_semi")
    rows = recorded_rows(ts, own, max_rows).join(shuffled(models_by_series(models)), "series_id")
    rows = rows.withColumnRenamed("model_id", "recorded_id").select(
        "series_id", "recorded_id", "time_index", "tourism", "lags", "train", "validation", F.inline("models")
    )
    used = has_bit(F.col("train").bitwiseOR(F.col("validation")), F.col("horizon"))
    rows = rows.where((F.col("model_id") == F.col("recorded_id")) & used)
    return with_score(rows).select(
        "series_id",
        "horizon",
        "model_id",
        F.when(has_bit(F.col("train"), F.col("horizon")), "train").otherwise("validation").alias("purpose"),
        F.col("time_index").alias("observation_id"),
        F.col("tourism").alias("target"),
        "score",
    )


def _named(scores: DataFrame, record_ids: DataFrame | None) -> DataFrame:
    """Scores with their target's id, error and purpose, which comes from `record_ids` where it is given."""
    errors = scores.select(
        target_id(F.col("series_id"), F.col("horizon")).alias("target"),
        "series_id",
        "horizon",
        "model_id",
        "observation_id",
        "score",
        (F.col("score") - F.col("target")).alias("error"),
        *(["purpose"] if record_ids is None else []),
    )
    return errors if record_ids is None else errors.join(shuffled(record_ids), ["target", "model_id", "observation_id"])


def train_residuals(scores: DataFrame, record_ids: DataFrame | None = None) -> DataFrame:
    """Signed error, score minus target, on the rows the scoring models were trained on.

    `scores` are `recorded_scores`, or scores of any rows to be matched with `record_ids`.
    """
    return (
        _named(scores, record_ids)
        .where(F.lower("purpose") == "train")
        .select("series_id", "horizon", "model_id", "observation_id", "score", "error")
    )


def evaluate_fit(
    scores: DataFrame,
    record_ids: DataFrame | None,
    fit_performance: DataFrame,
    models: DataFrame | None = None,
    loss_function: str = LOSS,
    tolerance: float = FIT_TOLERANCE,
) -> DataFrame:
    """Compare the loss on the stored rows, scored again, with the loss stored at fitting.

    `scores` are `recorded_scores`, or scores of any rows to be matched with `record_ids`.
    With `models` (target, model_id), the ones that were scored, a loss that is missing on either side
    fails the check instead of leaving it.
    """
    repeated = (
        _named(scores, record_ids)
        .groupBy("target", "model_id", "purpose")
        .agg((-F.avg(F.abs("error"))).alias("repeated"))
    )
    stored = fit_performance.where(F.lower("loss_function") == loss_function.lower()).select(
        "target", "model_id", "purpose", F.col("performance").alias("stored")
    )
    if models is not None:
        stored = stored.join(shuffled(models.select("target", "model_id").distinct()), ["target", "model_id"], "left_semi")
    passed = F.coalesce(F.abs(F.col("stored") - F.col("repeated")) < tolerance, F.lit(False))
    joined = repeated.join(shuffled(stored), ["target", "model_id", "purpose"], "inner" if models is None else "full")
    return joined.select("target", "model_id", "purpose", "stored", "repeated", passed.alias("pass"))


def changed_rows(stored: DataFrame, repeated: DataFrame) -> DataFrame:
    """Whether the rows each model was fitted on are still the same: target, model_id, purpose, rows, pass.

    Both sides are `fingerprints`; one that is missing on either side fails. The order of rows and of their
    partitions does not matter.
    """
    keys = ["target", "model_id", "purpose"]
    again = repeated.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("rows", "hash_a", "hash_b")])
    same = [F.col(c) == F.col(f"_{c}") for c in ("rows", "hash_a", "hash_b")]
    passed = F.coalesce(same[0] & same[1] & same[2], F.lit(False))
    return stored.join(shuffled(again), keys, "full").select(*keys, "rows", passed.alias("pass"))
