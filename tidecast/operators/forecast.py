"""Scoring, direct and recursive forecasts. All scoring is JVM-side arithmetic on coefficient arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import LAG_NAMES, N_LAGS, PREDICTORS
from tidecast.functions.expressions import lag_columns, linear_score, max_horizon, month_flags, target_id
from tidecast.operators.features import anchors, future_limit, lagged_rows
from tidecast.sources.tables import shuffled


def aligned_coefficients(models: DataFrame, predictors: DataFrame) -> DataFrame:
    """Stored models reduced to the predictors listed for them.

    Coefficients are stored for all 25 predictors in one order; those of predictors that are not listed
    become 0. A model without any listed predictor is left out.
    """
    listed = predictors.groupBy("target", "model_id").agg(F.collect_set(F.trim("predictor")).alias("listed"))
    used = [
        F.when(F.array_contains("listed", name), F.get("coef", F.lit(1 + i))).otherwise(0.0)
        for i, name in enumerate(PREDICTORS)
    ]
    return (
        models.join(shuffled(listed), ["target", "model_id"])
        .withColumn("coef", F.array(F.get("coef", F.lit(0)), *used))
        .drop("listed")
    )


def fill_of(models: DataFrame) -> Column:
    """The stored replacements of lags that are not finite; NULL for models without any."""
    stored = F.col("fill") if "fill" in models.columns else F.lit(None)
    return stored.cast("array<double>").alias("fill")


def batch_score(features: DataFrame, models: DataFrame) -> DataFrame:
    """Add `score` to the rows of a feature table from the model of their (series_id, horizon).

    `models` holds one row per target. A series' models, at most 24, come as one row, so a table that lies
    by series is not shuffled. If one series has far more rows than the others, adaptive execution splits
    its part of the join. Rows without a model are left out.
    """
    lags = [F.col(name) for name in LAG_NAMES]
    own = F.get(F.filter("models", lambda m: m["horizon"] == F.col("horizon")), F.lit(0))
    return (
        features.join(shuffled(models_by_series(models)), "series_id")
        .withColumn("model", own)
        .where(F.col("model").isNotNull())
        .withColumns(
            {
                "model_id": F.col("model.model_id"),
                "score": linear_score(F.col("model.coef"), F.col("observation_id"), lags, F.col("model.fill")),
            }
        )
        .drop("models", "model")
    )


def models_by_series(models: DataFrame) -> DataFrame:
    """One row per series with its models, one per target: at most 24."""
    return models.groupBy("series_id").agg(
        F.collect_list(F.struct("horizon", "model_id", "coef", fill_of(models))).alias("models")
    )


def with_models(lagged: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with all their lags, once for each model of their series whose horizon has its lags.

    The join comes before the horizons are multiplied out: with bounded series the rows are not shuffled
    again after their lags are built.
    """
    rows = lagged.join(shuffled(models_by_series(models)), "series_id").select(*lagged.columns, F.inline("models"))
    return rows.where(F.get("lags", F.col("horizon") + N_LAGS - 1).isNotNull())


def with_score(rows: DataFrame) -> DataFrame:
    """Add lag_1 to lag_12 and `score` to rows of `with_models`.

    The lags are columns of their own first: the score uses each several times, and written out in full the
    expression would be too long for the JVM to compile.
    """
    rows = rows.select("*", *lag_columns(F.col("lags"), F.col("horizon"))).drop("lags")
    lags = [F.col(name) for name in LAG_NAMES]
    return rows.withColumn("score", linear_score(F.col("coef"), F.col("time_index"), lags, F.col("fill")))


def train_scores(
    ts: DataFrame, models: DataFrame, holdout: str = "fixed", max_rows: int | None = None
) -> DataFrame:
    """Scores of all training rows by the given models, one per target."""
    lagged = lagged_rows(ts, max_rows).where(F.col("future_record_count") > future_limit(holdout))
    return with_score(with_models(lagged, models)).select(
        "series_id",
        "horizon",
        "model_id",
        F.col("time_index").alias("observation_id"),
        F.col("tourism").alias("target"),
        "score",
    )


def scored_features(
    ts: DataFrame, models: DataFrame, holdout: str = "fixed", max_rows: int | None = None
) -> DataFrame:
    """The training features of every target with a model, and their score."""
    lagged = lagged_rows(ts, max_rows).where(F.col("future_record_count") > future_limit(holdout))
    return with_score(with_models(lagged, models)).select(
        "series_id",
        "horizon",
        F.col("time_index").alias("observation_id"),
        F.col("tourism").alias("target"),
        *LAG_NAMES,
        *month_flags(F.col("time_index")),
        "future_record_count",
        "model_id",
        "score",
    )


def direct_forecast(ts: DataFrame, models: DataFrame, pred_type: str, first_horizon: int = 1) -> DataFrame:
    """One forecast per (series, horizon), each from its own model.

    One anchor row per series meets at most 24 models. `first_horizon=0` places the observation one
    step early.
    """
    observation_id = F.col("anchor_time") + F.col("horizon") - (1 - first_horizon)
    return (
        anchors(ts, pred_type)
        .join(shuffled(models.select("series_id", "horizon", "model_id", "coef", fill_of(models))), "series_id")
        .where(F.col("horizon") <= max_horizon(F.col("series_id")))
        .select(
            "series_id",
            "horizon",
            target_id(F.col("series_id"), F.col("horizon")).alias("target"),
            "model_id",
            (F.col("anchor_time") + F.col("horizon")).alias("time_index"),
            linear_score(F.col("coef"), observation_id, [F.col(n) for n in LAG_NAMES], F.col("fill")).alias("score"),
        )
    )


def recursive_forecast(ts: DataFrame, models: DataFrame, pred_type: str, feed: str = "aligned") -> DataFrame:
    """Forecasts of all steps from the one-step model, fed with its own results.

    The one-step model was trained with lag_1 two rows back. `feed="aligned"` keeps that distance,
    so the anchor value comes in at step 2 and the first forecast at step 3; `"immediate"` puts each
    forecast into lag_1 of the very next step and never uses the anchor value.
    """
    if feed not in ("aligned", "immediate"):
        raise ValueError(f"feed must be 'aligned' or 'immediate', not {feed!r}")
    lags = [F.col(name) for name in LAG_NAMES]
    known = [F.col("anchor_value"), *lags] if feed == "aligned" else lags
    first_lag = len(known) - N_LAGS

    def step(state, j):
        recent = state["recent"]
        used = [F.get(recent, F.lit(first_lag + k)) for k in range(N_LAGS)]
        score = linear_score(F.col("coef"), F.col("anchor_time") + j, used, F.col("fill"))
        return F.struct(
            F.slice(F.concat(F.array(score), recent), 1, len(known)).alias("recent"),
            F.concat(state["scores"], F.array(score)).alias("scores"),
        )

    start = F.struct(
        F.array(*known).alias("recent"), F.array().cast("array<double>").alias("scores")
    )
    steps = F.sequence(F.lit(1), max_horizon(F.col("series_id")))
    return (
        anchors(ts, pred_type)
        .join(shuffled(models.where("horizon = 1").select("series_id", "model_id", "coef", fill_of(models))), "series_id")
        .select(
            "series_id",
            "model_id",
            "anchor_time",
            F.posexplode(F.aggregate(steps, start, step, lambda state: state["scores"])).alias("i", "score"),
        )
        .select(
            "series_id",
            (F.col("i") + 1).alias("horizon"),
            "model_id",
            (F.col("anchor_time") + F.col("i") + 1).alias("time_index"),
            "score",
        )
    )
