"""Whole runs: fit and store models, forecast both ways, and compare."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.config import PREDICTORS
from tidecast.operators.evaluate import mase, mase_difference
from tidecast.operators.fit import CANDIDATES, fit_models
from tidecast.operators.forecast import direct_forecast, recursive_forecast
from tidecast.operators.reference_tables import scale_factor
from tidecast.operators.registry import Registry, latest_models, scoring_models
from tidecast.operators.selection import oos_observations, validation_actuals
from tidecast.sources.tables import staged, staging_path


def fit_and_store(
    registry: Registry,
    ts: DataFrame,
    predictors: Sequence[str] = tuple(PREDICTORS),
    candidates: Sequence[str] = CANDIDATES,
    holdout: str = "fixed",
    max_rows: int | None = None,
    create_date: str | None = None,
) -> DataFrame:
    fitted = staged(fit_models(ts, predictors, candidates, holdout=holdout, max_rows=max_rows), "fitted")
    return registry.add_models(fitted, ts, predictors, holdout, max_rows, create_date)


def new_registry(spark) -> Registry:
    """An empty registry in the session's shared folder."""
    return Registry(spark, staging_path(spark, "registry")).create()


def current_models(registry: Registry) -> DataFrame:
    return scoring_models(latest_models(registry.read("model_storage")))


def actual_values(ts: DataFrame, pred_type: str, max_rows: int | None = None) -> DataFrame:
    return validation_actuals(ts) if pred_type == "validation" else oos_observations(ts)


def compare_methods(
    ts: DataFrame, models: DataFrame, pred_type: str, feed: str = "aligned", max_rows: int | None = None
) -> DataFrame:
    """Per series: MASE of the direct and of the recursive forecast, and their difference."""
    actuals = staged(actual_values(ts, pred_type, max_rows), "actuals")
    scales = staged(scale_factor(ts, max_rows=max_rows), "scale_factor")
    return mase_difference(
        mase(direct_forecast(ts, models, pred_type), actuals, scales),
        mase(recursive_forecast(ts, models, pred_type, feed), actuals, scales),
    )
