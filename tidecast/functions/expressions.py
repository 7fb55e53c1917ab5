"""Column expressions shared by the operators, built-in functions only."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.config import HORIZONS, LAG_NAMES, METADATA_ROWS, MONTH_NAMES, N_LAGS, N_MONTHS


def frequency(series_id: Column) -> Column:
    return F.substring(F.lower(series_id), 1, 1)


def by_frequency(series_id: Column, values: dict) -> Column:
    """The value for the series' frequency; anything but m and q counts as yearly."""
    freq = frequency(series_id)
    return F.when(freq == "m", values["m"]).when(freq == "q", values["q"]).otherwise(values["y"])


def max_horizon(series_id: Column) -> Column:
    return by_frequency(series_id, HORIZONS)


def metadata_rows(series_id: Column) -> Column:
    return by_frequency(series_id, METADATA_ROWS)


def horizons(series_id: Column) -> Column:
    return F.sequence(F.lit(1), max_horizon(series_id))


def target_id(series_id: Column, horizon: Column) -> Column:
    return F.concat_ws("_", series_id, horizon.cast("string"))


def target_series(target: Column) -> Column:
    return F.regexp_replace(target, "_[^_]*$", "")


def target_horizon(target: Column) -> Column:
    return F.substring_index(target, "_", -1).cast("int")


def month_flags(time: Column) -> list[Column]:
    return [
        F.when(time % N_MONTHS == m, 1).otherwise(0).alias(name) for m, name in enumerate(MONTH_NAMES)
    ]


def lag_columns(lags: Column, skip: Column) -> list[Column]:
    """lag_1..lag_12 read from an array of consecutive lags, leaving out the nearest `skip`."""
    return [F.get(lags, skip + k).alias(name) for k, name in enumerate(LAG_NAMES)]


def is_finite(value: Column) -> Column:
    """True for a number, false for NULL, NaN and the infinities."""
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def parse_number(text: Column, missing: str) -> Column:
    """Text to double; the `missing` marker and anything unreadable become NULL."""
    return F.nullif(F.trim(text.cast("string")), F.lit(missing)).try_cast("double")


def linear_score(coef: Column, observation_id: Column, lags: list[Column], fill: Column | None = None) -> Column:
    """Dot product of a coefficient array (intercept, then the predictors in order) and a row.

    Only one month flag is 1, so the twelve month terms are one look-up. A lag that is not finite is
    replaced by the model's own value in `fill`, if it has one.
    """
    if fill is not None:
        lags = [
            F.when(is_finite(lag), lag).otherwise(F.coalesce(F.get(fill, F.lit(k)), lag)) for k, lag in enumerate(lags)
        ]
    terms = [coef[0], coef[1] * observation_id]
    terms += [coef[2 + k] * lag for k, lag in enumerate(lags)]
    terms.append(F.get(coef, 2 + N_LAGS + (observation_id % N_MONTHS).cast("int")))
    return reduce(lambda total, term: total + term, terms)
