"""What grows with the input is not broadcast, and no task holds more of it."""

from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidecast.config import PREDICTORS
from tidecast.functions import linear_models as lm
from tidecast.functions import shared_lags
from tidecast.operators import fit, registry
from tidecast.operators.fit import fit_models
from tidecast.operators.forecast import train_scores
from tidecast.operators.impute import exact_medians, impute
from tidecast.sources import sales_series as source
from tidecast.sources.sales_series import MAX_SERIES_ROWS, sales_series, tasks_for
from tidecast.sources.tables import staged

BOUND = {"max_rows": MAX_SERIES_ROWS}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def series(spark):
    rows = [(f"m{s}", "in", t, float(s + t % 12)) for s in range(5) for t in range(90)]
    return staged(spark.createDataFrame(rows, "series_id string, sample_type string, time_index int, tourism double"), "ts")


def test_medians_broadcast_nothing(spark, series):
    """The values themselves were broadcast, since repeated values make small files."""
    assert "Broadcast" not in plan(exact_medians(series, ["series_id"], ["tourism"]))
    texts = series.select("series_id", F.col("tourism").cast("string").alias("near"), F.lit("1").alias("target"))
    filled = impute(texts, ["series_id"], ["near"], "target")
    assert "Broadcast" not in plan(filled) and filled.count() == 450


def test_storing_models_broadcasts_nothing(spark, series):
    fitted = series.select("series_id").distinct().select(
        "series_id",
        F.lit(1).alias("horizon"),
        F.concat("series_id", F.lit("_1")).alias("target"),
        F.lit("naive").alias("family"),
        F.array(*[F.lit(0.0)] * 26).alias("coef"),
        F.lit(None).cast("array<double>").alias("fill"),
    )
    fitted = staged(fitted, "fitted")
    stored = fitted.select("target", F.lit(1).alias("model_id"), "family", "coef", "fill")
    models = registry.with_model_ids(fitted, staged(stored, "stored"))
    assert "Broadcast" not in plan(models) and {m.model_id for m in models.collect()} == {2}
    masks = registry.record_masks(series, staged(models, "models"), **BOUND)
    assert "Broadcast" not in plan(masks)
    masks = staged(masks, "masks")
    assert "Broadcast" not in plan(registry.fingerprints(series, masks, **BOUND))
    assert "Broadcast" not in plan(train_scores(series, staged(models, "models"), **BOUND))


def line_items(spark, path, rows):
    """A folder with the table, in several files; days count from 1995-01-01."""
    rows = [(s, price, None if d is None else date(1995, 1, 1) + timedelta(days=d)) for s, price, d in rows]
    frame = spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_shipdate date")
    frame.repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_tasks_grow_with_the_line_items(spark, tmp_path, monkeypatch):
    """Left to the size of the shuffle, few tasks held ever more suppliers."""
    assert tasks_for(spark, 0) == spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 100 * source.ROWS_PER_TASK + 1) == 101
    folder = line_items(spark, tmp_path, [(s, 1.0, d) for s in range(40) for d in range(30)])
    monkeypatch.setattr(source, "tasks_for", lambda spark, rows: rows // 60)
    assert sales_series(spark, folder, "m").rdd.getNumPartitions() == 20


def test_line_items_of_one_day_are_added_up(spark, tmp_path):
    rows = [(1, 0.25, 5)] * 400 + [(1, 1.0, 15), (2, 2.0, None), (None, 3.0, 5), (None, 4.0, 6)]
    ts = sales_series(spark, line_items(spark, tmp_path, rows), "m")
    found = sorted((r.series_id or "", r.time_index, r.tourism) for r in ts.where("time_index > 2").collect())
    assert found == [("", 3, 7.0), ("m1", 3, 100.0), ("m1", 4, 1.0), ("m2", 3, 2.0)]


def test_fits_of_derived_series_keep_their_tasks(spark, tmp_path):
    """The fit's shuffle fell together with the one of the series and was joined to few tasks."""
    folder = line_items(spark, tmp_path, [(s, float(d % 7), d) for s in range(20) for d in range(0, 900, 15)])
    fitted = fit_models(sales_series(spark, folder, "m"), candidates=("naive",), **BOUND)
    assert fitted.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_few_lasso_targets_as_many(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 5, 12)) + 2 * rng.normal(size=(6, 1, 12))
    left, penalty = np.corrcoef(x.reshape(30, 12))[:5, :5] * np.ones((6, 1, 1)), np.full(6, 0.05)
    right, slopes, moved = rng.normal(size=(6, 5)), [], []
    for few in (0, 16):
        monkeypatch.setattr(lm, "LASSO_FEW", few)
        own = np.zeros((6, 5))
        moved.append(lm._descend(own, left, right, penalty))
        slopes.append(own)
    assert (slopes[0] == slopes[1]).all() and (moved[0] == moved[1]).all()


def test_short_series_are_laid_out_once(monkeypatch):
    """Huber steps over one layout give what they give block by block."""
    rng = np.random.default_rng(4)
    n, horizons, predictors = 90, np.array([1, 2, 3]), ["observation_id", "lag_1", "month_2"]
    rows = (np.arange(n), rng.normal(size=n), rng.normal(size=(n, 36)), rng.integers(-1, 3, n), np.ones((n, 36), dtype=bool))
    coefs, shift = rng.normal(size=(3, 4, 4)), np.zeros(5)
    calls, design = [], lm.design
    monkeypatch.setattr(lm, "design", lambda *a: calls.append(1) or design(*a))
    whole = lm.huber_fit(rows, horizons, predictors, coefs, 1.345, None, shift)
    assert len(calls) == 2  # once for the bounds, once for all steps
    monkeypatch.setattr(lm, "BLOCK_ROWS", 40)
    assert np.allclose(whole, lm.huber_fit(rows, horizons, predictors, coefs, 1.345, None, shift), rtol=1e-8)


def whole_series(n, seed, frequency="m", first=0):
    """Training rows of a series without gaps, as the fit sees them, and its horizons."""
    rng = np.random.default_rng(seed)
    values = 900 + rng.normal(0, 20, n) + 30 * (np.arange(n) % 12 == 3) + np.where(rng.random(n) < 0.1, 400.0, 0.0)
    fold = rng.integers(-1, 3, n)
    rows = pa.StructArray.from_arrays([pa.array(np.arange(first, first + n)), pa.array(values), pa.array(fold)], ["time_index", "tourism", "fold"])
    return fit._series_columns(rows, frequency, "fixed"), fit._horizons(frequency)


@pytest.mark.parametrize("predictors", [PREDICTORS, ["lag_3", "month_2", "observation_id", "lag_1", "month_11"], ["lag_1"], ["observation_id"]])
def test_huber_fits_of_several_series_together(predictors):
    """Each step went over one series at a time, with a system of all columns for each of its targets."""
    series = [whole_series(n, n, first=n % 5) for n in (150, 163, 90, 140)]
    horizons, parts, sums, starts = np.arange(1, 25), [], [], []
    for (rows, gaps), _ in series:
        assert shared_lags.shares_lags(rows, gaps, predictors)
        shift = lm.shifts(predictors, rows[1].mean(), int(rows[0].min()))
        sums.append(lm.product_sums(rows, horizons, predictors, 3, None, shift)[0])
        starts.append(lm.fit_candidates(sums[-1], horizons, ("huber:1.345",), predictors, "m", shift)[:, 0])
        parts.append((rows, shift))
    layout = shared_lags.SharedLags([rows for rows, _ in parts], horizons, predictors, 3)
    together = layout.huber(np.stack(starts), 1.345, lm.varying(np.stack(sums)))
    for (rows, shift), start, found in zip(parts, starts, together):
        alone = lm.huber_fit(rows, horizons, predictors, start, 1.345, None, shift)
        x, _, full = lm.design(rows, horizons, predictors)
        assert (np.isnan(alone) == np.isnan(found)).all() and np.abs(np.nan_to_num(alone - start)).max() > 0.01
        scores = [np.where(full[:, :, None], x @ c.swapaxes(1, 2), 0.0) for c in (alone, found)]
        has_rows = ~np.isnan(alone).any(axis=2)
        np.testing.assert_allclose(scores[1].swapaxes(1, 2)[has_rows], scores[0].swapaxes(1, 2)[has_rows], rtol=1e-5, atol=1e-3)


def test_only_series_with_gaps_are_fitted_alone(monkeypatch):
    (rows, _), _ = whole_series(120, 1)
    (later, _), _ = whole_series(60, 2, "q")
    (gappy, _), _ = whole_series(100, 3)
    gappy = tuple(np.delete(column, 20, axis=0) for column in gappy)
    ids, columns = ["m1", "q1", "m2"], [(rows, False), (later, False), (gappy, False)]
    calls, alone = [], lm.huber_fit
    monkeypatch.setattr(lm, "huber_fit", lambda rows, *a: calls.append(len(rows[0])) or alone(rows, *a))
    names = ("naive", "huber:1.345", "huber:2.0")
    together = fit._fit_series(ids, columns, PREDICTORS, names, 3).to_pylist()
    assert calls == [len(gappy[0])] * 2
    assert not shared_lags.shares_lags(rows, False, ["month_4"]) and not shared_lags.shares_lags(rows, True, PREDICTORS)
    monkeypatch.setattr(shared_lags, "shares_lags", lambda *a: False)
    one_by_one = fit._fit_series(ids, columns, PREDICTORS, names, 3).to_pylist()
    assert len(together) == len(one_by_one) == 24 + 8 + 24
    for a, b in zip(together, one_by_one):
        assert (a["series_id"], a["horizon"], a["n_train"]) == (b["series_id"], b["horizon"], b["n_train"])
        for x, y in zip(a["candidates"], b["candidates"], strict=True):
            assert x["family"] == y["family"] and x["cv_mae"] == pytest.approx(y["cv_mae"], rel=1e-4)


def test_lasso_with_alike_columns_ends():
    """Sweeps alone stopped short of the least where a fit has few rows, or went on for many rounds."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4, 25))
    x[:, :, 13:] = (rng.integers(0, 12, (400, 4, 1)) == np.arange(12)) * 1.0
    y = rng.normal(size=(400, 4))
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    scale = x.std(axis=1)
    z = np.where(scale[:, None] > 0, x / np.where(scale > 0, scale, 1.0)[:, None], 0.0)
    left = z.transpose(0, 2, 1) @ z / 4 + (scale == 0)[:, :, None] * np.eye(25)
    right = (z.transpose(0, 2, 1) @ y[..., None])[..., 0] / 4
    top = np.abs(right).max(axis=1, keepdims=True)
    for ratio, slopes in zip((0.1, 0.3), lm.lasso_path((left, right, np.ones_like(right), None), (0.1, 0.3))):
        gradient = (right - (left @ slopes[..., None])[..., 0]) / (ratio * top)
        assert np.abs(gradient).max() < 1 + 1e-6
        assert np.abs(gradient - np.sign(slopes))[np.abs(slopes) > 1e-7 * top].max() < 1e-6
