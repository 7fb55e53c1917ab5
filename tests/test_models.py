"""Fits, scores and forecasts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequence import TS, series
from tidecast.config import PREDICTORS
from tidecast.functions import linear_models as lm
from tidecast.operators import evaluate, forecast
from tidecast.operators.features import train_features
from tidecast.operators.fit import fit_models, target_status, trend_models
from tidecast.operators.registry import Registry, best_models, latest_models, next_model_ids, scoring_models
from tidecast.operators.split import fold, purpose
from tidecast.plans.pipeline import compare_methods, fit_and_store
from tidecast.sources.tables import staged


def training_columns(n, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.normal(1000, 50, n)
    return np.arange(13, 13 + n), y, rng.normal(1000, 50, (n, 36)), rng.integers(-1, 3, n), np.ones((n, 36), dtype=bool)


def test_ridge_equals_closed_form(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_ROWS", 17)  # several blocks
    rows, horizons = training_columns(90), np.array([1, 5, 24])
    shift = lm.shifts(PREDICTORS, 990.0, 13)
    sums, n_validation = lm.product_sums(rows, horizons, PREDICTORS, 3, None, shift)
    coefs = lm.fit_candidates(sums, horizons, ["naive", "trend", "ridge:0.1", "ols"], PREDICTORS, "m", shift)
    errors = lm.error_sums(rows, horizons, PREDICTORS, coefs, None)
    time_index, y, lags, fold_, _ = rows
    assert list(n_validation) == [(fold_ < 0).sum()] * 3
    for i, h in enumerate(horizons):
        x = np.column_stack(
            [time_index, lags[:, h : h + 12], *[time_index % 12 == m for m in range(12)]]
        ).astype(float)
        for f in range(4):
            train = (fold_ >= 0) & (fold_ != f)
            scale = x[train].std(axis=0)
            z = (x[train] - x[train].mean(axis=0)) / scale
            b = np.linalg.solve(z.T @ z / train.sum() + 0.1 * np.eye(25), z.T @ (y[train] - y[train].mean()) / train.sum())
            np.testing.assert_allclose(coefs[i, 2, f, 1:], b / scale, rtol=1e-6, atol=1e-8)
            line = np.polyfit(time_index[train], y[train], 1)
            np.testing.assert_allclose(coefs[i, 1, f, [1, 0]], line, rtol=1e-6)
        full = np.column_stack([np.ones(90), x])
        scores = full @ coefs[i, 2, 3]
        np.testing.assert_allclose(errors[i, 2, 1], np.abs(scores - y)[fold_ >= 0].sum(), rtol=1e-9)
        np.testing.assert_allclose(errors[i, 2, 2], np.abs(scores - y)[fold_ < 0].sum(), rtol=1e-9)
        out_of_fold = sum(
            np.abs(full[fold_ == f] @ coefs[i, 2, f] - y[fold_ == f]).sum() for f in range(3)
        )
        np.testing.assert_allclose(errors[i, 2, 0], out_of_fold, rtol=1e-9)
    assert coefs[1, 0, 0, 1 + PREDICTORS.index("lag_7")] == 1.0 and coefs[1, 0, 0].sum() == 1.0


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    t = np.arange(110)
    rows = series("m1", 10 + 3.0 * t)
    rows += series("m2", 100 + 20 * np.sin(t * np.pi / 6) + rng.normal(0, 1, 110))
    rows += series("m3", rng.normal(50, 5, 110))
    rows += series("m4", np.where(t == 5, np.inf, rng.normal(50, 5, 110)))
    rows += series("m6", np.where(t == 40, np.nan, rng.normal(50, 5, 110)))
    rows += series("m7", [None if i in (30, 61) else float(v) for i, v in enumerate(rng.normal(50, 5, 110))])
    rows += series("q1", rng.normal(50, 5, 60)) + series("y1", range(9)) + series("m5", [4.0] * 70)
    return staged(spark.createDataFrame(rows, TS), "mixed")


def test_chunked_fit_equals_whole_fit(mixed):
    keys = ["series_id", "horizon"]
    whole = fit_models(mixed, max_rows=1000).toPandas().sort_values(keys).reset_index(drop=True)
    chunked = fit_models(mixed, chunk_rows=32).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(whole) == len(chunked) and set(whole["series_id"]) == {"m1", "m2", "m3", "m4", "m5", "m6", "m7", "q1"}
    steady = whole["series_id"].isin(["m2", "m3", "m4", "m6", "m7"])
    assert (whole["family"] == chunked["family"])[steady].all()
    for column in ("n_train", "n_validation"):
        assert (whole[column] == chunked[column]).all()
    for column in ("cv_mae", "train_mae", "validation_mae"):
        np.testing.assert_allclose(whole[column], chunked[column], rtol=1e-6, atol=1e-6)
    assert ((whole["fill"].isna()) == (~whole["series_id"].isin(["m4", "m6", "m7"]))).all()
    line = whole[whole["series_id"] == "m1"]
    np.testing.assert_allclose(line["cv_mae"], 0, atol=1e-6)


def test_infinite_values_are_replaced_by_medians(mixed):
    one = mixed.where("series_id = 'm4'")
    whole = fit_models(one, ["lag_1", "lag_2"], ("ridge:0.1",), max_rows=1000).orderBy("horizon").toPandas()
    chunked = fit_models(one, ["lag_1", "lag_2"], ("ridge:0.1",), chunk_rows=32).orderBy("horizon").toPandas()
    assert len(whole) == len(chunked) > 0
    np.testing.assert_allclose(np.array(list(whole["coef"])), np.array(list(chunked["coef"])), rtol=1e-6, atol=1e-6)


def test_small_spread_on_a_high_level(spark):
    rng = np.random.default_rng(1)
    values = 1e6 + np.cumsum(rng.normal(0, 1, 300))
    ts = spark.createDataFrame(series("m1", values), TS)
    got = fit_models(ts, ["lag_1"], ("ols",)).where("horizon = 1").first()
    t = np.arange(13, 300 - 25)
    from_rows = ts.select("series_id", F.col("time_index"), purpose(F.col("series_id"), F.col("time_index")).alias("p"))
    train = np.array([r.p == "train" for r in from_rows.orderBy("time_index").collect()])[t]
    slope = np.polyfit(values[t - 2][train] - 1e6, values[t][train], 1)[0]
    assert got.coef[1 + PREDICTORS.index("lag_1")] == pytest.approx(slope, rel=1e-6)


def test_rows_are_chosen_by_horizon(spark):
    values = [None if i == 40 else float(i % 7) for i in range(110)]
    ts = spark.createDataFrame(series("m1", values), TS)
    used = {r.horizon: r.n_train + r.n_validation for r in fit_models(ts, ["lag_1"], ("ols",)).collect()}
    for h in (1, 6, 24):
        usable = [t for t in range(110 - 25) if t >= h + 12 and t != 40 and t - h - 12 != 40]
        assert used[h] == len(usable)


def test_scores_use_the_stored_medians(spark, mixed, tmp_path):
    ts = mixed.where("series_id in ('m4', 'm6', 'm7')")
    store = Registry(spark, str(tmp_path / "registry")).create()
    fit_and_store(store, ts, ["lag_1", "lag_5"], ("ridge:0.1",))
    scores = forecast.train_scores(ts, scoring_models(store.read("model_storage")))
    checked = evaluate.evaluate_fit(scores, store.read("record_ids"), store.read("fit_performance")).collect()
    assert checked and all(r["pass"] for r in checked)


def test_split_does_not_depend_on_partitions(mixed):
    rows = mixed.select(
        "series_id", "time_index", purpose(F.col("series_id"), F.col("time_index")).alias("p"),
        fold(F.col("series_id"), F.col("time_index"), 3).alias("f"),
    )
    a = {(r[0], r[1]): (r[2], r[3]) for r in rows.repartition(7).collect()}
    b = {(r[0], r[1]): (r[2], r[3]) for r in rows.coalesce(1).collect()}
    assert a == b
    assert all((p == "validation") == (f == -1) for p, f in a.values())
    share = np.mean([p == "validation" for p, _ in a.values()])
    assert 0.15 < share < 0.35


def test_status_and_trend(mixed):
    fitted = fit_models(mixed, ["observation_id"], ("ols",), max_rows=1000)
    status = {(r.series_id, r.horizon): r.status for r in target_status(mixed, fitted).collect()}
    assert status[("y1", 1)] == "no_training_rows" and status[("m1", 24)] == "fitted"
    trend = {r.series_id: r for r in trend_models(mixed, max_rows=1000).collect()}
    assert trend["m1"].slope == pytest.approx(3.0) and trend["m1"].intercept == pytest.approx(10.0)


@pytest.fixture(scope="module")
def models(spark, mixed):
    fitted = fit_models(mixed.where("series_id NOT IN ('m4', 'm6', 'm7')"), candidates=("ridge:0.1",), max_rows=1000)
    return staged(fitted.withColumn("model_id", F.lit(1)), "models")


@pytest.mark.parametrize("feed", ["aligned", "immediate"])
def test_recursive_forecast_equals_loop(mixed, models, feed):
    got = forecast.recursive_forecast(mixed, models, "validation", feed).toPandas()
    coefs = {r.series_id: np.array(r.coef) for r in models.where("horizon = 1").collect()}
    for name, rows in got.groupby("series_id"):
        steps = 24 if name[0] == "m" else 8
        values = [r.tourism for r in mixed.where(f"series_id = '{name}'").orderBy("time_index").collect()]
        anchor = len(values) - 1 - steps
        recent = values[: anchor + 1][::-1] if feed == "aligned" else values[:anchor][::-1]
        skip = 1 if feed == "aligned" else 0
        wanted = []
        for j in range(1, steps + 1):
            flags = [float((anchor + j) % 12 == m) for m in range(12)]
            wanted.append(coefs[name] @ np.array([1.0, anchor + j, *recent[skip : skip + 12], *flags]))
            recent = [wanted[-1], *recent]
        rows = rows.sort_values("horizon")
        assert list(rows["time_index"]) == [anchor + j for j in range(1, steps + 1)]
        np.testing.assert_allclose(rows["score"], wanted, rtol=1e-9)


def test_perfect_line_has_no_error(spark, mixed):
    line = mixed.where("series_id = 'm1'")
    fitted = staged(
        fit_models(line, ["observation_id"], ("ols",), max_rows=1000).withColumn("model_id", F.lit(1)), "line"
    )
    row = compare_methods(line, fitted, "validation", max_rows=1000).first()
    assert row.direct == pytest.approx(0, abs=1e-8) and row.recursive == pytest.approx(0, abs=1e-8)


def test_constant_series_has_no_mase(spark, mixed, models):
    constant = mixed.where("series_id = 'm5'")
    row = compare_methods(constant, models, "validation", max_rows=1000).first()
    assert row.direct is None and row.recursive is None


def test_only_listed_predictors_are_scored(spark):
    stored = [float(i) for i in range(26)]
    storage = spark.createDataFrame([("m1_1", 1, "ridge", stored)], "target string, model_id int, family string, coef array<double>")
    names = spark.createDataFrame(
        [("m1_1", 1, 1, " lag_3 "), ("m1_1", 1, 0, "month_2")],
        "target string, model_id int, predictor_index int, predictor string",
    )
    coef = forecast.aligned_coefficients(storage, names).first().coef
    kept = {0, 1 + PREDICTORS.index("month_2"), 1 + PREDICTORS.index("lag_3")}
    assert coef == [v if i in kept else 0.0 for i, v in enumerate(stored)]


def test_registry_round_trip(spark, mixed, tmp_path):
    ts = mixed.where("series_id in ('m2', 'q1', 'y1')")
    store = Registry(spark, str(tmp_path / "registry")).create()
    fit_and_store(store, ts, ["observation_id"], ("ols",), max_rows=1000)
    fit_and_store(store, ts, max_rows=1000)
    storage = store.read("model_storage")
    assert storage.groupBy("target").count().where("count <> 2").isEmpty()
    assert latest_models(storage).where("model_id <> 2").isEmpty()
    ids = {r.target: r.model_id for r in next_model_ids(spark.createDataFrame([("m2_1",), ("new_1",)], "target string"), storage).collect()}
    assert ids == {"m2_1": 3, "new_1": 1}
    scores = {(r.target, r.model_id): r.performance for r in store.read("fit_performance").where("purpose = 'validation'").collect()}
    for row in best_models(storage, store.read("fit_performance")).collect():
        assert scores[(row.target, row.model_id)] == max(scores[(row.target, m)] for m in (1, 2))
    for models in (latest_models(storage), storage.where("model_id = 1")):
        for bound in (1000, None):
            scores = forecast.train_scores(ts, scoring_models(models), max_rows=bound)
            checked = evaluate.evaluate_fit(scores, store.read("record_ids"), store.read("fit_performance")).collect()
            assert checked and all(r["pass"] for r in checked)
    scores = forecast.train_scores(ts, scoring_models(latest_models(storage)), max_rows=1000)
    features = train_features(ts, max_rows=1000)
    batch = forecast.batch_score(features, scoring_models(latest_models(storage)))
    keys = ["series_id", "horizon", "observation_id"]
    pairs = scores.select(*keys, "score").join(batch.select(*keys, F.col("score").alias("batch")), keys)
    assert pairs.count() == features.count() == pairs.where("abs(score - batch) < 1e-9").count()
    residuals = evaluate.train_residuals(scores, store.read("record_ids"))
    mae = residuals.groupBy("series_id", "horizon").agg(F.avg(F.abs("error")).alias("mae")).collect()
    stored = {r.target: -r.performance for r in store.read("fit_performance").where("purpose = 'train' and model_id = 2").collect()}
    for row in mae:
        assert row.mae == pytest.approx(stored[f"{row.series_id}_{row.horizon}"], rel=1e-9)


def fits_of(rows, horizon, fold_, fit):
    """Plain design and values of the rows one fit uses."""
    time_index, y, lags = rows[:3]
    at = (fold_ >= 0) & (fold_ != fit)
    return np.column_stack([time_index, lags[:, horizon : horizon + 12], *[time_index % 12 == m for m in range(12)]])[at].astype(float), y[at]


def plain_lasso(x, y, ratio):
    """Coordinate by coordinate on the rows themselves."""
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    b, residual = np.zeros(x.shape[1]), y - y.mean()
    penalty = ratio * np.abs(z.T @ residual / len(y)).max()
    for _ in range(3000):
        before = b.copy()
        for j in range(len(b)):
            rho = z[:, j] @ residual / len(y) + b[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0.0)
            residual += z[:, j] * (b[j] - new)
            b[j] = new
        if np.abs(b - before).max() < 1e-12:
            break
    return b / x.std(axis=0)


def plain_huber(x, y, number):
    """Reweighted least squares on the rows themselves, and the width of the bound."""
    full = np.column_stack([np.ones(len(y)), x])
    fit = np.linalg.lstsq(full, y, rcond=None)[0]
    bound = number * np.sqrt(np.pi / 2) * np.abs(full @ fit - y).mean()
    for _ in range(lm.HUBER_STEPS):
        error = np.abs(full @ fit - y)
        weight = np.where(error > bound, bound / np.maximum(error, 1e-300), 1.0)
        root = np.sqrt(weight)
        fit = np.linalg.lstsq(full * root[:, None], y * root, rcond=None)[0]
    return full @ fit, bound


def test_lasso_and_huber_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_ROWS", 17)
    rows, horizons = training_columns(130, seed=5), np.array([1, 7, 24])
    rows[1][::9] += 900.0  # outliers
    names = ["lasso:0.1", "huber:1.345", "lasso:0.5", "ols", "lasso:0.01"]
    shift = lm.shifts(PREDICTORS, 990.0, 13)
    sums, _ = lm.product_sums(rows, horizons, PREDICTORS, 3, None, shift)
    coefs = lm.fit_candidates(sums, horizons, names, PREDICTORS, "m", shift)
    start = coefs[:, 1].copy()
    coefs[:, 1] = lm.huber_fit(rows, horizons, PREDICTORS, coefs[:, 1], 1.345, None, shift)
    assert np.abs(coefs[:, 1] - start).max() > 0.01
    for i, h in enumerate(horizons):
        for f in range(4):
            x, y = fits_of(rows, h, rows[3], f)
            for place, ratio in ((0, 0.1), (2, 0.5), (4, 0.01)):
                wanted = plain_lasso(x, y, ratio)
                np.testing.assert_allclose(coefs[i, place, f, 1:], wanted, rtol=1e-5, atol=1e-6)
                assert ((coefs[i, place, f, 1:] == 0) == (wanted == 0)).all()
            full = np.column_stack([np.ones(len(y)), x])
            np.testing.assert_allclose(full @ start[i, f], full @ coefs[i, 3, f], rtol=1e-6)
            scores, bound = plain_huber(x, y, 1.345)
            np.testing.assert_allclose(full @ coefs[i, 1, f], scores, rtol=1e-6)
            # Near the minimum of the Huber loss the clipped errors are uncorrelated with the columns.
            clipped = np.clip(scores - y, -bound, bound)
            assert np.abs(np.corrcoef(np.column_stack([clipped, x[:, :13]]).T)[0, 1:]).max() < 0.02


def test_resistant_fit_is_alike_in_chunks(mixed):
    some = mixed.where("series_id in ('m2', 'm3', 'm6', 'q1')")
    names, keys = ("naive", "lasso:0.1", "huber:1.345", "ridge:1.0"), ["series_id", "horizon"]
    for candidates in (names, ("huber:1.345", "huber:2.5")):
        whole = fit_models(some, ["lag_1", "lag_6", "observation_id"], candidates, max_rows=1000).orderBy(*keys).toPandas()
        chunked = fit_models(some, ["lag_1", "lag_6", "observation_id"], candidates, chunk_rows=40).orderBy(*keys).toPandas()
        assert len(whole) == len(chunked) > 60 and (whole["family"] == chunked["family"]).all()
        np.testing.assert_allclose(np.array(list(whole["coef"])), np.array(list(chunked["coef"])), rtol=1e-5, atol=1e-6)
        for column in ("cv_mae", "train_mae", "validation_mae"):
            np.testing.assert_allclose(whole[column], chunked[column], rtol=1e-6, atol=1e-6)


def test_outliers_prefer_the_resistant_fit(spark):
    rng = np.random.default_rng(8)
    values = 5.0 * np.arange(260) + rng.normal(0, 1, 260)
    values[rng.choice(260, 26, replace=False)] += 4000.0
    ts = spark.createDataFrame(series("m1", values), TS)
    got = fit_models(ts, ["observation_id"], ("ols", "huber:1.0"), max_rows=300).toPandas()
    assert (got["family"] == "huber:1.0").all()
