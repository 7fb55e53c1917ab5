"""Runs of a registry that overlap, are cut short, or hold few tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequence import TS, series
from tidecast import schemas
from tidecast.operators import evaluate, forecast
from tidecast.operators.fit import fit_models
from tidecast.operators.registry import Conflict, Registry, scoring_models, write_models
from tidecast.plans.pipeline import fit_and_store
from tidecast.sources.tables import staged


@pytest.fixture(scope="module")
def ts(spark):
    rng = np.random.default_rng(4)
    return staged(spark.createDataFrame(series("m1", rng.normal(50, 5, 90)) + series("q1", rng.normal(9, 2, 60)), TS), "ts")


@pytest.fixture(scope="module")
def fitted(ts):
    return staged(fit_models(ts, ["lag_1"], ("ols",), max_rows=1000), "fitted")


def ids(store):
    return {tuple(r) for r in store.read("model_storage").select("target", "model_id").collect()}


def test_two_runs_that_overlap(spark, ts, fitted, tmp_path):
    store = Registry(spark, str(tmp_path / "r")).create()
    assert store.read("model_storage").count() == 0 and store.published() == []
    first, second, cut_short = store.begin(), store.begin(), store.begin()
    for run in (first, second):
        write_models(run, fitted, ts, ["lag_1"], max_rows=1000)
    cut_short.add("model_storage", first.registry.read("model_storage", [second.name]))
    assert ids(store) == set()
    first.publish()
    targets = {r.target for r in fitted.collect()}
    assert ids(store) == {(t, 1) for t in targets}
    with pytest.raises(Conflict):
        second.publish()
    assert ids(store) == {(t, 1) for t in targets}
    # The whole operation takes ids anew instead.
    store.add_models(fitted, ts, ["lag_1"], max_rows=1000)
    assert ids(store) == {(t, k) for t in targets for k in (1, 2)}
    assert len(store.published()) == 2
    for name, keys in schemas.KEYS.items():
        if name != "time_series":
            assert store.read(name).groupBy(*keys).count().where("count > 1").isEmpty(), name


def test_a_run_published_in_between_is_followed(spark, ts, fitted, tmp_path, monkeypatch):
    store = Registry(spark, str(tmp_path / "r")).create()
    begin, begun = Registry.begin, []

    def interrupted(self):
        run = begin(self)
        if not begun:
            begun.append(run)
            other = Registry(spark, store.folder)
            other_run = begin(other)
            write_models(other_run, fitted, ts, ["lag_1"], max_rows=1000)
            other_run.publish()
        return run

    monkeypatch.setattr(Registry, "begin", interrupted)
    models = store.add_models(fitted, ts, ["lag_1"], max_rows=1000)
    assert {r.model_id for r in models.collect()} == {2} and {m for _, m in ids(store)} == {1, 2}


def test_masks_equal_rows_chosen_one_by_one(spark, ts, tmp_path):
    store = Registry(spark, str(tmp_path / "r")).create()
    fit_and_store(store, ts, ["lag_1"], ("ols",), max_rows=1000)
    fit_and_store(store, ts.where("series_id = 'm1'"), ["lag_1", "lag_2"], ("ols",))
    models = scoring_models(store.read("model_storage").where("model_id = 1"))
    scores = forecast.train_scores(ts, models)
    wanted = {tuple(r) for r in scores.select("series_id", "horizon", "observation_id").collect()}
    for bound in (1000, None):
        got = evaluate.recorded_scores(ts, store.read("record_masks"), models, max_rows=bound)
        assert {tuple(r) for r in got.select("series_id", "horizon", "observation_id").collect()} == wanted
        keys = ["series_id", "horizon", "observation_id"]
        both = got.join(scores.select(*keys, F.col("score").alias("again")), keys)
        assert both.where(F.abs(F.col("score") - F.col("again")) < 1e-9).count() == len(wanted) == got.count()
        checked = evaluate.evaluate_fit(got, None, store.read("fit_performance"), models).collect()
        assert checked and all(r["pass"] for r in checked)
    by_id = evaluate.evaluate_fit(scores, store.read("record_ids"), store.read("fit_performance"), models)
    assert {(r.target, r.purpose) for r in by_id.collect()} == {(r.target, r.purpose) for r in checked}
    records = evaluate.train_records(ts, store.read("record_masks"), None, max_rows=1000)
    listed = store.read("record_ids")
    keys = ["target_id", "model_id", "purpose", "observation_id"]
    assert records.count() == listed.count() > 0
    assert records.join(listed.withColumnRenamed("target", "target_id"), keys).count() == listed.count()
    assert records.where("model_id = 2").select("series_id").distinct().collect()[0][0] == "m1"
    with pytest.raises(ValueError):
        evaluate.train_records(ts, store.read("record_masks"), "holdout")


def test_append_one_table(spark, tmp_path):
    store = Registry(spark, str(tmp_path / "r")).create()
    rows = spark.createDataFrame([("m1_1", 1, "train", "x", -1.0)], schemas.FIT_PERFORMANCE)
    store.append("fit_performance", rows)
    store.append("fit_performance", rows.withColumn("model_id", F.lit(2)))
    assert store.read("fit_performance").count() == 2 and store.read("models").count() == 0
