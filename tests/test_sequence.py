"""Lags and counts against plain pandas, for whole and for chunked series."""

import numpy as np
import pandas as pd
import pytest

from tidecast.operators.features import anchors, inference_features, train_features
from tidecast.operators.reference_tables import max_time, scale_factor, unified_axis
from tidecast.operators.selection import oos_observations, validation_actuals
from tidecast.operators.sequence import last_rows, with_lags

TS = "series_id string, sample_type string, time_index int, tourism double"


def series(name, values, sample="in", times=None):
    times = range(len(values)) if times is None else times
    return [(name, sample, int(t), None if v is None else float(v)) for t, v in zip(times, values)]


@pytest.fixture(scope="module")
def uneven():
    """Gaps, a far jump, very short series, and one series far longer than the rest."""
    rng = np.random.default_rng(1)
    gaps = np.sort(rng.choice(600, 200, replace=False))
    rows = series("m1", rng.normal(100, 10, 200), times=gaps)
    rows += series("m2", rng.normal(100, 10, 5), times=[0, 1, 500, 501, 900])
    rows += series("m3", [7.0]) + series("m4", [1.0, 2.0])
    rows += series("q1", rng.normal(100, 10, 3000))
    return rows


@pytest.mark.parametrize("chunk_rows", [16, 100, 1 << 16])
def test_chunked_lags_equal_shift(spark, uneven, chunk_rows):
    offsets = [1, 2, 12, 36]
    frame = pd.DataFrame(uneven, columns=["series_id", "sample_type", "time_index", "tourism"])
    groups = frame.sort_values(["series_id", "time_index"]).groupby("series_id")
    wanted = frame.assign(
        **{f"lag_{k}": groups["tourism"].shift(k) for k in offsets},
        later=groups["tourism"].transform("size") - groups.cumcount() - 1,
    ).sort_values(["series_id", "time_index"])
    df = spark.createDataFrame(uneven, TS)
    for bound in (None, 5000):
        got = with_lags(df, offsets, max_rows=bound, chunk_rows=chunk_rows).toPandas()
        got = got.sort_values(["series_id", "time_index"])
        lags = np.array([list(x) for x in got["lags"]], dtype=float)
        np.testing.assert_array_equal(lags, wanted[[f"lag_{k}" for k in offsets]].to_numpy())
        np.testing.assert_array_equal(got["future_record_count"], wanted["later"])


def test_null_values_keep_their_place_across_chunks(spark):
    values = [None if i % 5 == 0 else float(i) for i in range(60)]
    df = spark.createDataFrame(series("m1", values), TS)
    got = with_lags(df, [1, 7], chunk_rows=8).toPandas().sort_values("time_index")
    for i, lags in zip(got["time_index"], got["lags"]):
        for k, lag in zip([1, 7], lags):
            wanted = values[i - k] if i >= k else None
            assert (lag is None or np.isnan(lag)) if wanted is None else lag == wanted


def test_last_rows(spark, uneven):
    got = last_rows(spark.createDataFrame(uneven, TS), 2).toPandas()
    assert got.groupby("series_id").size().to_dict() == {"m1": 2, "m2": 2, "m3": 1, "m4": 2, "q1": 2}
    assert got[got["series_id"] == "m2"].set_index("rank")["time_index"].to_dict() == {1: 900, 2: 501}


def test_long_series_is_not_windowed_whole(spark, uneven):
    plan = with_lags(spark.createDataFrame(uneven, TS), [1])._jdf.queryExecution().executedPlan().toString()
    rows_windows = [line for line in plan.splitlines() if "lag(" in line and "Window" in line]
    assert rows_windows and all("_chunk" in line for line in rows_windows)


def test_scale_factor_closed_forms(spark):
    rows = series("m1", range(40)) + series("m1", range(40, 44), "oos")
    rows += series("q1", [5.0] * 30) + series("y1", [1, 3, 6, 10])
    rows += series("q2", [0, 1, 2, 3] * 5) + series("m9", [1.0, 2.0], "oos") + series("m8", [1.0])
    df = spark.createDataFrame(rows, TS)
    for options in ({"max_rows": 100}, {"chunk_rows": 7}):
        got = dict(scale_factor(df, **options).collect())
        assert got == {"m1": 12.0, "q1": 0.0, "y1": 3.0, "q2": 0.0, "m8": None}


def test_unified_axis_and_actuals(spark):
    rows = series("q1", range(50)) + series("q1", [8, 2001, 1, *range(100, 108)], "oos")
    rows += series("y1", range(9)) + series("y1", [4, 2001, 77, 78], "oos")
    df = spark.createDataFrame(rows, TS)
    assert dict(max_time(df).collect()) == {"q1": 49, "y1": 8}
    for bound in (None, 100):
        axis = unified_axis(df, bound).where("sample_type = 'oos' and series_id = 'q1'")
        assert sorted(r.new_time_index for r in axis.collect()) == list(range(50, 61))
    oos = oos_observations(df).collect()
    assert sorted((r.time_index, r.step, r.tourism) for r in oos if r.series_id == "q1") == [
        (50 + i, 1 + i, 100.0 + i) for i in range(8)
    ]
    assert [(r.time_index, r.tourism) for r in oos if r.series_id == "y1"] == [(9, 77.0)]
    tail = validation_actuals(df).where("series_id = 'q1'").collect()
    assert sorted((r.step, r.time_index) for r in tail) == [(i + 1, 42 + i) for i in range(8)]


def test_anchors_and_inference_features(spark):
    df = spark.createDataFrame(series("m1", range(60)) + series("m2", range(20)) + series("y1", range(15)), TS)
    got = {r.series_id: r for r in anchors(df, "validation").collect()}
    assert set(got) == {"m1", "y1"}
    assert got["m1"].anchor_time == 35 and got["m1"].lag_1 == 34.0 and got["m1"].lag_12 == 23.0
    rows = inference_features(df, "oos").where("series_id = 'm1'").collect()
    assert len(rows) == 24
    for row in rows:
        assert row.observation_id == 59 + row.horizon and row.lag_1 == 58.0 and row.target == 59.0
        assert [row[f"month_{m}"] for m in range(12)] == [int(row.observation_id % 12 == m) for m in range(12)]
    behind = inference_features(df, "oos", first_horizon=0).where("series_id = 'm1'").collect()
    assert sorted(r.horizon for r in behind) == list(range(24))


def test_training_row_counts(spark):
    df = spark.createDataFrame(series("m1", range(100)) + series("q1", range(48)) + series("y1", range(7)), TS)
    rows = train_features(df, max_rows=1000)
    counts = {(r.series_id, r.horizon): r["count"] for r in rows.groupBy("series_id", "horizon").count().collect()}
    wanted = {("m1", h): 100 - 37 - h for h in range(1, 25)} | {("q1", h): 48 - 37 - h for h in range(1, 9)}
    assert counts == {key: n for key, n in wanted.items() if n > 0}
    row = rows.where("series_id = 'm1' and horizon = 7 and observation_id = 50").first()
    assert (row.target, row.lag_1, row.lag_12) == (50.0, 42.0, 31.0)
