"""States after appends against a recomputation, and sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sequence import TS, series
from tidecast.operators import increments, reference_tables, selection, sketches
from tidecast.sources.tables import staged


def rows_of():
    rng = np.random.default_rng(11)
    rows = []
    for name, n, m in (("m1", 140, 24), ("m2", 9, 3), ("q1", 70, 8), ("q2", 3, 0), ("y1", 12, 4), ("y2", 1, 0), ("m3", 30, 0), ("m4", 0, 6)):
        values = list(1e7 + rng.normal(0, 5, n))
        if n > 20:
            values[15] = None
        rows += series(name, values) + series(name, rng.normal(50, 9, m), "oos")
    return rows


# Uneven batches: one with a single row a series, one that skips some series, out-of-sample rows last.
CUTS = ["sample_type = 'in' and time_index < 1", "sample_type = 'in' and time_index between 1 and 17",
        "sample_type = 'in' and time_index > 17", "sample_type = 'oos'"]


@pytest.mark.parametrize("options", [{"max_rows": 1000}, {"chunk_rows": 10}])
def test_appends_equal_a_recomputation(spark, options):
    ts = staged(spark.createDataFrame(rows_of(), TS), "ts")
    state = profile = None
    for cut in CUTS:
        batch = ts.where(cut)
        state = staged(increments.add_rows(state, batch, **options), "state")
        profile = staged(increments.add_to_profile(profile, batch), "profile")
    assert {tuple(r) for r in increments.max_time_of(state).collect()} == {tuple(r) for r in reference_tables.max_time(ts).collect()}
    wanted = {r.series_id: r.error for r in reference_tables.scale_factor(ts, max_rows=1000).collect()}
    got = {r.series_id: r.error for r in increments.scale_factor_of(state).collect()}
    assert got.keys() == wanted.keys() and got["y2"] is None
    for name in got:
        same = got[name] is None if wanted[name] is None else got[name] == pytest.approx(wanted[name], rel=1e-9)
        assert same, (name, got[name], wanted[name])
    counts = {r.series_id: r["count"] for r in ts.groupBy("series_id").count().collect()}
    assert {r.series_id: r.rows for r in state.collect()} == counts
    keys = ["series_type", "sample_type", "time_index"]
    old = selection.similarity_profile(ts).toPandas().sort_values(keys).reset_index(drop=True)
    new = increments.similarity_profile_of(profile).toPandas().sort_values(keys).reset_index(drop=True)
    assert old[keys].equals(new[keys])
    for column in ("tourism_avg", "tourism_stddev", "lower", "upper"):
        np.testing.assert_allclose(old[column], new[column], rtol=1e-7)
    again = increments.add_rows(state, ts.limit(0), **options)
    assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))


def test_rows_out_of_order_are_refused(spark):
    ts = spark.createDataFrame(series("m1", range(5)), TS)
    state = staged(increments.add_rows(None, ts, max_rows=1000), "state")
    with pytest.raises(Exception, match="not later"):
        increments.add_rows(state, ts.where("time_index = 4"), max_rows=1000).collect()


def test_sketches(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v), float(v % 7)) for v in rng.permutation(40_000)] + [("b", float(v), None) for v in range(9)] + [("c", float("nan"), None)]
    df = staged(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), "values")
    parts = [staged(sketches.median_sketches(df.where(F.xxhash64("x") % 3 == k), ["g"], ["x", "y"]), "part") for k in (-2, -1, 0, 1, 2)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    for merged in (sketches.median_sketches(df, ["g"], ["x", "y"]), sketches.merge_sketches(table, ["g"], ["x", "y"])):
        medians = staged(sketches.sketched_medians(merged, ["g"], ["x", "y"]), "medians")
        found = {r.g: (r.x, r.y) for r in medians.collect()}
        assert found["b"] == (4.0, None) and found["c"] == (None, None)
        errors = {(r.g, r.column): r for r in sketches.rank_errors(df, medians, ["g"], ["x", "y"]).collect()}
        assert set(errors) == {("a", "x"), ("a", "y"), ("b", "x")}
        assert errors["a", "x"].rows == 40_000 and errors["b", "x"].error == 0
        assert all(e.error <= sketches.RANK_ERROR[800] for e in errors.values())
        assert abs(found["a"][0] - 19_999.5) <= 40_000 * sketches.RANK_ERROR[800]
    with pytest.raises(ValueError):
        sketches.median_sketches(df, ["g"], ["x"], k=7)
