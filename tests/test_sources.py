"""Wide CSV files, stored tables, imputation, and the executor-side code."""

import subprocess
import sys

import numpy as np
import pytest

from tests.test_sequence import TS, series
from tidecast.operators.impute import exact_medians, impute
from tidecast.operators.quality import duplicate_keys
from tidecast.schemas import KEYS
from tidecast.sources.tables import append_time_series, read_time_series
from tidecast.sources.wide_csv import numbered_lines, read_wide_csv, unpivot_wide


@pytest.fixture
def files(tmp_path):
    quarterly = ["q1,q2", "8,8", "2001,2002", "1,3", "10.5,20", "", "NaN,21", "12,", "13,23"]
    (tmp_path / "quarterly_oos.csv").write_bytes("\r\n".join(quarterly + [""]).encode())
    yearly = ['"Y1",Y2,Y3', "4,4,4", "1990,1991,1992", "1,2,NA", "4,5,6"]
    (tmp_path / "yearly_in.csv").write_text("\n".join(yearly) + "\n")
    return [str(tmp_path / n) for n in ("quarterly_oos.csv", "yearly_in.csv")]


def rows_of(df):
    return sorted((r.series_id, r.sample_type, r.time_index, r.tourism) for r in df.collect())


def test_wide_csv(spark, files):
    stripped = rows_of(read_wide_csv(spark, files))
    assert stripped == [
        ("q1", "oos", 0, 10.5), ("q1", "oos", 2, 12.0), ("q1", "oos", 3, 13.0),
        ("q2", "oos", 0, 20.0), ("q2", "oos", 1, 21.0), ("q2", "oos", 3, 23.0),
        ("y1", "in", 0, 1.0), ("y1", "in", 1, 4.0), ("y2", "in", 0, 2.0), ("y2", "in", 1, 5.0), ("y3", "in", 1, 6.0),
    ]
    kept = rows_of(read_wide_csv(spark, files, metadata="keep"))
    assert ("q1", "oos", 0, 8.0) in kept and ("q1", "oos", 3, 10.5) in kept and len(kept) == len(stripped) + 12
    with pytest.raises(ValueError):
        read_wide_csv(spark, files, metadata="other")


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "monthly_in.csv"
    lines = [f"{i}," + "x" * (i % 37) for i in range(3000)]
    path.write_text("\n\n".join(lines) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        numbered = numbered_lines(spark, [str(path)])
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        assert sorted((r.line_number, r.line) for r in numbered.collect()) == list(enumerate(lines))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unpivot(spark):
    wide = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), 4.0)], "t int, M1 double, M2 double")
    assert rows_of(unpivot_wide(wide, "t", "in")) == [("m1", "in", 0, 1.0), ("m2", "in", 1, 4.0)]


def test_stored_series(spark, tmp_path):
    path = str(tmp_path / "ts")
    append_time_series(spark.createDataFrame(series("m1", [1, 2, 3]), TS), path)
    append_time_series(spark.createDataFrame(series("m1", [4], "oos") + series("m1", [3.0], times=[2]), TS), path)
    stored = read_time_series(spark, path)
    assert stored.count() == 5
    assert [tuple(r) for r in duplicate_keys(stored, KEYS["time_series"]).collect()] == [("m1", "in", 2, 2)]
    plan = stored.where("sample_type = 'oos'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sample_type" in plan


@pytest.mark.parametrize("parts", [None, 30])
def test_imputation(spark, parts):
    rows = [("a", "1", "idk"), ("a", "-", "5"), ("a", "2", " 7 "), ("a", "3", "inf"), ("a", None, "9"), ("a", "4", "nan")]
    rows += [("b", str(i), str(i % 7)) for i in range(200)] + [("b", "9", "what")]
    rows += [("c", str(i), "idk") for i in range(30)] + [(None, "1", "2"), (None, "2", "idk")]
    df = spark.createDataFrame(rows, "k string, y string, x string")
    got = impute(df, ["k"], ["x"], "y", parts=parts).collect()
    a = sorted((r.y, r.x) for r in got if r.k == "a")
    assert a == [(1.0, 8.0), (2.0, 7.0), (3.0, 8.0), (4.0, 8.0)]  # median of 5, 7, 9, inf
    assert [r.x for r in got if r.k == "b" and r.y == 9.0 and r.x not in (2.0,)] == [3.0]
    assert [r.x for r in got if r.k == "c"] == [None] * 30
    assert sorted((r.y, r.x) for r in got if r.k is None) == [(1.0, 2.0), (2.0, 2.0)]
    assert len(got) == 4 + 201 + 30 + 2


def test_large_medians_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"same": np.full(999, 3.0), "odd": rng.normal(0, 1, 5001), "even": rng.lognormal(0, 3, 5000)}
    groups["half"] = np.array([1.0] * 500 + [2.0] * 500)
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double")
    got = dict(exact_medians(df, ["k"], ["v"], parts=50).collect())
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()}, rel=1e-15)


def test_tasks_need_no_installed_package(tmp_path):
    """Run a fit from a folder where the package cannot be imported by the workers."""
    code = f"""
import sys; sys.path.insert(0, {str(sys.path[0])!r}); sys.path.insert(0, {__file__.rsplit('/tests/', 1)[0]!r})
from tests.conftest import local_session
from tests.test_sequence import TS, series
from tidecast.operators.fit import fit_models
df = local_session().createDataFrame(series("m1", range(60)), TS)
assert fit_models(df, max_rows=100).count() == 22
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
