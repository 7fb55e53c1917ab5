"""Registered queries against their SQL on the smallest data set.

The slower ones, whose parts the other tests cover, run only with ALL_QUERIES=1; `check_oracle.py`
runs all of them.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import difference, oracle_frame

SF_DIR = "/root/testdata/sf0.001"


SLOW = {
    "best_model", "error_bounds", "fit_one_lag_split", "fit_performance", "forecast_bands", "latest_model",
    "mase_by_position", "mase_diff", "mase_direct_oos", "model_dates", "next_model_id", "predictor_lookup",
    "record_ids", "train_records", "train_residuals", "direct_forecast_oos", "recursive_forecast_immediate",
    "evaluate_fit_all_passed", "forecast_best_model", "fingerprint_check", "max_time_appended", "train_records_bucketed",
}
NAMES = set(oracle_sql()) if os.environ.get("ALL_QUERIES") else set(oracle_sql()) - SLOW


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(spark, name):
    assert difference(queries()[name](spark, SF_DIR).toPandas(), oracle_frame(SF_DIR, oracle_sql()[name])) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_direct_and_recursive_on_all_predictors(spark):
    rows = queries()["mase_validation_all_predictors"](spark, SF_DIR).collect()
    assert rows and all(r.direct > 0 and r.recursive > 0 for r in rows)
