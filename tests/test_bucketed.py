"""Tables that lie by series: files read, plans without a shuffle, and appended rows."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_sequence import TS, series
from tidecast.operators import selection
from tidecast.operators.fit import fit_one_series
from tidecast.plans.queries import BOUND, co_located_records
from tidecast.sources import bucketed

BUCKETS = 8


def table_of(spark, path, count, per_series=60):
    rows = [r for k in range(count) for r in series(f"m{k}", [float(k + t % 7) for t in range(per_series)])]
    return spark.table(bucketed.write_bucketed(spark.createDataFrame(rows, TS), str(path), BUCKETS))


def files_read(df):
    """Files that the tasks of a plan without a shuffle are given."""
    return sum(len(p.files()) for p in df._jdf.queryExecution().toRdd().partitions())


def shuffles(df):
    return re.findall(r"\w*Exchange\b", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("count", [20, 200])
def test_one_series_reads_one_bucket(spark, tmp_path, count):
    table = table_of(spark, tmp_path / "t", count)
    one = bucketed.one_series(table, "M7")
    assert files_read(one) == 1 and files_read(table.where("tourism > 0")) == BUCKETS
    assert one.count() == 60
    extract = selection.series_extract(table, "in", "M7").drop("series_id")
    assert [r.tourism for r in extract.collect()] == [float(7 + t % 7) for t in range(60)]


def test_fit_one_series_filters_the_scan(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", 40, per_series=90)
    fitted = fit_one_series(table, "M3", candidates=("naive",), **BOUND)
    assert {r.series_id for r in fitted.collect()} == {"m3"}
    assert "EqualTo(series_id,m3)" in fitted._jdf.queryExecution().executedPlan().toString()


def test_a_window_over_series_needs_no_shuffle(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", 30)
    summed = table.groupBy("series_id").agg(F.sum("tourism"))
    assert shuffles(summed) == [] and summed.count() == 30


def test_records_join_inside_buckets(spark):
    rows = co_located_records(spark, "/root/testdata/sf0.001")
    # The small tables of the test would be broadcast.
    rows.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert shuffles(rows) == [] and rows.count() > 0


def test_append_and_declare(spark, tmp_path):
    path = str(tmp_path / "t")
    table = table_of(spark, path, 10)
    more = spark.createDataFrame([("m3", "in", t, 1.0) for t in range(60, 65)], TS)
    bucketed.write_bucketed(more, path, BUCKETS, mode="append")
    name = bucketed.table_name(path)
    spark.catalog.refreshTable(name)
    assert bucketed.one_series(spark.table(name), "m3").count() == 65
    schema = table.schema
    spark.sql(f"DROP TABLE {name}")
    assert bucketed.declare_bucketed(spark, path, schema, BUCKETS) == name
    again = spark.table(name)
    assert again.count() == 605 and files_read(bucketed.one_series(again, "m3")) == 2
    assert shuffles(again.groupBy("series_id").count()) == []


def test_buckets_grow_with_the_table():
    assert [bucketed.buckets_for(n, 100) for n in (0, 100, 799, 1600, 100_000)] == [8, 8, 8, 32, 1024]
