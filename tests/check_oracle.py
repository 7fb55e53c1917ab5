"""Compare queries with their SQL: python tests/check_oracle.py <sf_dir> [query ...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries


def oracle_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection.execute(sql).df()


def normalised(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if column.endswith("date"):
            frame = frame.assign(**{column: pd.to_datetime(frame[column])})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """None if both hold exactly the same rows."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    got, wanted = normalised(got), normalised(wanted)
    for column in got.columns:
        a, b = got[column], wanted[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            first = same[~same].index[0]
            return f"{column}: {(~same).sum()} differ, first {a[first]!r} != {b[first]!r}\n{got.loc[first].to_dict()}\n{wanted.loc[first].to_dict()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import local_session

    spark, failed, sqls = local_session(), 0, oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            spent = time.time() - start
            problem = difference(got, oracle_frame(sf_dir, sqls[name])) if name in sqls else None
        except Exception as error:  # report and go on with the next query
            spent, problem, got = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}", []
        failed += problem is not None
        state = "FAIL" if problem else ("ok" if name in sqls else "ran")
        total = time.time() - start
        print(f"{state:5}{name:34}{len(got):8} rows {spent:7.2f}s + {total - spent:.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
