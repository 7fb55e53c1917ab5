"""The same results in SQL, written for a single-node engine, to check the Spark plans against."""

from tidecast.config import HORIZONS, N_LAGS, N_MONTHS, SEASON_LAGS

LAGS = range(1, N_LAGS + 1)
LAG_LIST = ", ".join(f"lag_{k}" for k in LAGS)

# The long table derived from `lineitem`.
TIME_SERIES = """
layout(freq, days, k, meta) AS (VALUES ('m', 15, 24, 3), ('q', 45, 8, 3), ('y', 365, 4, 2)),
metadata(freq, i, v) AS (VALUES
  ('m', 0, 24.0), ('m', 1, 2001.0), ('m', 2, 1.0),
  ('q', 0, 8.0), ('q', 1, 2001.0), ('q', 2, 1.0),
  ('y', 0, 4.0), ('y', 1, 2001.0)),
sums AS (
  SELECT freq, freq || CAST(l_suppkey AS VARCHAR) AS series_id,
         floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / CAST(days AS DOUBLE)) AS step,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS tourism
  FROM lineitem CROSS JOIN layout GROUP BY 1, 2, 3),
placed AS (
  SELECT freq, series_id, tourism,
         row_number() OVER (PARTITION BY series_id ORDER BY step) - 1 AS pos,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM sums),
time_series AS (
  SELECT series_id, CASE WHEN pos < n - k THEN 'in' ELSE 'oos' END AS sample_type,
         CAST(CASE WHEN pos < n - k THEN pos ELSE pos - greatest(n - k, 0) + meta END AS INTEGER) AS time_index,
         tourism
  FROM placed JOIN layout USING (freq)
  UNION ALL
  SELECT series_id, 'oos', CAST(i AS INTEGER), CAST(v AS DOUBLE)
  FROM (SELECT DISTINCT series_id, freq FROM placed) s JOIN metadata USING (freq))
"""


def _by_freq(values: dict, series_id: str = "series_id") -> str:
    return (
        f"CASE left({series_id}, 1) WHEN 'm' THEN {values['m']} WHEN 'q' THEN {values['q']} "
        f"ELSE {values['y']} END"
    )


MAX_H = _by_freq(HORIZONS)
SEASON = _by_freq(SEASON_LAGS)

MAX_TIME = """
max_time AS (SELECT series_id, max(time_index) AS max_time FROM time_series
             WHERE sample_type = 'in' GROUP BY series_id)
"""

UNIFIED = f"""{MAX_TIME},
unified AS (
  SELECT series_id, sample_type, time_index,
         CASE WHEN sample_type = 'in' THEN time_index ELSE max_time + time_index + 1 END AS new_time_index,
         tourism
  FROM time_series JOIN max_time USING (series_id)),
seasonal AS (
  SELECT series_id, sample_type, new_time_index, tourism,
         lag(tourism, 12) OVER w AS lag_12, lag(tourism, 4) OVER w AS lag_4, lag(tourism, 1) OVER w AS lag_1
  FROM unified WINDOW w AS (PARTITION BY series_id ORDER BY new_time_index)),
scale_factor AS (
  SELECT series_id,
         sum(abs(tourism - s)) / sum(CASE WHEN s IS NOT NULL THEN 1 END) AS error
  FROM (SELECT *, {_by_freq({"m": "lag_12", "q": "lag_4", "y": "lag_1"})} AS s FROM seasonal) x
  GROUP BY series_id)
"""

# Every in-sample row with its position, then joined to itself for the lags of each horizon.
IN_ROWS = """
in_rows AS (
  SELECT series_id, time_index, tourism,
         row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS pos,
         count(*) OVER (PARTITION BY series_id ORDER BY time_index
                        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future_record_count
  FROM time_series WHERE lower(sample_type) = 'in')
"""

MONTHS = ", ".join(
    f"CASE WHEN observation_id % 12 = {m} THEN 1 ELSE 0 END AS month_{m}" for m in range(N_MONTHS)
)

_LAG_BLOCKS = " UNION ALL ".join(
    f"SELECT series_id, {h} AS horizon, time_index AS observation_id, tourism AS target, "
    + ", ".join(f"lag(tourism, {k + h}) OVER w AS lag_{k}" for k in LAGS)
    + f", future_record_count FROM in_rows WHERE {h} <= {MAX_H} "
    "WINDOW w AS (PARTITION BY series_id ORDER BY time_index)"
    for h in range(1, 25)
)
LAG_FEATURES = f"{IN_ROWS}, lag_features AS ({_LAG_BLOCKS})"
TRAIN = f"""{LAG_FEATURES},
train AS (SELECT *, CASE WHEN substr(md5(series_id || '|' || CAST(observation_id AS VARCHAR)), 1, 2) >= 'c0'
                        THEN 'validation' ELSE 'train' END AS purpose
          FROM lag_features WHERE lag_12 IS NOT NULL AND future_record_count > 24)
"""

_ANCHOR_LAGS = ", ".join(f"lag(tourism, {k}) OVER w AS lag_{k}" for k in LAGS)


def anchors(pred_type: str) -> str:
    after = MAX_H if pred_type == "validation" else "0"
    return f"""
anchors AS (
  SELECT * FROM (SELECT series_id, time_index AS anchor_time, tourism AS anchor_value, {_ANCHOR_LAGS},
                        future_record_count
                 FROM in_rows WINDOW w AS (PARTITION BY series_id ORDER BY time_index)) a
  WHERE future_record_count = {after})
"""


HORIZON_LIST = "horizon_list AS (SELECT unnest(range(1, 25)) AS horizon)"


def inference(pred_type: str, first_horizon: int = 1) -> str:
    shift = 1 - first_horizon
    return f"""WITH {TIME_SERIES}, {IN_ROWS}, {anchors(pred_type)}, {HORIZON_LIST},
expanded AS (
  SELECT a.*, CAST(horizon - {shift} AS INTEGER) AS h, CAST(anchor_time + horizon - {shift} AS INTEGER) AS observation_id
  FROM anchors a JOIN horizon_list ON horizon <= {MAX_H})
SELECT series_id, h AS horizon, observation_id, anchor_value AS target, {LAG_LIST}, {MONTHS}, future_record_count
FROM expanded"""


VALIDATION_ACTUALS = f"""
actuals AS (SELECT series_id, time_index, tourism, CAST({MAX_H} - future_record_count AS INTEGER) AS step
            FROM in_rows WHERE future_record_count < {MAX_H})
"""

OOS_ACTUALS = f"""
actuals AS (
  SELECT series_id, CAST(max_time + step AS INTEGER) AS time_index, tourism, CAST(step AS INTEGER) AS step
  FROM (SELECT series_id, tourism, time_index - {_by_freq({"m": 3, "q": 3, "y": 2})} + 1 AS step
        FROM time_series WHERE sample_type = 'oos') o
  JOIN max_time USING (series_id)
  WHERE step BETWEEN 1 AND {MAX_H})
"""


def models(predictor: str, name: str = "models") -> str:
    """One-predictor least squares per target, with its losses. A predictor that does not vary gives a constant."""
    return f"""
{name}_line AS (
  SELECT series_id, horizon,
         CASE WHEN min({predictor}) < max({predictor}) THEN regr_slope(target, {predictor}) ELSE 0.0 END AS b,
         CASE WHEN min({predictor}) < max({predictor}) THEN regr_intercept(target, {predictor})
              ELSE avg(target) END AS a,
         count(*) AS n_train
  FROM train WHERE purpose = 'train' GROUP BY series_id, horizon),
{name} AS (
  SELECT l.series_id, l.horizon, l.series_id || '_' || CAST(l.horizon AS VARCHAR) AS target_id,
         any_value(a) AS a, any_value(b) AS b, any_value(n_train) AS n_train,
         avg(CASE WHEN purpose = 'train' THEN abs(a + b * {predictor} - target) END) AS train_mae,
         avg(CASE WHEN purpose = 'validation' THEN abs(a + b * {predictor} - target) END) AS validation_mae
  FROM {name}_line l JOIN train t ON l.series_id = t.series_id AND l.horizon = t.horizon
  GROUP BY l.series_id, l.horizon)
"""


DIRECT = """
direct AS (
  SELECT a.series_id, m.horizon, CAST(anchor_time + m.horizon AS INTEGER) AS time_index,
         a + b * (anchor_time + m.horizon) AS score
  FROM anchors a JOIN models m ON a.series_id = m.series_id)
"""


def recursive(feed: str) -> str:
    second = "anchor_value" if feed == "aligned" else "a + b * lag_1"
    later = "before" if feed == "aligned" else "now"
    return f"""
recursive AS (
  SELECT series_id, 1 AS horizon, a, b, a + b * lag_1 AS now, {second} AS before, anchor_time
  FROM anchors JOIN models USING (series_id) WHERE horizon = 1
  UNION ALL
  SELECT series_id, horizon + 1, a, b, a + b * {later}, now, anchor_time
  FROM recursive WHERE horizon < {MAX_H})
"""
