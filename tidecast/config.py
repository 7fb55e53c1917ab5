"""Fixed values of the forecasting setup."""

N_LAGS = 12
N_MONTHS = 12
MAX_HORIZON = 24
LAG_NAMES = [f"lag_{k}" for k in range(1, N_LAGS + 1)]
MONTH_NAMES = [f"month_{m}" for m in range(N_MONTHS)]
PREDICTORS = ["observation_id", *LAG_NAMES, *MONTH_NAMES]

# Per frequency, keyed by the first letter of the series id: monthly, quarterly, yearly.
HORIZONS = {"m": 24, "q": 8, "y": 1}
SEASON_LAGS = {"m": 12, "q": 4, "y": 1}
# Leading rows of an out-of-sample file that describe it (horizon, start year[, start period]).
METADATA_ROWS = {"m": 3, "q": 3, "y": 2}

# A training row must have more than this many rows of its series after it.
TRAIN_FUTURE_ROWS = 24
LOSS = "neg_mean_absolute_error"
FIT_TOLERANCE = 0.0001

# A series proven to have at most this many rows may be windowed in one task; any other is cut
# into chunks of CHUNK_ROWS time steps. time_index is a 32-bit int, so a series has at most
# 32,768 chunks.
WHOLE_SERIES_ROWS = 1 << 18
CHUNK_ROWS = 1 << 16
