"""One model per (series, horizon), chosen among candidates by cross-validated absolute error.

Series are fitted chunk by chunk: product sums per chunk are added up and solved, then each chunk is
scored with the solutions and the errors are added up, so no group grows with the series. With a bound
on the length of a series each is one chunk and comes to its task as one row of values; sums, solutions
and errors then follow in one pass, by the same functions.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tidecast
from tidecast.config import CHUNK_ROWS, HORIZONS, LAG_NAMES, MAX_HORIZON, N_LAGS, PREDICTORS, SEASON_LAGS, TRAIN_FUTURE_ROWS
from tidecast.functions import linear_models as lm
from tidecast.functions import shared_lags
from tidecast.functions.expressions import is_finite, max_horizon, target_id
from tidecast.operators.features import future_limit, lagged_rows, per_horizon
from tidecast.operators.impute import exact_medians
from tidecast.operators.selection import in_sample
from tidecast.operators.sequence import chunk_of, fits_one_task, with_lags
from tidecast.operators.split import fold as fold_of
from tidecast.sources.bucketed import one_series
from tidecast.sources.tables import shuffled, staged

# Send the package's code along with the tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(tidecast)

CANDIDATES = ("naive", "trend", "ridge:0.01", "ridge:0.1", "ridge:1.0")
# Also sparse and outlier-resistant models; the fit takes a few times as long.
WIDE_CANDIDATES = (*CANDIDATES, "lasso:0.3", "lasso:0.1", "huber:1.345")
FOLDS = 3
# Values of series that are solved together.
BATCH_VALUES = 1 << 12
BATCH_SERIES = 32
# Targets that are solved together.
BATCH_TARGETS = 128

CANDIDATE_TYPE = (
    "struct<cv_mae: double, place: int, family: string, coef: array<double>, "
    "train_mae: double, validation_mae: double>"
)
FITTED_SCHEMA = (
    f"series_id string, horizon int, n_train long, n_validation long, candidates array<{CANDIDATE_TYPE}>"
)
SUMS_SCHEMA = "series_id string, horizon int, n_validation long, shift array<double>, sums array<double>"
SOLVED_SCHEMA = "series_id string, horizon int, n_train long, n_validation long, coefs array<double>"
ERRORS_SCHEMA = "series_id string, horizon int, place int, cv double, train double, validation double"


def fit_models(
    ts: DataFrame,
    predictors: Sequence[str] = tuple(PREDICTORS),
    candidates: Sequence[str] = CANDIDATES,
    folds: int = FOLDS,
    holdout: str = "fixed",
    max_rows: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(series_id, horizon, target, family, coef, fill, cv_mae, train_mae, validation_mae, n_train,
    n_validation): the chosen model. A target without training rows has no model and no row.

    `fill` has the medians that stand for lag_1 to lag_12 where they are not finite; it is NULL for a
    series without such values. `max_rows`, a bound on the rows of a series, only chooses the plan.
    """
    ts = in_sample(ts)
    if fits_one_task(max_rows):
        fitted = _fit_whole(ts, list(predictors), list(candidates), folds, holdout)
    else:
        rows = staged(training_rows(ts, folds, holdout, max_rows, chunk_rows), "training-rows")
        fitted = _fit_chunked(ts, rows, list(predictors), list(candidates), folds, chunk_rows)
    # Structs compare field by field, so the least one has the least error, then the first place.
    return fitted.withColumn("best", F.array_min("candidates")).select(
        "series_id",
        "horizon",
        target_id(F.col("series_id"), F.col("horizon")).alias("target"),
        "best.family",
        "best.coef",
        "fill",
        "best.cv_mae",
        "best.train_mae",
        "best.validation_mae",
        "n_train",
        "n_validation",
    )


def fit_one_series(ts: DataFrame, series_id: str, **options) -> DataFrame:
    """`fit_models` for one series, named in any letter case.

    The filter reaches the scan: from a bucketed table only the files of the series' bucket are read, however
    many series there are.
    """
    return fit_models(one_series(ts, series_id), **options)


def training_rows(ts, folds, holdout, max_rows, chunk_rows):
    """Each row that any horizon trains on, with all its lags and its fold; horizons are cut out later."""
    furthest = F.slice("lags", N_LAGS + 1, MAX_HORIZON)  # the twelfth lag of every horizon
    return (
        lagged_rows(ts, max_rows, chunk_rows)
        .where(
            (F.col("future_record_count") > future_limit(holdout))
            & F.exists(furthest, lambda lag: lag.isNotNull())
            & is_finite(F.col("tourism"))
        )
        .select(
            "series_id",
            "time_index",
            "tourism",
            "lags",
            fold_of(F.col("series_id"), F.col("time_index"), folds).alias("fold"),
        )
    )


def _columns(table):
    """numpy columns of training rows. NULL and NaN lags are both NaN; `present` tells them apart."""
    lags = table["lags"].combine_chunks().flatten()
    shape = (len(table), -1)
    return (
        table["time_index"].to_numpy(),
        table["tourism"].to_numpy(),
        lags.to_numpy(zero_copy_only=False).reshape(shape),
        table["fold"].to_numpy(),
        lags.is_valid().to_numpy(zero_copy_only=False).reshape(shape),
    )


def _numbers(column, shape):
    """A column of numbers, or of equally long lists of them, as an array."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(shape)


def _frequency(series_id):
    freq = series_id[:1].lower()
    return freq if freq in HORIZONS else "y"


def _horizons(frequency):
    return np.arange(1, HORIZONS[frequency] + 1)


CANDIDATE_ARROW = pa.struct(
    [
        ("cv_mae", pa.float64()),
        ("place", pa.int32()),
        ("family", pa.string()),
        ("coef", pa.list_(pa.float64())),
        ("train_mae", pa.float64()),
        ("validation_mae", pa.float64()),
    ]
)
KEY_ARROW = [("series_id", pa.string()), ("horizon", pa.int32())]
COUNT_ARROW = [("n_train", pa.int64()), ("n_validation", pa.int64())]
FITTED_ARROW = pa.schema([*KEY_ARROW, *COUNT_ARROW, ("candidates", pa.list_(CANDIDATE_ARROW))])
SUMS_ARROW = pa.schema(
    [*KEY_ARROW, ("n_validation", pa.int64()), ("shift", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))]
)
SOLVED_ARROW = pa.schema([*KEY_ARROW, *COUNT_ARROW, ("coefs", pa.list_(pa.float64()))])
ERRORS_ARROW = pa.schema(
    [*KEY_ARROW, ("place", pa.int32()), *[(n, pa.float64()) for n in ("cv", "train", "validation")]]
)


SERIES_FIT_ARROW = FITTED_ARROW.append(pa.field("fill", pa.list_(pa.float64())))


def _fitted_table(series_ids, horizons, n_train, n_validation, coefs, errors, candidates, predictors, fills=None):
    """One row per target with the candidates that could be fitted, if any.

    A candidate without an error estimate from the folds gets an infinite one and so comes last.
    """
    n_train, n_validation = np.asarray(n_train), np.asarray(n_validation)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = errors / np.stack([n_train, n_train, n_validation], axis=1)[:, None, :]
    cv = np.where(np.isnan(mean[:, :, 0]), np.inf, mean[:, :, 0])
    fitted = ~np.isnan(coefs).any(axis=2) & (n_train + n_validation > 0)[:, None]
    full = lm.full_width(coefs, predictors)[fitted]
    place = np.broadcast_to(np.arange(len(candidates), dtype=np.int32), fitted.shape)[fitted]
    models = pa.StructArray.from_arrays(
        [
            pa.array(cv[fitted]),
            pa.array(place),
            pa.array(candidates).take(pa.array(place)),
            pa.ListArray.from_arrays(
                pa.array(np.arange(len(full) + 1, dtype=np.int32) * full.shape[1]), pa.array(full.ravel())
            ),
            pa.array(mean[:, :, 1][fitted], from_pandas=True),
            pa.array(mean[:, :, 2][fitted], from_pandas=True),
        ],
        fields=list(CANDIDATE_ARROW),
    )
    ends = np.concatenate([[0], fitted.sum(axis=1).cumsum()]).astype(np.int32)
    table = pa.table(
        [
            series_ids if isinstance(series_ids, pa.Array) else pa.array(series_ids, pa.string()),
            horizons if isinstance(horizons, pa.Array) else pa.array(horizons, pa.int32()),
            pa.array(n_train, pa.int64()),
            pa.array(n_validation, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), models),
        ],
        schema=FITTED_ARROW,
    )
    if fills is not None:
        table = table.append_column("fill", fills)
    return table.filter(pa.array(fitted.any(axis=1)))


def _table(rows, schema):
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


SERIES_FIT_SCHEMA = f"{FITTED_SCHEMA}, fill array<double>"


def _fit_whole(ts, predictors, candidates, folds, holdout):
    """One row of values per series, whose length the caller has bounded; only these rows are shuffled."""
    fold = fold_of(F.col("series_id"), F.col("time_index"), folds)
    future_limit(holdout)  # refuses an unknown name
    # Few bytes but much work a row: the number of tasks is not left to the size of the data.
    parts = int(ts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = ts.repartition(parts, "series_id").groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("time_index", "tourism", fold.alias("fold")))).alias("rows")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("series_id").to_pylist(), batch.column("rows")
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            start = 0
            while start < len(ids):
                before = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, before + BATCH_VALUES, side="right"))
                stop = min(max(start + 1, stop), start + BATCH_SERIES)
                columns = [_series_columns(lists[i].values, _frequency(ids[i]), holdout) for i in range(start, stop)]
                table = _fit_series(ids[start:stop], columns, predictors, candidates, folds)
                yield from table.to_batches()
                start = stop

    return series.mapInArrow(fit, SERIES_FIT_SCHEMA)


def _series_columns(rows, frequency, holdout):
    """Training rows of a whole series as `_columns` has them, and whether any of its values is not finite."""
    time_index, values = rows.field("time_index").to_numpy(), rows.field("tourism")
    known = values.is_valid().to_numpy(zero_copy_only=False)
    y = values.to_numpy(zero_copy_only=False).astype(float)
    depth = N_LAGS + MAX_HORIZON

    def earlier(column, missing):
        padded = np.concatenate([np.full(depth, missing, dtype=column.dtype), column])
        return np.lib.stride_tricks.sliding_window_view(padded[:-1], depth)[:, ::-1]

    lags, present = earlier(y, np.nan), earlier(known, False)
    limit = TRAIN_FUTURE_ROWS if holdout == "fixed" else HORIZONS[frequency]
    after = len(y) - 1 - np.arange(len(y))
    used = (after > limit) & present[:, N_LAGS - 1 :].any(axis=1) & np.isfinite(y)
    columns = (time_index, y, lags, rows.field("fold").to_numpy(), present)
    return tuple(np.ascontiguousarray(c[used]) for c in columns), not np.isfinite(y).all()


def _lag_medians(rows, horizons):
    """Medians of lag_1 to lag_12 over each horizon's rows, NULL and NaN left out; 0 where nothing is left."""
    _, _, lags, _, present = rows
    out = np.zeros((len(horizons), N_LAGS))
    for i, h in enumerate(horizons):
        own = lags[present[:, h + N_LAGS - 1], h : h + N_LAGS]
        for k in range(N_LAGS):
            column = own[~np.isnan(own[:, k]), k]
            if len(column):
                out[i, k] = np.median(column)
    return out


def _fill_columns(medians, predictors):
    fill = np.zeros((len(medians), 1 + len(predictors)))
    for column, name in enumerate(predictors, start=1):
        if name in LAG_NAMES:
            fill[:, column] = medians[:, LAG_NAMES.index(name)]
    return fill


def _fit_series(ids, columns, predictors, candidates, folds):
    """Fit several series: product sums and errors for each, solutions for all their targets at once."""
    parts, targets, shared = [], [], []
    for series_id, (rows, gaps) in zip(ids, columns):
        if not len(rows[0]):
            continue
        frequency = _frequency(series_id)
        horizons = _horizons(frequency)
        medians = _lag_medians(rows, horizons) if gaps else None
        fill = None if medians is None else _fill_columns(medians, predictors)
        shift = lm.shifts(predictors, rows[1].mean(), int(rows[0].min()))
        sums, n_validation = lm.product_sums(rows, horizons, predictors, folds, fill, shift)
        kept = (n_validation > 0) | sums[:, :, 0, 0].any(axis=1)
        if kept.any():
            own = None if fill is None else fill[kept]
            parts.append((rows, horizons[kept], own, shift))
            shared.append(shared_lags.shares_lags(rows, gaps, predictors))
            fills = [None] * int(kept.sum()) if medians is None else medians[kept].tolist()
            targets.append((series_id, sums[kept], n_validation[kept], SEASON_LAGS[frequency], fills))
    if not parts:
        return SERIES_FIT_ARROW.empty_table()
    sizes = [len(p[1]) for p in parts]
    horizons = np.concatenate([p[1] for p in parts])
    sums = np.concatenate([t[1] for t in targets])
    seasons = np.repeat([t[3] for t in targets], sizes)
    shifts = np.repeat(np.stack([p[3] for p in parts]), sizes, axis=0)
    coefs = np.concatenate(
        [
            lm.fit_candidates(sums[own], horizons[own], candidates, predictors, seasons[own], shifts[own])
            for own in (slice(at, at + BATCH_TARGETS) for at in range(0, len(sums), BATCH_TARGETS))
        ]
    )
    own_coefs = np.split(coefs, np.cumsum(sizes)[:-1])
    _resist(parts, [t[1] for t in targets], own_coefs, shared, predictors, candidates, folds)
    errors = [
        lm.error_sums(rows, own, predictors, part, fill) for (rows, own, fill, _), part in zip(parts, own_coefs)
    ]
    n_train = sums[:, :, 0, 0].sum(axis=1).astype(np.int64)
    fills = pa.array([f for t in targets for f in t[4]], pa.list_(pa.float64()))
    names = np.repeat([t[0] for t in targets], sizes)
    n_validation = np.concatenate([t[2] for t in targets])
    return _fitted_table(
        names, horizons, n_train, n_validation, coefs[:, :, -1], np.concatenate(errors), candidates, predictors, fills
    )


def _resist(parts, sums, coefs, shared, predictors, candidates, folds):
    """Replace the start of each huber candidate, in place, by its reweighted fits: those of series that share
    their lags together, the others one by one."""
    places = lm.huber_places(candidates)
    if not places:
        return
    # Those laid out together have as many horizons, the first ones of their frequency.
    alike = {}
    for i, (_, horizons, _, _) in enumerate(parts):
        alike.setdefault(len(horizons) if shared[i] else None, []).append(i)
    for i in alike.pop(None, []):
        rows, own, fill, shift = parts[i]
        for place, number in places:
            coefs[i][:, place] = lm.huber_fit(rows, own, predictors, coefs[i][:, place], number, fill, shift)
    for horizons, those in alike.items():
        weights = [len(parts[i][0][0]) * horizons * (folds + 1) for i in those]
        for group in shared_lags.together(np.array(weights)):
            own = [those[i] for i in group]
            layout = shared_lags.SharedLags([parts[i][0] for i in own], parts[own[0]][1], predictors, folds)
            varies = lm.varying(np.stack([sums[i] for i in own]))
            for place, number in places:
                found = layout.huber(np.stack([coefs[i][:, place] for i in own]), number, varies)
                for i, part in zip(own, found):
                    coefs[i][:, place] = part


def _fit_chunked(ts, rows, predictors, candidates, folds, chunk_rows):
    rows = rows.withColumn("chunk", chunk_of("time_index", chunk_rows))
    levels = rows.groupBy("series_id").agg(F.avg("tourism").alias("level"), F.min("time_index").alias("start"))
    medians = _medians(ts, rows)
    if medians is None:
        known = levels.withColumn("medians", F.lit(None).cast(MEDIANS_TYPE))
    else:
        known = levels.join(shuffled(medians), "series_id", "left")
    known = staged(known, "levels")
    rows = rows.join(shuffled(known), "series_id")
    sums = rows.groupBy("series_id", "chunk").applyInArrow(_chunk_sums(predictors, folds), SUMS_SCHEMA)
    # Sums of one target pass through one task as a stream, one small matrix per chunk and fold.
    solved = (
        sums.repartition("series_id", "horizon")
        .sortWithinPartitions("series_id", "horizon")
        .mapInArrow(_add_and_solve(predictors, candidates, folds), SOLVED_SCHEMA)
    )
    # Stored, since both the scoring pass and the final result need it.
    solved = staged(solved, "solved")
    if lm.huber_places(candidates):
        solved = staged(_resistant(rows, solved, predictors, candidates, folds), "solved")
    models = solved.groupBy("series_id").agg(F.collect_list(F.struct("horizon", "coefs")).alias("models"))
    per_chunk = _per_chunk(rows, models, "models")
    errors = (
        rows.groupBy("series_id", "chunk")
        .cogroup(per_chunk.groupBy("model_series", "model_chunk"))
        .applyInArrow(_chunk_errors(predictors, candidates, folds), ERRORS_SCHEMA)
        .groupBy("series_id", "horizon", "place")
        .agg(*[F.sum(c).alias(c) for c in ("cv", "train", "validation")])
        .groupBy("series_id", "horizon")
        .agg(F.sort_array(F.collect_list(F.struct("place", "cv", "train", "validation"))).alias("errors"))
    )
    fitted = errors.join(shuffled(solved), ["series_id", "horizon"]).mapInArrow(
        _describe(predictors, candidates, folds), FITTED_SCHEMA
    )
    if medians is None:
        return fitted.withColumn("fill", F.lit(None).cast("array<double>"))
    own = F.filter("medians", lambda m: m["horizon"] == F.col("horizon"))
    return fitted.join(shuffled(known.select("series_id", "medians")), "series_id").withColumn(
        "fill", F.get(own, F.lit(0))["lags"]
    )


MEDIANS_TYPE = "array<struct<horizon: int, lags: array<double>>>"


def _medians(ts, rows):
    """Per series, the medians of lag_1 to lag_12 for each horizon, over the horizon's training rows.

    Only series with a non-finite value need them; None if there is no such series. A lag without any
    value has the median 0.
    """
    marked = ts.where(~is_finite(F.col("tourism"))).select("series_id").distinct()
    if not marked.head(1):
        return None
    features = per_horizon(
        rows.join(shuffled(marked), "series_id", "left_semi").withColumn("future_record_count", F.lit(0))
    ).where(F.col(f"lag_{N_LAGS}").isNotNull())
    lags = F.array(*[F.coalesce(name, F.lit(0.0)) for name in LAG_NAMES])
    by_horizon = F.sort_array(F.collect_list(F.struct(F.col("horizon").cast("int").alias("horizon"), lags.alias("lags"))))
    return (
        exact_medians(features, ["series_id", "horizon"], LAG_NAMES)
        .groupBy("series_id")
        .agg(by_horizon.cast(MEDIANS_TYPE).alias("medians"))
    )


def _chunk_medians(table, horizons, predictors):
    """Medians per horizon for the columns of the design, or None if all values are finite."""
    found = table["medians"][0].as_py()
    if not found:
        return None
    fill = np.zeros((len(horizons), 1 + len(predictors)))
    at = [(1 + i, LAG_NAMES.index(name)) for i, name in enumerate(predictors) if name in LAG_NAMES]
    for row in found:
        for column, lag in at:
            fill[np.asarray(horizons) == row["horizon"], column] = row["lags"][lag]
    return fill


def _chunk_shift(table, predictors):
    return lm.shifts(predictors, table["level"][0].as_py(), table["start"][0].as_py())


def _chunk_sums(predictors, folds):
    def chunk_sums(table: pa.Table) -> pa.Table:
        series_id = table["series_id"][0].as_py()
        horizons = _horizons(_frequency(series_id))
        fill = _chunk_medians(table, horizons, predictors)
        shift = _chunk_shift(table, predictors)
        sums, n_validation = lm.product_sums(_columns(table), horizons, predictors, folds, fill, shift)
        out = [
            (series_id, h, n_validation[i], shift, lm.packed(sums[i]).ravel())
            for i, h in enumerate(horizons)
            if n_validation[i] or sums[i, :, 0, 0].any()
        ]
        return _table(out, SUMS_ARROW)

    return chunk_sums


SOLVED_AT_ONCE = 256


def _add_and_solve(predictors, candidates, folds):
    side = 2 + len(predictors)

    def solved(done):
        horizons = np.array([key[1] for key, *_ in done])
        seasons = np.array([SEASON_LAGS[_frequency(key[0])] for key, *_ in done])
        sums = np.stack([total for _, total, _, _ in done])
        coefs = lm.fit_candidates(sums, horizons, candidates, predictors, seasons, np.stack([x[3] for x in done]))
        n_train = sums[:, :, 0, 0].sum(axis=1)
        rows = [
            (*key, int(n), validation, coef.ravel())
            for (key, _, validation, _), n, coef in zip(done, n_train, coefs)
        ]
        return _table(rows, SOLVED_ARROW).to_batches()

    def add(batches):
        done, key, total, n_validation, shift = [], None, None, 0, None
        for batch in batches:
            parts = lm.unpacked(_numbers(batch["sums"], (-1, folds, side * (side + 1) // 2 + 2 * side)), side)
            row_shifts = _numbers(batch["shift"], (-1, side))
            keys = zip(batch["series_id"].to_pylist(), batch["horizon"].to_pylist())
            for row_key, part, row_shift, validation in zip(keys, parts, row_shifts, batch["n_validation"].to_pylist()):
                if row_key != key:
                    if key is not None:
                        done.append((key, total, n_validation, shift))
                    key, total, n_validation, shift = row_key, part, validation, row_shift
                else:
                    total = lm.added(total, part)
                    n_validation += validation
                if len(done) >= SOLVED_AT_ONCE:
                    yield from solved(done)
                    done = []
        if key is not None:
            yield from solved([*done, (key, total, n_validation, shift)])

    return add


def _per_chunk(rows, per_series, name):
    """One row per chunk with a list of its series' targets, to be met by the chunk's rows."""
    return (
        rows.select("series_id", "chunk")
        .distinct()
        .join(shuffled(per_series), "series_id")
        .select(F.col("series_id").alias("model_series"), F.col("chunk").alias("model_chunk"), name)
    )


def _resistant(rows, solved, predictors, candidates, folds):
    """Replace the start of each huber candidate by its reweighted fits, one pass over the chunks per step."""
    width, places = 1 + len(predictors), lm.huber_places(candidates)
    side = 2 + len(predictors)

    def listed(states):
        models = F.sort_array(F.collect_list(F.struct("horizon", "coefs", "bounds"))).alias("models")
        return _per_chunk(rows, states.groupBy("series_id").agg(models), "models")

    def cogrouped(states, function, schema):
        groups = listed(states).groupBy("model_series", "model_chunk")
        return rows.groupBy("series_id", "chunk").cogroup(groups).applyInArrow(function, schema)

    def chunk_of_rows(table, models):
        series_id, models = table["series_id"][0].as_py(), models["models"][0].as_py()
        kept = np.array([m["horizon"] for m in models])
        coefs = np.array([m["coefs"] for m in models]).reshape(len(kept), len(places), folds + 1, width)
        bounds = np.array([m["bounds"] or [0.0] * (len(places) * (folds + 1)) for m in models])
        fill = _chunk_medians(table, _horizons(_frequency(series_id)), predictors)
        fill = None if fill is None else fill[kept - 1]
        return series_id, kept, coefs, bounds.reshape(len(kept), len(places), folds + 1), fill

    def chunk_errors(table: pa.Table, models: pa.Table) -> pa.Table:
        if not len(table) or not len(models):
            return _table([], PART_ARROW)
        series_id, kept, coefs, _, fill = chunk_of_rows(table, models)
        found = [lm.absolute_errors(_columns(table), kept, predictors, coefs[:, p], fill) for p in range(len(places))]
        return _table([(series_id, h, np.stack([x[i] for x in found]).ravel(), None) for i, h in enumerate(kept)], PART_ARROW)

    def chunk_sums(table: pa.Table, models: pa.Table) -> pa.Table:
        if not len(table) or not len(models):
            return _table([], PART_ARROW)
        series_id, kept, coefs, bounds, fill = chunk_of_rows(table, models)
        shift, columns = _chunk_shift(table, predictors), _columns(table)
        found = [
            lm.packed(lm.weighted_sums(columns, kept, predictors, coefs[:, p], bounds[:, p], fill, shift))
            for p in range(len(places))
        ]
        return _table([(series_id, h, np.stack([x[i] for x in found]).ravel(), shift) for i, h in enumerate(kept)], PART_ARROW)

    def totals(finish):
        """Add up the parts of each target, which follow one another, and turn the total into a state."""

        def run(batches):
            key, total, shift = None, None, None
            for batch in batches:
                out = []
                for series_id, horizon, part, own in zip(
                    batch["series_id"].to_pylist(), batch["horizon"].to_pylist(), batch["part"], batch["shift"].to_pylist()
                ):
                    part = np.array(part.values)
                    if (series_id, horizon) != key:
                        if key is not None:
                            out.append((*key, finish(total, shift)))
                        key, total, shift = (series_id, horizon), part, own
                    else:
                        total = _joined(total, part)
                yield from _table(out, STATE_ARROW).to_batches()
            if key is not None:
                yield from _table([(*key, finish(total, shift))], STATE_ARROW).to_batches()

        return run

    def _joined(total, part):
        if part.size == len(places) * (folds + 1) * 2:
            return total + part
        shape = (len(places), folds + 1, -1)
        both = [lm.unpacked(x.reshape(shape), side) for x in (total, part)]
        return lm.packed(lm.added(*both)).ravel()

    def to_bounds(total, _):
        errors = total.reshape(len(places), folds + 1, 2)
        return np.stack([lm.huber_bounds(e, number) for e, (_, number) in zip(errors, places)]).ravel()

    def to_coefs(total, shift):
        sums = lm.unpacked(total.reshape(len(places), folds + 1, -1), side)
        return lm.weighted_fit(sums, np.array(shift)).ravel()

    def reduced(parts, finish):
        ordered = parts.repartition("series_id", "horizon").sortWithinPartitions("series_id", "horizon")
        return ordered.mapInArrow(totals(finish), STATE_SCHEMA)

    size = (folds + 1) * width
    start = F.flatten(F.array(*[F.slice("coefs", 1 + place * size, size) for place, _ in places]))
    states = solved.select("series_id", "horizon", start.alias("coefs"), F.lit(None).cast("array<double>").alias("bounds"))
    bounds = reduced(cogrouped(states, chunk_errors, PART_SCHEMA), to_bounds)
    bounds = staged(bounds.withColumnRenamed("state", "bounds"), "bounds")
    keys = ["series_id", "horizon"]
    states = states.drop("bounds").join(shuffled(bounds), keys)
    for _ in range(lm.HUBER_STEPS):
        stepped = reduced(cogrouped(states, chunk_sums, PART_SCHEMA), to_coefs).withColumnRenamed("state", "coefs")
        states = staged(stepped, "huber").join(shuffled(bounds), keys)
    # Each huber candidate's stretch of the coefficients comes from the last step.
    order = {place: i for i, (place, _) in enumerate(places)}
    pieces = [
        F.slice("fitted", 1 + order[p] * size, size) if p in order else F.slice("coefs", 1 + p * size, size)
        for p in range(len(candidates))
    ]
    last = states.select(*keys, F.col("coefs").alias("fitted"))
    return solved.join(shuffled(last), keys).withColumn("coefs", F.flatten(F.array(*pieces))).select(*solved.columns)


PART_SCHEMA = "series_id string, horizon int, part array<double>, shift array<double>"
PART_ARROW = pa.schema([*KEY_ARROW, ("part", pa.list_(pa.float64())), ("shift", pa.list_(pa.float64()))])
STATE_SCHEMA = "series_id string, horizon int, state array<double>"
STATE_ARROW = pa.schema([*KEY_ARROW, ("state", pa.list_(pa.float64()))])


def _chunk_errors(predictors, candidates, folds):
    shape = (-1, len(candidates), folds + 1, 1 + len(predictors))

    def chunk_errors(table: pa.Table, solved: pa.Table) -> pa.Table:
        if not len(table) or not len(solved):
            return _table([], ERRORS_ARROW)
        series_id = table["series_id"][0].as_py()
        horizons = _horizons(_frequency(series_id))
        fill = _chunk_medians(table, horizons, predictors)
        models = sorted(solved["models"][0].as_py(), key=lambda m: m["horizon"])
        kept = np.array([m["horizon"] for m in models])
        coefs = np.array([m["coefs"] for m in models]).reshape(shape)
        fill = None if fill is None else fill[kept - 1]
        errors = lm.error_sums(_columns(table), kept, predictors, coefs, fill)
        return _table(
            [(series_id, h, c, *errors[i, c]) for i, h in enumerate(kept) for c in range(len(candidates))],
            ERRORS_ARROW,
        )

    return chunk_errors


def _describe(predictors, candidates, folds):
    shape = (-1, len(candidates), folds + 1, 1 + len(predictors))

    def describe(batches):
        for batch in batches:
            if len(batch):
                errors = batch["errors"].flatten()
                errors = [_numbers(errors.field(c), (len(batch), -1)) for c in ("cv", "train", "validation")]
                yield from _fitted_table(
                    batch["series_id"],
                    batch["horizon"],
                    batch["n_train"].to_numpy(),
                    batch["n_validation"].to_numpy(),
                    _numbers(batch["coefs"], shape)[:, :, -1],
                    np.stack(errors, axis=2),
                    candidates,
                    predictors,
                ).to_batches()

    return describe


def trend_models(
    ts: DataFrame, horizon: int = 1, holdout: str = "fixed", max_rows: int | None = None
) -> DataFrame:
    """A line through time per series, from the training rows of one horizon.

    Only these rows' times and values are needed, so the built-in regression aggregates suffice.
    """
    rows = in_sample(ts).select("series_id", "time_index", "tourism")
    return (
        with_lags(rows, [horizon + N_LAGS], max_rows=max_rows)
        .where((F.col("future_record_count") > future_limit(holdout)) & F.get("lags", F.lit(0)).isNotNull())
        .groupBy("series_id")
        .agg(
            F.regr_slope("tourism", "time_index").alias("slope"),
            F.regr_intercept("tourism", "time_index").alias("intercept"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def target_status(ts: DataFrame, fitted: DataFrame) -> DataFrame:
    """Every target with `fitted` or, when it had no usable training rows, `no_training_rows`."""
    grid = ts.select("series_id").distinct().select(
        "series_id", F.explode(F.sequence(F.lit(1), max_horizon(F.col("series_id")))).alias("horizon")
    )
    return grid.join(
        shuffled(fitted.select("series_id", "horizon", F.lit("fitted").alias("status"))), ["series_id", "horizon"], "left"
    ).select("series_id", "horizon", F.coalesce("status", F.lit("no_training_rows")).alias("status"))
