"""Huber fits of short series without gaps, for all horizons, fits and several series at once.

`lag_k` at horizon h of row t is the value k rows before row t - h. By the position s = t - h, the lags and their
products are thus the same for all horizons of a series, and weighted sums for every horizon and fit are one
product of matrices. Months are not columns of the systems: given the other slopes each has a closed form, and
putting it in leaves a system of the lags and the time alone. The results are those of `linear_models.huber_fit`.
"""

import numpy as np

from tidecast.config import N_LAGS, N_MONTHS
from tidecast.functions import linear_models as lm

# Weights of series that are fitted together, so that what a step passes over stays near the processor.
WEIGHTS = 1 << 16


def shares_lags(rows, gaps, predictors):
    """Whether a series' rows follow each other without a gap, and are few enough to be laid out at once.

    With months as the only predictors there are no systems to share.
    """
    time_index = rows[0]
    return (
        not gaps
        and not all(p.startswith("month_") for p in predictors)
        and 1 < len(time_index) <= lm.BLOCK_ROWS
        and len(set(predictors)) == len(predictors)
        and time_index[-1] - time_index[0] == len(time_index) - 1
        and bool((np.diff(time_index) == 1).all())
    )


def together(sizes):
    """Places of series in groups of about WEIGHTS weights and similar size. `sizes` has each one's weights."""
    order, start = np.argsort(sizes, kind="stable"), 0
    while start < len(order):
        stop = start + 1
        # Shorter ones are filled up to the longest.
        while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= WEIGHTS and sizes[order[stop]] <= 2 * sizes[order[start]]:
            stop += 1
        yield order[start:stop].tolist()
        start = stop


class MonthlySystems:
    """Least squares with the months' slopes put in by their closed form, for many systems side by side.

    Columns are others than months, k of them, and y; the systems are the last axis. `left` are products from the
    diagonal on, row after row, (k (k + 1) / 2, systems), `right` products with y, `sums` (months, k, systems) and
    `values` sums of columns and of y per month, `count` the weight of its rows. `dummy` tells which months have a
    slope, `varies` which columns. Sums are relative to a level.

    With weight n_c in month c, penalty t_c on the square of its slope and mean residual r_c, the best slope is
    n_c / (n_c + t_c) of r_c less the intercept. What stays of n_c is n_c t_c / (n_c + t_c).
    """

    def __init__(self, months, k, systems):
        self.k = k
        # Where the rows of the triangle begin.
        self.starts = np.concatenate([[0], np.cumsum(np.arange(k, 0, -1))])
        # What is taken from the products: the months, their centre, and row after row of the factors.
        self.taken = np.empty((months + 1 + k, k + 1, systems))

    def solve(self, left, right, sums, values, count, dummy, varies, ridge):
        """Slopes, intercepts and the months' slopes. `left` is overwritten."""
        k, taken, months = self.k, self.taken, len(count)
        n = count.sum(axis=0)
        share = count / n
        penalty = ridge * n * (share - share * share)
        dummy = dummy & (penalty > 0)
        part = np.where(dummy, count / (count + penalty), 0.0)  # of the mean residual that the month takes
        stays = np.where(dummy, part * penalty, count)
        rest = stays.sum(axis=0)
        each = np.where(count > 0, 1.0 / count, 0.0)
        # What the months leave to the slopes is seen from the centre of what stays.
        stays *= each
        centre, middle = np.einsum("cs,cks->ks", stays, sums) / rest, (stays * values).sum(axis=0) / rest
        root = np.sqrt(part * each)
        np.multiply(sums, root[:, None], out=taken[:months, :k])
        np.multiply(values, root, out=taken[:months, k])
        root = np.sqrt(rest)
        np.multiply(centre, root, out=taken[months, :k])
        np.multiply(middle, root, out=taken[months, k])

        means = sums.sum(axis=0) / n
        variance = left[self.starts[:-1]] / n - means * means
        used = varies & (variance > 0)
        whole = used.all()
        for j in range(k):
            above, own, row = taken[: months + 1 + j], taken[months + 1 + j], left[self.starts[j] : self.starts[j + 1]]
            row -= np.einsum("cs,cks->ks", above[:, j], above[:, j:k])
            value = right[j] - np.einsum("cs,cs->s", above[:, j], above[:, k])
            # Rounding aside, no pivot is less than the penalty.
            least = ridge * n * variance[j]
            row[0] += least
            np.maximum(row[0], least, out=row[0])
            if not whole:
                row[...] = np.where(used[j] & used[j:], row, 0.0)
                row[0] += ~used[j]
                value = np.where(used[j], value, 0.0)
            root = np.sqrt(row[0])
            np.divide(row, root, out=own[j:k])
            np.divide(value, root, out=own[k])
        slopes = np.empty_like(right)
        for j in range(k - 1, -1, -1):
            own = taken[months + 1 + j]
            slopes[j] = (own[k] - np.einsum("ks,ks->s", own[j + 1 : k], slopes[j + 1 :])) / own[j]
        intercept = middle - (slopes * centre).sum(axis=0)
        slopes_of_months = part * ((values - np.einsum("cks,ks->cs", sums, slopes)) * each - intercept)
        # Without rows, or where all weigh nothing, there is no model.
        return slopes, np.where(n > 0, intercept, np.nan), np.where(part > 0, slopes_of_months, 0.0)


class SharedLags:
    """The layout of several series: rows by (series, phase, turn, target), where the position is twelve turns plus
    phase and a target is a horizon and a fit. A phase has one month per series and horizon.

    Systems, one per series and target, are the last axis of what is made from the rows, so that they are solved
    side by side.
    """

    def __init__(self, parts, horizons, predictors, folds):
        """`parts` has the training rows of each series."""
        self.horizons, self.predictors = horizons, predictors
        self.lag_at = [i for i, p in enumerate(predictors, 1) if p.startswith("lag_")]
        self.time_at = [i for i, p in enumerate(predictors, 1) if p == "observation_id"]
        self.month_at = {int(p.rpartition("_")[2]): i for i, p in enumerate(predictors, 1) if p.startswith("month_")}
        # Columns of the systems.
        self.at = np.array([*self.lag_at, *self.time_at], dtype=int)
        self.columns = k = len(self.at)
        back = np.array([int(predictors[i - 1].rpartition("_")[2]) for i in self.lag_at], dtype=int)
        turns = max(-(-(len(rows[0]) - 1) // N_MONTHS) for rows in parts)
        n = turns * N_MONTHS
        position = np.arange(n).reshape(turns, N_MONTHS).T.ravel()
        series, fits = len(parts), folds + 1
        self.targets = (len(horizons), fits)
        self.shape = (series, N_MONTHS, turns, len(horizons) * fits)
        self.level = np.array([rows[1].mean() for rows in parts])
        self.first = np.array([rows[0][0] for rows in parts])
        values = np.zeros((series, N_LAGS + n + horizons.max() + 1))
        fold = np.full(values.shape, -1)
        for i, rows in enumerate(parts):
            end = N_LAGS + len(rows[0])
            values[i, :N_LAGS] = rows[2][0, :N_LAGS][::-1]
            values[i, N_LAGS:end] = rows[1]
            values[i, :end] -= self.level[i]
            fold[i, N_LAGS:end] = rows[3]
        self.middle = n / 2
        self.x = np.empty((series, n, k))
        self.x[:, :, : len(back)] = values[:, position[:, None] + N_LAGS - back]
        self.x[:, :, len(back) :] = (position - self.middle)[:, None]
        across = np.ascontiguousarray(self.x.swapaxes(1, 2))
        upper = np.triu_indices(k)
        self.across, self.products = across, across[:, upper[0]] * across[:, upper[1]]
        self.by_phase = np.ascontiguousarray(across.reshape(series, k, N_MONTHS, turns).swapaxes(1, 2))
        target = position[:, None] + N_LAGS + horizons
        self.fold = fold[:, target]
        self.y = np.repeat(values[:, target], fits, axis=2).reshape(self.shape)
        self.month = (self.first[:, None, None] + horizons[:, None] + np.arange(N_MONTHS)) % N_MONTHS

    def _systems(self, per_phase):
        """(series, phases, targets) with the systems last."""
        return np.ascontiguousarray(per_phase.swapaxes(0, 1)).reshape(N_MONTHS, -1)

    def _by_series(self, systems):
        """A view of what has the systems last, by series first."""
        split = systems.reshape(*systems.shape[:-1], self.shape[0], self.shape[3])
        return np.moveaxis(split, -2, 0)

    def _times(self):
        """The time at which the column for it is 0, per series and horizon."""
        return self.first[:, None] + self.horizons + self.middle

    def inside(self, coefs):
        """Slopes and the effects of phases from coefficients (series, horizons, fits, width) for plain values."""
        level = coefs[..., 0] - self.level[:, None, None] * (1 - coefs[..., self.lag_at].sum(axis=-1))
        for i in self.time_at:
            level = level + coefs[..., i] * self._times()[:, :, None]
        months = np.zeros((*coefs.shape[:3], N_MONTHS))
        for month, i in self.month_at.items():
            months[..., month] = coefs[..., i]
        month = np.broadcast_to(self.month[:, :, None], months.shape)
        effects = level[..., None] + np.take_along_axis(months, month, axis=-1)
        return coefs[..., self.at].reshape(-1, self.columns).T, effects.reshape(-1, N_MONTHS).T

    def outside(self, slopes, intercept, months):
        """Coefficients for plain values; `months` are by phase."""
        shape = (self.shape[0], *self.targets)
        coefs = np.zeros((*shape, 1 + len(self.predictors)))
        coefs[..., self.at] = slopes.T.reshape(*shape, -1)
        lags = coefs[..., self.lag_at].sum(axis=-1)
        coefs[..., 0] = intercept.reshape(shape) + self.level[:, None, None] * (1 - lags)
        for i in self.time_at:
            coefs[..., 0] -= coefs[..., i] * self._times()[:, :, None]
        by_month = np.empty((*shape, N_MONTHS))
        month = np.broadcast_to(self.month[:, :, None], by_month.shape)
        np.put_along_axis(by_month, month, months.T.reshape(by_month.shape), axis=-1)
        for month, i in self.month_at.items():
            coefs[..., i] = by_month[..., month]
        return coefs

    def _make_room(self):
        """What the steps of the reweighted fits use again."""
        series, k, fits = self.shape[0], self.columns, self.targets[1]
        fold = self.fold[..., None]
        self.used = ((fold >= 0) & (fold != np.arange(fits))).astype(float).reshape(self.shape)
        counts = self._systems(self.used.sum(axis=2))
        self.rows = counts.sum(axis=0)
        listed = np.isin(self.month, list(self.month_at))[:, :, None]
        listed = np.broadcast_to(listed, (series, *self.targets, N_MONTHS)).reshape(-1, N_MONTHS).T
        # A month that no row or every row has is no column.
        self.dummy = (counts > 0) & (counts < self.rows) & listed
        systems = len(self.rows)
        self.left = np.empty((k * (k + 1) // 2, systems))
        self.right = np.empty((k, systems))
        self.sums = np.empty((N_MONTHS, k, systems))
        self.systems = MonthlySystems(N_MONTHS, k, systems)

    def errors(self, slopes, effects):
        scores = (self.x @ self._by_series(slopes)).reshape(self.shape)
        scores += self._by_series(effects)[:, :, None]
        scores -= self.y
        return np.abs(scores, out=scores)

    def huber(self, coefs, number, varies):
        """Coefficients (series, horizons, fits, width) after the reweighted fits from a start, for plain values.

        `varies` tells which columns vary in the rows of a fit, in the order of the coefficients.
        """
        self._make_room()
        varies = varies[..., self.at].reshape(-1, self.columns).T
        slopes, effects = self.inside(coefs)
        errors = self.errors(slopes, effects)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            total = np.einsum("scta,scta->sa", errors, self.used).ravel()
            bounds = lm.huber_bounds(np.stack([total, self.rows], axis=-1), number)
            # An error of 0 has no bound, also where the bound is 0 or there is none.
            least = np.minimum if (bounds > 0).all() else np.fmin
            bounds = bounds.reshape(self.shape[0], 1, 1, -1)
            for step in range(lm.HUBER_STEPS):
                if step:
                    errors = self.errors(slopes, effects)
                # Rows beyond the bound are weighted down to it.
                weights = np.divide(bounds, errors, out=errors)
                least(weights, 1.0, out=weights)
                weights *= self.used
                slopes, intercept, months = self.solved(weights, varies)
                effects = intercept + months
        return self.outside(slopes, intercept, months)

    def solved(self, weights, varies):
        """Weighted least squares: slopes, intercept, and the months' slopes by phase. Changes the weights."""
        left, right, sums = self.left, self.right, self.sums
        flat = weights.reshape(self.shape[0], -1, self.shape[3])
        np.matmul(self.products, flat, out=self._by_series(left))
        np.matmul(self.by_phase, weights, out=self._by_series(sums))
        count = self._systems(weights.sum(axis=2))
        weights *= self.y
        values = self._systems(weights.sum(axis=2))
        np.matmul(self.across, flat, out=self._by_series(right))
        return self.systems.solve(left, right, sums, values, count, self.dummy, varies, lm.HUBER_PENALTY)
