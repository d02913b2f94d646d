"""Trailing-window functions of one code's series as arrays: the same results as the Columns of `functions.timeseries`, for many formulas in one pass.

A library has hundreds of windows over the same rows. As Columns each is a frame of its own that Spark walks row by row, some with a list of the frame's values for every row; here a
task gets one code's rows once, in date order, and makes all windows of a depth from them. Null is NaN; a frame that begins before the series has fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.timeseries import BY, ORDER, share


_WIDE = Context(prec=400)


def _frames(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last w values of each row (NaN where there is none), which of them are known, and how many."""
    v = sliding_window_view(np.concatenate([np.full((*x.shape[:-1], w - 1), np.nan), x], axis=-1), w, axis=-1)
    known = ~np.isnan(v)
    return v, known, known.sum(axis=-1)


def _if(condition: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(condition & np.isfinite(value), value, np.nan)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b == 0, np.nan, b)


def _shifted(x: np.ndarray, k: int, fill: float) -> np.ndarray:
    out = np.full(x.shape, fill, x.dtype)
    if k < x.shape[-1]:
        out[..., k:] = x[..., : x.shape[-1] - k]
    return out


def _trailing(parts: tuple, w: int, join: Callable, empty: tuple) -> tuple:
    """Parts of single rows joined to those of each row's last w: blocks of 1, 2, 4, ... rows, of which those that make up w are put together.

    join(older parts, newer parts, rows of the older, rows of the newer); empty: parts of rows before the first. A result reads its own window's values only.
    """
    moved = lambda block, k: tuple(_shifted(p, k, e) for p, e in zip(block, empty, strict=True))
    out, done, block, width = None, 0, parts, 1
    while True:
        if w & width:
            out = block if out is None else join(moved(block, done), out, width, done)
            done += width
        if 2 * width > w:
            return out
        block = join(moved(block, width), block, width, width)
        width *= 2


def _sum(x, w):
    """From the oldest value on, so that windows with the same known values have the same sum wherever the unknown ones stand."""
    out = np.zeros(x.shape)
    for k in range(min(w, x.shape[-1]) - 1, -1, -1):
        out[..., k:] += x[..., : x.shape[-1] - k]
    return out


def _known(x, w):
    """Number of known values among the last w, and all values with 0 for unknown ones."""
    known = ~np.isnan(x)
    return _trailing((known.astype(float),), w, lambda a, b, *_: (a[0] + b[0],), (0.0,))[0], np.where(known, x, 0.0)


def _joined_moments(a, b, *_):
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    off, both = b[1] - a[1], a[0] * share
    # With no value on one side the mean is that of the other, whatever stands in for its own.
    return n, a[1] + off * share, a[2] + b[2] + off * off * both


def _moments(x, w):
    """Number, mean and sum of squared deviations of the last w; that sum is exactly 0 where all values agree."""
    known = ~np.isnan(x)
    return _trailing((known.astype(float), np.where(known, x, 0.0), np.zeros(x.shape)), w, _joined_moments, (0.0, 0.0, 0.0))


def total(x, w, least=None):
    n, filled = _known(x, w)
    return _if(n >= (least or share(w, 0.7)), _sum(filled, w))


def mean(x, w, least=None):
    n, filled = _known(x, w)
    return _if(n >= (least or share(w, 0.5)), _over(_sum(filled, w), n))


def std(x, w, least=None):
    n, _, square = _moments(x, w)
    return _if(n >= (least or share(w, 0.5, 2)), np.sqrt(_over(square, n - 1)))


def _extreme(x, w, extreme, empty):
    return _trailing((np.where(np.isnan(x), empty, x),), w, lambda a, b, *_: (extreme(a[0], b[0]),), (empty,))[0]


def largest(x, w, least=None):
    return _if(_known(x, w)[0] >= (least or share(w, 0.7)), _extreme(x, w, np.maximum, -np.inf))


def smallest(x, w):
    return _if(_known(x, w)[0] >= share(w, 0.7), _extreme(x, w, np.minimum, np.inf))


def product(x, w):
    filled = np.where(np.isnan(x), 1.0, x)
    return _if(_known(x, w)[0] >= share(w, 0.7), _trailing((filled,), w, lambda a, b, *_: (a[0] * b[0],), (1.0,))[0])


def compounded(x, w, least):
    """Return of w rows compounded, of returns above -1; `least` of any size must be known."""
    n, _ = _known(x, w)
    some, filled = _known(np.log(1 + np.where(x > -1, x, np.nan)), w)
    return _if((n >= least) & (some > 0), np.exp(_sum(filled, w)) - 1)


def rank(x, w):
    n, _ = _known(x, w)
    below, equal = np.zeros(x.shape, np.int32), np.zeros(x.shape, np.int32)
    for k in range(min(w, x.shape[-1])):
        before, now = x[..., : x.shape[-1] - k], x[..., k:]
        below[..., k:] += before < now
        equal[..., k:] += before == now
    return _if(~np.isnan(x) & (n >= share(w, 0.7, 2)), _over(below + (equal + 1) / 2, n))


def first_extreme(x, w, sign):
    n, _ = _known(x, w)
    at = np.broadcast_to(np.arange(x.shape[-1], dtype=float), x.shape)

    def join(a, b, *_):
        newer = b[0] > a[0]
        return np.where(newer, b[0], a[0]), np.where(newer, b[1], a[1])

    found, place = _trailing((np.where(np.isnan(x), -np.inf, sign * x), at), w, join, (-np.inf, np.nan))
    begin = at - (w - 1)
    return _if((n > 0) & (begin >= 0), np.where(found == -np.inf, 0.0, place - begin))


def quantile(x, w, q):
    v, _, n = _frames(x, w)
    ordered = np.sort(v, axis=-1)  # NaN last
    at = np.maximum(n - 1, 0) * q
    low = np.floor(at).astype(int)
    a, b = (np.take_along_axis(ordered, k[..., None], -1)[..., 0] for k in (low, np.minimum(low + 1, np.maximum(n - 1, 0))))
    return _if(n >= share(w, 0.7, 2), a + (b - a) * (at - low))


def _pair_moments(x, y, w):
    both = ~(np.isnan(x) | np.isnan(y))

    def join(a, b, *_):
        n = a[0] + b[0]
        share = b[0] / np.maximum(n, 1)
        off, other, each = b[1] - a[1], b[2] - a[2], a[0] * share
        return n, a[1] + off * share, a[2] + other * share, a[3] + b[3] + off * off * each, a[4] + b[4] + other * other * each, a[5] + b[5] + off * other * each

    zero = np.zeros(x.shape)
    n, _, _, xx, yy, xy = _trailing((both.astype(float), np.where(both, x, 0.0), np.where(both, y, 0.0), zero, zero, zero), w, join, (0.0,) * 6)
    return _over(xy, n - 1), np.sqrt(_over(xx, n - 1)) * np.sqrt(_over(yy, n - 1)), n


def correlation(x, y, w):
    product, spread, n = _pair_moments(x, y, w)
    return _if((n >= share(w, 0.7, 2)) & (spread > 1e-12), _over(product, np.where(spread > 1e-12, spread, np.nan)))


def covariance(x, y, w):
    product, _, n = _pair_moments(x, y, w)
    return _if(n >= share(w, 0.7, 2), product)


def weighted(x, weights):
    """weights: of the oldest row first. Unknown values, also those before the first row, leave their windows unknown."""
    weights = np.array(weights) / np.sum(weights)
    out = np.zeros(x.shape)
    for k, weight in enumerate(weights[::-1]):
        out += weight * _shifted(x, k, np.nan)
    return _if(np.isfinite(out), out)


def _line(x, w):
    """Of full windows the mean, the slope on the rows' places, and the sum of squared deviations; NaN where a value is unknown."""

    def join(a, b, older, newer):
        n = older + newer
        off = b[0] - a[0]
        return a[0] + off * (newer / n), a[1] + b[1] + off * (older * newer / 2), a[2] + b[2] + off * off * (older * newer / n)

    zero = np.where(np.isnan(x), np.nan, 0.0)
    m, product, square = _trailing((x, zero, zero), w, join, (np.nan,) * 3)
    return m, product / (w * (w * w - 1) / 12) if w > 1 else np.full(x.shape, np.nan), square


def slope(x, _, w):
    _, b, _ = _line(x, w)
    return _if(np.isfinite(b), b)


def r_square(x, _, w):
    _, b, square = _line(x, w)
    return _if(square > 0, _over(b * b * (w * (w * w - 1) / 12), square))


def residual(x, _, w):
    m, b, _ = _line(x, w)
    return _if(np.isfinite(b), x - (m + b * (w - 1) / 2))


def delayed(x, k):
    return _shifted(x, k, np.nan)


def recursive(x, n, m):
    return _if(np.ones(x.shape, bool), pd.DataFrame(x.T if x.ndim > 1 else x).ewm(alpha=m / n, adjust=False, ignore_na=False).mean().to_numpy().T.reshape(x.shape))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: the decimal that a double is written as, rounded half away from zero. Only what is near a half is rounded as a decimal itself."""
    scale = 10.0**digits
    size = np.abs(x) * scale
    with np.errstate(invalid="ignore"):
        whole = np.floor(size + 0.5)
        out = np.copysign(whole / scale, x) + 0.0
        # Doubles that are too large for so many digits are left.
        near = np.flatnonzero((np.abs(size + 0.5 - whole - 0.5) > 0.5 - 1e-9 - size * 1e-15) | (size >= 1e15))
    unit = Decimal(1).scaleb(-digits)
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP, _WIDE)) + 0.0 if np.isfinite(x[i]) else x[i]
    return out


def decayed(values: np.ndarray, halflife: float, reach: int = 64) -> np.ndarray:
    """Of each row of values the sums up to each place, weights halving every `halflife` places; scaled up and back in blocks of `reach` halvings, each on top of the one before."""
    out, before, length = np.empty_like(values), np.zeros(len(values)), max(1, int(reach * halflife))
    for at in range(0, values.shape[1], length):
        block = values[:, at : at + length]
        scale = 2.0 ** (np.arange(block.shape[1]) / halflife)
        out[:, at : at + length] = np.cumsum(block * scale, axis=1) / scale + before[:, None] / (scale * 2.0 ** (1 / halflife))
        before = out[:, at + block.shape[1] - 1]
    return out


def decayed_regression(r, m, halflife, window, deviation):
    """Slope, or residual deviation, of r on m with decaying weights, where at least half of the window's rows have both."""
    both = np.isfinite(r) & np.isfinite(m)
    r, m = np.where(both, r, 0.0), np.where(both, m, 0.0)
    n, *sums = decayed(np.stack([both.astype(float), r, m, r * r, m * m, r * m]), halflife)
    mr, mm, rr, m2, rm = (_over(s, n) for s in sums)
    vr, vm = np.maximum(rr - mr * mr, 0), np.maximum(m2 - mm * mm, 0)
    counts = np.cumsum(both)
    counts = counts - np.concatenate([np.zeros(window, int), counts])[: len(counts)]
    beta = _if((counts >= max(2, window // 2)) & (vm > 0), _over(rm - mr * mm, vm))
    return np.sqrt(np.maximum(vr - beta * beta * vm, 0)) if deviation else beta


def halflife_mean(x, window, halflife, least):
    """Mean of the window's values with decaying weights; null where the known ones have less than the share `least` of all the weight."""
    known = np.isfinite(x)
    sums = decayed(np.stack([np.where(known, x, 0.0), known.astype(float)]), halflife)
    # What left the window is the sum as it was `window` rows ago, decayed since.
    gone = np.concatenate([np.zeros((2, window)), sums], axis=1)[:, : len(x)]
    total, weight = sums - gone * 0.5 ** (window / halflife)
    whole = sum(0.5 ** (d / halflife) for d in range(window))
    return _if(weight >= least * whole * (1 - 1e-12), _over(total, np.where(weight > 0, weight, np.nan)))


#: By the names under which `expressions` builds its terms: arrays first, plain numbers after them. Arrays may have several series, each along the last axis.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "delay": delayed, "sum": total, "mean": mean, "std": std, "max": largest, "min": smallest, "prod": product, "tsrank": rank,
    "argmax": lambda x, w: first_extreme(x, w, 1), "argmin": lambda x, w: first_extreme(x, w, -1), "quantile": quantile, "corr": correlation, "cov": covariance, "count": total,
    "decay": lambda x, w: weighted(x, range(1, w + 1)), "wma": lambda x, w: weighted(x, [0.9**k for k in range(w - 1, -1, -1)]), "sma": recursive, "slope": slope, "rsquare": r_square, "resi": residual,
}
#: Of named factors; the decaying ones take one series.
NAMED_KERNELS: dict[str, Callable[..., np.ndarray]] = {"compounded": compounded, "decayedregression": decayed_regression, "halflifemean": halflife_mean}


def section_rank(x):
    """Average rank over the number of values."""
    ranks = pd.Series(x).rank().to_numpy()
    return ranks / max(1, (~np.isnan(x)).sum())


def section_scale(x):
    size = np.nansum(np.abs(x))
    return x / size if size > 0 else np.full(len(x), np.nan)


def winsorized(x, share):
    """Held within the quantiles of the known values."""
    known = x[~np.isnan(x)]
    if not len(known):
        return x
    low, high = np.quantile(known, [share, 1 - share])
    return np.maximum(np.minimum(x, high), low)


def zscored(x, clip=None):
    """Population z-score, null where all values agree."""
    known = x[~np.isnan(x)]
    spread = known.std() if len(known) and known.min() < known.max() else 0.0
    if not spread > 1e-12:
        return np.full(len(x), np.nan)
    z = (x - known.mean()) / spread
    return z if clip is None else np.clip(z, -clip, clip)


def _everywhere(x, extreme):
    known = x[~np.isnan(x)]
    return np.full(len(x), extreme(known) if len(known) else np.nan)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """1 for the smallest, the average among equal values; NaN is equal to itself and the largest, as in a sort of Spark's."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
    counts = np.diff(np.append(first, len(s)))
    out = np.empty(len(s))
    out[order] = np.repeat(first + (counts + 1) / 2, counts)
    return out


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Of two arrays of ranks, as covariance over deviations; None where one of them doesn't vary."""
    if not len(x):
        return None
    a, b = x - x.mean(), y - y.mean()
    size = np.sqrt((a * a).mean()) * np.sqrt((b * b).mean())
    return float((a * b).mean() / size) if size > 1e-12 else None


#: Of all codes of a date.
SECTIONS: dict[str, Callable[..., np.ndarray]] = {"winsor": winsorized, "z": zscored, "winsorz": lambda x, share, clip: zscored(winsorized(x, share), clip), "csrank": section_rank, "scale": section_scale, "rowmax": lambda x: _everywhere(x, np.max), "rowmin": lambda x: _everywhere(x, np.min)}


def with_series(panel: DataFrame, made: dict[str, tuple[str, tuple[str, ...], tuple]], by: str = BY, order: str = ORDER) -> DataFrame:
    """The panel with a column for each of made: name to (kernel, input columns, numbers).

    A code's rows, of the calendar's length, are one group; for SECTIONS, by date, it is the codes of a date, of the universe's size.
    """
    schema = StructType([*panel.schema.fields, *[StructField(n, DoubleType()) for n in made]])
    names, kernels = panel.columns, KERNELS | NAMED_KERNELS | SECTIONS

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(order, "ascending")]))
        arrays: dict[str, np.ndarray] = {}

        def array(name: str) -> np.ndarray:
            if name not in arrays:
                arrays[name] = pc.fill_null(rows.column(name).cast(pa.float64()), np.nan).to_numpy()
            return arrays[name]

        with np.errstate(all="ignore"):
            out = [pa.array(kernels[kind](*(array(c) for c in inputs), *numbers), from_pandas=True) for kind, inputs, numbers in made.values()]
        return pa.table([*rows.columns, *out], names=[*names, *made])

    return panel.groupBy(by).applyInArrow(walk, schema)
