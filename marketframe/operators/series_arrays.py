"""The processed feature table of whole series as arrays: indicators, label, row drops and clean-up in one pass.

The window expressions of ``indicators`` cost some hundred microseconds a row, as every one of about 120 window
functions walks the wide rows. Here the bars of some series at a time become matrices (row of the series, series),
and every column is a few array operations over all of them; a recurrence is one step a row for all series and all
weighted sums together. A null is NaN inside, and the rules for nulls are those of the expressions. Series must fit
into a task (``SERIES_ROWS``); ``features.engineer_features`` sends longer ones through the windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..config import NEUTRAL_SENTIMENT, LabelThresholds
from .indicators import (AROON_LENGTH, BB_LENGTH, BB_STD, CANDLE_EPS, CCI_CONSTANT, EMA_LENGTHS, EPS, INT_FEATURES,
                         RETURN_LAGS, SMA_LENGTHS)
from .windows import IDX

SERIES_ROWS = 20_000      # rows of a series that a task may hold as arrays
CELLS = 40_000            # cells of a matrix: series share one while their number times the longest stays below
PRICES = ["open", "high", "low", "close", "volume"]
CALENDAR = ["day_of_week", "month", "quarter", "is_month_end"]
# Rows are kept only once these warm-up indicators are all present.
CORE_COLUMNS = ["rsi_14", "macd", "sma_50"]


def series_bounds(key: pa.ChunkedArray) -> np.ndarray:
    """Where the series begin, and the end, of rows that lie together by ``key`` (null is a key)."""
    codes = key.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else np.zeros(1, int)


def whole_series(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole series with their bounds, out of batches whose rows are sorted by series. The last series of a
    batch may go on in the next one and waits for it."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        held.append(x)
        if sum(b.num_rows for b in held) < CELLS or not x.num_rows:
            continue
        table = pa.Table.from_batches(held)
        bounds = series_bounds(table.column(by))
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        held = table.slice(bounds[-2]).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table, series_bounds(table.column(by))


def matrices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of series (from, to) that share a matrix."""
    lengths, first, most = np.diff(bounds), 0, 0
    for k, n in enumerate(lengths):
        if k > first and (k + 1 - first) * max(most, n) > CELLS:
            yield first, k
            first, most = k, 0
        most = max(most, n)
    if len(lengths):
        yield first, len(lengths)


# ---- columns over (row, series); a null is NaN ----------------------------------------------------------------


def lag(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    out[n:] = x[:-n] if n < len(x) else x[:0]
    return out


def div(a, b):
    """Null for a zero divisor."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def rolled_sum(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of the last n rows, oldest first; null until all n are there."""
    out, m = np.full_like(x, np.nan), len(x) - n + 1
    if m > 0:
        acc = x[:m].copy()
        for k in range(1, n):
            acc += x[k:k + m]
        out[n - 1:] = acc
    return out


def rolled_deviation(x: np.ndarray, n: int, free: int) -> np.ndarray:
    """Standard deviation of the last n rows, taken about the oldest one first, so that equal values give zero."""
    out, m = np.full_like(x, np.nan), len(x) - n + 1
    if m > 0:
        first, total, squares = x[:m], np.zeros_like(x[:m]), np.zeros_like(x[:m])
        for k in range(1, n):
            total += x[k:k + m] - first
        mean = total / n
        for k in range(n):
            squares += (x[k:k + m] - first - mean) ** 2
        out[n - 1:] = np.sqrt(squares / (n - free))
    return out


def rolled_extreme(pick: Callable, x: np.ndarray, n: int) -> np.ndarray:
    """pick: np.minimum or np.maximum; null where a row of the frame is."""
    out, m = np.full_like(x, np.nan), len(x) - n + 1
    if m > 0:
        acc = x[:m].copy()
        for k in range(1, n):
            pick(acc, x[k:k + m], out=acc)
        out[n - 1:] = acc
    return out


def rows_since(x: np.ndarray, n: int, sign: float) -> np.ndarray:
    """Rows since the least (sign 1) or greatest (-1) of the last n rows, the latest of equals; a null sorts first."""
    x = np.where(np.isnan(x), -np.inf, x) * sign
    out, m = np.full_like(x, np.nan), len(x) - n + 1
    if m > 0:
        best, at = x[:m].copy(), np.full((m, x.shape[1]), float(n - 1))
        for k in range(1, n):
            np.copyto(at, n - 1 - k, where=x[k:k + m] <= best)
            np.minimum(best, x[k:k + m], out=best)
        out[n - 1:] = at
    return out


def running(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Running sum of the known values, null before the first."""
    return np.where(np.cumsum(known, axis=0) > 0, np.cumsum(np.where(known, x, 0.0), axis=0), np.nan)


def weighted_sums(ys: list[np.ndarray], alphas: list[float]) -> list[np.ndarray]:
    """N(t) = (1 - alpha) N(t - 1) + y(t) of every y, all together."""
    y, r = np.stack(ys, axis=1), (1.0 - np.array(alphas))[:, None]
    n = np.zeros(y.shape[1:])
    for t in range(len(y)):
        n *= r
        n += y[t]
        y[t] = n
    return [y[:, k] for k in range(len(ys))]


def _rma_sums(x: np.ndarray, observed: np.ndarray) -> list[np.ndarray]:
    return [np.where(observed, x, 0.0), observed.astype(float)]


def _ema_input(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What is summed: the seed (mean of the frame of n rows at the n-th observed one) over alpha, then the values;
    and where the series is known."""
    observed = ~np.isnan(x)
    seen = np.cumsum(observed, axis=0)
    y = np.where(observed & (seen > n), x, 0.0)
    own = np.flatnonzero(seen[-1] >= n)
    at = (seen[:, own] >= n).argmax(axis=0)
    frame = at - np.arange(n - 1, -1, -1)[:, None]
    values = np.where(frame >= 0, x[np.maximum(frame, 0), own], np.nan)
    known = ~np.isnan(values)
    y[at, own] = np.cumsum(np.where(known, values, 0.0), axis=0)[-1] / known.sum(axis=0) / (2.0 / (n + 1))
    return y, seen >= n


def indicator_arrays(o, h, l, c, v, v_null, i) -> dict[str, np.ndarray]:  # noqa: E741
    """The indicator columns but the calendar's; ``v_null`` tells where the volume is null, ``i`` is the row."""
    f: dict[str, np.ndarray] = {}
    c1, o1, nan = lag(c, 1), lag(o, 1), np.isnan
    up, dn, diff = h - lag(h, 1), lag(l, 1) - l, c - c1
    hl = np.where(h == l, EPS, h - l)
    tr = np.where(nan(c1), np.nan, np.fmax(np.fmax(np.abs(hl), np.abs(h - c1)), np.abs(c1 - l)))
    moved, changed = ~nan(up), ~nan(diff)
    pos, neg = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
    pos, neg = (np.where(np.abs(x) < EPS, 0.0, x) for x in (pos, neg))
    gain, loss = np.where(diff > 0, diff, 0.0), np.where(diff < 0, -diff, 0.0)

    emas = {n: _ema_input(c, n) for n in [*EMA_LENGTHS, 12, 26]}
    ys, alphas = [y for y, _ in emas.values()], [2.0 / (n + 1) for n in emas]
    for n, seen, xs in ((7, changed, (gain, loss)), (14, changed, (gain, loss)), (14, ~nan(tr), (tr,)), (14, moved, (pos, neg))):
        own = [np.where(seen, x, 0.0) for x in xs] + [seen.astype(float)]
        ys, alphas = ys + own, alphas + [1.0 / n] * len(own)
    sums = weighted_sums(ys, alphas)
    ema = {n: np.where(known, 2.0 / (n + 1) * s, np.nan) for (n, (_, known)), s in zip(emas.items(), sums)}
    ag7, al7, d7, ag14, al14, d14, tr14, dtr, p14, n14, dup = sums[len(emas):]

    def rma(num, den, seen, n):
        return np.where(np.cumsum(seen, axis=0) >= n, div(num, den), np.nan)

    rsi = {}
    for n, g, s, d in ((7, ag7, al7, d7), (14, ag14, al14, d14)):
        g, s = rma(g, d, changed, n), rma(s, d, changed, n)
        rsi[n] = div(100.0 * g, g + np.abs(s))
    atr = rma(tr14, dtr, ~nan(tr), 14)
    plus, minus = (div(np.full_like(atr, 100.0), atr) * rma(x, dup, moved, 14) for x in (p14, n14))
    dx = div(100.0 * np.abs(plus - minus), plus + minus)
    macd = ema[12] - ema[26]
    y, known = _ema_input(macd, 9)
    signal, adx, dadx = weighted_sums([y, *_rma_sums(dx, ~nan(dx))], [0.2, 1.0 / 14, 1.0 / 14])
    signal, adx = np.where(known, 0.2 * signal, np.nan), rma(adx, dadx, ~nan(dx), 14)

    for n in RETURN_LAGS:
        f[f"log_return_{n}d"] = np.log(div(c, lag(c, n)))
    f["overnight_gap"] = np.log(div(o, c1))
    for n in SMA_LENGTHS:
        f[f"sma_{n}"] = rolled_sum(c, n) / n
        f[f"price_sma{n}_ratio"] = div(c, f[f"sma_{n}"])
    for n in EMA_LENGTHS:
        f[f"ema_{n}"], f[f"price_ema{n}_ratio"] = ema[n], div(c, ema[n])
    f["rsi_7"], f["rsi_14"] = rsi[7], rsi[14]
    gate = ~nan(rolled_sum(np.where(nan(l + h), np.nan, 0.0), 14))
    ll, hh = (np.where(gate, rolled_extreme(pick, x, 14), np.nan) for pick, x in ((np.minimum, l), (np.maximum, h)))
    raw = np.where(hh == ll, 0.0, div(100.0 * (c - ll), hh - ll))
    f["stoch_k"] = rolled_sum(raw, 3) / 3
    f["stoch_d"] = rolled_sum(f["stoch_k"], 3) / 3
    f["willr_14"] = 100.0 * (div(c - ll, hh - ll) - 1.0)
    tp = (h + l + c) / 3.0
    mean, spread = rolled_sum(tp, 20) / 20, np.zeros_like(tp)
    for k in range(20):
        spread += np.abs(lag(tp, k) - mean if k else tp - mean)
    f["cci_20"] = div(tp - mean, CCI_CONSTANT * (spread / 20.0))
    f["roc_10"], f["roc_20"] = (100.0 * div(c - lag(c, n), lag(c, n)) for n in (10, 20))
    f["macd"], f["macd_hist"], f["macd_signal"], f["adx"] = macd, macd - signal, signal, adx
    f["aroon_down"], f["aroon_up"] = (100.0 * (1.0 - rows_since(x, AROON_LENGTH + 1, sign) / AROON_LENGTH) for x, sign in ((l, 1.0), (h, -1.0)))
    mid, sd = rolled_sum(c, BB_LENGTH) / BB_LENGTH, rolled_deviation(c, BB_LENGTH, 0)
    low, high = mid - BB_STD * sd, mid + BB_STD * sd
    f["bb_lower"], f["bb_mid"], f["bb_upper"] = low, mid, high
    f["bb_width"], f["bb_pct_b"] = div(high - low, mid), div(c - low, high - low + CANDLE_EPS)
    f["atr_14"] = atr
    f["hist_vol_20"] = rolled_deviation(div(c, c1) - 1.0, 20, 1) * math.sqrt(252.0)
    f["obv"] = running(np.where(i == 0, 1.0, np.sign(diff)) * v, ~v_null & (changed | (i == 0)))
    f["vwap"] = div(running(c * v, ~v_null & ~nan(c)), running(v, ~v_null))
    dtp, flow = tp - lag(tp, 1), tp * v
    up14, down14 = (rolled_sum(np.where(side, flow, 0.0), 14) for side in (dtp > 0, dtp < 0))
    f["mfi_14"] = np.where(nan(rolled_sum(flow, 14)), np.nan, div(100.0 * up14, up14 + down14))
    f["volume_sma_ratio"], f["volume_roc"] = div(v, rolled_sum(v, 20) / 20), div(v, lag(v, 5)) - 1.0
    rng = h - l + CANDLE_EPS
    body, above, below = div(np.abs(c - o), rng), div(h - np.fmax(c, o), rng), div(np.fmin(c, o) - l, rng)
    f["body_size"], f["upper_shadow"], f["lower_shadow"] = body, above, below
    f["doji"] = np.where(nan(body), np.nan, body < 0.1)
    unknown = nan(body + below) | nan(above)
    no = (~nan(body + below) & ~(below > 2.0 * body)) | (~nan(above) & ~(above < 0.1))
    f["hammer"] = np.where(no, 0.0, np.where(unknown, np.nan, 1.0))
    f["bullish_engulf"] = ((o < c1) & (c > o1) & (c > o) & (c1 < o1)).astype(float)
    return f


def label_array(ret: np.ndarray, t: LabelThresholds) -> np.ndarray:
    """``labels.label_class``."""
    return np.select([ret > t.strong_buy, ret > t.buy, ret < t.strong_sell, ret < t.sell], [4, 3, 0, 1], 2)


def filled(x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """``features.clean_fill`` over the kept rows of each series."""
    good = np.isfinite(x) & keep
    if (good == keep).all():
        return x
    at = np.maximum.accumulate(np.where(good, np.arange(len(x))[:, None], -1), axis=0)
    return np.where(at < 0, 0.0, np.take_along_axis(np.where(good, x, 0.0), np.maximum(at, 0), axis=0))


def processed_batches(by: str, kept: list[str], out: list[str], labels: LabelThresholds) -> Callable:
    """A function for ``mapInArrow``: bars sorted by series and date (``kept``, PRICES and CALENDAR) -> the processed
    rows: the columns ``out``, which are those kept, the neutral sentiment where none is kept, the row number ``_i``, the
    features and the label. They are all that is asked for: a projection of so many columns costs more than their values."""

    def of(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        lengths = np.diff(bounds)
        t = np.arange(lengths.max())[:, None]
        inside, place = t < lengths, np.minimum(bounds[:-1] + t, bounds[-1] - 1)
        columns = {c: table.column(c).to_numpy() for c in [*PRICES, *CALENDAR]}
        x = {c: np.where(inside, a.astype(float)[place], np.nan) for c, a in columns.items()}
        v_null = ~inside | np.asarray(table.column("volume").is_null())[place]
        f = indicator_arrays(*(x[c] for c in PRICES), v_null, t)
        f |= {c: x[c] for c in CALENDAR}
        close = x["close"]
        ret = div(np.concatenate([close[1:], np.full((1, close.shape[1]), np.nan)]), close) - 1.0
        keep = ~np.isnan(ret)
        for c in CORE_COLUMNS:
            keep &= ~np.isnan(f[c])
        rows = keep.T
        own = table.select(kept).filter(pa.array(rows[inside.T]))
        done = {c: pa.array(filled(f[c], keep).T[rows].astype(np.int32 if c in INT_FEATURES else float)) for c in out if c in f}
        done |= {c: pa.array(np.full(own.num_rows, v, float)) for c, v in NEUTRAL_SENTIMENT.items()} | {c: own.column(c) for c in kept}
        done["label"] = pa.array(label_array(ret, labels).T[rows].astype(np.int32))
        done[IDX] = pa.array(np.broadcast_to(t, keep.shape).T[rows].astype(np.int32))
        return pa.table({c: done[c] for c in out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for table, bounds in whole_series(batches, by):
                for first, last in matrices(bounds):
                    part = of(table.slice(bounds[first], bounds[last] - bounds[first]), bounds[first:last + 1] - bounds[first])
                    yield from part.combine_chunks().to_batches()

    return run
