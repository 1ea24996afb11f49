"""Plain loops that the recurrences are held against."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _averages(prices: np.ndarray, period: int) -> tuple[list[float], list[float]]:
    """Wilder averages of gains and losses, from the ``period``-th change on."""
    change = np.diff(prices)
    gains, losses = np.where(change > 0, change, 0.0).tolist(), np.where(change > 0, 0.0, -change).tolist()
    if period < 1 or len(gains) < period:
        return [], []
    g = l = 0.0  # noqa: E741
    for k in range(period):
        g += gains[k]
        l += losses[k]  # noqa: E741
    g, l = g / period, l / period  # noqa: E741
    up, down = [g], [l]
    for k in range(period, len(gains)):
        g = (g * (period - 1) + gains[k]) / period
        l = (l * (period - 1) + losses[k]) / period  # noqa: E741
        up.append(g), down.append(l)
    return up, down


def _rsi(g: float, l: float) -> float:  # noqa: E741
    return 100.0 if l == 0 else 100.0 - 100.0 / (1.0 + g / l)


def rsi_values(prices: Sequence[float], period: int) -> np.ndarray:
    """Wilder's RSI of each price, NaN where it isn't defined."""
    p = np.asarray(prices, float)
    out = np.full(len(p), np.nan)
    up, down = _averages(p, period)
    if up:
        out[period:] = [_rsi(g, l) for g, l in zip(up, down, strict=True)]  # noqa: E741
    return out


def ema_values(values: Sequence[float], period: int) -> np.ndarray:
    """The exponential average, seeded with the mean of the first ``period`` values; leading NaNs are skipped."""
    v = np.asarray(values, float)
    out = np.full(len(v), np.nan)
    start = int(np.argmax(~np.isnan(v))) if (~np.isnan(v)).any() else len(v)
    own = v[start:].tolist()
    if period < 1 or len(own) < period:
        return out
    prev, k = 0.0, 2.0 / (period + 1.0)
    for x in own[:period]:
        prev += x
    prev /= period
    got = [prev]
    for x in own[period:]:
        prev = x * k + prev * (1 - k)
        got.append(prev)
    out[start + period - 1 :] = got
    return out


def wma_values(values: Sequence[float], period: int) -> np.ndarray:
    """The linearly weighted average, newest weight ``period``; leading NaNs are skipped."""
    v = np.asarray(values, float)
    out = np.full(len(v), np.nan)
    start = int(np.argmax(~np.isnan(v))) if (~np.isnan(v)).any() else len(v)
    n = len(v) - start - period + 1
    if period < 1 or n < 1:
        return out
    num = np.zeros(n)
    for k in range(period):
        num += v[start + k : start + k + n] * (k + 1)
    out[start + period - 1 :] = num / (period * (period + 1) / 2)
    return out


def bucket_rsi_values(closes: Sequence[float], buckets: Sequence, period: int) -> np.ndarray:
    """RSI of a coarser timeframe at every bar: completed buckets' last closes, then the bar's own close.

    One pass: the averages after each completed bucket are kept, and a bar takes
    one provisional step from those before its own bucket (or completes the seed).
    """
    c = np.asarray(closes, float)
    out = np.full(len(c), np.nan)
    if not len(c) or period < 1:
        return out
    b = np.asarray(buckets)
    new = np.concatenate(([True], b[1:] != b[:-1]))
    number = np.cumsum(new) - 1
    last = c[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(c) - 1]))]
    change = np.diff(last)
    gains, losses = np.where(change > 0, change, 0.0).tolist(), np.where(change > 0, 0.0, -change).tolist()
    up, down = _averages(last, period)
    for i in range(len(c)):
        k = int(number[i])  # completed buckets
        if k < period:
            continue
        d = float(c[i] - last[k - 1])
        gain, loss = (d, 0.0) if d > 0 else (0.0, -d)
        if k == period:
            g = l = 0.0  # noqa: E741
            for j in range(period - 1):
                g += gains[j]
                l += losses[j]  # noqa: E741
            g, l = (g + gain) / period, (l + loss) / period  # noqa: E741
        else:
            g = (up[k - 1 - period] * (period - 1) + gain) / period
            l = (down[k - 1 - period] * (period - 1) + loss) / period  # noqa: E741
        out[i] = _rsi(g, l)
    return out
