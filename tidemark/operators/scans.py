"""Recursive indicators, bar by bar: a step keeps a few numbers of its series and gives the next value.

A long series is read in batches and its steps go on from batch to batch (see carried.py), so a task never holds a whole
series. The functions on arrays run the same steps over a series at hand; NaN stands for null.
"""
from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..schema import KEY, TIME
from .carried import scanned

NAN = math.nan


def over(step: Callable, *columns) -> np.ndarray | tuple[np.ndarray, ...]:
    """A step's values over whole columns: an array, or one for each value that it gives."""
    rows = [step(*x) for x in zip(*(np.asarray(c, float).tolist() for c in columns))]
    if rows and isinstance(rows[0], tuple):
        return tuple(np.array(x) for x in zip(*rows))
    return np.array(rows, float)


def ewm_step(alpha: float):
    """y + alpha (x - y), from the first value that isn't null; null where x is, the state is kept."""
    y = NAN

    def step(x):
        nonlocal y
        if x != x:
            return NAN
        y = x if y != y else (1 - alpha) * y + alpha * x
        return y

    return step


def ewm(x, alpha: float):
    return over(ewm_step(alpha), x)


def sma(x, n: int, m: int):
    return ewm(x, m / n)


def ema_step(n: int):
    return ewm_step(2 / (n + 1))


def ema(x, n: int):
    return over(ema_step(n), x)


def mean_step(n: int, least: int | None = None):
    """Mean of the last n values; null unless `least` (n) of them aren't null."""
    held, least = deque(maxlen=n), n if least is None else least

    def step(x):
        held.append(x)
        there = [v for v in held if v == v]
        return sum(there) / len(there) if len(there) >= least else NAN

    return step


def rsi_step(n: int):
    """First from the means of n changes, then smoothed by 1/n; 0 where nothing has moved."""
    last, k, gain, loss = NAN, 0, 0.0, 0.0

    def step(c):
        nonlocal last, k, gain, loss
        d, last = c - last, c
        if d != d:
            return NAN
        k += 1
        up, down = max(d, 0.0), max(-d, 0.0)
        gain, loss = (gain + up / n, loss + down / n) if k <= n else ((gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n)
        if k < n:
            return NAN
        return 0.0 if gain == loss == 0 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)

    return step


def wilder_rsi(close, n: int):
    return over(rsi_step(n), close)


def kama_step(n: int = 10, fast: int = 2, slow: int = 30):
    """Smoothing by the efficiency of the last n bars' path; null for the first n bars."""
    held, y, f, s = deque(maxlen=n + 1), NAN, 2 / (fast + 1), 2 / (slow + 1)

    def step(c):
        nonlocal y
        held.append(c)
        if y != y:
            y = c
        if len(held) <= n:
            return NAN
        past = list(held)
        path = sum(abs(b - a) for a, b in zip(past, past[1:]))
        er = abs(c - past[0]) / path if path else 0.0
        y += (er * (f - s) + s) ** 2 * (c - y)
        return y

    return step


def kama(close, n: int = 10, fast: int = 2, slow: int = 30):
    return over(kama_step(n, fast, slow), close)


def frama_step(n: int = 9):
    """Fractal smoothing of the middle price; the window is made even; null until it is full, the close goes before. A
    window without any range keeps the middle price."""
    n += n % 2
    half, highs, lows, y, last = n // 2, deque(maxlen=n), deque(maxlen=n), NAN, NAN

    def step(high, low, close):
        nonlocal y, last
        highs.append(high)
        lows.append(low)
        before, last = last, close
        if len(highs) < n:
            return NAN
        hi, lo = list(highs), list(lows)
        halves, whole = (max(hi[:half]) - min(lo[:half]) + max(hi[half:]) - min(lo[half:])) / half, (max(hi) - min(lo)) / n
        d = (math.log(halves) - math.log(whole)) / math.log(2) if halves > 0 and whole > 0 else 1.0
        alpha = math.exp(-4.6 * (d - 1))
        y = alpha * (high + low) / 2 + (1 - alpha) * (before if y != y else y)
        return y

    return step


def frama(high, low, close, n: int = 9):
    return over(frama_step(n), high, low, close)


def llt_step(n: int = 9):
    """Second-order low-pass line; first the close, then one plain smoothing step; after that both earlier values are the
    second bar's at first."""
    a, x, y = 2 / (n + 1), [], []

    def step(c):
        if not y:
            v = c
        elif len(y) == 1:
            v = a * c + (1 - a) * x[-1]
        else:
            (y2, y1), (x2, x1) = (y[-2:], x[-2:]) if len(y) > 2 else ((y[-1],) * 2, (x[-1],) * 2)
            v = (a - a * a / 4) * c + a * a / 2 * x1 - (a - 3 * a * a / 4) * x2 + 2 * (1 - a) * y1 - (1 - a) ** 2 * y2
        x[:], y[:] = [*x[-2:], c], [*y[-2:], v]
        return v

    return step


def llt(close, n: int = 9):
    return over(llt_step(n), close)


def super_smoother_step(n: int = 10):
    """Two-pole filter; the first value is the input, the second uses it twice."""
    a = math.exp(-math.sqrt(2) * math.pi / n)
    c2, c3 = 2 * a * math.cos(math.sqrt(2) * math.pi / n), -a * a
    c1, last, y1, y2 = 1 - c2 - c3, NAN, NAN, NAN

    def step(x):
        nonlocal last, y1, y2
        v = x if y1 != y1 else c1 * (x + last) / 2 + c2 * y1 + c3 * y2
        last, y1, y2 = x, v, v if y1 != y1 else y1
        return v

    return step


def super_smoother(x, n: int = 10):
    return over(super_smoother_step(n), x)


def ultimate_smoother_step(n: int = 10):
    a = math.exp(-1.414 * math.pi / n)
    c2, c3 = 2 * a * math.cos(1.414 * math.pi / n), -a * a
    c1, x, y = (1 + c2 - c3) / 4, deque(maxlen=2), deque(maxlen=2)
    k = 0

    def step(now):
        nonlocal k
        v = now if k < 4 else (1 - c1) * now + (2 * c1 - c2) * x[-1] - (c1 + c3) * x[-2] + c2 * y[-1] + c3 * y[-2]
        k += k < 4
        x.append(now)
        y.append(v)
        return v

    return step


def ultimate_smoother(x, n: int = 10):
    return over(ultimate_smoother_step(n), x)


def flex_step(n: int, chord: bool):
    """Of the last n smoothed values, the mean distance from their chord (or from the newest), by the root of its own
    smoothed square; null until there are n."""
    smooth, past, ms = super_smoother_step(n // 2), deque(maxlen=n), NAN

    def step(x):
        nonlocal ms
        past.append(smooth(x))
        if len(past) < n:
            return NAN
        slope = (past[0] - past[-1]) / n if chord else 0.0
        s = sum(past[-1] + i * slope - v for i, v in enumerate(past)) / n
        ms = s * s if ms != ms else 0.04 * s * s + 0.96 * ms
        return s / math.sqrt(ms) if ms > 0 else 0.0

    return step


def reflex(x, n: int = 20):
    return over(flex_step(n, True), x)


def trendflex(x, n: int = 20):
    return over(flex_step(n, False), x)


def stoch_rsi_step(n: int = 14, k: int = 3, d: int = 3):
    """(k, d): where the RSI lies in its last n values, summed over k bars, 100 where it doesn't move, and the mean of d of
    these. Values of zero aren't remembered, neither of the RSI nor of k, and d needs one more k than it averages."""
    kept, seen, done, ended = deque(maxlen=n + k), 0, deque(maxlen=max(d - 1, 1)), 0

    def step(r):
        nonlocal seen, ended
        if r != r:
            return NAN, NAN
        if r:
            kept.append(r)
            seen += 1
        if seen < n + k:
            return NAN, NAN
        past = list(kept)
        parts = [past[len(past) - j - n : len(past) - j] for j in range(k)]
        span = sum(max(p) - min(p) for p in parts)
        value = 100 * sum(p[-1] - min(p) for p in parts) / span if span else 100.0
        slow = (sum(list(done)[-(d - 1) :] if d > 1 else []) + value) / d if ended > d else NAN
        if value:
            done.append(value)
            ended += 1
        return value, slow

    return step


def stoch_rsi(rsi, n: int = 14, k: int = 3, d: int = 3):
    return over(stoch_rsi_step(n, k, d), rsi)


def kdj_step(n: int = 9, k: int = 3, d: int = 3):
    """(k, d, j) from the place of the close in the last n bars; 0 where that is flat; seeds are the first values."""
    highs, lows, fast, slow = deque(maxlen=n), deque(maxlen=n), ewm_step(1 / k), ewm_step(1 / d)

    def step(high, low, close):
        highs.append(high)
        lows.append(low)
        if len(highs) < n or any(v != v for v in (*highs, *lows)):
            return NAN, NAN, NAN
        hi, lo = max(highs), min(lows)
        a = fast(0.0 if hi == lo else 100 * (close - lo) / (hi - lo))
        b = slow(a)
        return a, b, 3 * a - 2 * b

    return step


def kdj(high, low, close, n: int = 9, k: int = 3, d: int = 3):
    return over(kdj_step(n, k, d), high, low, close)


def range_step():
    """True range; the first is high less low."""
    last = NAN

    def step(high, low, close):
        nonlocal last
        span = high - low if last != last else max(high - low, abs(high - last), abs(low - last))
        last = close
        return span

    return step


def true_range(high, low, close):
    return over(range_step(), high, low, close)


def dmi_step(smoothing: int = 6, n: int = 14):
    """(adx, +di, -di, adxr), from the second bar on; the first range is high less low, and where there is no range or no
    movement shares are 100; adxr is the mean with the oldest of the last smoothing + 1 values before, from the time there
    are `smoothing`, and adx until then."""
    span, ups, downs, smooth, held = range_step(), mean_step(n), mean_step(n), ema_step(smoothing), deque(maxlen=smoothing + 1)
    ph = pl = NAN

    def step(high, low, close):
        nonlocal ph, pl
        up, down, first = max(high - ph, 0.0), max(pl - low, 0.0), ph != ph
        ph, pl = high, low
        if first:
            return NAN, NAN, NAN, NAN
        tr = span(high, low, close)
        pdi, mdi = ups(100 * up / tr if tr > 0 else 100.0), downs(100 * down / tr if tr > 0 else 100.0)
        if pdi != pdi:
            return NAN, pdi, mdi, NAN
        adx = smooth(100 * abs(pdi - mdi) / (pdi + mdi) if pdi + mdi > 0 else 100.0)
        adxr = (adx + held[0]) / 2 if len(held) >= smoothing else adx
        held.append(adx)
        return adx, pdi, mdi, adxr

    return step


def dmi(high, low, close, smoothing: int = 6, n: int = 14):
    return over(dmi_step(smoothing, n), high, low, close)


def sar_step(first: float = 0.02, most: float = 0.2, step_up: float = 0.02):
    """(sar, is_long): it turns when the close passes it, and starts again from that bar's high or low; the extreme goes on,
    and the acceleration grows with every bar."""
    long, af, ep, y = True, first, NAN, NAN

    def step(high, low, close):
        nonlocal long, af, ep, y
        if y != y:
            ep, y = high, low
            return y, True
        y += af * (ep - y)
        ep = max(high, ep) if long else min(low, ep)
        if close < y if long else close > y:
            long, y, af = not long, high if long else low, first
        af = min(af + step_up, most)
        return y, long

    return step


def sar(high, low, close, first: float = 0.02, most: float = 0.2, step: float = 0.02):
    out = over(sar_step(first, most, step), high, low, close)
    return out if len(out) else (np.zeros(0), np.zeros(0, bool))


def super_trend_step(n: int = 14, times: float = 3.0):
    """(line, side 1 or -1) of bands at `times` the mean range of up to n bars around the middle. Bands only close in while
    the close stays within them; the side begins with the close over or under the middle and turns when the close passes
    the line before."""
    span, mean, up, dn, line = range_step(), mean_step(n, 1), NAN, NAN, NAN

    def step(high, low, close):
        nonlocal up, dn, line
        atr, mid = mean(span(high, low, close)), (high + low) / 2
        u, d = mid + times * atr, mid - times * atr
        if up == up:
            u, d = min(u, up) if close <= up else u, max(d, dn) if close >= dn else d
        side = 1 if close > (mid if line != line else line) else -1
        up, dn, line = u, d, d if side > 0 else u
        return line, side

    return step


def super_trend(high, low, close, n: int = 14, times: float = 3.0):
    return over(super_trend_step(n, times), high, low, close)


Kernel = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def scan(df: DataFrame, columns: str, kernel: Kernel, key=KEY, time=TIME) -> DataFrame:
    """df with the kernel's columns (a schema string), for kernels that need a whole series at once, which one task then
    holds: one grouped pass over each series in time order. Nulls reach the kernel as NaN, and NaN comes back as null; a
    series of one row is a series; equal times keep no order."""
    from pyspark.sql.types import StructType

    added = df.sparkSession.createDataFrame([], columns).schema
    schema = StructType([*df.schema.fields, *added.fields])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(time, kind="stable").reset_index(drop=True)
        new = kernel(t)
        return t.assign(**{f.name: (pd.Series(new[f.name]).where(pd.Series(new[f.name]).notna(), None) if f.dataType.simpleString() == "double" else new[f.name]) for f in added.fields})

    return df.groupBy(*key).applyInPandas(run, schema)


def _keltner():
    mid, span, mean = ema_step(20), range_step(), mean_step(10, 1)

    def step(high, low, close):
        m, a = mid(close), mean(span(high, low, close))
        return m - 2 * a, m, m + 2 * a

    return step


def _chaikin():
    smooth, held = ema_step(10), deque(maxlen=10)

    def step(high, low, close):
        held.append(smooth(high - low))
        if len(held) < 10:
            return NAN
        change = held[-1] - held[0]
        return 100 * change / held[0] if held[0] else math.inf if change > 0 else NAN

    return step


def _macd():
    fast, slow, moving = ema_step(12), ema_step(26), ema_step(9)

    def step(high, low, close):
        dif = fast(close) - slow(close)
        return dif, moving(dif)

    return step


def _rsi():
    rsi, stoch = rsi_step(14), stoch_rsi_step()

    def step(high, low, close):
        r = rsi(close)
        return r, *stoch(r)

    return step


def _of_close(make, *args):
    def begin():
        inner = make(*args)
        return lambda high, low, close: (inner(close),)

    return begin


def _single(make):
    def begin():
        inner = make()
        return lambda *bar: (inner(*bar),)

    return begin


#: Names of the values, and what begins the steps of a series that give them from (high, low, close).
INDICATORS = {
    ("ema9",): _of_close(ema_step, 9), ("rsi14", "stoch_k", "stoch_d"): _rsi, ("kama10",): _of_close(kama_step), ("frama9",): _single(frama_step), ("llt9",): _of_close(llt_step), ("ss10",): _of_close(super_smoother_step),
    ("us10",): _of_close(ultimate_smoother_step), ("reflex20",): _of_close(flex_step, 20, True), ("trendflex20",): _of_close(flex_step, 20, False), ("k", "d", "j"): kdj_step, ("adx", "pdi", "mdi", "adxr"): dmi_step,
    ("sar", "sar_long"): sar_step, ("st", "st_side"): super_trend_step, ("macd_dif", "macd_dea"): _macd, ("kelt_lower", "kelt_mid", "kelt_upper"): _keltner, ("chaikin",): _single(_chaikin),
}


class _Recursive:
    def __init__(self, wanted):
        self.steps = [(names, INDICATORS[names]()) for names in wanted]

    def feed(self, rows):
        bars = list(zip(*(rows[c].astype(float).tolist() for c in ("high", "low", "close"))))
        out = {}
        for names, step in self.steps:
            out |= dict(zip(names, zip(*[step(*b) for b in bars])))
        return {c: np.array(v) for c, v in out.items()}


def recursive_indicators(bars: DataFrame, names: list[str] | None = None, key=KEY) -> DataFrame:
    """Recursive indicators with their default parameters, all or those named, in one scan with carried state; those that
    come of one step come together."""
    wanted = [group for group in INDICATORS if names is None or set(group) & set(names)]
    kinds = ", ".join(f"{c} {'boolean' if c == 'sar_long' else 'double'}" for group in wanted for c in group)
    return scanned(bars, kinds, lambda: _Recursive(wanted), ["high", "low", "close"], key)


class _Stepped:
    def __init__(self, name, step, columns):
        self.name, self.step, self.columns = name, step, columns

    def feed(self, rows):
        return {self.name: over(self.step, *(rows[c] for c in self.columns))}


def stepped(df: DataFrame, name: str, begin: Callable[[], Callable], columns: list[str], key=KEY) -> DataFrame:
    """df with one column of a step that `begin` makes for each series, over the values of columns."""
    return scanned(df, f"{name} double", lambda: _Stepped(name, begin(), columns), columns, key)
