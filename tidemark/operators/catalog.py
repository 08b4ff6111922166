"""The published list of 191 short-horizon price and volume formulas, by their numbers there.

Each is an expression of nodes; equal parts of the chosen formulas are computed once. `rank` is over the whole series unless
the cross-section is asked for. 30, 149, 181 and 182 compare with a benchmark, columns bench_open and bench_close; without
one, 30 takes the series itself and the others are null. Where the list's form can't give a number, the evident one is
built: 54 takes the deviation of ten bars.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import ops
from ..functions.nodes import (
    EPS, Node, absolute, corr, count, cov, decay, delay, delta, greatest, leaf, least, log, materialize, mean, nothing, rank as _rank, residual, sign, since_max, since_min, slope, sma, std, tidy, total, ts_max, ts_min, ts_rank, where, wma,
)
from .bars import with_vwap


def formulas(scope: str = "series", benchmark: bool = False) -> dict[int, Node]:
    o, h, lo, c, v, vwap, amount = (leaf(x) for x in ("open", "high", "low", "close", "volume", "vwap", "amount"))
    b_open, b_close = leaf("bench_open"), leaf("bench_close")

    def rank(x):
        return _rank(x, scope)

    prev, mid = delay(c, 1), (h + lo) / 2
    ret, rose, fell = c / prev - 1, c > prev, c < prev
    place = ((c - lo) - (h - c)) / (h - lo)
    kd9 = (c - ts_min(lo, 9)) / (ts_max(h, 9) - ts_min(lo, 9)) * 100
    moved = greatest(absolute(h - delay(h, 1)), absolute(lo - delay(lo, 1)))
    falling = where((h + lo) >= (delay(h, 1) + delay(lo, 1)), 0.0, moved)
    rising = where((h + lo) <= (delay(h, 1) + delay(lo, 1)), 0.0, moved)
    bias6 = (c - mean(c, 6)) / mean(c, 6)
    steps = sign(c - prev) + sign(prev - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))
    swing = total(o, 5) * total(ret, 5)
    typical, diff = (h + lo + c) / 3, c - prev
    gain, size, down = where(diff < 0, 0.0, diff), absolute(diff), where(diff > 0, 0.0, -diff)
    rise, drop = where(rose, diff, 0.0), where(fell, -diff, 0.0)
    signed = where(rose, v, where(fell, -v, 0.0))
    above, below = where(h < prev, 0.0, h - prev), where(lo > prev, 0.0, prev - lo)
    wr6 = (ts_max(h, 6) - c) / (ts_max(h, 6) - ts_min(lo, 6)) * 100
    d_open = o - delay(o, 1)
    dtm = where(o <= delay(o, 1), 0.0, where(h - o > d_open, h - o, d_open))
    dbm = where(o >= delay(o, 1), 0.0, where(o - lo > d_open, o - lo, d_open))
    dtm20, dbm20 = total(dtm, 20), total(dbm, 20)
    hc, lc = absolute(h - prev), absolute(lo - prev)
    wide = (diff + (c - o) / 2 + prev - delay(o, 1)) * 16 / (hc + lc / 2 + absolute(prev - delay(o, 1)) / 4) * greatest(hc, lc)
    range_ = greatest(greatest(h - lo, hc), lc)
    hd, ld = h - delay(h, 1), delay(lo, 1) - lo
    sum_ld, sum_hd = total(where((ld > 0) & (ld > hd), ld, 0.0), 14) * 100 / total(range_, 14), total(where((hd > 0) & (hd > ld), hd, 0.0), 14) * 100 / total(range_, 14)
    trend = mean(absolute(sum_ld - sum_hd) / (sum_ld + sum_hd) * 100, 6)
    span5 = (h - lo) / (total(c, 5) / 5)
    rsi12 = sma(gain, 12, 1) / sma(size, 12, 1) * 100
    stay = total(c - mean(c, 24), 24)
    spread24 = (ts_max(stay, 24) - ts_min(stay, 24)) / std(c, 24)
    log3 = sma(sma(sma(log(c + EPS), 13, 2), 13, 2), 13, 2)
    macd_c, macd_v = sma(c, 13, 2) - sma(c, 27, 2), sma(v, 13, 2) - sma(v, 27, 2)
    vola = absolute(ret) / v
    slow = (c / delay(c, 19)) ** (1 / 20) - 1
    off = (ret - slow) * (ret - slow)
    lagged = delay(sma(delay(c / delay(c, 9), 1), 9, 1), 1)
    lagged_d = delay(sma(diff, 9, 1), 1)
    best = where(rose, 1.0 / diff, 1.0)
    flow = v * (2 * c - h - lo) / (h + lo)
    market = b_close / delay(b_close, 1) - 1 if benchmark else ret
    up20, down20 = where(ret > slow, off, 0.0), where(ret < slow, off, 0.0)
    d100 = delta(total(c, 100) / 100, 100) / delay(c, 100)
    fit = decay(corr(ts_rank(c, 8), ts_rank(mean(v, 60), 20), 8), 7)
    hard = rank(rank(log(ts_min(rank(rank(delta(c - 1, 5))), 2) + EPS)))
    turn = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    bench = {
        149: slope(where(market < 0, ret, 0.0), 20) - slope(where(market > 0, ret, 0.0), 20),
        181: total((ret - mean(ret, 20)) - (b_close - mean(b_close, 20)) * (b_close - mean(b_close, 20)), 20) / total((b_close - mean(b_close, 20)) * (b_close - mean(b_close, 20)) * (b_close - mean(b_close, 20)), 20),
        182: (count((c > o) & (b_close > b_open), 20) + count((c < o) & (b_close < b_open), 20)) / 20,
    } if benchmark else {149: nothing, 181: nothing, 182: nothing}
    return {
        1: -corr(rank(delta(log(v + 1e-12), 1)), rank((c - o) / o), 6), 2: -delta(place, 1),
        3: total(where(c.same(prev), 0.0, where(fell, c - least(lo, prev), c - greatest(h, prev))), 6),
        4: where(mean(c, 8) + std(c, 8) < mean(c, 2), -1.0, where(mean(c, 2) < mean(c, 8) - std(c, 8), 1.0, where(v / mean(v, 20) >= 1, 1.0, -1.0))),
        5: -ts_max(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3), 6: -(rank(sign(delta(o * 0.85 + h * 0.15, 4))) * ts_rank(v, 3)),
        7: (rank(ts_max(vwap - c, 3)) + rank(ts_min(vwap - c, 3))) * rank(delta(v, 3)), 8: rank(-delta(mid * 0.2 + vwap * 0.8, 4)),
        9: -(absolute(mid - mean(mid, 7)) * rank(mean(v, 10))), 10: rank((ts_max(h - c, 3) + ts_max(c - lo, 3)) * 100 / ts_max(h - lo, 3)), 11: total(place * v, 6),
        12: -(rank(o - mean((h + lo + c) / 3, 10)) * rank(absolute(c - mean(c, 10)))), 13: (h * lo) ** 0.5 - vwap, 14: c - delay(c, 5), 15: o / prev - 1,
        16: -ts_max(rank(corr(rank(v), rank(vwap), 5)), 5), 17: rank(vwap - ts_max(vwap, 15)) * delta(c, 1), 18: c / delay(c, 5), 19: (c - delay(c, 5)) / delay(c, 5), 20: (c - delay(c, 6)) / delay(c, 6) * 100,
        21: slope(mean(c, 6), 6), 22: sma(bias6 - delay(bias6, 3), 12, 1), 23: sma(where(rose, std(c, 20), 0.0), 20, 1), 24: sma(c - delay(c, 5), 5, 1),
        25: -(rank(delta(c, 7) * (1 - rank(decay(v / mean(v, 20), 9)))) * (1 + rank(total(ret, 250)))), 26: mean(c, 7) - c + corr(vwap, delay(c, 5), 230),
        27: wma((c - delay(c, 3)) / delay(c, 3) * 100 + (c - delay(c, 6)) / delay(c, 6) * 100, 12), 28: 3 * sma(kd9, 3, 1) - 2 * sma(sma(kd9, 3, 1), 3, 1), 29: (c - delay(c, 6)) / delay(c, 6) * v,
        30: wma(residual(ret, market, 20) * residual(ret, market, 20), 20), 31: (c - mean(c, 12)) / mean(c, 12) * 100, 32: -total(rank(corr(rank(h), rank(v), 3)), 3), 33: (delay(ts_min(lo, 5), 5) - ts_min(lo, 5)) * rank((total(ret, 240) - total(ret, 20)) / 220) * ts_rank(v, 5),
        34: mean(c, 12) / c, 35: -least(rank(decay(delta(o, 1), 15)), rank(decay(corr(v, c * 0.65 + o * 0.35, 17), 7))), 36: rank(total(corr(rank(v), rank(vwap), 6), 2)),
        37: -rank(swing - delay(swing, 10)), 38: where(mean(h, 20) < h, -delta(h, 2), 0.0), 39: -(rank(decay(delta(c, 2), 8)) - rank(decay(corr(vwap * 0.3 + o * 0.7, total(mean(v, 180), 37), 14), 12))),
        40: total(where(rose, v, 0.0), 26) / total(where(c <= prev, v, 0.0), 26) * 100, 41: -rank(ts_max(delta(vwap, 3), 5)), 42: -(rank(std(h, 10)) * corr(h, v, 10)),
        43: total(where(rose, v, where(fell, -v, 0.0)), 6), 44: ts_rank(decay(corr(lo, mean(v, 10), 7), 6), 4) + ts_rank(decay(delta(vwap, 3), 10), 15), 45: rank(delta(c * 0.6 + o * 0.4, 1)) * rank(corr(vwap, mean(v, 150), 15)),
        46: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / (c * 4), 47: sma((ts_max(h, 6) - c) / (ts_max(h, 6) - ts_min(lo, 6)) * 100, 9, 1), 48: -(rank(steps) * total(v, 5) / total(v, 20)),
        49: total(falling, 12) / (total(falling, 12) + total(rising, 12)), 50: total(rising, 12) / (total(rising, 12) + total(falling, 12)) - total(falling, 12) / (total(falling, 12) + total(rising, 12)), 51: total(rising, 12),
        52: total(above, 26) / total(below, 26) * 100, 53: count(rose, 12) / 12 * 100, 54: -rank(std(absolute(c - o), 10) + (c - o) + corr(c, o, 10)), 55: total(wide, 20),
        56: where(rank(o - ts_min(o, 12)) < rank(corr(total(mid, 19), total(mean(v, 40), 19), 13)) ** 5, 1.0, 0.0), 57: sma(kd9, 3, 1), 58: count(rose, 20) / 20 * 100,
        59: total(where(c.same(prev), 0.0, where(rose, c - least(lo, prev), c - greatest(h, prev))), 20), 60: total(gain, 20), 61: total(drop, 20), 62: -corr(h, rank(v), 5), 63: sma(gain, 6, 1) / sma(size, 6, 1) * 100,
        64: -greatest(rank(decay(corr(rank(vwap), rank(v), 4), 4)), rank(decay(ts_max(corr(rank(c), rank(mean(v, 60)), 4), 13), 14))), 65: mean(c, 6) / c, 66: bias6 * 100, 67: sma(gain, 24, 1) / sma(size, 24, 1) * 100,
        68: sma((mid - (delay(h, 1) + delay(lo, 1)) / 2) * (h - lo) / v, 15, 2), 69: where(dtm20 > dbm20, (dtm20 - dbm20) / dtm20, where(dtm20.same(dbm20), 0.0, (dtm20 - dbm20) / dbm20)), 70: std(amount, 6), 71: (c - mean(c, 24)) / mean(c, 24) * 100, 72: sma(wr6, 15, 1),
        73: -(ts_rank(decay(decay(corr(c, v, 10), 16), 4), 5) - rank(decay(corr(vwap, mean(v, 30), 4), 3))), 74: rank(corr(total(lo * 0.35 + vwap * 0.65, 20), total(mean(v, 40), 20), 7)) + rank(corr(rank(vwap), rank(v), 6)), 75: count(c > o, 20) / 20 * 100,
        76: std(vola, 20) / mean(vola, 20), 77: least(rank(decay((mid + h) - (vwap + h), 20)), rank(decay(corr(mid, mean(v, 40), 3), 6))), 78: (typical - mean(typical, 12)) / (mean(absolute(c - mean(typical, 12)), 12) * 0.015), 79: rsi12,
        80: (v - delay(v, 5)) / delay(v, 5) * 100, 81: sma(v, 21, 2), 82: sma(wr6, 20, 1), 83: -rank(cov(rank(h), rank(v), 5)), 84: total(signed, 20), 85: ts_rank(v / mean(v, 20), 20) * ts_rank(-delta(c, 7), 8),
        86: where(turn > 0.25, -1.0, where(turn < 0, 1.0, -1.0)), 87: -(rank(decay(delta(vwap, 4), 7)) + ts_rank(decay((lo * 0.9 + lo * 0.1 - vwap) / (o - mid), 11), 7)), 88: (c - delay(c, 20)) / delay(c, 20) * 100, 89: 2 * (macd_c - sma(macd_c, 10, 2)),
        90: -rank(corr(rank(vwap), rank(v), 5)), 91: -(rank(c - ts_max(c, 5)) * rank(corr(mean(v, 40), lo, 5))), 92: -greatest(rank(decay(delta(c * 0.35 + vwap * 0.65, 2), 15)), rank(decay(absolute(corr(mean(v, 180), c, 13)), 17))),
        93: total(where(o >= delay(o, 1), 0.0, greatest(o - lo, d_open)), 20), 94: total(signed, 30), 95: std(amount, 20), 96: sma(sma(kd9, 3, 1), 3, 1), 97: std(v, 10), 98: where(d100 <= 0.05, -(c - ts_min(c, 100)), -delta(c, 3)), 99: -rank(cov(rank(c), rank(v), 5)), 100: std(v, 20),
        101: (c - o) / (h - lo + 0.001), 102: sma(gain, 6, 1) / sma(size, 6, 1) * 100, 103: (20 - since_max(h, 20)) / 20 * 100, 104: -(delta(corr(h, v, 5), 5) * rank(std(c, 20))), 105: -corr(rank(o), rank(v), 10), 106: c - delay(c, 10),
        107: -(rank(o - delay(h, 1)) * rank(o - prev) * rank(o - delay(lo, 1))), 108: -(rank(h - ts_min(h, 2)) ** rank(corr(vwap, mean(v, 120), 6))), 109: sma(h - lo, 10, 2) / sma(sma(h - lo, 10, 2), 10, 2), 110: total(above, 20) / total(below, 20) * 100,
        111: sma(flow, 11, 2) - sma(flow, 4, 2), 112: (total(gain, 12) - total(down, 12)) / (total(gain, 12) + total(down, 12)) * 100, 113: -(rank(total(delay(c, 5), 20) / 20) * corr(c, v, 2) * rank(corr(tidy(total(c, 5)), tidy(total(c, 20)), 2))),
        114: rank(delay(span5, 2)) * rank(rank(v)) / (span5 / (vwap - c)), 115: rank(corr(h * 0.9 + c * 0.1, mean(v, 30), 10)) ** rank(corr(ts_rank(mid, 4), ts_rank(v, 10), 7)), 116: slope(c, 20), 117: ts_rank(v, 32) * (1 - ts_rank(c + h - lo, 16)) * (1 - ts_rank(ret, 32)),
        118: total(h - o, 20) / total(o - lo, 20) * 100, 119: rank(decay(corr(vwap, total(mean(v, 5), 26), 5), 7)) - rank(decay(ts_rank(ts_min(corr(rank(o), rank(mean(v, 15)), 21), 9), 7), 6)), 120: rank(vwap - c) / rank(vwap + c),
        121: -(rank(vwap - ts_min(vwap, 12)) ** ts_rank(corr(ts_rank(vwap, 20), ts_rank(mean(v, 60), 4), 18), 3)), 122: (log3 - delay(log3, 1)) / delay(log3, 1), 123: where(rank(corr(total(mid, 20), total(mean(v, 60), 20), 9)) < rank(corr(lo, v, 6)), -1.0, 0.0),
        124: (c - vwap) / decay(rank(ts_max(c, 30)), 2), 125: rank(decay(corr(vwap, mean(v, 80), 17), 20)) / rank(decay(delta(c * 0.5 + vwap * 0.5, 3), 16)), 126: typical, 127: mean((100 * (c - ts_max(c, 12)) / ts_max(c, 12)) ** 2, 12) ** 0.5,
        128: 100 - 100 / (1 + total(where(typical > delay(typical, 1), typical - delay(typical, 1), 0.0), 14) / total(where(typical < delay(typical, 1), delay(typical, 1) - typical, 0.0), 14)), 129: total(drop, 12),
        130: rank(decay(corr(mid, mean(v, 40), 9), 10)) / rank(decay(corr(rank(vwap), rank(v), 7), 3)), 131: rank(delta(vwap, 1)) ** ts_rank(corr(c, mean(v, 50), 18), 18), 132: mean(amount, 20), 133: (20 - since_max(h, 20)) / 20 * 100 - (20 - since_min(lo, 20)) / 20 * 100,
        134: (c - delay(c, 12)) / delay(c, 12) * v, 135: sma(delay(c / delay(c, 20), 1), 20, 1), 136: -(rank(delta(ret, 3)) * corr(o, v, 10)), 137: wide, 138: -(rank(decay(delta(lo * 0.7 + vwap * 0.3, 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(lo, 8), ts_rank(mean(v, 60), 17), 5), 19), 16), 7)),
        139: -corr(o, v, 10), 140: least(rank(decay(rank(mid) + rank(h) + rank(v), 8)), ts_rank(fit, 3)), 141: where(rank(corr(rank(h), rank(mean(v, 15)), 9)) < rank(corr(rank(lo), rank(mean(v, 15)), 9)), -1.0, 0.0),
        142: (rank(ts_max(diff, 3)) + rank(ts_min(diff, 3))) * rank(delta(v, 3)) * rank(corr(c * 0.5 + vwap * 0.5, mean(v, 180), 17)), 143: where(rose, 1.0, -1.0) * v, 144: total((ret - mean(ret, 20)) ** 2, 20), 145: (mean(v, 9) - mean(v, 26)) / mean(v, 12) * 100,
        146: mean(diff / prev - mean(diff / prev, 20), 20), 147: slope(mean(c, 12), 12), 148: where(rank(corr(o, total(mean(v, 60), 9), 6)) < rank(o - ts_min(o, 14)), -1.0, 0.0), 149: bench[149], 150: typical * v, 151: sma(c - delay(c, 20), 20, 1),
        152: sma(mean(lagged, 12) - mean(lagged, 26), 9, 1), 153: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4, 154: where(vwap - ts_min(vwap, 16) < corr(vwap, mean(v, 180), 18), 1.0, 0.0), 155: macd_v - sma(macd_v, 10, 2),
        156: -greatest(rank(decay(delta(vwap, 5), 3)), rank(decay(-(delta(o * 0.15 + lo * 0.85, 2) / (o * 0.15 + lo * 0.85)), 3))), 157: ts_min(hard, 5) + ts_rank(delay(-ret, 6), 5), 158: ((h - sma(c, 15, 2)) - (lo - sma(c, 15, 2))) / c,
        159: (c - total(least(lo, prev), 6)) / total(greatest(h, prev) - least(lo, prev), 6), 160: sma(where(c <= prev, std(c, 20), 0.0), 20, 1), 161: mean(range_, 12), 162: (rsi12 - ts_min(rsi12, 12)) / (ts_max(rsi12, 12) - ts_min(rsi12, 12)),
        163: rank(-ret * mean(v, 20) * vwap * (h - c)), 164: sma((best - ts_min(best, 12)) / (h - lo) * 10000, 13, 2), 165: spread24, 166: -cov(o, v, 10), 167: total(gain, 12), 168: -(v / mean(v, 20)), 169: sma(mean(lagged_d, 12) - mean(lagged_d, 26), 10, 1),
        170: rank(1.0 / c) * v / mean(v, 20) * (h * rank(h - c) / (total(h, 5) / 5)) - rank(vwap - delay(vwap, 5)), 171: -((lo - c) * o**5) / ((c - h) * c**5), 172: trend, 173: 3 * sma(c, 13, 2) - 2 * sma(sma(c, 13, 2), 13, 2) + sma(sma(sma(c, 13, 2), 13, 2), 13, 2),
        174: sma(where(rose, std(c, 20), 0.0), 20, 1), 175: mean(range_, 6), 176: corr(rank((c - ts_min(lo, 12)) / (ts_max(h, 12) - ts_min(lo, 12))), rank(v), 6), 177: (20 - since_max(h, 20)) / 20 * 100, 178: diff / prev * v,
        179: rank(corr(vwap, v, 4)) * rank(corr(rank(lo), rank(mean(v, 50)), 12)), 180: where(mean(v, 20) < v, -(ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7))), -v), 181: bench[181], 182: bench[182], 183: spread24,
        184: rank(corr(delay(o - c, 1), c, 200)) + rank(o - c), 185: rank(-((1 - o / c) ** 2)), 186: (trend + delay(trend, 6)) / 2, 187: total(where(o <= delay(o, 1), 0.0, greatest(h - o, d_open)), 20), 188: ((h - lo) - sma(h - lo, 11, 2)) / sma(h - lo, 11, 2) * 100,
        189: mean(absolute(c - mean(c, 6)), 6), 190: log((count(ret > slow, 20) - 1) * total(down20, 20) / (count(ret < slow, 20) * total(up20, 20)) + EPS), 191: corr(mean(v, 20), lo, 5) + mid - c,
    }


def catalog(bars: DataFrame, ids=None, scope: str = "series") -> DataFrame:
    """Bars with one column A001, A002, ... for each formula asked for; unknown numbers are an error. Bars that have
    bench_open and bench_close are compared with them."""
    all_ = formulas(scope, {"bench_open", "bench_close"} <= set(bars.columns))
    chosen = sorted(all_) if ids is None else list(ids)
    return materialize(with_vwap(ops.by_key(bars)), {f"A{i:03d}": all_[i] for i in chosen})
