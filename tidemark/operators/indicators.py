"""Indicators over bars, as window expressions; every function gives columns, or adds them in levels."""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ops
from ..functions.ops import P, S, U, W, ahead, col, delay, delta, guard, mean, std, ts_max, ts_min  # noqa: F401


def true_range() -> Column:
    pc = delay("close")
    span = F.col("high") - F.col("low")
    return F.when(pc.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def moving(df: DataFrame, x="close") -> DataFrame:
    """Averages and bands: ma, wma, bbi, bias, bollinger, zscore; hma needs a second level."""
    n = 9
    line = lambda c, k: ops.decay_linear(c, k)
    mid, dev = mean(x, 20), std(x, 20)
    bbi = (mean(x, 3) + mean(x, 6) + mean(x, 12) + mean(x, 24)) / 4
    dev_pop = F.stddev_pop(col(x)).over(W(20))
    flat = F.max(col(x)).over(W(20)) == F.min(col(x)).over(W(20))
    return ops.in_levels(
        df,
        {
            "ma": mean(x, n), "wma": line(x, n), "_hma": 2 * line(x, n // 2) - line(x, n), "_bbi": bbi, "bias": F.try_divide(col(x) - mean(x, 10), mean(x, 10)) * 100,
            "boll_mid": mid, "boll_up": mid + 2 * dev, "boll_low": mid - 2 * dev, "zscore": guard(F.when(flat, F.lit(0.0)).otherwise(F.try_divide(col(x) - F.avg(col(x)).over(W(20)), dev_pop)), x, 20, W(20)),
        },
        {"hma": line("_hma", int(n**0.5)), "bbi": F.last("_bbi", True).over(U())},
    ).drop("_hma", "_bbi")


def ranges(df: DataFrame) -> DataFrame:
    """True range and its mean over up to 14 bars, Donchian channel, extremes, Gann lines, Williams %R, RSRS."""
    hh, ll = ts_max("high", 14), ts_min("low", 14)
    gh, gl = guard(F.max("high").over(P(1)), "high", 1, P(1)), guard(F.min("low").over(P(1)), "low", 1, P(1))
    return ops.in_levels(
        df,
        {
            "tr": true_range(), "dc_low": ts_min("low", 20), "dc_up": ts_max("high", 20), "ext_high": F.max("high").over(W(20)), "ext_low": F.min("low").over(W(20)), "gann_high": gh, "gann_low": gl,
            "wr": F.when(hh == ll, F.lit(100.0)).otherwise(F.try_divide(100 * (hh - F.col("close")), hh - ll)), "rsrs": (ts_max("high", 10) - ts_min("low", 10)) / 9,
        },
        {"atr": F.avg("tr").over(W(14)), "dc_mid": (F.col("dc_low") + F.col("dc_up")) / 2, "gann_up": F.col("close") > F.col("gann_high"), "gann_down": F.col("close") < F.col("gann_low")},
    )


def cci(df: DataFrame, n: int = 12) -> DataFrame:
    """cci: typical price against its mean and mean deviation; cci2: deviation as the mean of each bar's own."""
    df = ops.in_levels(df, {"_tp": (F.col("high") + F.col("low") + F.col("close")) / 3}, {"_m": mean("_tp", n), "_a": ops.window_array("_tp", n)})
    df = df.withColumn("_md", F.aggregate(F.transform("_a", lambda v: F.abs(v - F.col("_m"))), F.lit(0.0), lambda s, v: s + v) / n).withColumn("_d", F.abs(F.col("_tp") - F.col("_m")))
    df = df.withColumn("_md2", mean("_d", n))
    score = lambda d: F.when(F.col(d) > 1e-12, (F.col("_tp") - F.col("_m")) / (0.015 * F.col(d)))
    return df.withColumns({"cci": score("_md"), "cci2": score("_md2")}).drop("_tp", "_m", "_a", "_md", "_d", "_md2")


def ichimoku(df: DataFrame) -> DataFrame:
    """Lines from the bars before the current one; spans as they were 25 bars back."""
    line = lambda n: guard((F.max("high").over(P(n)) + F.min("low").over(P(n))) / 2, "high", n, P(n))
    df = ops.in_levels(df, {"tenkan": line(9), "kijun": line(26), "_b": line(52)}, {"_a": (F.col("tenkan") + F.col("kijun")) / 2})
    return df.withColumns({"span_a": delay("_a", 25), "span_b": delay("_b", 25)}).drop("_a", "_b")


def macd_sma(df: DataFrame, fast: int = 12, slow: int = 26, moving: int = 9) -> DataFrame:
    return ops.in_levels(df, {"dif": mean("close", fast) - mean("close", slow)}, {"dea": mean("dif", moving)})


def elder_impulse(df: DataFrame, ema: str = "ema13") -> DataFrame:
    """1 where the average rises and the histogram is over zero, -1 where it falls and that is under zero, else 0; `ema` is a
    column of the scan."""
    df = macd_sma(df).withColumns({"_h": F.col("dif") - F.col("dea"), "_de": delta(ema)})
    return df.withColumn("impulse", F.when((F.col("_de") > 0) & (F.col("_h") > 0), 1).when((F.col("_de") < 0) & (F.col("_h") < 0), -1).otherwise(0)).drop("_h", "_de")


def dk(df: DataFrame) -> DataFrame:
    """Long while the close is over rising averages of 5, 10 and 20; missing earlier averages count as ten million."""
    df = df.withColumns({f"_m{n}": mean("close", n) for n in (5, 10, 20)})
    df = df.withColumns({f"_p{n}": F.coalesce(delay(f"_m{n}"), F.lit(10_000_000.0)) for n in (5, 10, 20)})
    ok = F.lit(True)
    for n in (5, 10, 20):
        ok = ok & (F.col("close") > F.col(f"_m{n}")) & (F.col(f"_m{n}") > F.col(f"_p{n}"))
    return df.withColumn("dk", F.coalesce(ok, F.lit(False))).drop(*[f"_{a}{n}" for a in "mp" for n in (5, 10, 20)])


def r_squared(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn("_t", F.row_number().over(ops.series()).cast("double"))
    r = ops.corr("close", "_t", n)
    value = F.least(F.greatest(r * r, F.lit(0.0)), F.lit(1.0))
    return df.withColumn("r_squared", guard(F.coalesce(value, F.lit(0.0)), "close", n, W(n))).drop("_t")


def spikes(df: DataFrame, window: int = 60, few: int = 3) -> DataFrame:
    """Strength (mean of the last absolute returns), threshold (median of up to `window`), and whether it is passed."""
    df = df.withColumn("_r", F.abs(ops.returns()))
    df = df.withColumns({"spike_strength": mean("_r", few), "spike_threshold": F.percentile("_r", F.lit(0.5)).over(W(window))})
    return df.withColumn("is_spike", F.col("spike_strength") > F.col("spike_threshold")).drop("_r")


def demarker(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean rises of highs as a whole percentage of these and the mean falls of lows; 50 where neither moves."""
    df = df.withColumns({"_u": F.greatest(delta("high"), F.lit(0.0)), "_d": F.greatest(-delta("low"), F.lit(0.0))})
    df = df.withColumns({"_u": F.when(delay("high").isNotNull(), F.col("_u")), "_d": F.when(delay("low").isNotNull(), F.col("_d"))})
    df = df.withColumns({"_u": mean("_u", n), "_d": mean("_d", n)})
    total = F.col("_u") + F.col("_d")
    return df.withColumn("demarker", F.when(total > 0, F.floor(F.col("_u") / total * 100).cast("int")).when(total == 0, F.lit(50))).drop("_u", "_d")


def volume_profile(df: DataFrame, lookback: int = 90, bins: int = 20, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """vp_distance: of the close to the middle of the price bin with the most volume, by that; in_hvn, in_lvn: 1 where the close
    is in a bin of much or of little volume, else 0, also before bar `lookback` and where there is no range or no volume.

    Bins part the range from the least low to the greatest high, take middles of bars, and are closed on the right, the
    first one on both sides. The close is held against their edges as they are named, rounded to three places (three
    digits under one; more where edges would fall together), the lowest moved down by one, closed on both sides."""
    df = df.withColumn("_a", guard(F.collect_list(F.struct("high", "low", "volume")).over(W(lookback)), "high", lookback, W(lookback)))
    df = df.withColumns({"_lo": F.array_min("_a.low"), "_hi": F.array_max("_a.high")}).withColumn("_a", F.when(F.col("_hi") > F.col("_lo"), F.col("_a")))
    edge = lambda k: F.when(k == bins, F.col("_hi")).otherwise(F.col("_lo") + k * ((F.col("_hi") - F.col("_lo")) / bins))
    df = df.withColumn("_e", F.when(F.col("_a").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(bins)), edge)))
    df = df.withColumn("_b", F.transform("_a", lambda v: F.struct(F.greatest(F.size(F.filter("_e", lambda e: e < (v["high"] + v["low"]) / 2)) - 1, F.lit(0)).alias("i"), v["volume"].alias("v"))))
    df = df.withColumn("_v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.aggregate(F.filter("_b", lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["v"])))
    digits = lambda e, p: F.when((F.abs(e) < 1) & (e != 0), p - 1 - F.floor(F.log10(F.abs(e)))).otherwise(p)
    named = lambda p: F.transform("_e", lambda e: F.rint(e * F.pow(F.lit(10.0), digits(e, p))) / F.pow(F.lit(10.0), digits(e, p)))
    df = df.withColumn("_p", F.try_element_at(F.filter(F.sequence(F.lit(3), F.lit(17)), lambda p: F.size(F.array_distinct(named(p))) > bins), F.lit(1)))
    df = df.withColumn("_e", F.transform(named(F.coalesce("_p", F.lit(17))), lambda e, k: F.when(k == 0, e - F.pow(F.lit(10.0), -F.col("_p"))).otherwise(e)))
    df = df.withColumns({"_poc": F.when(F.array_max("_v") > 0, F.array_position("_v", F.array_max("_v")) - 1).cast("int"), "_s": F.array_sort("_v")})
    poc = (F.get("_e", "_poc") + F.get("_e", F.col("_poc") + 1)) / 2

    def quantile_of(q: float) -> Column:
        at = q * (bins - 1)
        below, above = F.get("_s", F.lit(int(at))), F.get("_s", F.lit(min(int(at) + 1, bins - 1)))
        return below + (above - below) * (at - int(at))

    mine = F.expr("filter(_v, (v, i) -> get(_e, i) <= close and close <= get(_e, i + 1))")
    df = df.withColumns({"_hvn": quantile_of(high), "_lvn": quantile_of(low), "_mine": F.when(F.col("_poc").isNotNull(), mine)})
    flag = lambda test: F.coalesce(F.exists("_mine", test), F.lit(False)).cast("int")
    df = df.withColumns({"vp_distance": F.when(poc == 0, 0.0).otherwise((F.col("close") - poc) / poc), "in_hvn": flag(lambda v: v >= F.col("_hvn")), "in_lvn": flag(lambda v: v <= F.col("_lvn"))})
    return df.drop(*[f"_{x}" for x in "a lo hi e b v p poc s hvn lvn mine".split()])


def divergence(df: DataFrame, n: int = 60, threshold: int = 1, cross_zero: bool = True, by_close: bool = True, by_peak: bool = True, by_candle: bool = True, by_area: bool = True, dea_pull: bool = True, pull: float = 0.0, rate: float = 0.9) -> DataFrame:
    """Adds top_divergence and bottom_divergence of the last n bars, from columns dif, dea and m (the histogram).

    At a top the histogram has fallen for two bars from a peak and dif is over zero. Going back, bars of one side of the
    histogram make runs (zeros go with the later bar's; the oldest bar is not looked at). The last run is held against the
    next earlier one of its side with three bars at least: a new high of close or peak counts once for a line that stays
    under `rate` of the earlier one, and once for a smaller area, peak and (by_candle) a candle that was pushed back.
    In between, dea (or dif) has to come back by the share `pull`, but not to three times below the zero line; at a bottom,
    it may not cross zero at all. cross_zero: the earlier run may begin with dif on the other side of zero. Rows with a null
    among the columns are not looked at; a row with fewer than ten bars has none.
    """
    need = ["high", "low", "open", "close", "dif", "dea", "m"]
    whole = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), need, F.lit(True))
    df = df.withColumn("_a", F.when(whole, F.collect_list(F.when(whole, F.struct(*need))).over(W(n))))
    for name, s in (("top_divergence", 1), ("bottom_divergence", -1)):
        df = _diverges(df, name, s, threshold, cross_zero, by_close, by_peak, by_candle, by_area, "dea" if dea_pull else "dif", pull, rate)
    return df.drop("_a")


def _diverges(df, name, s, threshold, cross_zero, by_close, by_peak, by_candle, by_area, line, pull, rate):
    """At the bottom (s = -1) all values are turned over, so that only tops are looked for."""
    turned = lambda x: F.struct((s * x["m"]).alias("m"), (s * x["dif"]).alias("dif"), (s * x["dea"]).alias("dea"), (s * x["close"]).alias("close"), (s * x["open"]).alias("open"), (s * x["high" if s > 0 else "low"]).alias("peak"))
    df = df.withColumn("_b", F.transform(F.reverse("_a"), turned))  # the newest first
    b = lambda i: F.get("_b", F.lit(i))
    begins = (F.size("_b") >= 10) & (b(0)["m"] < b(1)["m"]) & (b(1)["m"] < b(2)["m"]) & (b(2)["m"] > b(3)["m"]) & (F.least(*[b(i)["dif"] for i in (0, 1, 2)]) > 0) & (b(0)["m"] >= 0)
    df = df.withColumn("_b", F.when(begins, F.col("_b"))).withColumn("_n", F.size("_b") - 1)
    df = df.withColumn("_starts", F.expr("filter(sequence(1, _n - 1), i -> get(_b, i).m != 0 and sign(get(_b, i).m) != coalesce(sign(element_at(filter(slice(_b, 1, i), y -> y.m != 0), -1).m), 1))"))
    df = df.withColumn("_runs", F.expr("transform(concat(array(0), _starts), (a, k) -> slice(_b, a + 1, coalesce(get(_starts, k), _n) - a))"))
    df = df.withColumn("_r", F.expr("get(filter(sequence(0, size(_runs) - 1), r -> r >= 2 and r % 2 = 0 and size(get(_runs, r)) >= 3), 0)"))
    df = df.withColumn("_r", F.expr("case when _n + 1 - get(_starts, _r - 2) > 3 then _r end"))
    most = lambda run, c: F.array_max(F.transform(run, lambda x: x[c]))
    area = lambda run: F.aggregate(F.slice(run, 2, F.size(run)), F.lit(0.0), lambda t, x: t + x["m"])
    df = df.withColumns({"_last": F.get("_runs", F.lit(0)), "_old": F.get("_runs", F.col("_r")), "_pull": F.array_min(F.transform(F.flatten(F.expr("filter(_runs, (x, r) -> r < _r and r % 2 = 1)")), lambda x: x[line]))})
    df = df.withColumns({"_line": most("_old", line), "_top": F.array_max(F.transform(F.slice("_b", 1, 4), lambda x: x["peak"]))})
    candle = F.get(F.filter(F.reverse(F.slice("_b", 1, 4)), lambda x: x["peak"] == F.col("_top")), F.lit(0))
    pushed = (candle["close"] < candle["open"]) | (candle["peak"] - candle["close"] > candle["close"] - candle["open"])
    broken = (F.col("_pull") < 0) & (F.abs(3 * F.col("_pull")) > F.col("_line") if s > 0 else F.lit(True))
    back = F.try_divide(F.col("_line") - F.col("_pull"), F.col("_line") if s > 0 else F.abs("_line"))
    lower = (F.abs(F.try_divide(most("_last", "dif"), most("_old", "dif"))) < rate).cast("int")
    smaller = ((area("_last") < area("_old")) & (most("_last", "m") < most("_old", "m")) & (pushed if by_candle else F.lit(True)) & F.lit(by_area)).cast("int")
    highs = sum(((most("_last", c) > most("_old", c)) & F.lit(on)).cast("int") for c, on in (("close", by_close), ("peak", by_peak)))
    crossed = F.lit(not cross_zero) & (F.element_at("_old", -1)["dif"] < 0)
    found = F.col("_r").isNotNull() & ~broken & (back >= pull) & ~crossed & (highs * (F.coalesce(lower, F.lit(0)) + smaller) >= threshold)
    return df.withColumn(name, F.coalesce(found, F.lit(False))).drop("_b", "_n", "_starts", "_runs", "_r", "_last", "_old", "_pull", "_line", "_top")
