"""Factor sets over bars: candle shapes, rolling sets, lag sets, and single factors. Windows over series of bars."""
from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ops
from ..functions.ops import W, delay, guard, mean, quantile, std
from ..schema import KEY, TIMEFRAMES
from .bars import with_vwap
from .carried import scanned

EPS = 1e-12
WINDOWS = (5, 10, 20, 30, 60)


def candle(eps: float = EPS) -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span, top, bottom = h - lo + eps, F.greatest(o, c), F.least(o, c)
    return {
        "KMID": (c - o) / o, "KLEN": (h - lo) / o, "KMID2": (c - o) / span, "KUP": (h - top) / o, "KUP2": (h - top) / span, "KLOW": (bottom - lo) / o, "KLOW2": (bottom - lo) / span,
        "KSFT": (2 * c - h - lo) / o, "KSFT2": (2 * c - h - lo) / span,
    }


def price_ratios() -> dict[str, Column]:
    return {f"{x.upper()}0": F.col(x) / F.col("close") for x in ("open", "high", "low", "vwap")}


#: Rows whose windows are held at once.
ROWS = 2_048
ROLLING = "ROC MA STD BETA RSQR RESI MAX MIN QTLU QTLD RANK RSV IMAX IMIN IMXD CORR CORD CNTP CNTN CNTD SUMP SUMN SUMD VMA VSTD WVMA VSUMP VSUMN VSUMD".split()


def rolling(t: dict[str, np.ndarray], n: int, rows: int, eps: float = EPS) -> dict[str, np.ndarray]:
    """The rolling set of one window for the last `rows` bars of the columns t, which hold n bars more, NaN before a series'
    first. A window with a NaN gives NaN."""
    over = lambda x: sliding_window_view(x[len(x) - rows - n + 1 :], n)
    now = lambda x: x[len(x) - rows :]
    c, v, close, high, low = now(t["close"]), now(t["volume"]), over(t["close"]), over(t["high"]), over(t["low"])

    def deviation(w):
        return np.where(w.max(1) == w.min(1), 0.0 * w[:, 0], w.std(1, ddof=1))

    def correlation(x, y):
        x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
        moves = (x.max(1) > x.min(1)) & (y.max(1) > y.min(1))
        cov = ((x - x.mean(1)[:, None]) * (y - y.mean(1)[:, None])).sum(1) / (n - 1)
        return np.where(moves, cov / (x.std(1, ddof=1) * y.std(1, ddof=1)), np.nan)

    def shares(gain, loss, moved):
        total = over(t[moved]).sum(1) + eps
        return over(t[gain]).sum(1) / total, over(t[loss]).sum(1) / total

    def at(q):
        k = q * (n - 1)
        below, above = sizes[:, int(k)], sizes[:, min(int(k) + 1, n - 1)]
        return below + (above - below) * (k - int(k))

    mean, hh, ll = close.mean(1), high.max(1), low.min(1)
    sizes = np.where(np.isnan(mean)[:, None], np.nan, np.sort(close, axis=1))
    slope = close @ (np.arange(n) - (n - 1) / 2) / (n - 1) / (n * (n + 1) / 12)
    moves = close.max(1) > close.min(1)
    r = slope * (n * (n + 1) / 12) ** 0.5 / close.std(1, ddof=1)
    rank = ((close < close[:, -1:]).sum(1) + ((close == close[:, -1:]).sum(1) + 1) / 2) / n
    place = lambda w, best: np.where(np.isnan(best), np.nan, (n - 1 - (w == best[:, None]).argmax(1)) / n)
    imax, imin = place(high, hh), place(low, ll)
    up, down, wv = over(t["up"]).mean(1), over(t["down"]).mean(1), over(t["wv"])
    gain, loss = shares("gain", "loss", "moved")
    vgain, vloss = shares("vgain", "vloss", "vmoved")
    values = [
        t["close"][len(t["close"]) - rows - n : len(t["close"]) - n] / c, mean / c, deviation(close) / c, np.where(moves, slope, np.nan) / c, np.where(moves, r * r, np.nan), np.where(moves, c - mean - slope * (n - 1) / 2, np.nan) / c,
        hh / c, ll / c, at(0.8) / c, at(0.2) / c, np.where(np.isnan(mean), np.nan, rank), (c - ll) / (hh - ll + eps), imax, imin, imax - imin, correlation(close, over(t["lv"])), correlation(over(t["cr"]), over(t["vr"])),
        up, down, up - down, gain, loss, gain - loss, over(t["volume"]).mean(1) / (v + eps), deviation(over(t["volume"])) / (v + eps), deviation(wv) / (wv.mean(1) + eps), vgain, vloss, vgain - vloss,
    ]
    return {f"{k}{n}": x for k, x in zip(ROLLING, values)}


class _Rolling:
    """The rolling sets of a series, with as many bars carried over as the largest window looks back."""

    def __init__(self, windows):
        self.windows, self.back = windows, max(windows) + 1
        self.tail = {x: np.full(self.back, np.nan) for x in ("close", "high", "low", "volume")}
        self.seen = 0

    def feed(self, rows):
        parts = []
        for a in range(0, len(rows["close"]), ROWS):
            parts.append(self.part({x: rows[x][a : a + ROWS].astype(float) for x in self.tail}))
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def part(self, new):
        n = len(new["close"])
        t = {x: np.concatenate([self.tail[x], new[x]]) for x in self.tail}
        self.tail = {x: v[-self.back :] for x, v in t.items()}
        before = lambda x: np.concatenate([[np.nan], x[:-1]])
        close, volume = t["close"], t["volume"]
        up, dv, pc = close - before(close), volume - before(volume), before(close)
        first = np.isnan(pc)  # also where the close before is missing
        flat = lambda x: np.where(np.isnan(x), 0.0, np.maximum(x, 0.0))
        t |= {"lv": np.log(volume + 1), "cr": close / pc, "vr": np.log(volume / before(volume) + 1), "moved": np.abs(up), "vmoved": np.abs(dv), "wv": np.abs(up / pc) * volume}
        t |= {"up": np.where(first, 0.0, np.where(np.isnan(up), np.nan, up > 0)), "down": np.where(first, 0.0, np.where(np.isnan(up), np.nan, up < 0))}
        t |= {k: np.where(first, np.nan, flat(x)) for k, x in (("gain", up), ("loss", -up), ("vgain", dv), ("vloss", -dv))}
        self.seen += n
        for k in ("up", "down"):  # what stands before the first bar is no bar
            t[k][: max(0, self.back + n - self.seen)] = np.nan
        with np.errstate(invalid="ignore", divide="ignore"):
            return {k: x for w in self.windows for k, x in rolling(t, w, n).items()}


def alpha158(bars: DataFrame, windows=WINDOWS, kbar: bool = True, price: bool = True, key=KEY) -> DataFrame:
    """Nine candle shapes, four price ratios, and 29 rolling columns for each window, of which those are null that don't have
    all their bars. Windows are taken in numpy over Arrow batches, with the last bars carried from batch to batch: one
    shuffle and one sort by series, whatever the number of windows."""
    df = with_vwap(ops.by_key(bars))
    df = df.withColumns((candle() if kbar else {}) | (price_ratios() if price else {}))
    names = ", ".join(f"{k}{n} double" for n in windows for k in ROLLING)
    return scanned(df, names, lambda: _Rolling(windows), ["close", "high", "low", "volume"], key)


class _Lags:
    def __init__(self, fields, lags):
        self.fields, self.lags = fields, lags
        self.tail = {x: np.full(max(lags), np.nan) for x in fields.values()}

    def feed(self, rows):
        close, volume = rows["close"].astype(float), rows["volume"].astype(float) + EPS
        n, out = len(close), {}
        for f, x in self.fields.items():
            every = np.concatenate([self.tail[x], rows[x].astype(float)])
            by, at = volume if x == "volume" else close, len(every) - n
            out |= {f"{f}{k}": every[at - k : at - k + n] / by for k in self.lags}
            self.tail[x] = every[-max(self.lags) :] if max(self.lags) else every[:0]
        return out


def lag_set(bars: DataFrame, fields: str = "CLOSE,OPEN,HIGH,LOW,VWAP,VOLUME", windows: str = "0-59", key=KEY) -> DataFrame:
    """Lagged fields by the current close, lagged volumes by the current volume; windows as '0-59' or '5,10'. The last
    values of each field are carried from batch to batch."""
    lags = [k for part in windows.split(",") for k in (range(int(part.split("-")[0]), int(part.split("-")[1]) + 1) if "-" in part else [int(part)])]
    names = {f: f.strip().lower() for f in fields.split(",")}
    kinds = ", ".join(f"{f}{k} double" for f in names for k in lags)
    return scanned(with_vwap(ops.by_key(bars)), kinds, lambda: _Lags(names, lags), list(dict.fromkeys([*names.values(), "close", "volume"])), key)


def technical(df: DataFrame) -> DataFrame:
    """Plain moving average, RSI by simple means, ATR by a guarded mean."""
    from .indicators import true_range

    d = ops.delta("close")
    zero = lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    df = df.withColumns({"_g": zero(d), "_l": zero(-d), "_tr": true_range()})
    g, lo = mean("_g", 14), mean("_l", 14)
    rsi = F.when((g == 0) & (lo == 0), F.lit(None)).when(lo == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(g, lo)))
    return df.withColumns({"MA_20": mean("close", 20), "RSI_14": rsi, "ATR_14": mean("_tr", 14)}).drop("_g", "_l", "_tr")


def time_features(df: DataFrame, time: str = "start_time") -> DataFrame:
    """Calendar columns in UTC whatever the session's zone."""
    t = F.expr(f"timestampadd(MILLISECOND, {time}, timestamp_ntz'1970-01-01 00:00:00')")
    df = df.withColumn("_t", t)
    cycle = lambda name, x, n: {f"{name}_sin": F.sin(2 * math.pi * x / n), f"{name}_cos": F.cos(2 * math.pi * x / n)}
    hour, dow, month, day = F.hour("_t"), F.weekday("_t"), F.month("_t"), F.to_date("_t")
    start_q = F.to_date(F.expr("trunc(_t, 'QUARTER')"))
    start_y, start_m = F.to_date(F.expr("trunc(_t, 'YEAR')")), F.to_date(F.expr("trunc(_t, 'MONTH')"))
    cols = {
        "hour": hour, "minute": F.minute("_t"), "day_of_week": dow, "day_of_month": F.dayofmonth("_t"), "day_of_year": F.dayofyear("_t"), "week": F.weekofyear("_t"), "month": month, "quarter": F.quarter("_t"),
        "is_weekend": (dow >= 5).cast("int"), "is_month_start": (day == start_m).cast("int"), "is_month_end": (day == F.last_day(day)).cast("int"), "is_quarter_start": (day == start_q).cast("int"),
        "is_quarter_end": (day == F.date_sub(F.add_months(start_q, 3), 1)).cast("int"), "is_year_start": (day == start_y).cast("int"), "is_year_end": (day == F.date_sub(F.add_months(start_y, 12), 1)).cast("int"),
        "days_in_month": F.datediff(day, start_m), "days_in_quarter": F.datediff(day, start_q), "days_in_year": F.datediff(day, start_y),
    } | cycle("hour", hour, 24) | cycle("dow", dow, 7) | cycle("month", month, 12)
    return df.withColumns(cols).drop("_t")


def direction(df: DataFrame, n: int = 20, kind: str = "ratio") -> DataFrame:
    """Rising bars (close over open) against falling ones: by the sum, number or mean of returns, those of falling bars
    without their signs. Full windows only, with two returns at least; null where neither side has anything."""
    df = df.withColumn("_r", ops.returns())
    up, down = F.when(F.col("close") > F.col("open"), F.col("_r")), F.when(F.col("close") < F.col("open"), F.abs("_r"))
    agg = {"ratio": F.sum, "count": F.count, "average": F.avg}[kind]
    pick = lambda c: F.coalesce(agg(c).over(W(n)).cast("double"), F.lit(0.0))
    df = df.withColumns({"_u": pick(up), "_d": pick(down), "_n": F.count(F.lit(1)).over(W(n)), "_k": F.count("_r").over(W(n))})
    value = F.when(F.col("_d") > 0, F.col("_u") / F.col("_d")).when(F.col("_u") > 0, F.col("_u") / 1e-10)
    return df.withColumn(f"Direction_{n}_{kind}", F.when((F.col("_n") >= n) & (F.col("_k") >= 2), value)).drop("_r", "_u", "_d", "_n", "_k")


def long_short_volume(df: DataFrame, n: int = 20, top: int = 5) -> DataFrame:
    """Volume of the `top` bars of a full window with the largest returns, as a share of theirs and of that of the `top`
    with the smallest; null with fewer than twice as many returns. With top = n this is always null, as the series' first
    return is missing or the sides overlap."""
    top = min(top, n)
    df = df.withColumn("_r", ops.returns())
    pair = F.when(F.col("_r").isNotNull() & F.col("volume").isNotNull(), F.struct("_r", "volume"))
    df = df.withColumns({"_a": F.array_sort(F.collect_list(pair).over(W(n))), "_n": F.count(F.lit(1)).over(W(n))})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["volume"])
    df = df.withColumns({"_u": total(F.slice(F.reverse("_a"), 1, top)), "_d": total(F.slice("_a", 1, top))})
    ok = (F.col("_n") >= n) & (F.size("_a") >= max(2, 2 * top)) & (F.col("_u") + F.col("_d") > 0)
    return df.withColumn(f"LongShortVolumeRatio_{n}_{top}", F.when(ok, F.col("_u") / (F.col("_u") + F.col("_d")))).drop("_r", "_a", "_n", "_u", "_d")


def volume_average(df: DataFrame, n: int = 20, side: str = "FLAT", kind: str = "min_volume", top: int = 20) -> DataFrame:
    """Mean of the `top` least (or most) volumes of all, rising or falling bars of the last n, by the current volume. Null
    before bar n, where fewer than `top` (n at most) such bars have a volume, and where one of the two isn't over zero."""
    cond, top = {"FLAT": F.lit(True), "LONG": F.col("close") > F.col("open"), "SHORT": F.col("close") < F.col("open")}[side], min(top, n)
    df = df.withColumn("_a", F.when(F.count(F.lit(1)).over(W(n)) >= n, F.array_sort(F.collect_list(F.when(cond, F.col("volume"))).over(W(n)))))
    few = F.slice(F.col("_a") if kind == "min_volume" else F.reverse("_a"), 1, top)
    df = df.withColumn("_f", F.aggregate(few, F.lit(0.0), lambda s, x: s + x) / top)
    ok = (F.size("_a") >= top) & (F.col("_f") > 0) & (F.col("volume") > 0)
    return df.withColumn(f"VolumeAverage_{n}_{side}_{kind}_{top}", F.when(ok, F.col("_f") / F.col("volume"))).drop("_a", "_f")


def acceleration(df: DataFrame, n: int = 21) -> DataFrame:
    """Quadratic fit of the close on 1..n: (alpha, beta, gamma, r2). The design is fixed, so each coefficient is a weighted
    sum of the window."""
    import numpy as np

    t = np.arange(1, n + 1, dtype=float)
    coef = np.linalg.pinv(np.column_stack([np.ones(n), t, t * t]))
    df = df.withColumn("_a", ops.window_array("close", n))
    dot = lambda w: F.aggregate(F.zip_with("_a", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    df = df.withColumns({"am_alpha": dot(coef[0]), "am_beta": dot(coef[1]), "am_gamma": dot(coef[2])})
    ts = F.array(*[F.lit(float(v)) for v in t])
    sq = F.aggregate(F.zip_with("_a", ts, lambda y, x: F.pow(y - F.col("am_alpha") - F.col("am_beta") * x - F.col("am_gamma") * x * x, 2)), F.lit(0.0), lambda s, v: s + v)
    df = df.withColumns({"_sse": sq, "_sst": F.var_pop("close").over(W(n)) * n})
    return df.withColumn("am_r2", F.when(F.col("_sst") > 1e-12, 1 - F.col("_sse") / F.col("_sst"))).drop("_a", "_sse", "_sst")


def run_lengths(df: DataFrame, x: str = "close") -> DataFrame:
    """up_run and down_run: rising or falling bars in a row up to each bar, by islands of equal direction; a bar that doesn't
    move leaves both as they are, and a series' first bar has none."""
    moved = F.signum(ops.delta(x))
    df = df.withColumn("_s", moved).withColumn("_d", F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(ops.U()))
    df = df.withColumn("_new", F.when(F.col("_d") == delay("_d"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(ops.U()))
    from pyspark.sql import Window

    k = F.sum(F.when(F.col("_s") != 0, 1).otherwise(0)).over(Window.partitionBy(*KEY, "_island").orderBy("start_time").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_k", k)
    run = lambda side: F.when(F.col("_s").isNotNull(), F.when(F.col("_d") == side, F.col("_k")).otherwise(0))
    return df.withColumns({"up_run": run(1), "down_run": run(-1)}).drop("_s", "_d", "_new", "_island", "_k")


def dmom(df: DataFrame, train: int = 120, vol: int = 20, most: int = 12, expanding: bool = True) -> DataFrame:
    """DMOM_prob: a linear model, fitted on the bars before, of whether a bar rises, by the volatility, run lengths and
    return of the bar before it; between 0 and 1, from bar train + 1, with ten bars to learn from. The model's normal
    equations are running sums over the series (or over the last `train` bars), so only 5 x 5 systems are left to solve."""
    import numpy as np
    from pyspark.sql import Window

    r = "_r"
    df = run_lengths(df).withColumns({r: ops.returns(), "_i": F.row_number().over(ops.series())})
    df = df.withColumns({"DMOM_up": F.least("up_run", F.lit(most)).cast("double"), "DMOM_down": F.least("down_run", F.lit(most)).cast("double"), "_v": F.when((F.col("_i") >= vol) & (F.count(r).over(W(vol)) >= 5), F.stddev_pop(r).over(W(vol)))}).drop("up_run", "down_run")
    names = ["_v", "DMOM_up", "DMOM_down", r]
    df = df.withColumns({f"_x{k + 1}": delay(c) for k, c in enumerate(names)} | {"_y": F.when(F.col(r).isNotNull(), (F.col(r) > 0).cast("double"))})
    ok = F.col("_y").isNotNull()
    for k in range(1, 5):
        ok = ok & F.col(f"_x{k}").isNotNull()
    df = df.withColumn("_x0", F.when(ok, F.lit(1.0)))
    before = ops.series().rowsBetween(Window.unboundedPreceding if expanding else -(train - 1), -1)
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    sums = {f"_a{i}{j}": F.sum(F.col("_x0") * F.col(f"_x{i}") * F.col(f"_x{j}")).over(before) for i, j in pairs} | {f"_b{i}": F.sum(F.col("_x0") * F.col(f"_x{i}") * F.col("_y")).over(before) for i in range(5)}
    df = df.withColumns(sums).withColumns({"_m": F.array(*[F.coalesce(f"_a{min(i, j)}{max(i, j)}", F.lit(0.0)) for i in range(5) for j in range(5)]), "_w": F.array(*[F.coalesce(f"_b{i}", F.lit(0.0)) for i in range(5)]), "_z": F.when((F.col("_i") > train) & (F.col("_a00") >= 10), F.array(F.lit(1.0), *[F.col(f"_x{k}") for k in range(1, 5)]))})
    df = df.drop(*sums, *[f"_x{k}" for k in range(5)], "_y", "_v", r, "_i")
    from pyspark.sql.types import DoubleType, StructType

    kept = [c for c in df.columns if c not in ("_m", "_w", "_z")]
    schema = StructType([f for f in df.schema.fields if f.name in kept]).add("DMOM_prob", DoubleType())

    def solve(batches):
        for t in batches:
            prob = np.full(len(t), np.nan)
            rows = np.flatnonzero([z is not None and all(v is not None and v == v for v in z) for z in t["_z"]])
            if len(rows):
                m, w, z = (np.array([list(v) for v in t[c].iloc[rows]], float) for c in ("_m", "_w", "_z"))
                fit = np.einsum("nij,nj->ni", np.linalg.pinv(m.reshape(-1, 5, 5)), w)
                prob[rows] = np.clip((fit * z).sum(1), 0, 1)
            yield t[kept].assign(DMOM_prob=prob)

    out = df.mapInPandas(solve, schema)
    return out.withColumn("DMOM_prob", F.when(~F.isnan("DMOM_prob"), F.col("DMOM_prob")))


def simple_dmom(df: DataFrame, vol: int = 20, most: int = 12, weights=(0.4, 0.4, 0.2)) -> DataFrame:
    """Score of the bar before, each part from 0 to 1: its run length, its return, and how low its volatility (of up to
    `vol` returns, five at least) ranks among those of the bars from it and `vol` - 1 before to the current one, ties and
    itself counted as not higher; a half where it has none. Null for the first `vol` bars and without a return."""
    df = run_lengths(df).withColumns({"_r": ops.delta("close") / (delay("close") + 1e-20), "_i": F.row_number().over(ops.series())})
    df = df.withColumn("_v", F.when((F.col("_i") >= vol) & (F.count("_r").over(W(vol)) >= 5), F.stddev_pop("_r").over(W(vol))))
    df = df.withColumns({"_a": F.collect_list("_v").over(W(vol + 1)), "_p": delay("_v")})
    runs = (F.least(delay("up_run"), F.lit(most)) - F.least(delay("down_run"), F.lit(most)) + most) / (2 * most)
    low = F.when(F.col("_p").isNotNull(), 1 - F.size(F.filter("_a", lambda v: v <= F.col("_p"))) / F.size("_a")).otherwise(0.5)
    score = weights[0] * runs + weights[1] * (F.tanh(delay("_r") * 20) + 1) / 2 + weights[2] * low
    return df.withColumn("SimpleDMOM", F.when(F.col("_i") > vol, score)).drop("_r", "_i", "_v", "_a", "_p", "up_run", "down_run")


def spread(df: DataFrame, n: int = 60, logs: bool = True) -> DataFrame:
    """Bid-ask spread: the root of -4 times the mean, over up to n bars, of (close - middle) of the bar before with that
    close less this bar's middle, in logs; the middle is that of high and low, products begin with the third bar, missing
    ones are left out, a negative square counts as zero. Null for the first n bars."""
    f = F.ln if logs else (lambda x: x)
    df = df.withColumns({"_c": f(F.col("close")), "_m": f((F.col("high") + F.col("low")) / 2), "_i": F.row_number().over(ops.series())})
    df = df.withColumn("_p", F.when(F.col("_i") > 2, (delay("_c") - delay("_m")) * (delay("_c") - F.col("_m"))))
    df = df.withColumn("_s", F.when(F.col("_i") > n, F.avg("_p").over(W(n))))
    return df.withColumn(f"SimpleAR_{n}", F.sqrt(F.greatest(-4 * F.col("_s"), F.lit(0.0) * F.col("_s")))).drop("_c", "_m", "_p", "_s", "_i")


def ar_spread(df: DataFrame, base: int = 240, windows=(5, 15, 30, 60), logs: bool = True) -> DataFrame:
    """Spread estimates from d, the product of (close - middle) of the bar before with that close less this bar's middle: AR,
    the root of the mean of -4 d without negative values over `base` bars; AR_base, the root of -4 times the mean of d; and
    AR_w for each window, where d is first averaged over w bars. Missing values are left out of the means, nothing is given
    before bar base + 1, and d begins with the third bar."""
    f = F.ln if logs else (lambda x: x)
    at = F.row_number().over(ops.series())
    df = df.withColumns({"_c": f(F.col("close")), "_m": f((F.col("high") + F.col("low")) / 2), "_i": at})
    df = df.withColumn("_d", F.when(F.col("_i") > 2, (delay("_c") - delay("_m")) * (delay("_c") - F.col("_m"))))
    df = df.withColumns({f"_d{w}": F.when(F.col("_i") >= w, F.avg("_d").over(W(w))) for w in windows})
    kept = lambda x, first: F.when(F.col("_i") > first, F.sqrt(F.avg(F.greatest(-4 * F.col(x), F.lit(0.0) * F.col(x))).over(W(base))))
    out = {"AR": kept("_d", base), f"AR_{base}": F.when(F.col("_i") > base, F.sqrt(F.greatest(-4 * F.avg("_d").over(W(base)), F.lit(0.0))))}
    out |= {f"AR_{w}": kept(f"_d{w}", max(base, w)) for w in windows}
    return df.withColumns(out).drop("_c", "_m", "_i", "_d", *[f"_d{w}" for w in windows])


def spikes(df: DataFrame, n: int = 60, few: int = 3, price: str = "close") -> DataFrame:
    """Adds spike_strength (mean absolute return of up to `few` bars, from bar `few` on), spike_threshold (median of up to n,
    from bar n on) and is_spike, whether the strength passes it. A price that isn't over zero makes no return."""
    df = df.withColumns({"_r": F.abs(F.when(delay(price) > 0, ops.delta(price) / delay(price))), "_i": F.row_number().over(ops.series())})
    df = df.withColumns({"spike_strength": F.when(F.col("_i") >= few, F.avg("_r").over(W(few))), "spike_threshold": F.when(F.col("_i") >= n, F.percentile("_r", F.lit(0.5)).over(W(n)))})
    return df.withColumn("is_spike", (F.col("spike_strength") > F.col("spike_threshold")).cast("int")).drop("_r", "_i")


def price_spike(df: DataFrame, n: int = 60, few: int = 3, low: float = 0.1, high: float = 0.9, vwap: bool = False) -> DataFrame:
    """Return, its rises and its falls (the other ones as zero), each in its place between rolling quantiles, clipped, and
    what spikes() gives; eight columns. A half where the quantiles are equal; places need bar n and three returns. vwap:
    amount by volume in place of the close, where there is a volume."""
    price = F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")).otherwise(F.col("close")) if vwap else F.col("close")
    df = df.withColumns({"_price": price, "_n": F.row_number().over(ops.series())})
    df = df.withColumn("ps_diff", F.when(delay("_price") > 0, ops.delta("_price") / delay("_price")))
    df = df.withColumns({"ps_pos": F.greatest("ps_diff", F.lit(0.0) * F.col("ps_diff")), "ps_neg": F.greatest(-F.col("ps_diff"), F.lit(0.0) * F.col("ps_diff"))})
    for c in ("ps_pos", "ps_neg"):
        df = df.withColumns({"_lo": F.percentile(c, F.lit(low)).over(W(n)), "_hi": F.percentile(c, F.lit(high)).over(W(n)), "_k": F.count(c).over(W(n))})
        place = F.when(F.col("_hi") > F.col("_lo"), (F.least(F.greatest(c, "_lo"), F.col("_hi")) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
        df = df.withColumn(f"{c}_norm", F.when((F.col("_n") >= n) & (F.col("_k") >= 3) & F.col(c).isNotNull(), place)).drop("_lo", "_hi", "_k")
    df = spikes(df, n, few, "_price").withColumnsRenamed({"spike_strength": "ps_strength", "spike_threshold": "ps_threshold", "is_spike": "ps_is_spike"})
    return df.drop("_price", "_n")


def compute_all(df: DataFrame, factors: dict) -> DataFrame:
    """Run factors (name: function that adds columns) and prefix what each adds; fails on a column that is there already or
    a factor that adds none."""
    base, out = df.columns, df
    for name, factor in factors.items():
        got = factor(out)
        added = [c for c in got.columns if c not in out.columns]
        if not added or any(f"{name}_{c}" in out.columns for c in added):
            raise ValueError(f"factor {name} adds no new column")
        out = got.withColumnsRenamed({c: f"{name}_{c}" for c in added})
    return out.select(*base, *[c for c in out.columns if c not in base])


def with_categories(df: DataFrame, column: str, categories: list) -> DataFrame:
    """The column, which numbers categories from 0, with their list in its metadata, as a nominal attribute: it goes with the
    column through select, join and Parquet, and tells Spark's tree learners to split by sets of values."""
    attr = {"type": "nominal", "name": column, "vals": [str(c) for c in categories]}
    return df.withMetadata(column, {"ml_attr": attr, "num_categories": len(categories)})


def categorical_info(df: DataFrame) -> dict[str, int]:
    """Number of categories of each column that has any in its metadata."""
    return {f.name: f.metadata["num_categories"] for f in df.schema.fields if "num_categories" in f.metadata}


def encoder_classes(df: DataFrame) -> dict[str, list[str]]:
    """The category lists of such columns, as encode_as() takes them."""
    return {f.name: f.metadata["ml_attr"]["vals"] for f in df.schema.fields if "num_categories" in f.metadata}


def encode(df: DataFrame, column: str, out: str, categories: list[str]) -> DataFrame:
    """out: the place of the column's value among the categories, null for another value, with their list as metadata."""
    known = [str(c) for c in categories]
    place = F.array_position(F.array(*[F.lit(c) for c in known]), F.col(column).cast("string")).cast("int") - 1 if known else F.lit(-1)
    return with_categories(df.withColumn(out, F.when(place >= 0, place)), out, known)


def encode_as(df: DataFrame, columns: dict[str, str], like: dict[str, list[str]]) -> DataFrame:
    """Columns (result: source) encoded by the lists that encoder_classes() gave for another frame."""
    for out, column in columns.items():
        df = encode(df, column, out, like[out])
    return df


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """One column for each category, sorted; an unknown value has zeros. Each is marked as of two categories."""
    names = {f"{column}_{c}": c for c in sorted(categories)}
    df = df.withColumns({n: (F.coalesce(F.col(column) == c, F.lit(False))).cast("int") for n, c in names.items()})
    for n in names:
        df = with_categories(df, n, ["0", "1"])
    return df


def timeframe_code(df: DataFrame) -> DataFrame:
    """The timeframe's place in alphabetical order of all timeframes, ticks included."""
    return encode(df, "timeframe", "timeframe_code", sorted([*TIMEFRAMES, "tick"]))


__all__ = [n for n in dir() if not n.startswith("_")]
