"""Metrics of equity curves and trades, by run_id."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

RUN, AT = "run_id", "time"


def _w(frm=Window.unboundedPreceding, to=0):
    return Window.partitionBy(RUN).orderBy(AT).rowsBetween(frm, to)


def simple_returns(eq: DataFrame) -> DataFrame:
    """With the step's return, 0 where the value before is 0; null for the first."""
    prev = F.lag("equity").over(Window.partitionBy(RUN).orderBy(AT))
    return eq.withColumn("ret", F.when(prev == 0, F.lit(0.0)).otherwise(F.col("equity") / prev - 1))


def drawdown_curve(eq: DataFrame) -> DataFrame:
    """With the running peak, the drawdown from it (0 or less), and the bars since it."""
    eq = eq.withColumns({"peak": F.max("equity").over(_w()), "_n": F.row_number().over(Window.partitionBy(RUN).orderBy(AT))})
    eq = eq.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(F.lit(0.0)))
    at_peak = F.max(F.when(F.col("equity") == F.col("peak"), F.col("_n"))).over(_w())
    return eq.withColumn("bars_from_peak", F.col("_n") - at_peak).drop("_n")


def annualized(total: Column, n: Column, ppy: float) -> Column:
    """Compound; linear for fewer than 30 steps or an exponent over 100; -1 for a total loss."""
    power = ppy / n
    return F.when(n == 0, F.lit(0.0)).when(total <= -1, F.lit(-1.0)).when((n < 30) | (power > 100), total * power).otherwise(F.pow(1 + total, power) - 1)


def metrics(eq: DataFrame, ppy: float = 365.0, rf: float = 0.02) -> DataFrame:
    """Headline metrics of each run: returns, volatility, both Sharpe ratios, Sortino, Calmar, omega, drawdowns, VaR and
    CVaR at 95 %, skewness and excess kurtosis (population). Two windows on one partitioning, and one aggregation."""
    eq = drawdown_curve(simple_returns(eq))
    under = F.when(F.col("drawdown") < 0, 1).otherwise(0)
    eq = eq.withColumn("_u", under)
    eq = eq.withColumn("_new", F.when((F.col("_u") == 1) & (F.coalesce(F.lag("_u").over(Window.partitionBy(RUN).orderBy(AT)), F.lit(0)) == 0), 1).otherwise(0))
    eq = eq.withColumn("_spell", F.sum("_new").over(_w()))
    eq = eq.withColumn("_len", F.when(F.col("_u") == 1, F.sum("_u").over(Window.partitionBy(RUN, "_spell").orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    q = F.percentile("ret", F.lit(0.05))
    agg = eq.groupBy(RUN).agg(
        F.count("ret").alias("n"), F.min_by("equity", AT).alias("first"), F.max_by("equity", AT).alias("last"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_std"),
        F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(F.when(F.col("ret").isNotNull(), F.lit(0.0))))).alias("_down"),
        F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("_gain"), F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)).alias("_loss"),
        F.min("drawdown").alias("max_drawdown"), F.min_by("bars_from_peak", F.struct("drawdown", AT)).alias("drawdown_bars"), F.sum("_new").alias("drawdown_periods"), F.max("_len").alias("longest_drawdown"),
        q.alias("var95"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
    )
    agg = agg.withColumn("total_return", F.try_divide(F.col("last"), F.col("first")) - 1)
    agg = agg.withColumns({"annual_return": annualized(F.col("total_return"), F.col("n"), ppy), "volatility": F.col("_std") * math.sqrt(ppy)})
    agg = agg.withColumns({
        "sharpe_annual_over_vol": F.try_divide(F.col("annual_return"), F.col("volatility")), "sharpe_excess": F.try_divide(F.col("_mean") * ppy - rf, F.col("volatility")),
        "sortino": F.try_divide(F.col("annual_return"), F.col("_down") * math.sqrt(ppy)), "calmar": F.try_divide(F.col("annual_return"), -F.col("max_drawdown")), "omega": F.try_divide(F.col("_gain"), F.col("_loss")),
    })
    tail = eq.join(agg.select(RUN, "var95"), RUN).filter(F.col("ret") <= F.col("var95")).groupBy(RUN).agg(F.avg("ret").alias("cvar95"))
    return agg.join(tail, RUN, "left").drop("_mean", "_std", "_down", "_gain", "_loss")


def benchmark(bars: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Buy and hold: the close scaled to the initial balance."""
    from ..functions import ops

    return bars.withColumn("benchmark", initial * F.col("close") / F.first("close").over(ops.U()))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Counts, rates and sizes of closed trades (run_id, side, pnl, entry_amount), for all, long and short ones."""

    def side(name: str, cond: Column) -> list[Column]:
        pnl = F.when(cond, F.col("pnl"))
        win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
        n = F.count(pnl)
        return [
            n.alias(f"{name}trades"), F.count(win).alias(f"{name}wins"), F.count(loss).alias(f"{name}losses"), F.try_divide(F.count(win), n).alias(f"{name}win_rate"),
            F.when(F.coalesce(F.sum(loss), F.lit(0.0)) == 0, F.when(F.count(win) > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(F.coalesce(F.sum(win), F.lit(0.0)) / -F.sum(loss)).alias(f"{name}profit_factor"),
            F.avg(win).alias(f"{name}avg_win"), F.avg(loss).alias(f"{name}avg_loss"), F.try_divide(F.avg(win), -F.avg(loss)).alias(f"{name}win_loss"), F.max(win).alias(f"{name}largest_win"),
            F.min(F.try_divide(loss, F.col("entry_amount"))).alias(f"{name}largest_loss_ratio"), F.avg(F.try_divide(pnl, F.col("entry_amount"))).alias(f"{name}avg_return"),
        ]

    return trades.groupBy(RUN).agg(*side("", F.lit(True)), *side("long_", F.col("side") == "LONG"), *side("short_", F.col("side") == "SHORT"))


def turnover(positions: DataFrame) -> DataFrame:
    """Sum of the changes of the position rate, the first from nothing."""
    prev = F.coalesce(F.lag("rate").over(Window.partitionBy(RUN).orderBy(AT)), F.lit(0.0))
    return positions.withColumn("_d", F.abs(F.col("rate") - prev)).groupBy(RUN).agg(F.sum("_d").alias("turnover"))


def _t_sf(t: float, df: int) -> float:
    """P(T > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        half = x / 2
    else:
        flip = x > (a + 1) / (a + b + 2)
        p, q, z = (b, a, 1 - x) if flip else (a, b, x)
        front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(z) + q * math.log(1 - z)) / p
        c, d = 1.0, 1 / max(1 - (p + q) * z / (p + 1), 1e-300)
        f = d
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                f *= c * d
        half = (1 - front * f if flip else front * f) / 2
    return half if t >= 0 else 1 - half


def t_test(eq: DataFrame) -> DataFrame:
    """(run_id, t, p): one-sided test that the mean return is over 0. The moments are one aggregation; p is computed on one
    row per run."""
    a = simple_returns(eq).groupBy(RUN).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))

    def p(batches):
        for t in batches:
            stat = t["m"] / t["s"].where(t["s"] > 0) * np.sqrt(t["n"])
            yield pd.DataFrame({RUN: t[RUN], "t": stat, "p": [_t_sf(x, int(n) - 1) for x, n in zip(stat, t["n"])]})

    return a.mapInPandas(p, f"{RUN} string, t double, p double")


def regression(df: DataFrame) -> DataFrame:
    """(run_id, n, alpha, beta, r_squared, t, alpha_pvalue, alpha_pvalue_ols) of returns `ret` on a benchmark's `bench`, on
    rows that have both. t is alpha by the slope's standard error, whose one-sided p-value is alpha_pvalue (one less it
    where alpha isn't positive); alpha_pvalue_ols goes by alpha's own error. A benchmark that doesn't move: alpha is the
    mean return, beta and r_squared 0, and p that of the mean. Fewer than two rows: zeros and p = 1."""
    rows = df.filter(F.col("ret").isNotNull() & F.col("bench").isNotNull())
    x, y = "bench", "ret"
    a = rows.groupBy(RUN).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"), (F.max(F.abs(F.col(x))) * 1e-5 + 1e-8 >= F.max(x) - F.min(x)).alias("flat"))
    few, flat = F.col("n") < 2, F.col("flat")
    beta = F.when(few | flat, F.lit(0.0)).otherwise(F.col("cxy") / F.col("vx"))
    r2 = F.when(few | flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")), F.lit(0.0)))
    a = a.withColumns({"beta": beta, "r_squared": r2}).withColumn("alpha", F.when(few, F.lit(0.0)).when(flat, F.col("my")).otherwise(F.col("my") - F.col("beta") * F.col("mx")))
    error = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r_squared")) * F.col("vy") / F.col("vx") / (F.col("n") - 2)))
    own = error * F.sqrt(F.col("vx") * (F.col("n") - 1) / F.col("n") + F.col("mx") * F.col("mx"))
    a = a.withColumns({"t": F.when(flat, F.try_divide(F.col("my"), F.sqrt(F.col("vy") / F.col("n")))).otherwise(F.try_divide(F.col("alpha"), error)), "t_ols": F.when(~flat, F.try_divide(F.col("alpha"), own)), "df": F.when(flat, F.col("n") - 1).otherwise(F.col("n") - 2)})

    def p(batches):
        for t in batches:
            ok = (t["n"] > 1) & t["t"].notna()
            first = [_t_sf(x, int(d)) if good else 1.0 for x, d, good in zip(t["t"], t["df"], ok)]
            turned = [1 - v if good and not still and a <= 0 else v for v, a, good, still in zip(first, t["alpha"], ok, t["flat"])]
            own = [_t_sf(x, int(d)) if good and x == x else v for x, d, good, v in zip(t["t_ols"].astype(float), t["df"], ok, first)]
            yield t[[RUN, "n", "alpha", "beta", "r_squared", "t"]].assign(alpha_pvalue=turned, alpha_pvalue_ols=own)

    kind = df.schema[RUN].dataType.simpleString()
    a = a.na.fill(False, ["flat"]).select(RUN, "n", "alpha", "beta", "r_squared", "t", "t_ols", "df", "flat")
    return a.mapInPandas(p, f"{RUN} {kind}, n long, alpha double, beta double, r_squared double, t double, alpha_pvalue double, alpha_pvalue_ols double")


def universality(m: DataFrame, by: str = "symbol", sharpe: str = "sharpe") -> DataFrame:
    """One row over the runs' (by, sharpe): groups, those whose mean is positive, their share, best and worst group by a
    single run, whether the share is 0.7 or more, and consistent (0.8), moderate (0.5) or inconsistent."""
    g = m.groupBy(by).agg(F.avg(sharpe).alias("_m"), F.max(sharpe).alias("_hi"), F.min(sharpe).alias("_lo"))
    a = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_m") > 0).alias("positive"), F.max_by(by, F.struct("_hi", by)).alias("best"), F.min_by(by, F.struct("_lo", by)).alias("worst"))
    share = F.coalesce(F.try_divide(F.col("positive"), F.col("groups")), F.lit(0.0))
    a = a.withColumn("share", share)
    return a.withColumns({"is_universal": F.col("share") >= 0.7, "consistency": F.when(F.col("share") >= 0.8, "consistent").when(F.col("share") >= 0.5, "moderate").otherwise("inconsistent")})


def run_summary(trades: DataFrame, eq: DataFrame) -> DataFrame:
    """Of each run: number, sum, mean, best and worst of the trades' profits, mean win and loss (0 without any), and first,
    last, highest and lowest equity with the number of points. A run may lack one side."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pnl = F.col("pnl")
    t = trades.groupBy(RUN).agg(F.count(F.lit(1)).alias("total_count"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"), F.max(pnl).alias("best_trade"), F.min(pnl).alias("worst_trade"), zero(F.avg(F.when(pnl > 0, pnl))).alias("avg_winning"), zero(F.avg(F.when(pnl < 0, pnl))).alias("avg_losing"))
    e = eq.groupBy(RUN).agg(F.min_by("equity", AT).alias("initial"), F.max_by("equity", AT).alias("final"), F.max("equity").alias("peak"), F.min("equity").alias("trough"), F.count(F.lit(1)).alias("data_points"))
    return t.join(e, RUN, "full")


def order_summary(orders: DataFrame) -> DataFrame:
    """Of each run's closing orders (position_id, pnl, fee, friction): profits with fee and friction; win rates in percent
    and mean win by mean loss (infinite without a loss, 0 without a win), by order and by position."""

    def rates(prefix: str, df: DataFrame) -> DataFrame:
        win, loss = F.avg(F.when(F.col("p") > 0, F.col("p"))), F.avg(F.when(F.col("p") < 0, -F.col("p")))
        ratio = F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss).when(win > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
        return df.groupBy(RUN).agg(F.count(F.lit(1)).alias(f"{prefix}s"), F.sum("p").alias(f"{prefix}_pnl"), (100 * F.count_if(F.col("p") > 0) / F.count(F.lit(1))).alias(f"{prefix}_win_rate"), ratio.alias(f"{prefix}_win_loss"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    o = orders.withColumn("p", zero("pnl") + zero("fee") + zero("friction"))
    return rates("order", o).join(rates("position", o.groupBy(RUN, "position_id").agg(F.sum("p").alias("p"))), RUN)


def binomial_p(wins: int, n: int) -> float:
    """P(at least so many wins of n at even odds)."""
    return min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(wins, n + 1))) if n > 0 else 1.0


def binomial_test(wins: str, n: str) -> Column:
    """binomial_p of two columns: a fold over the counts, in logs; 1 without trades, null for a null."""
    step = lambda acc, k: F.struct(
        (acc["log"] + F.log((F.col(n) - k) / (k + 1.0))).alias("log"), (acc["p"] + F.when(k >= F.col(wins), F.exp(acc["log"] - F.col(n) * math.log(2))).otherwise(0.0)).alias("p")
    )
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("p"))
    below = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1), start, step)  # the last count, n, is left
    last = F.exp(-F.col(n) * math.log(2))
    return F.when(F.col(n) < 1, 1.0).when(F.col(n) >= 1, F.least(F.lit(1.0), below["p"] + F.when(F.col(wins) <= F.col(n), last).otherwise(0.0)))


def paired_t_test(df: DataFrame) -> DataFrame:
    """(run_id, n, t, p): one-sided test that returns `ret` are over those of a benchmark, `bench`, on rows that have both; 0
    and 1 for fewer than two rows. Where all differences are equal, t and p are null."""
    diff = df.withColumn("_d", F.col("ret") - F.col("bench"))
    a = diff.groupBy(RUN).agg(F.count("_d").alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"))
    kind = df.schema[RUN].dataType.simpleString()

    def p(batches):
        for t in batches:
            few = t["n"] < 2
            stat = (t["m"] / t["s"].where(t["s"] > 0) * np.sqrt(t["n"])).mask(few, 0.0)
            tail = pd.Series([1.0 if f else _t_sf(x, int(n) - 1) for x, n, f in zip(stat, t["n"], few)], index=t.index, dtype="float64")
            yield pd.DataFrame({RUN: t[RUN], "n": t["n"], "t": stat, "p": tail})

    out = a.mapInPandas(p, f"{RUN} {kind}, n long, t double, p double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t", "p")})


def period_comparison(eq: DataFrame, start: int, ppy: float = 365.0, rf: float = 0.02) -> DataFrame:
    """metrics() of each run before the time `start` and from it on, in rows with period `previous` and `current`, and for the
    latter the change of each number since the former. A run without points in a period has no row for it."""
    at = F.when(F.col(AT) < start, "previous").otherwise("current")
    parts = eq.withColumn(RUN, F.struct(F.col(RUN).alias("run"), at.alias("period")))
    m = metrics(parts, ppy, rf).withColumns({"_run": F.col(f"{RUN}.run"), "period": F.col(f"{RUN}.period")}).drop(RUN).withColumnRenamed("_run", RUN)
    numbers = [c for c, kind in m.dtypes if kind in ("double", "bigint", "int")]
    before = m.filter("period = 'previous'").select(RUN, F.lit("current").alias("period"), *[F.col(c).alias(f"_p_{c}") for c in numbers])
    both = m.join(before, [RUN, "period"], "left")
    return both.withColumns({f"{c}_change": F.col(c) - F.col(f"_p_{c}") for c in numbers}).drop(*[f"_p_{c}" for c in numbers])


def bootstrap(eq: DataFrame, times: int = 1000, ppy: float = 365.0, seed: int = 42) -> DataFrame:
    """95 % intervals of Sharpe ratio and annual return over resampled returns; runs are the unit of parallelism, draws are
    taken in blocks."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        r = t.sort_values(AT)["ret"].dropna().to_numpy()
        rng = np.random.default_rng(seed)
        s, a = [], []
        for _ in range(0, times, 100):
            x = r[rng.integers(0, len(r), (100, len(r)))] if len(r) > 1 else np.zeros((100, 2))
            sd = x.std(1, ddof=1)
            s.append(np.where(sd > 0, x.mean(1) / np.where(sd > 0, sd, 1) * np.sqrt(ppy), 0))
            a.append(np.expm1(np.log1p(np.maximum(x, -0.999999)).mean(1) * ppy))
        q = [np.percentile(np.concatenate(v), [2.5, 97.5]) for v in (s, a)]
        return pd.DataFrame({RUN: [t[RUN].iloc[0]], "sharpe_low": [q[0][0]], "sharpe_high": [q[0][1]], "annual_low": [q[1][0]], "annual_high": [q[1][1]]})

    return simple_returns(eq).groupBy(RUN).applyInPandas(run, f"{RUN} string, sharpe_low double, sharpe_high double, annual_low double, annual_high double")


#: Points of a run by bands of annual return, Sharpe ratio and drawdown, best first; letters by points.
POINTS = (25, 20, 15, 10, 5)
BANDS = {"annual_return": (0.5, 0.3, 0.15, 0.0, -0.1), "sharpe": (2.0, 1.5, 1.0, 0.5, 0.0), "max_drawdown": (-0.1, -0.2, -0.3, -0.5, -0.7)}
LETTERS = ((90, "A+"), (80, "A"), (70, "B+"), (60, "B"), (50, "C"), (40, "D"))


def grade(m: DataFrame, sharpe: str = "sharpe_annual_over_vol", p: str = "p", trades: str = "trades") -> DataFrame:
    """A letter from A+ to F by four times up to 25 points: annual return, Sharpe ratio, drawdown, and how sure the result is
    by its p-value and number of trades; the points; and a list of concerns. Missing values have no points."""

    def first(pairs):
        out = None
        for cond, value in pairs:
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    points = sum((first([(F.col(sharpe if c == "sharpe" else c) > low, pts) for low, pts in zip(lows, POINTS)]).otherwise(0) for c, lows in BANDS.items()), F.lit(0))
    n = F.col(trades)
    sure = first([((F.col(p) < at) & (n >= least), pts) for at, least, pts in ((0.01, 50, 25), (0.05, 30, 20), (0.1, 20, 15))]).when(n >= 30, 10).when(n >= 10, 5).otherwise(0)
    m = m.withColumn("points", points + sure)
    worry = F.array_compact(F.array(
        F.when(n < 30, "few trades"), F.when(F.col(p) >= 0.05, "not significant"), F.when(F.col("max_drawdown") < -0.3, "deep drawdown"), F.when((F.col(sharpe) < 0.5) & (F.col("total_return") > 0), "low Sharpe ratio"),
    ))
    return m.withColumns({"grade": first([(F.col("points") >= at, letter) for at, letter in LETTERS]).otherwise("F"), "concerns": worry})


def combined_curve(eq: DataFrame) -> DataFrame:
    """One curve over runs: mean of the runs' step returns at each time (0 where a run has no new point), compounded. The
    last step goes over one row for each distinct time, after all runs are summed."""
    r = simple_returns(eq).groupBy(AT).agg(F.sum(F.coalesce("ret", F.lit(0.0))).alias("s"))
    runs = eq.agg(F.greatest(F.count_distinct(RUN), F.lit(1)).alias("k"))
    w = Window.partitionBy(F.lit(0)).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    return r.crossJoin(runs).withColumn("combined", F.exp(F.sum(F.log1p(F.col("s") / F.col("k"))).over(w))).select(AT, "combined")


def across_runs(m: DataFrame, sums=("n", "drawdown_periods")) -> DataFrame:
    """Averages of all metrics over runs; counts are summed."""
    nums = [c for c, t in m.dtypes if t in ("double", "bigint", "int") and c != RUN]
    return m.agg(*[(F.sum(c) if c in sums else F.avg(c)).alias(c) for c in nums], F.count(F.lit(1)).alias("runs"))
