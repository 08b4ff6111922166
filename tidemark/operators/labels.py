"""Training labels from the bars that follow. Null where the horizon isn't complete, unless tail='zero'."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ops
from ..functions.ops import N, W, ahead, guard, mean, std


def future_return(n: int = 1, log: bool = False, x="close") -> Column:
    r = F.try_divide(ahead(x, n), F.col(x))
    return F.ln(r) if log else r - 1


def _tail(c: Column, tail: str) -> Column:
    return F.coalesce(c, F.lit(0)) if tail == "zero" else c


def direction(n: int = 1, threshold: float = 0.0, classes: int = 2, tail: str = "null") -> Column:
    r = future_return(n)
    if classes == 2:
        return _tail(F.when(r.isNotNull(), (r > threshold).cast("int")), tail)
    return _tail(F.when(r <= -threshold, 0).when(r <= threshold, 1).when(r.isNotNull(), 2), tail)


def ranked(df: DataFrame, n: int = 1, method: str = "percentile", scope: str = "series") -> DataFrame:
    df = df.withColumn("_f", future_return(n))
    r = ops.rank("_f", scope)
    return df.withColumn("label", r if method == "percentile" else r * F.count("_f").over(ops.S())).drop("_f")


def event(hold: int = 3, gain: float = 0.05, loss: float = 0.03, lows: bool = True, tail: str = "null") -> Column:
    """1 where the return after `hold` bars is over `gain` and no low on the way is `loss` below."""
    worst = F.try_divide(F.min("low" if lows else "close").over(N(hold)), F.col("close")) - 1
    r = future_return(hold)
    return _tail(F.when(r.isNotNull(), ((r > gain) & (worst > -loss)).cast("int")), tail)


def risk_adjusted(df: DataFrame, n: int = 5, rf: float = 0.0, method: str = "sharpe", vol: int = 20) -> DataFrame:
    df = df.withColumns({"_r": ops.returns(), "_f": future_return(n)})
    if method == "calmar":
        df = df.withColumn("_dd", 1 - F.col("close") / F.max("close").over(W(vol)))
        risk = guard(F.max("_dd").over(W(vol)), "close", vol, W(vol))
    else:
        risk = std("_r", vol)
    return df.withColumn("label", (F.col("_f") - (rf if method == "sharpe" else 0.0)) / (risk + 1e-8)).drop("_r", "_f", *(["_dd"] if method == "calmar" else []))


def reversal(df: DataFrame, n: int = 3, lookback: int = 20, threshold: float = 0.02, method: str = "classification") -> DataFrame:
    """How far the next bars turn against the deviation from the mean; as classes -1, 0, 1 beyond the threshold."""
    dev = F.try_divide(F.col("close") - mean("close", lookback), mean("close", lookback))
    df = df.withColumns({"_d": dev, "_f": future_return(n)}).withColumn("_s", -F.signum("_d") * F.col("_f"))
    value = F.col("_s") if method != "classification" else F.when(F.col("_s") > threshold, 1).when(F.col("_s") < -threshold, -1).when(F.col("_s").isNotNull(), 0)
    return df.withColumn("label", value).drop("_d", "_f", "_s")


def triple_barrier(df: DataFrame, hold: int = 10, profit: float = 0.02, stop: float = 0.01, side: str = "long", classes: int = 3, conservative: bool = True) -> DataFrame:
    """First barrier that the next `hold` bars touch: 2 profit, 1 neither, 0 stop. On the same bar the stop comes first if
    conservative. With two classes neither is decided by the last close. side 'short' mirrors; the horizon shortens at the
    end of a series, and its last bar has no label.

    side 'both': a side wins that reaches its profit before its stop; 2 if only the long one does, 0 if only the short one,
    else 1. With two classes, 1 for long and 0 for short: of two winners the earlier profit decides (long on the same bar),
    of none the last close, which has to be under the bar's for 0."""
    df = df.withColumn("_n", F.collect_list(F.struct("high", "low", "close")).over(N(hold)))
    first = lambda test: F.array_position(F.transform("_n", test), True)
    over = lambda by: first(lambda b: b["high"] >= F.col("close") * (1 + by))
    under = lambda by: first(lambda b: b["low"] <= F.col("close") * (1 - by))
    df = df.withColumns({"_lw": over(profit), "_ll": under(stop), "_sw": under(profit), "_sl": over(stop)})
    last = F.element_at("_n", -1)["close"]
    if side == "both":
        wins = {k: (F.col(f"_{k}w") > 0) & ((F.col(f"_{k}l") == 0) | (F.col(f"_{k}l") > F.col(f"_{k}w") if conservative else F.col(f"_{k}l") >= F.col(f"_{k}w"))) for k in "ls"}
        only_long, only_short = wins["l"] & ~wins["s"], wins["s"] & ~wins["l"]
        if classes == 2:
            label = F.when(only_long, 1).when(only_short, 0).when(wins["l"], (F.col("_lw") <= F.col("_sw")).cast("int")).otherwise((last >= F.col("close")).cast("int"))
        else:
            label = F.when(only_long, 2).when(only_short, 0).otherwise(1)
    else:
        win, lose = (F.col(f"_{side[0]}{x}") for x in "wl")
        none = F.when((win == 0) & (lose == 0), 1).when(lose == 0, 2).when(win == 0, 0)
        tie = F.when(win == lose, 0 if conservative else 2)
        label = F.coalesce(none, tie, F.when(win < lose, 2).otherwise(0))
        if classes == 2:
            rose = (last > F.col("close")) if side != "short" else (last < F.col("close"))
            label = F.when(label == 1, rose.cast("int")).otherwise((label == 2).cast("int"))
    return df.withColumn("label", F.when(F.size("_n") > 0, label)).drop("_n", "_lw", "_ll", "_sw", "_sl")


def fused(df: DataFrame, labels: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """The labels as columns, and their weighted sum as label; weights are equal by default."""
    weights = weights or dict.fromkeys(labels, 1 / len(labels))
    df = df.withColumns(labels)
    return df.withColumn("label", sum((F.col(k) * float(weights[k]) for k in labels), F.lit(0.0)))


def distribution(df: DataFrame, label: str = "label") -> DataFrame:
    from pyspark.sql import Window

    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
