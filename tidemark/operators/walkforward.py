"""Walk-forward windows, parameter grids, selection."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TIME

DAY = 86_400_000


def windows(spark: SparkSession, start: int, end: int, train: int, test: int, embargo: int = 0, expanding: bool = False) -> DataFrame:
    """(window, train_start, train_end, test_start, test_end) in milliseconds: training days, embargo days, test days; each
    window begins a test length after the last. Expanding windows keep the first start."""
    step, head = test * DAY, (train + embargo) * DAY
    n = max(0, (end - start - head) // step)
    w = spark.range(n).withColumnRenamed("id", "window")
    first = F.lit(start) if expanding else F.lit(start) + F.col("window") * step
    test_start = F.lit(start + head) + F.col("window") * step
    return w.select("window", first.cast("long").alias("train_start"), (test_start - embargo * DAY).alias("train_end"), test_start.alias("test_start"), (test_start + step).alias("test_end"))


def folds(w: DataFrame, n: int) -> DataFrame:
    """Equal time slices of each window's training range."""
    size = F.floor((F.col("train_end") - F.col("train_start")) / n)
    f = w.select("window", "train_start", "train_end", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    return f.select("window", "fold", (F.col("train_start") + F.col("fold") * size).alias("fold_start"), F.when(F.col("fold") == n - 1, F.col("train_end")).otherwise(F.col("train_start") + (F.col("fold") + 1) * size).alias("fold_end"))


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """One row for each combination of parameters; empty lists are skipped."""
    df = spark.range(1).select(F.lit(0).alias("_"))
    for name, values in space.items():
        if values:
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    names = [k for k, v in space.items() if v]
    return df.select(F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in names]).alias("params"), *names)


def assign(bars: DataFrame, w: DataFrame, start: str = "test_start", end: str = "test_end") -> DataFrame:
    """Bars with each window that holds them; a bar belongs to several. Both sides meet by days, so that neither has to be
    small, and a bar only meets the windows of its day."""
    days = F.sequence(F.floor(F.col(start) / DAY), F.floor((F.col(end) - 1) / DAY))
    by_day = w.filter(F.col(start) < F.col(end)).withColumn("_day", F.explode(days))
    inside = (F.col(TIME) >= F.col(start)) & (F.col(TIME) < F.col(end))
    return bars.withColumn("_day", F.floor(F.col(TIME) / DAY)).join(by_day, "_day").filter(inside).drop("_day")


def best(scores: DataFrame) -> DataFrame:
    """Per window the parameters with the best mean score, then the least mean drawdown, then the most trades."""
    m = scores.groupBy("window", "params").agg(F.avg("score").alias("score"), F.avg(F.abs("drawdown")).alias("drawdown"), F.avg("trades").alias("trades"))
    return m.groupBy("window").agg(F.max_by("params", F.struct("score", -F.col("drawdown"), "trades", "params")).alias("params"), F.max("score").alias("score"))


def overfit(train: DataFrame, test: DataFrame) -> DataFrame:
    """Decay of the Sharpe ratio from training to test, flagged over one half."""
    j = train.select("window", F.col("sharpe").alias("train_sharpe")).join(test.select("window", F.col("sharpe").alias("test_sharpe")), "window")
    decay = F.when(F.col("train_sharpe") > 0, 1 - F.col("test_sharpe") / F.col("train_sharpe"))
    return j.withColumn("decay", decay).withColumn("overfit", F.col("decay") > 0.5)


def parameter_stability(best_of: DataFrame, params: list[str]) -> DataFrame:
    """(parameter, windows, values, stability) over the windows' chosen parameters, a column each: `stable` with one value,
    `moderate` with at most half as many values as windows, else `unstable`. Null is no value; fewer than two windows give
    no rows."""
    long = best_of.select(F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("value")) for c in params])).alias("x")).select("x.*")
    g = long.groupBy("parameter").agg(F.count(F.lit(1)).alias("all"), F.count("value").alias("windows"), F.countDistinct("value").alias("values")).filter("all > 1 and windows > 0").drop("all")
    return g.withColumn("stability", F.when(F.col("values") == 1, "stable").when(F.col("values") <= F.col("windows") / 2, "moderate").otherwise("unstable"))
