"""Scoring factors and models."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ops
from ..functions.ops import S, U, W
from ..schema import KEY, TIME
from .labels import future_return


def with_future(df: DataFrame, n: int = 1) -> DataFrame:
    """With future_return; the last n rows of a series have none and are left out."""
    return df.withColumn("future_return", future_return(n)).filter(F.col("future_return").isNotNull())


def _ranked(df: DataFrame, factor: str) -> DataFrame:
    ok = F.col(factor).isNotNull() & F.col("future_return").isNotNull()
    df = df.withColumns({"_x": F.when(ok, F.col(factor)), "_y": F.when(ok, F.col("future_return"))})
    return df.withColumns({"_rx": ops.rank("_x"), "_ry": ops.rank("_y")})


def spearman(df: DataFrame, factor: str) -> DataFrame:
    """Rank correlation of factor and future return over each series, on rows that have both."""
    r = _ranked(df, factor).groupBy(*KEY).agg(F.count("_x").alias("n"), F.covar_samp("_rx", "_ry").alias("_c"), F.stddev_samp("_rx").alias("_a"), F.stddev_samp("_ry").alias("_b"))
    return r.select(*KEY, "n", F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")).alias("ic"))


def rolling_ic(df: DataFrame, factor: str, window: int | None = 60, least: int = 10) -> DataFrame:
    """IC at each time: ranks over the whole series, correlated over the window; None: over all rows so far."""
    w = U() if window is None else W(window)
    df = _ranked(df, factor)
    return df.select(*KEY, TIME, ops.corr("_rx", "_ry", 0, least=least, w=w).alias("ic")).filter("ic is not null")


def ic_summary(ic: DataFrame, by=KEY) -> DataFrame:
    s = ic.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.skewness("ic").alias("ic_skew"))
    return s.withColumn("ic_ir", F.try_divide(F.col("ic_mean"), F.col("ic_std")))


def quantile_returns(df: DataFrame, factor: str, n: int = 5) -> DataFrame:
    """Mean future return of each bucket between interpolated quantiles, right-closed, the lowest edge included; buckets
    with equal edges fall away. The edges are one aggregation, joined back on the same partitioning."""
    ok = df.filter(F.col(factor).isNotNull() & F.col("future_return").isNotNull())
    edges = ok.groupBy(*KEY).agg(F.array_distinct(F.percentile(factor, F.array(*[F.lit(k / n) for k in range(n + 1)]))).alias("_e"))
    rows = ok.select(*KEY, factor, "future_return").join(edges, KEY)
    bucket = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(factor))))
    return rows.groupBy(*KEY, bucket.alias("bucket")).agg(F.avg("future_return").alias("mean_return"), F.count(F.lit(1)).alias("n"))


def long_short(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy(*KEY).agg((F.max("mean_return") - F.min("mean_return")).alias("long_short"))


def correlation_matrix(df: DataFrame, factors: list[str]) -> DataFrame:
    """(f1, f2, corr) over rows that have both: all pairs in one aggregation."""
    cells = []
    for i, a in enumerate(factors):
        for b in factors[i:]:
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            cells.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("corr")))
    half = df.agg(F.array(*cells).alias("m")).select(F.explode("m").alias("c")).select("c.*")
    return half.unionByName(half.filter("f1 != f2").select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr"))


def diversity(matrix: DataFrame) -> float:
    """Entropy of the correlation matrix's eigenvalues as a share of its largest; the matrix is p x p for p factors."""
    m = matrix.toPandas().pivot(index="f1", columns="f2", values="corr").fillna(0.0).to_numpy()
    v = np.clip(np.linalg.eigvalsh((m + m.T) / 2), 0, None)
    p = v[v > 1e-12] / v.sum()
    return float(-(p * np.log(p)).sum() / np.log(len(v))) if len(v) > 1 else 0.0


def stability(df: DataFrame, factor: str, bins: int = 10) -> DataFrame:
    """Of each timeframe: 1 / (1 + mean divergence) between the rank histograms of consecutive times, and a turnover."""
    r = df.withColumn("_r", ops.rank(factor, "cross_section")).filter("_r is not null")
    h = r.groupBy("timeframe", TIME, F.least(F.floor(F.col("_r") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = h.select("timeframe", TIME).distinct().select("timeframe", TIME, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    d = grid.join(h, ["timeframe", TIME, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(Window.partitionBy("timeframe", TIME))
    d = d.withColumn("p", F.col("c") / total + 1e-10).withColumn("q", F.lag("p").over(Window.partitionBy("timeframe", "bin").orderBy(TIME)))
    kl = d.filter("q is not null").groupBy("timeframe", TIME).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))
    out = kl.groupBy("timeframe").agg((1 / (1 + F.avg("kl"))).alias("rre"))
    return out.withColumn("turnover", F.greatest(F.lit(0.0), 20 - 18 * F.col("rre")))


def self_stability(df: DataFrame, factor: str, lags=(1, 2, 3, 5)) -> DataFrame:
    """Of each series: mean of the absolute correlations of the factor with itself some rows before, between 0 and 1, and a
    turnover; lags need ten values more than they reach back, a series of fewer than ten has 0 for both."""
    df = df.filter(F.col(factor).isNotNull())
    df = df.withColumns({f"_l{k}": F.lag(factor, k).over(ops.series()) for k in lags})

    def one(k):
        x = F.when(F.col(f"_l{k}").isNotNull(), F.col(factor))
        r = F.try_divide(F.covar_samp(x, f"_l{k}"), F.stddev_samp(x) * F.stddev_samp(f"_l{k}"))
        return F.when(F.count(F.lit(1)) > k + 10, F.abs(r))

    g = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.array_compact(F.array(*[one(k) for k in lags])).alias("_r"))
    mean = F.coalesce(F.aggregate("_r", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("_r"), F.lit(0)), F.lit(0.0))
    few = F.col("n") < 10
    g = g.withColumn("rre", F.when(few, F.lit(0.0)).otherwise(F.least(mean, F.lit(1.0))))
    return g.withColumn("turnover", F.when(few, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 20 - 18 * F.col("rre")))).drop("_r")


def merge_matrices(matrices: DataFrame) -> DataFrame:
    """Mean of each cell (f1, f2, corr) over the matrices that have it."""
    return matrices.groupBy("f1", "f2").agg(F.avg("corr").alias("corr"))


def report_summary(reports: DataFrame) -> DataFrame:
    """One row over factors' reports (ic_mean, ic_ir, win_rate, rre, robustness): their means, missing ones left out, and
    the number of reports; zeros without any."""
    zero = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
    return reports.agg(*[zero(c).alias(c) for c in ("ic_mean", "ic_ir", "win_rate", "rre", "robustness")], F.count(F.lit(1)).alias("factors"))


def robustness(df: DataFrame, factor: str, level: float = 0.05, trials: int = 5, seed: int = 42) -> DataFrame:
    """Least of the mean rank correlations between the factor and itself with Gaussian and with t(3) noise; 1 for
    fewer than ten values."""
    std = F.stddev_samp(factor).over(S())
    z = lambda k: F.randn(seed + k)
    cols = {}
    for k in range(trials):
        chi = sum((z(100 + 10 * k + i) * z(100 + 10 * k + i) for i in range(3)), F.lit(0.0))
        cols |= {f"_g{k}": F.col(factor) + level * std * z(k), f"_t{k}": F.col(factor) + level * std * z(50 + k) / F.sqrt(chi / 3)}
    df = df.filter(F.col(factor).isNotNull()).withColumns(cols)
    df = df.withColumn("_r", ops.rank(factor)).withColumns({f"{c}r": ops.rank(c) for c in cols})
    pair = lambda c: F.try_divide(F.covar_samp("_r", f"{c}r"), F.stddev_samp("_r") * F.stddev_samp(f"{c}r"))
    mean = lambda kind: sum((pair(f"_{kind}{k}") for k in range(trials)), F.lit(0.0)) / trials
    return df.groupBy(*KEY).agg(F.when(F.count(F.lit(1)) < 10, 1.0).otherwise(F.least(mean("g"), mean("t"))).alias("robustness"))


def merge_ic(ic: DataFrame) -> DataFrame:
    """Mean IC over series at each time, and its summary."""
    return ic_summary(ic.groupBy(TIME).agg(F.avg("ic").alias("ic")), by=[])


def report(df: DataFrame, factor: str, window: int | None = None) -> DataFrame:
    """Summary of IC, long-short return and IC over the whole of each series, for one factor."""
    df = with_future(df)
    return ic_summary(rolling_ic(df, factor, window)).join(long_short(quantile_returns(df, factor)), KEY).join(spearman(df, factor).select(*KEY, F.col("ic").alias("spearman")), KEY).withColumn("factor", F.lit(factor))


# Models ---------------------------------------------------------------------------------------------------------------


def split(df: DataFrame, ratio: float = 0.8, cols: list[str] | None = None) -> DataFrame:
    """Rows without nulls, marked train or val by time within each series at int(n * ratio); series with an empty side go."""
    df = df.dropna(subset=cols)
    k, n = F.row_number().over(ops.series()), F.count(F.lit(1)).over(S())
    df = df.withColumns({"_k": k, "_cut": F.floor(n * ratio), "_n": n})
    return df.filter((F.col("_cut") > 0) & (F.col("_cut") < F.col("_n"))).withColumn("split", F.when(F.col("_k") <= F.col("_cut"), "train").otherwise("val")).drop("_k", "_cut", "_n")


def split3(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Rows of each series by time as train, val or test: the test begins at int(n * train), and the last int(m * val) of
    the m rows before it are val."""
    k, n = F.row_number().over(ops.series()), F.count(F.lit(1)).over(S())
    m = F.floor(n * train)
    df = df.withColumns({"_k": k, "_m": m}).withColumn("_v", F.col("_m") - F.floor(F.col("_m") * val))
    return df.withColumn("split", F.when(F.col("_k") > F.col("_m"), "test").when(F.col("_k") > F.col("_v"), "val").otherwise("train")).drop("_k", "_m", "_v")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("weight", F.sum("_c").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_c")))
    return df.join(c.select(label, "weight"), label)


def sequences(df: DataFrame, features: list[str], label: str, n: int) -> DataFrame:
    """Features of the n rows before each row, and its label; the first n rows of a series have none."""
    return df.withColumn("sequence", F.collect_list(F.array(*[F.col(f).cast("float") for f in features])).over(ops.P(n))).filter(F.size("sequence") == n).select(*KEY, TIME, "sequence", label)


def confusion(df: DataFrame, y="y_true", p="y_pred") -> DataFrame:
    return df.groupBy(F.col(y).cast("int").alias("y_true"), F.col(p).cast("int").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; zero where nothing is divided."""
    c = confusion(df)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = c.select(F.explode(F.array(F.struct(F.col("y_true").alias("k"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("y_pred").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("r")).select("r.*")
    g = rows.groupBy(F.col("k").alias("label")).agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    g = g.withColumns({"precision": zero(F.col("tp"), F.col("predicted")), "recall": zero(F.col("tp"), F.col("support"))})
    return g.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "predicted")


def accuracy_and_means(report: DataFrame) -> DataFrame:
    """Support-weighted and plain means of the classes' scores; accuracy is the weighted recall."""
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return report.agg(w("recall").alias("accuracy"), *[w(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def auc(df: DataFrame, y="y_true", s="y_prob") -> DataFrame:
    """Area under the ROC curve by ranks, ties at their mean, exactly: counts per score, then running counts in two levels,
    so that no task holds all scores. Bands lie between about 500 quantiles, whatever the scale of the scores."""
    c = df.groupBy(F.col(s).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    edges = c.agg(F.percentile_approx("s", F.array(*[F.lit(k / 512) for k in range(1, 512)])).alias("_e"))
    c = c.filter("s is not null").crossJoin(edges).withColumn("b", F.size(F.filter("_e", lambda e: e <= F.col("s")))).drop("_e")
    bands = c.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("before", F.coalesce(F.sum("bn").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(bands.select("b", "before"), "b")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("rank", F.col("before") + within + (F.col("n") + 1) / 2)
    pos, all_ = F.sum("p"), F.sum("n")
    return c.agg(F.try_divide(F.sum(F.col("p") * F.col("rank")) - pos * (pos + 1) / 2, (pos * (all_ - pos)).cast("double")).alias("auc"))


def regression_scores(df: DataFrame, y="y_true", p="y_prob") -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.avg(F.when(F.abs(F.col(y)) > 1e-6, F.abs(e / F.col(y)))).alias("mape"))


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    """(bin, center, n) of equal bins from least to largest, the last closed, empty ones included."""
    r = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    lo, hi = (r.lo, r.hi) if r.lo is not None else (0.0, 0.0)
    size = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(x) - lo) / size), F.lit(bins - 1)).cast("int")
    c = df.filter(F.col(x).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(c, "bin", "left").select("bin", (lo + (F.col("bin") + 0.5) * (hi - lo) / bins).alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sample(df: DataFrame, n: int = 5000, seed: int = 42, order: str = "doc_id") -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n).orderBy(order)


def to_signal(p: Column, threshold: float = 0.6) -> Column:
    """(side, confidence) of a probability array, of two classes (down, up) or three (down, flat, up): the side whose
    probability is over the threshold, up before down, and with three classes the largest; NONE and null otherwise."""
    up, down, top = F.element_at(p, -1), p[0], F.array_max(p)
    two = F.size(p) == 2
    long, short = (up > threshold) & (two | (up == top)), (down > threshold) & (two | (down == top))
    ok = F.size(p).isin(2, 3)
    return F.struct(F.when(ok & long, "LONG").when(ok & short, "SHORT").otherwise("NONE").alias("side"), F.when(ok & long, up).when(ok & short, down).alias("confidence"))


def return_signal(r: Column, threshold: float = 0.01) -> Column:
    """(side, confidence) of a predicted return: beyond the threshold, as sure as it is large, 1 from twice the threshold on."""
    far = F.abs(r) > threshold
    return F.struct(F.when(far & (r > 0), "LONG").when(far, "SHORT").otherwise("NONE").alias("side"), F.when(far, F.least(F.abs(r) / (2 * threshold), F.lit(1.0))).alias("confidence"))
