"""Time-series operators over bars, as window expressions on one partitioning (key) and order (time).

Undefined is null: a rolling value needs n values that aren't null (the guard), as the first rows of a series have fewer.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import KEY, TIME


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def series(key=KEY, time=TIME):
    """A series in its order; a row without a time comes last, as in SQL."""
    return Window.partitionBy(*key).orderBy(col(time).asc_nulls_last())


def W(n: int, key=KEY, time=TIME):
    """The last n rows, the current one included."""
    return series(key, time).rowsBetween(-(n - 1), 0)


def P(n: int, key=KEY, time=TIME):
    """The n rows before the current one."""
    return series(key, time).rowsBetween(-n, -1)


def N(n: int, key=KEY, time=TIME):
    """The n rows after the current one."""
    return series(key, time).rowsBetween(1, n)


def U(key=KEY, time=TIME):
    """All rows up to the current one."""
    return series(key, time).rowsBetween(Window.unboundedPreceding, 0)


def S(key=KEY):
    """The whole series."""
    return Window.partitionBy(*key)


def clean(x) -> Column:
    """Null for NaN and infinities."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def guard(value: Column, x, n: int, w) -> Column:
    return F.when(F.count(col(x)).over(w) >= n, value)


def delay(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def ahead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(series())


def delta(x, n: int = 1) -> Column:
    return col(x) - delay(x, n)


def returns(x="close") -> Column:
    return F.try_divide(delta(x), delay(x))


def _rolling(f):
    def op(x, n: int, least: int | None = None) -> Column:
        return guard(f(col(x)).over(W(n)), x, n if least is None else least, W(n))

    return op


ts_sum, mean, ts_min, ts_max, prod = (_rolling(f) for f in (F.sum, F.avg, F.min, F.max, F.product))
_std, std_pop = _rolling(F.stddev_samp), _rolling(F.stddev_pop)


def std(x, n: int, least: int | None = None) -> Column:
    """Sample deviation; exactly zero on a constant window."""
    return F.when(F.max(col(x)).over(W(n)) == F.min(col(x)).over(W(n)), guard(F.lit(0.0), x, max(2, n if least is None else least), W(n))).otherwise(_std(x, n, least))


def _jointly(x, y):
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def cov(x, y, n: int) -> Column:
    x, y = _jointly(x, y)
    return guard(F.covar_samp(x, y).over(W(n)), x, n, W(n))


def corr(x, y, n: int, least: int | None = None, w=None) -> Column:
    """Over pairs without a null; null where one side is constant."""
    x, y = _jointly(x, y)
    w = w or W(n)
    flat = (F.max(x).over(w) == F.min(x).over(w)) | (F.max(y).over(w) == F.min(y).over(w))
    return guard(F.when(~flat, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))), x, n if least is None else least, w)


def rank(x, scope: str = "series") -> Column:
    """Share of the ranks, ties at their mean; nulls stay null. scope: 'series' (the whole series, which looks ahead) or
    'cross_section' (the rows of one timeframe and time)."""
    c = col(x)
    by = KEY if scope == "series" else ["timeframe", TIME]
    order = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    return F.when(c.isNotNull(), (F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2) / F.count(c).over(Window.partitionBy(*by)))


def window_array(x, n: int) -> Column:
    """The window's values, oldest first; null unless it has n. Make it a column of its own where several operators use it."""
    return guard(F.collect_list(col(x)).over(W(n)), x, n, W(n))


def ts_rank(arr: Column) -> Column:
    """Rank share of the newest value in its window array."""
    new = F.element_at(arr, -1)
    return (F.size(F.filter(arr, lambda v: v < new)) + (F.size(F.filter(arr, lambda v: v == new)) + 1) / 2) / F.size(arr)


def bars_since_max(arr: Column) -> Column:
    """Bars since the first of the window's largest values."""
    return F.size(arr) - F.array_position(arr, F.array_max(arr))


def bars_since_min(arr: Column) -> Column:
    return F.size(arr) - F.array_position(arr, F.array_min(arr))


def weighted(x, weights: list[float]) -> Column:
    """Sum of lagged values by weights (newest first), null if any is."""
    out = None
    for k, w in enumerate(weights):
        term = (delay(x, k) if k else col(x)) * F.lit(float(w))
        out = term if out is None else out + term
    return out


def decay_linear(x, d: int) -> Column:
    total = d * (d + 1) / 2
    return weighted(x, [(d - k) / total for k in range(d)])


def wma(x, n: int) -> Column:
    w = [0.9**k for k in range(n)]
    return weighted(x, [v / sum(w) for v in w])


def count_if(cond: Column, n: int) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).over(W(n))


def sum_if(x, n: int, cond: Column) -> Column:
    return F.sum(F.when(cond, col(x)).otherwise(F.lit(0.0))).over(W(n))


def _on_time(y, n: int):
    y = col(y)
    t = F.row_number().over(series()).cast("double")
    return y, t


def slope(y, n: int, x=None) -> Column:
    """Slope on time, or on x; null where x is constant."""
    if x is None:
        y, x = _on_time(y, n)
    y, x = _jointly(y, x)
    return guard(F.try_divide(F.covar_samp(y, x).over(W(n)), F.var_samp(x).over(W(n))), y, n, W(n))


def residual(y, n: int, x=None) -> Column:
    """What the newest value is above its window's regression line."""
    s = slope(y, n, x)
    y, x = _on_time(y, n) if x is None else (col(y), col(x))
    return y - F.avg(y).over(W(n)) - s * (x - F.avg(x).over(W(n)))


def quantile(x, n: int, q: float) -> Column:
    return guard(F.percentile(col(x), F.lit(q)).over(W(n)), x, n, W(n))


def signed_power(x, p) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(float(p)))


def scale(x, a: float = 1.0, by=KEY) -> Column:
    return F.try_divide(F.lit(float(a)) * col(x), F.sum(F.abs(col(x))).over(Window.partitionBy(*by)))


def neutralize(x, group) -> Column:
    """Less the mean of its group at its time."""
    return col(x) - F.avg(col(x)).over(Window.partitionBy("timeframe", TIME, col(group)))


def by_key(df: DataFrame) -> DataFrame:
    """Dealt by key into as many partitions as shuffles have. The windows that follow need no other exchange; and as the work
    is in the windows, not in the bytes, partitions that look small shouldn't be merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def in_levels(df: DataFrame, *levels: dict[str, Column]) -> DataFrame:
    """Add columns level by level: windows on windowed columns go into a later level, so each level is one pass over the
    same partitioning and order."""
    for level in levels:
        df = df.withColumns(level)
    return df
