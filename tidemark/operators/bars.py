"""Preparing bars: hygiene, gaps, merging."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ops
from ..functions.scalars import tf_ms
from ..schema import BAR_COLUMNS, KEY, TIME


def drop_stale(updates: DataFrame, *arrival: str) -> DataFrame:
    """Without updates of bars at or before the last finished bar that has arrived for the key. arrival: columns that updates
    are ordered by; one without an arrival comes last."""
    w = Window.partitionBy(*KEY).orderBy(*[F.col(c).asc_nulls_last() for c in arrival]).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("is_finished"), F.col(TIME))).over(w)
    return updates.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(TIME) > F.col("_seen"))).drop("_seen")


def finished(bars: DataFrame) -> DataFrame:
    return bars.filter("is_finished")


def latest_snapshot(updates: DataFrame) -> DataFrame:
    """Of each bar its latest update."""
    rest = [c for c in updates.columns if c not in [*KEY, TIME]]
    return updates.groupBy(*KEY, TIME).agg(F.max_by(F.struct(*rest), "current_time").alias("_r")).select(*KEY, TIME, "_r.*").select(*updates.columns)


def gaps(bars: DataFrame) -> DataFrame:
    """With the number of bars missing before each bar."""
    step = F.col(TIME) - ops.delay(TIME)
    return bars.withColumn("missing", F.coalesce(F.greatest(F.floor(step / tf_ms("timeframe")) - 1, F.lit(0)), F.lit(0)).cast("long"))


def fill_gaps(bars: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """With synthetic bars in the gaps. The first opens at the close before the gap, later ones at the middle of that bar;
    each closes at that middle, the last at the next open; high and low reach over that bar's; volume and amount are means
    of the last five real bars. Bars that a second source has are taken from it first, marked as filled."""
    if secondary is not None:
        have = _missing_slots(bars).select(*KEY, TIME)
        found = secondary.select(*BAR_COLUMNS).withColumn("is_filled", F.lit(True)).join(have, [*KEY, TIME], "left_semi")
        bars = bars.select(*BAR_COLUMNS).unionByName(found.select(*BAR_COLUMNS))
    s = _missing_slots(bars)
    mid = (F.col("p.high") + F.col("p.low")) / 2
    opened = F.when(F.col("i") == 1, F.col("p.close")).otherwise(mid)
    closed = F.when(F.col("i") == F.col("k"), F.col("next_open")).otherwise(mid)
    made = s.withColumns({"open": opened, "close": closed}).withColumns({
        "high": F.greatest("open", "close", "p.high"), "low": F.least("open", "close", "p.low"), "volume": F.col("v5"), "amount": F.col("a5"),
        "end_time": F.col(TIME) + F.col("size"), "current_time": F.col(TIME) + F.col("size"), "asset_type": F.col("p.asset_type"), "is_finished": F.lit(True), "is_filled": F.lit(True),
    })
    return bars.select(*BAR_COLUMNS).unionByName(made.select(*BAR_COLUMNS))


def _missing_slots(bars: DataFrame) -> DataFrame:
    w5 = ops.W(5)
    b = bars.withColumns({"next_time": ops.ahead(TIME), "next_open": ops.ahead("open"), "v5": F.avg("volume").over(w5), "a5": F.avg("amount").over(w5), "size": tf_ms("timeframe")})
    b = b.withColumn("k", (F.floor((F.col("next_time") - F.col(TIME)) / F.col("size")) - 1).cast("long")).filter("k > 0")
    b = b.select(*KEY, F.struct(TIME, "close", "high", "low", "asset_type").alias("p"), "next_open", "v5", "a5", "size", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("i"))
    return b.withColumn(TIME, F.col(f"p.{TIME}") + F.col("i") * F.col("size"))


def with_history(live: DataFrame, hist: DataFrame, n: int = 100) -> DataFrame:
    """Each key's last n bars of history before its first live bar, flagged, and the live bars."""
    first = live.groupBy(*KEY).agg(F.min(TIME).alias("_first"))
    back = Window.partitionBy(*KEY).orderBy(F.desc(TIME))
    old = hist.join(first, KEY).filter(F.col(TIME) < F.col("_first")).withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= n)
    return old.select(*live.columns).withColumn("history_data", F.lit(True)).unionByName(live.withColumn("history_data", F.lit(False)))


def throttle(updates: DataFrame, ratio: float = 0.001, seconds: float = 10.0) -> DataFrame:
    """Updates worth keeping: a key's first, finished ones, one that follows another bar's, and ones that come more than
    `seconds` after the last kept, or differ from its close by more than `ratio`."""

    def scan(rows: pa.Table) -> pa.Table:  # rows stay in Arrow: pandas would take NaN for null
        t = rows.select(["current_time", "start_time", "close", "is_finished"]).to_pandas().sort_values("current_time", kind="stable")
        keep, at, close, bar = np.zeros(len(t), bool), None, None, None
        for i, (now, start, c, done) in enumerate(zip(t["current_time"], t["start_time"], t["close"], t["is_finished"])):
            if at is None or done or start != bar or now - at > 1000 * seconds or (c and abs(1 - close / c) > ratio):
                keep[i], at, close, bar = True, now, c, start
        return rows.take(pa.array(t.index[keep]))

    return updates.groupBy(*KEY).applyInArrow(scan, updates.schema)


def merge_bars(bars: DataFrame, n: int) -> DataFrame:
    """Bars of n times the timeframe, aligned to the epoch; a bucket with fewer than n finished bars is unfinished, and a
    series' first bucket is dropped if it doesn't begin with its first bar."""
    size = tf_ms("timeframe")
    b = bars.withColumns({"_size": size * n}).withColumn("_bucket", F.floor(F.col(TIME) / F.col("_size")) * F.col("_size"))
    g = b.groupBy(*KEY, "_bucket", "_size", "asset_type").agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
        F.min(TIME).alias("_first"), F.max("current_time").alias("current_time"), F.count_if("is_finished").alias("_n"), F.max("is_filled").alias("is_filled"),
    )
    lead = F.min("_bucket").over(ops.S())
    g = g.withColumn("_lead", lead).filter((F.col("_bucket") > F.col("_lead")) | (F.col("_first") == F.col("_bucket")))
    from ..functions.scalars import tf_from_ms

    return g.withColumns({TIME: F.col("_bucket"), "end_time": F.col("_bucket") + F.col("_size"), "is_finished": F.col("_n") >= n, "timeframe": tf_from_ms("_size")}).select(*BAR_COLUMNS)


def merge_bars_running(bars: DataFrame, n: int) -> DataFrame:
    """For each bar, the larger bar as it stands then: m_open, m_high, m_low, m_close, m_volume, m_amount, m_count."""
    size = tf_ms("timeframe") * n
    b = bars.withColumn("_bucket", F.floor(F.col(TIME) / size) * size)
    w = Window.partitionBy(*KEY, "_bucket").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumns({
        "m_open": F.first("open").over(w), "m_high": F.max("high").over(w), "m_low": F.min("low").over(w), "m_close": F.col("close"), "m_volume": F.sum("volume").over(w), "m_amount": F.sum("amount").over(w), "m_count": F.count(F.lit(1)).over(w),
    }).withColumnRenamed("_bucket", "m_start")


def ffill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.last(c, True).over(ops.U()), F.lit(0.0)) for c in cols})


def with_vwap(df: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Amount by volume, or the mean of high, low and close where there is none."""
    plain = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", F.when((F.col("volume") > 0) & F.col("amount").isNotNull(), F.col("amount") / (F.col("volume") + eps)).otherwise(plain))


def with_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.coalesce("amount", F.col("close") * F.col("volume")) if "amount" in df.columns else F.col("close") * F.col("volume"))
