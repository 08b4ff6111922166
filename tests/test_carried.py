"""Indicators, positions and controls whose state outlives a batch, and what a long series takes."""
from pyspark.sql import functions as F

from tidemark.operators import factors as fa, scans, signals
from tidemark.operators.carried import scanned
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def everything(spark):
    rows = scans.recursive_indicators(fx.bars(spark, SF, "1W"))
    held = signals.hold_positions(signals.dmi_signals(rows))
    o = fx.table(spark, SF, "orders").select((F.col("o_custkey") % 3).alias("strategy"), F.col("o_orderkey").alias("time"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_totalprice") - 250000) / 2_500_000).alias("profit"))
    lots = o.filter("profit is not null").select(F.col("strategy").alias("position_id"), F.col("time").alias("seq"), F.lit(1).alias("side"), (F.col("time") % 2 == 0).alias("is_open"), F.abs("profit").alias("price"), (F.col("time") % 5 + 1.0).alias("size"))
    week = fx.bars(spark, SF, "1W")
    sets = [fa.alpha158(week, windows=(5, 20)).select("symbol", "start_time", *[f"{k}{n}" for n in (5, 20) for k in fa.ROLLING]), fa.lag_set(week, windows="0-9").select("symbol", "start_time", "CLOSE9", "VOLUME3")]
    frames = [*sets, held.select("symbol", "start_time", "position", *[c for group in scans.INDICATORS for c in group]), signals.profit_control(o, hours=1e-3), signals.virtual_profits(lots)]
    return [sorted(map(repr, f.collect())) for f in frames]


def test_states_outlive_batches(spark):
    want = everything(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert everything(spark) == want and all(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rolling_sets_without_bars_or_with_one(spark):
    week = fx.bars(spark, SF, "1W")
    assert fa.alpha158(week.limit(0)).count() == 0
    one = fa.alpha158(week.orderBy("start_time").limit(1)).first()
    assert one.MA5 is None and one.CNTP5 is None and one.KMID is not None


def test_only_what_is_asked_for_is_computed(spark):
    rows = scans.recursive_indicators(fx.bars(spark, SF, "1W"), ["adx", "llt9"])
    assert set(rows.columns) - set(fx.BAR_COLUMNS) == {"adx", "pdi", "mdi", "adxr", "llt9"}


def test_memory_of_a_long_series_stays(spark):
    class Watched:
        def __init__(self):
            self.inner = scans._Recursive([("ema9",), ("kama10",), ("adx", "pdi", "mdi", "adxr")])

        def feed(self, rows):
            mb = [int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("VmRSS")]
            return {"y": self.inner.feed(rows)["kama10"], "mb": mb * len(rows["close"])}

    bars = 400_000
    one = spark.range(bars).select(F.lit("a").alias("symbol"), F.col("id").alias("start_time"), *[(F.hash("id") % 100 + 200.0).alias(c) for c in ("high", "low", "close")])
    seen = scanned(one, "y double, mb long", Watched, ["high", "low", "close"], ["symbol"]).agg(F.min_by("mb", "start_time").alias("first"), F.max("mb").alias("most"), F.count("y").alias("n")).first()
    assert seen.n == bars - 10 and seen.most - seen.first < 60
