"""Bars, ticks, trades and equity derived from the given tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import ntz_ms
from ..schema import BAR_COLUMNS, TIMEFRAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row in storage: `_file`, its file's number by name, and `_row`, its number there."""
    rows = table(spark, sf_dir, name)
    found = rows.withColumns({"_path": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = sorted(rows.inputFiles())
    if len(files) < 2:
        return found.drop("_path").withColumn("_file", F.lit(0))
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "_path string, _file int")
    return found.join(F.broadcast(numbers), "_path", "left").drop("_path")


def as_bars(rows: DataFrame, tf: str, order: list[str], place: tuple[str, ...] = ()) -> DataFrame:
    """Rows (symbol, ms, price, qty, value, order columns) as finished bars of a timeframe, buckets from the epoch.

    As in the SQL, a price that is null neither opens nor closes a bar, null orders come last, and times are cut toward the
    epoch. place: numbers that tell which of the rows with one order is the first; this one counts, for open and close."""
    size, last = TIMEFRAMES[tf], [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    first, final = (F.when(F.col("price").isNotNull(), F.struct(*last, *p)) for p in (place, [-F.col(c) for c in place]))
    bars = rows.groupBy("symbol", (F.col("ms") - F.col("ms") % size).alias("start_time")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", final).alias("close"), F.sum("qty").alias("volume"), F.sum("value").alias("amount")
    )
    const = {"market": "test", "quote_currency": "USDT", "ins_type": 1, "asset_type": "crypto", "timeframe": tf, "is_finished": True, "is_filled": False}
    bars = bars.withColumns({k: F.lit(v) for k, v in const.items()}).withColumn("end_time", F.col("start_time") + size).withColumn("current_time", F.col("start_time") + size)
    return bars.select(*BAR_COLUMNS)


def _sales(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.withColumns({"ms": ntz_ms("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity")})


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity"]


def bars(spark: SparkSession, sf_dir: str, tf: str = "1W") -> DataFrame:
    """Bars of each brand from lineitem and part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = _sales(spark, sf_dir).join(part, "l_partkey").withColumns({"qty": F.col("l_quantity"), "value": F.col("l_extendedprice")})
    return as_bars(rows, tf, ORDER)


def supplier_bars(spark: SparkSession, sf_dir: str, tf: str = "1W") -> DataFrame:
    rows = _sales(spark, sf_dir).withColumns({"symbol": F.col("l_suppkey").cast("string"), "qty": F.col("l_quantity"), "value": F.col("l_extendedprice")})
    return as_bars(rows, tf, ORDER)


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1H") -> DataFrame:
    ev = stored(spark, sf_dir, "events")
    rows = ev.select(F.col("event_type").alias("symbol"), ntz_ms("ts").alias("ms"), (F.col("value") + 1).alias("price"), F.lit(1.0).alias("qty"), (F.col("value") + 1).alias("value"), "ts", "event_id", "_file", "_row")
    return as_bars(rows, tf, ["ts", "event_id"], ("_file", "_row"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("trade_id"), ntz_ms("o_orderdate").alias("time"), F.when(F.col("o_custkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        F.col("o_totalprice").alias("entry_amount"), ((F.col("o_totalprice") - 250000) / 1000).alias("pnl"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, time, equity) by day: 100000 and the running sum of the day's profits."""
    from pyspark.sql import Window

    day = trades(spark, sf_dir).groupBy("run_id", (F.floor(F.col("time") / 86_400_000) * 86_400_000).alias("time")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("run_id").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("run_id", "time", (F.lit(100000.0) + F.sum("pnl").over(w)).alias("equity"))


def equity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each run's equity, from the day before's to the day's: a series that walks."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("time")
    rows = equity(spark, sf_dir).withColumn("open", F.lag("equity", 1, 100000.0).over(w))
    bar = {"symbol": F.col("run_id"), "start_time": F.col("time"), "end_time": F.col("time") + 86_400_000, "current_time": F.col("time") + 86_400_000, "high": F.greatest("open", "equity"), "low": F.least("open", "equity"), "close": F.col("equity"), "volume": F.lit(0.0), "amount": F.lit(0.0)}
    const = {"market": "test", "quote_currency": "USDT", "ins_type": 1, "asset_type": "crypto", "timeframe": "1D", "is_finished": True, "is_filled": False}
    return rows.withColumns(bar | {k: F.lit(v) for k, v in const.items()}).select(*BAR_COLUMNS)


def out(c: Column) -> Column:
    """As single precision, which hides what the order of a sum adds, without a negative zero."""
    return (c + F.lit(0.0)).cast("float")
