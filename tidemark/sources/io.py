"""Reading and writing bar tables, and raw candles of exchanges."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import tf_ms
from ..schema import BAR_COLUMNS, KEY, TIME


def read_bars(bars: DataFrame, keys: DataFrame | None = None, start=None, end=None, limit: int | None = None, ordered: bool = False, **equal) -> DataFrame:
    """Stored bars by equality on key columns (or a table of keys) and an inclusive range of start times. end_time is
    start_time plus the timeframe; null volume and amount are zero; rows are finished. Filters reach the scan. Rows ascend
    within each partition; over all of them where `ordered` is set, which sorts the whole table, or a limit is."""
    for name, value in equal.items():
        bars = bars.filter(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    if start is not None:
        bars = bars.filter(F.col(TIME) >= start)
    if end is not None:
        bars = bars.filter(F.col(TIME) <= end)
    if keys is not None:
        bars = bars.join(keys.distinct(), keys.columns, "left_semi")
    bars = bars.withColumns({"end_time": F.col(TIME) + tf_ms("timeframe"), "volume": F.coalesce("volume", F.lit(0.0)), "amount": F.coalesce("amount", F.lit(0.0)), "is_finished": F.lit(True)})
    if limit is not None:
        return bars.orderBy(TIME, *KEY).limit(limit)
    return bars.orderBy(*KEY, TIME) if ordered else bars.sortWithinPartitions(*KEY, TIME)


def default_range(now: Column | None = None) -> tuple[Column, Column]:
    """One calendar month up to now, in milliseconds."""
    now = F.current_timestamp() if now is None else now
    return F.unix_millis(F.expr("current_timestamp() - interval 1 month") if now is None else now - F.expr("interval 1 month")), F.unix_millis(now)


def dedup_bars(bars: DataFrame, version: str) -> DataFrame:
    """Of rows with the same key and start time, the one written last. One aggregation, combined before its shuffle."""
    rest = [c for c in bars.columns if c not in [*KEY, TIME]]
    return bars.groupBy(*KEY, TIME).agg(F.max_by(F.struct(*rest), version).alias("_row")).select(*KEY, TIME, "_row.*").select(*bars.columns)


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by timeframe and month, sorted within files by key and time."""
    rows = bars.withColumn("yyyymm", F.date_format(F.timestamp_millis(TIME), "yyyyMM"))
    rows.repartition("timeframe", "yyyymm", *KEY[:3]).sortWithinPartitions("timeframe", "yyyymm", *KEY, TIME).write.mode(mode).partitionBy("timeframe", "yyyymm").parquet(path)


def catalog(bars: DataFrame) -> DataFrame:
    """Distinct markets, symbols, timeframes, quotes and instrument types, sorted, in one pass."""
    return bars.agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in KEY])


def expand_keys(spark: SparkSession, symbols, quotes, ins_types, timeframes) -> DataFrame:
    """All combinations of the given short lists."""
    one = spark.range(1)
    for name, values in (("symbol", symbols), ("quote_currency", quotes), ("ins_type", ins_types), ("timeframe", timeframes)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.drop("id")


def slice_range(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.filter((F.col(TIME) >= start) & (F.col("end_time") <= end))


#: The exchange's channel names.
OKX_CHANNELS = {"candle1s": "1s", "candle1m": "1m", "candle3m": "3m", "candle5m": "5m", "candle15m": "15m", "candle30m": "30m", "candle1H": "1H", "candle4H": "4H", "candle6Hutc": "6H", "candle12Hutc": "12H", "candle1Dutc": "1D"}
#: Quote currencies, longest first where one ends another.
QUOTES = ("USDT", "USDC", "BUSD", "FDUSD", "TUSD", "USD", "BTC", "ETH", "BNB")


def _finish(rows: DataFrame, market: str) -> DataFrame:
    size = tf_ms("timeframe")
    rows = rows.withColumns({"market": F.lit(market), "asset_type": F.lit("crypto"), "end_time": F.col(TIME) + size, "current_time": F.coalesce("current_time", F.col(TIME) + size), "is_filled": F.lit(False)})
    return rows.select(*BAR_COLUMNS)


def parse_okx(raw: DataFrame, body: str = "value") -> DataFrame:
    """Candle messages {arg: {channel, instId}, data: [[ts, o, h, l, c, vol, _, amount, finished], ...]}; rows of fewer than
    nine fields are dropped, as is what isn't a candle."""
    shape = "arg struct<channel: string, instId: string>, data array<array<string>>"
    m = raw.select(F.from_json(body, shape).alias("m")).select("m.arg.*", F.explode("m.data").alias("d")).filter(F.size("d") >= 9)
    channels = F.create_map(*[F.lit(v) for kv in OKX_CHANNELS.items() for v in kv])
    name = F.split("instId", "-")
    num = lambda k: F.col("d")[k].try_cast("double")
    rows = m.select(
        F.get(name, F.lit(0)).alias("symbol"), F.get(name, F.lit(1)).alias("quote_currency"), F.when(F.get(name, F.lit(2)) == "SWAP", 3).when(F.size(name) > 2, 4).otherwise(1).alias("ins_type"),
        F.try_element_at(channels, F.col("channel")).alias("timeframe"), F.col("d")[0].try_cast("long").alias(TIME), num(1).alias("open"), num(2).alias("high"), num(3).alias("low"), num(4).alias("close"),
        num(5).alias("volume"), num(7).alias("amount"), (F.col("d")[8] == "1").alias("is_finished"), F.lit(None).cast("long").alias("current_time"),
    )
    return _finish(rows.filter(F.col("timeframe").isNotNull()), "okx")


def parse_binance(raw: DataFrame, body: str = "value", ins_type: int = 1) -> DataFrame:
    """Kline messages {E, s, k: {t, T, i, o, h, l, c, v, q, x}}; the quote currency is the first known suffix of the name."""
    k = raw.select(F.from_json(body, "E long, s string, k struct<t: long, i: string, o: string, h: string, l: string, c: string, v: string, q: string, x: boolean>").alias("m")).select(F.col("m.E").alias("sent"), "m.s", F.col("m.k").alias("k")).filter("k is not null")
    suffix = F.regexp_extract("s", f"^(.+?)({'|'.join(QUOTES)})$", 2)
    hours = F.regexp_replace(F.regexp_replace(F.regexp_replace("k.i", "h$", "H"), "d$", "D"), "w$", "W")
    rows = k.select(
        F.regexp_extract("s", f"^(.+?)({'|'.join(QUOTES)})$", 1).alias("symbol"), suffix.alias("quote_currency"), F.lit(ins_type).alias("ins_type"), hours.alias("timeframe"), F.col("k")["t"].alias(TIME),
        *[F.col("k")[a].try_cast("double").alias(b) for a, b in zip("ohlcvq", ("open", "high", "low", "close", "volume", "amount"))], F.col("k")["x"].alias("is_finished"), F.col("sent").alias("current_time"),
    )
    return _finish(rows.filter("quote_currency != ''"), "binance")


def parse_gate(raw: DataFrame, body: str = "value", ins_type: int = 1) -> DataFrame:
    """Candles as objects {t, o, h, l, c, v, a, n: tf_BASE_QUOTE, w} or arrays [t, amount, c, h, l, o, v, finished] with a
    name beside them; seconds become milliseconds."""
    obj = F.from_json(body, "t string, o string, h string, l string, c string, v string, a string, n string, w boolean")
    arr = F.from_json(body, "array<string>")
    rows = raw.select(obj.alias("o"), F.when(F.trim(body).startswith("["), arr).alias("a"), *([F.col("name")] if "name" in raw.columns else [F.lit(None).cast("string").alias("name")]))
    pick = lambda key, k: F.coalesce(F.col("o")[key], F.get("a", F.lit(k)))
    name = F.split(F.coalesce("o.n", "name"), "_")
    tf = F.regexp_replace(F.regexp_replace(F.get(name, F.lit(0)), "h$", "H"), "d$", "D")
    rows = rows.select(
        F.get(name, F.lit(1)).alias("symbol"), F.get(name, F.lit(2)).alias("quote_currency"), F.lit(ins_type).alias("ins_type"), tf.alias("timeframe"), (pick("t", 0).try_cast("long") * 1000).alias(TIME),
        pick("o", 5).try_cast("double").alias("open"), pick("h", 3).try_cast("double").alias("high"), pick("l", 4).try_cast("double").alias("low"), pick("c", 2).try_cast("double").alias("close"),
        pick("v", 6).try_cast("double").alias("volume"), pick("a", 1).try_cast("double").alias("amount"), F.coalesce("o.w", F.get("a", F.lit(7)) == "true", F.lit(False)).alias("is_finished"), F.lit(None).cast("long").alias("current_time"),
    )
    return _finish(rows.filter(F.col(TIME).isNotNull()), "gate")


def clean_features(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Features as single precision, label as int; rows with a null, NaN or infinity go."""
    cols = {c: F.when(~(F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf"))), F.col(c).cast("float")) for c in features}
    return df.withColumns(cols | {label: F.col(label).cast("int")}).dropna(subset=[*features, label])


def write_features(df: DataFrame, path: str, fmt: str = "csv") -> None:
    (df.write.mode("overwrite").option("header", True).csv(path) if fmt == "csv" else df.write.mode("overwrite").parquet(path))


def read_features(spark: SparkSession, path: str, schema: str, features: list[str], label: str) -> DataFrame:
    return clean_features(spark.read.schema(schema).option("header", True).csv(path), features, label)


def latest_version(rows: DataFrame, version: str) -> DataFrame:
    """As dedup_bars, by a window: where whole rows are too wide for an aggregation's buffer."""
    w = Window.partitionBy(*KEY, TIME).orderBy(F.desc(version))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
