"""Table jobs on hand-made rows, and batch against stream."""
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as prep, labels, performance, signals
from tidemark.schema import BAR_COLUMNS, BAR_SCHEMA, KEY
from tidemark.sources import io
from tidemark.streaming import bars as stream


def bar(t, o=1.0, h=2.0, lo=0.5, c=1.5, v=10.0, tf="1m", symbol="A", done=True):
    size = {"1m": 60_000, "1H": 3_600_000}[tf]
    return ("test", symbol, "USDT", 1, "crypto", tf, t, t + size, t + size, o, h, lo, c, v, v * c, done, False)


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR_SCHEMA)


def test_gap_of_two(spark):
    got = prep.fill_gaps(frame(spark, [bar(0, h=3.0, lo=1.0, c=2.5), bar(180_000, o=9.0)])).orderBy("start_time").collect()
    assert [r.start_time for r in got] == [0, 60_000, 120_000, 180_000]
    assert (got[1].open, got[1].close, got[1].high, got[1].low) == (2.5, 2.0, 3.0, 1.0) and (got[2].open, got[2].close, got[2].high) == (2.0, 9.0, 9.0)
    assert [r.is_filled for r in got] == [False, True, True, False]


def test_gaps_of_two_series_apart(spark):
    rows = [bar(0), bar(120_000), bar(0, tf="1H"), bar(3_600_000, tf="1H"), bar(60_000, symbol="B")]
    assert prep.fill_gaps(frame(spark, rows)).count() == 6


def test_second_source_comes_first(spark):
    base, second = frame(spark, [bar(0), bar(180_000)]), frame(spark, [bar(60_000, c=7.0), bar(600_000)])
    got = {r.start_time: r for r in prep.fill_gaps(base, second).collect()}
    assert sorted(got) == [0, 60_000, 120_000, 180_000] and got[60_000].close == 7.0 and got[60_000].is_filled


def test_merge_marks_unfinished(spark):
    got = prep.merge_bars(frame(spark, [bar(60_000 * k, c=float(k)) for k in range(1, 12)]), 5).orderBy("start_time").collect()
    assert [(r.start_time, r.timeframe, r.is_finished, r.close) for r in got] == [(300_000, "5m", True, 9.0), (600_000, "5m", False, 11.0)]


def test_write_and_read(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bars"
    io.write_bars(frame(spark, [bar(0), bar(60_000), bar(0, symbol="B")]), path)
    got = io.read_bars(spark.read.parquet(path), symbol="A", start=0, end=60_000)
    assert [(r.symbol, r.start_time) for r in got.collect()] == [("A", 0), ("A", 60_000)]


def test_raw_candles(spark):
    okx = '{"arg":{"channel":"candle1m","instId":"BTC-USDT-SWAP"},"data":[["60000","1","3","0.5","2","10","x","20","1"],["1","2"]]}'
    binance = '{"E":61000,"s":"ETHUSDT","k":{"t":60000,"T":119999,"i":"1m","o":"1","h":"3","l":"0.5","c":"2","v":"10","q":"20","x":true}}'
    gate = '{"t":"60","o":"1","h":"3","l":"0.5","c":"2","v":"10","a":"20","n":"1m_BTC_USDT","w":true}'
    for parse, text, symbol, kind in ((io.parse_okx, okx, "BTC", 3), (io.parse_binance, binance, "ETH", 1), (io.parse_gate, gate, "BTC", 1)):
        rows = parse(spark.createDataFrame([(text,), ("broken",), (None,)], "value string")).collect()
        assert [(r.symbol, r.quote_currency, r.ins_type, r.timeframe, r.start_time, r.end_time, r.open, r.high, r.low, r.close, r.volume, r.amount, r.is_finished) for r in rows] == [(symbol, "USDT", kind, "1m", 60_000, 120_000, 1.0, 3.0, 0.5, 2.0, 10.0, 20.0, True)]


def test_throttle(spark):
    rows = [bar(0, c=100.0, done=False), bar(0, c=100.01, done=False), bar(0, c=101.0, done=False), bar(0, c=101.0), bar(60_000, c=101.0, done=False)]
    df = frame(spark, [(*r[:8], 1000 * i, *r[9:]) for i, r in enumerate(rows)])
    assert [r.current_time for r in prep.throttle(df).orderBy("current_time").collect()] == [0, 2000, 3000, 4000]


def test_triple_barrier_ties(spark):
    rows = [bar(0, h=100.0, lo=100.0, c=100.0), bar(60_000, h=103.0, lo=98.0, c=100.0), bar(120_000, h=100.5, lo=99.5, c=100.2)]
    df = frame(spark, rows)
    label = lambda **k: [r.label for r in labels.triple_barrier(df, **k).orderBy("start_time").collect()]
    assert label() == [0, 1, None] and label(conservative=False) == [2, 1, None] and label(classes=2)[1] == 1


def test_late_order_states_are_dropped(spark):
    log = spark.createDataFrame([("p", "o", 1, 1.0, 10.0, 0.1, True, 1), ("p", "o", 2, 3.0, 33.0, 0.3, True, 1), ("p", "o", 3, 2.0, 21.0, 0.2, True, 1), ("p", "c", 4, 3.0, 36.0, 0.4, False, 1)], "position_id string, order_id string, arrival int, size double, amount double, fee double, is_open boolean, side int")
    p = signals.positions(log).first()
    assert (p.total_size, p.cost_price, p.close_price, p.is_closed) == (3.0, 11.0, 12.0, True) and p.pnl == pytest.approx(3.0) and p.fee == pytest.approx(0.7)


def test_positions_ignore_entries_while_holding(spark):
    df = frame(spark, [bar(60_000 * k) for k in range(6)])
    entry = F.element_at(F.array(*[F.lit(v) for v in (0, 1, -1, 0, -1, 0)]), (F.col("start_time") / 60_000 + 1).cast("int"))
    df = df.withColumns({"entry": entry, "exit_long": F.col("start_time") == 180_000, "exit_short": F.lit(False)})
    assert [r.position for r in signals.hold_positions(df).orderBy("start_time").collect()] == [0, 1, 1, 0, -1, -1]


def run_stream(spark, df, build):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.parquet(f"{path}/in")
    name = "s" + path[-6:].replace("-", "_").replace("_", "x")
    q = build(stream.read_stream(spark, f"{path}/in")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_merges_as_batch(spark):
    df = frame(spark, [bar(60_000 * k, c=float(k)) for k in range(40)])
    got = {r.start_time: (r.close, r.volume) for r in run_stream(spark, df, lambda s: stream.merged(s, "5 minutes", "1 minute")).collect()}
    want = {r.start_time: (r.close, r.volume) for r in prep.merge_bars(df, 5).collect()}
    assert len(got) >= 6 and all(want[k] == v for k, v in got.items())


def test_stream_drops_duplicates(spark):
    t = 1_700_000_000_000  # rows at the epoch itself lie at the first watermark
    df = frame(spark, [bar(t), bar(t), bar(t + 60_000), bar(t + 120_000, done=False)])
    assert run_stream(spark, df, stream.without_duplicates).count() == 2


def test_streamed_ema_is_the_batch_one(spark):
    from tidemark.operators import scans

    df = frame(spark, [bar(60_000 * k, c=float(k % 7)) for k in range(30)])
    got = {r.start_time: r.ema for r in run_stream(spark, df, stream.ema_state).collect()}
    want = {r.start_time: r.e for r in scans.scan(df, "e double", lambda t: {"e": scans.ema(t["close"].to_numpy(float), 9)}).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("kind", ["rsi", "atr"])
def test_streamed_indicators_are_the_batch_ones(spark, kind):
    from tidemark.operators import scans

    df = frame(spark, [bar(60_000 * k, c=float(k * k % 7)) for k in range(40)])
    got = {r.start_time: r[kind] for r in run_stream(spark, df, lambda s: stream.indicator_state(s, kind)).collect()}
    if kind == "rsi":
        want = scans.scan(df, "e double", lambda t: {"e": scans.wilder_rsi(t["close"].to_numpy(float), 14)})
    else:
        from tidemark.operators import indicators

        want = indicators.ranges(df).withColumn("e", F.col("atr"))
    for r in want.collect():
        assert got[r.start_time] == (None if r.e is None else pytest.approx(r.e)), r.start_time


def test_streamed_fill_and_throttle_are_the_batch_ones(spark):
    df = frame(spark, [bar(60_000 * k, c=float(k * k % 11 + 1)) for k in range(30) if k % 7 not in (2, 3, 5)])
    got = {(r.start_time, r.close, r.open, r.high, r.low, r.volume, r.is_filled) for r in run_stream(spark, df, stream.filled).collect()}
    want = {(r.start_time, r.close, r.open, r.high, r.low, r.volume, r.is_filled) for r in prep.fill_gaps(df).collect()}
    assert got == want and sum(x[-1] for x in got) > 5
    live = frame(spark, [bar(0, c=1.0, done=False), bar(0, c=1.0001, done=False), bar(0, c=1.1, done=False), bar(60_000, c=1.1, done=False), bar(60_000, c=1.1)])
    live = live.withColumn("current_time", F.monotonically_increasing_id())
    assert sorted(r.close for r in run_stream(spark, live, stream.throttled).collect()) == sorted(r.close for r in prep.throttle(live).collect())


@pytest.fixture
def tiny(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streams_lose_nothing_in_small_frames_and_shuffled_files(spark, tiny):
    from tidemark.operators import scans

    rows = [bar(60_000 * k, c=float(k * k % 7 + 1)) for k in range(60)]
    df = frame(spark, rows).orderBy(F.rand(3)).repartition(8)
    got = {r.start_time: r.ema for r in run_stream(spark, df, stream.ema_state).collect()}
    want = {r.start_time: r.e for r in scans.scan(frame(spark, rows), "e double", lambda t: {"e": scans.ema(t["close"].to_numpy(float), 9)}).collect()}
    assert len(got) == 60 and got == pytest.approx(want)
    assert run_stream(spark, df, stream.filled).count() == 60


def test_streamed_fill_of_a_long_gap(spark, tiny):
    df = frame(spark, [bar(0, c=2.0), bar(60_000, c=3.0), bar(60_000 * 5_002, c=4.0)])
    got = run_stream(spark, df, stream.filled)
    assert got.count() == 5_003 and got.filter("is_filled").count() == 5_000
    want = prep.fill_gaps(df)
    assert got.select("start_time", "open", "high", "low", "close", "volume").exceptAll(want.select("start_time", "open", "high", "low", "close", "volume")).isEmpty()


def test_idle_states_are_given_up(spark):
    df = frame(spark, [bar(60_000 * k, c=float(k)) for k in range(5)])
    assert run_stream(spark, df, lambda s: stream.indicator_state(s, "ema", idle=60_000)).count() == 5


@pytest.mark.parametrize("buffer", [3, 10, 50])
def test_stored_bars_are_found_past_gaps(spark, buffer):
    times = [*range(20), *range(100, 104)]
    df = frame(spark, [bar(60_000 * k, c=float(k)) for k in times])
    first = df.select(*KEY).distinct().withColumn("_first", F.lit(60_000 * 103))
    got = sorted(r.start_time // 60_000 for r in stream.last_stored(df, first, buffer).collect())
    assert got == times[:-1][-buffer:]
    assert stream.last_stored(df, first.limit(0), buffer).count() == 0


def test_dual_mode_is_the_batch_on_the_tail(spark):
    from tidemark.functions import ops

    df = frame(spark, [bar(60_000 * k, c=float(k * k % 11)) for k in range(30)])
    factor = lambda x: x.withColumn("m", ops.mean("close", 5))
    seen = []
    stream.dual_mode(lambda: df.filter("start_time < 1500000"), factor, lambda out, n: seen.extend(out.collect()), 10)(df.filter("start_time >= 1500000"), 0)
    want = {r.start_time: r.m for r in factor(df).collect()}
    assert len(seen) == 5 and all(r.m == pytest.approx(want[r.start_time]) for r in seen)


def test_columns(spark):
    assert frame(spark, []).columns == BAR_COLUMNS


def test_newest_openings_close_first(spark):
    rows = [("p", 1, 1, True, 10.0, 2.0), ("p", 2, 1, True, 20.0, 1.0), ("p", 3, 1, False, 30.0, 2.0), ("p", 4, 1, False, 40.0, 5.0)]
    got = signals.virtual_profits(spark.createDataFrame(rows, "position_id string, seq int, side int, is_open boolean, price double, size double")).orderBy("seq").collect()
    # first all of the second opening at 30, and one of the first; then the other at 40, at their mean closing price 35
    assert [r.virtual_pnl for r in got] == pytest.approx([10 + 20, 35 - 10])


def test_profit_control_pauses_and_resumes(spark):
    h = 3_600_000
    rows = [("s", 0, None), ("s", 1, -0.01), ("s", 2, -0.01), ("s", 3, None), ("s", 4, -0.01), ("s", 5, None), ("s", 6, 0.01), ("s", 7, None), ("s", 8, 0.01), ("s", 9, None), ("s", 10, -0.2), ("s", 11, None), ("s", 10 + 24 * h, None), ("s", 11 + 24 * h, None)]
    got = signals.profit_control(spark.createDataFrame(rows, "strategy string, time long, profit double")).orderBy("time").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, False, True, True]


def test_trees_learn_and_are_kept(spark):
    from tidemark.operators import models

    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("label", (F.col("a") > 3).cast("double"))
    model = models.train(df, ["a", "b"], rounds=3)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/model"
    models.save(model, path)
    got = models.predict(models.load(path), df.withColumn("a", F.when(F.col("id") > 0, F.col("a"))))
    assert got.count() == 399 and got.filter("y_pred != label").count() == 0 and got.filter("(y_prob > 0.5) != (label = 1)").count() == 0
    assert models.importances(model, ["a", "b"])[0][0] == "a" and models.compare({"m": model}, df).first().accuracy == 1.0
    three = models.train_forest(df.withColumn("label", F.col("b")), ["a", "b"], trees=5)
    assert len(models.predict(three, df).first().y_prob) == 3
    line = models.train(df.withColumn("label", F.col("a")), ["a", "b"], task="regression", rounds=3)
    assert models.predict(line, df).filter("abs(y_pred - a) > 1").count() == 0


def test_regression_on_a_benchmark(spark):
    rows = [("r", 0.01 * k + 0.02 * (k % 2), 0.01 * k) for k in range(10)] + [("flat", 0.01 * (k % 3), 0.0) for k in range(9)] + [("one", 0.1, 0.2)]
    got = {r.run_id: r for r in performance.regression(spark.createDataFrame(rows, "run_id string, ret double, bench double")).collect()}
    x, y = np.array([0.01 * k for k in range(10)]), np.array([0.01 * k + 0.02 * (k % 2) for k in range(10)])
    slope, cut = np.polyfit(x, y, 1)
    assert got["r"].beta == pytest.approx(slope) and got["r"].alpha == pytest.approx(cut) and 0 < got["r"].alpha_pvalue < 1 and got["r"].alpha_pvalue_ols > 0.05
    assert (got["flat"].beta, got["flat"].r_squared) == (0, 0) and got["flat"].alpha == pytest.approx(0.01) and got["flat"].alpha_pvalue < 0.05
    assert (got["one"].alpha, got["one"].beta, got["one"].alpha_pvalue) == (0, 0, 1)


@pytest.mark.parametrize("expanding", [True, False])
def test_dmom_is_a_fit_for_each_bar(spark, expanding):
    from tidemark.operators import factors

    rng = np.random.default_rng(3)
    close = 100 + np.round(rng.normal(size=70), 1).cumsum()
    df = frame(spark, [bar(60_000 * k, c=float(c)) for k, c in enumerate(close)])
    got = factors.dmom(df, train=40, vol=10, most=5, expanding=expanding).orderBy("start_time").collect()
    r = np.r_[np.nan, np.diff(close) / close[:-1]]
    vol = np.array([np.nanstd(r[i - 9 : i + 1]) if i >= 9 else np.nan for i in range(70)])
    up, down, runs = 0, 0, [(np.nan, np.nan)]
    for x in r[1:]:
        up, down = (up + 1, 0) if x > 0 else (0, down + 1) if x < 0 else (up, down)
        runs.append((min(up, 5), min(down, 5)))
    x = np.column_stack([np.ones(70), vol, np.array(runs), r])
    for i, row in enumerate(got):
        if i < 40:
            assert row.DMOM_prob is None
            continue
        known = [j for j in range(1 if expanding else i - 39, i) if not np.isnan(x[j - 1]).any()]
        fit = np.linalg.pinv(x[[j - 1 for j in known]]) @ (r[known] > 0)
        assert row.DMOM_prob == pytest.approx(float(np.clip(fit @ x[i - 1], 0, 1)), abs=1e-6)
        assert (row.DMOM_up, row.DMOM_down) == runs[i]
