"""Folds with carried state, and what they give on small series."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import carried, chaos, indicators as ind, structure as st
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
KEY = ["symbol"]


def bars(spark, series, **more):
    """Rows (high, low) or single closes of each symbol as bars."""
    rows = []
    for symbol, values in series.items():
        for t, v in enumerate(values):
            high, low = v if isinstance(v, tuple) else (v + 1, v - 1)
            rows.append((symbol, t, float(high), float(low), float((high + low) / 2)))
    return spark.createDataFrame(rows, "symbol string, start_time long, high double, low double, close double")


def walk(seed, n):
    return (100 + np.random.default_rng(seed).normal(size=n).cumsum()).round(3).tolist()


@pytest.fixture
def tiny(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def everything(spark):
    day = fx.equity_bars(spark, SF)
    merged = st.merged_bars(day)
    frames = [st.fractals(merged), st.strokes(day), st.pivot_zones(st.strokes(day)), st.sequence(day), chaos.chaos(fx.event_bars(spark, SF))]
    return [sorted(map(repr, f.collect())) for f in frames]


def test_state_outlives_batches(spark, request):
    want = everything(spark)
    request.getfixturevalue("tiny")
    assert everything(spark) == want and all(want)


def test_null_keys_and_empty_tables(spark):
    rows = bars(spark, {"a": walk(1, 40), "b": walk(2, 5)}).withColumn("symbol", F.when(F.col("symbol") == "a", F.col("symbol")))
    assert st.merged_bars(rows, KEY).filter("symbol is null").count() > 0
    for f in (st.merged_bars, st.strokes, st.sequence, chaos.chaos):
        assert f(rows.limit(0), KEY).count() == 0


def test_added_columns_replace_those_of_the_same_name(spark):
    rows = bars(spark, {"a": [1, 2]}).withColumn("td_count", F.lit("x"))
    assert st.sequence(rows, KEY).columns.count("td_count") == 1


def test_merging(spark):
    series = [(10, 5), (9, 6), (12, 8), (11, 9), (7, 2), (6, 3), (6, 3)]
    got = [(r.start_time, r.end_time, r.high, r.low, r.rising, r.n_bars, r.high_time, r.low_time, r.is_finished) for r in st.merged_bars(bars(spark, {"a": series}), KEY).orderBy("seq").collect()]
    assert got == [(0, 1, 10, 6, True, 2, 0, 0, True), (2, 3, 12, 9, True, 2, 2, 2, True), (4, 6, 6, 2, False, 3, 4, 4, False)]


def test_fractals_test_tops_first_and_allow_ties(spark):
    rows = spark.createDataFrame([("a", i, float(h), float(lo)) for i, (h, lo) in enumerate([(5, 1), (7, 5), (7, 6), (3, 2), (9, 8)])], "symbol string, seq long, high double, low double")
    assert [(r.fractal, r.gap) for r in st.fractals(rows, KEY).orderBy("seq").collect()] == [(None, None), ("top", False), ("top", False), ("bottom", True), (None, None)]


def test_strokes_alternate_and_join(spark):
    rows = st.strokes(bars(spark, {s: walk(s, 900) for s in range(3)}), KEY).orderBy("symbol", "seq").collect()
    assert len(rows) > 60
    for a, b in itertools.pairwise(rows):
        if a.symbol == b.symbol:
            assert a.rising != b.rising and a.end_time == b.start_time and a.end_value == b.start_value and b.seq == a.seq + 1
        assert a.high >= a.low and a.n_merged >= 7 and (a.end_value > a.start_value) == a.rising


def test_zones(spark):
    legs = [(10, 0), (8, 3), (9, 2), (9, 4), (7, 1), (20, 9), (19, 10), (30, 12), (29, 15)]
    rows = spark.createDataFrame([("a", i, i * 10, i * 10 + 9, float(h), float(lo)) for i, (h, lo) in enumerate(legs)], "symbol string, seq long, start_time long, end_time long, high double, low double")
    got = [tuple(r)[1:] for r in st.pivot_zones(rows, KEY).orderBy("seq").collect()]
    # 3..8 of the first three; broken by (20, 9), when the zone from the second leg on, 4..8, is broken too; then 3 legs from 20 on
    assert got == [(0, 0, 39, 8.0, 3.0, 5, True), (1, 50, 89, 19.0, 12.0, 4, False)]


def falling(n, start=100.0):
    return [(start - i + 0.5, start - i - 0.5) for i in range(n)]


def test_sequence_counts_down_and_reverses(spark):
    series = falling(40)
    got = [r.td_count for r in st.sequence(bars(spark, {"a": series}), KEY, perfect_setup=False).orderBy("start_time").collect()]
    assert got[:13] == [0] * 13 and set(got) == {0}  # each bar is a setup of its own, which starts the count again
    # perfect: of the last two bars a low has to be over those of the two before, which never is so in a fall
    assert {r.td_count for r in st.sequence(bars(spark, {"a": series}), KEY).collect()} == {0}


def test_sequence_is_recycled_cancelled_and_doubled():
    def run(closes, **switches):
        seq = st._Sequence(perfect_setup=False, **switches)
        return [seq.step(c + 0.5, c - 0.5, c) for c in closes]

    down = [100.0 - i for i in range(13)]
    # single drops under the low of two bars before count; no nine falls in a row follow
    jagged = [88.0 - 0.5 * (i // 3) - (1.6 if i % 3 == 2 else 0) for i in range(60)]
    counts = run(down + jagged)
    assert min(counts) < -3 and all(abs(b - a) <= 1 or b == 0 or b == 2 * a for a, b in itertools.pairwise(counts))
    assert run(down + jagged[:12] + [200.0])[-1] == 0  # past all of the setup
    again = run(down + jagged[:12] + down)
    assert again[-1] == 0 and again[len(down) + 11] < 0  # a new setup
    doubled = run(down + jagged + [jagged[-1] + 5.0] * 2, most=4)
    assert -8 in doubled


def plain_distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def plain_dimension(r, dim=10, radii=10):
    v = [r[i : i + dim] for i in range(len(r) - dim + 1)]
    d = sorted(x for i in range(len(v)) for j in range(i + 1, len(v)) if (x := plain_distance(v[i], v[j])) > 0)
    low, high = math.log(d[len(d) // 20]), math.log(d[len(d) * 19 // 20])
    at = [low + (high - low) * i / (radii - 1) for i in range(radii)]
    found = [(x, math.log(n / len(d))) for x in at if (n := sum(y < math.exp(x) for y in d))]
    return np.polyfit(*zip(*found), 1)[0]


def plain_lyapunov(r, dim=10, apart=10):
    v = [r[i : i + dim] for i in range(len(r) - dim + 1)]
    n = len(v)
    steps = min(n // 4, 20)
    logs = [[] for _ in range(steps)]
    for i in range(n - steps):
        near = min(((plain_distance(v[i], v[j]), j) for j in range(n) if abs(i - j) > apart and plain_distance(v[i], v[j]) > 0), default=None)
        if near and near[1] + steps < n:
            for k in range(steps):
                if (x := plain_distance(v[i + k], v[near[1] + k])) > 0:
                    logs[k].append(math.log(x))
    at = [k for k in range(steps) if logs[k]]
    return np.polyfit(at, [np.mean(logs[k]) for k in at], 1)[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chaos_of_all_pairs(spark, seed):
    close = walk(seed, 130)
    if seed == 3:
        close[40:60] = close[20:40]  # equal vectors
    got = chaos.chaos(bars(spark, {"a": close}), KEY).orderBy("start_time").collect()
    assert [r.hurst is None for r in got[:22]] == [True] * 20 + [False] * 2
    assert got[49].lyapunov is None and got[50].lyapunov is not None and got[50].correlation_dimension is not None
    for i in (50, 90, 100, 129):
        part = close[max(0, i - 100) : i + 1]
        r = [math.log(b / a) for a, b in itertools.pairwise(part)]
        assert got[i].correlation_dimension == pytest.approx(plain_dimension(r), rel=1e-9)
        assert got[i].lyapunov == pytest.approx(plain_lyapunov(r), rel=1e-9)


def test_chaos_passes_over_nulls_and_prices_of_nothing(spark):
    close = walk(5, 60)
    rows = [("a", i, c) for i, c in enumerate(close)]
    with_gaps = [("a", i * 2, c) for i, c in enumerate(close)] + [("a", 31, None)]
    one, two = (chaos.chaos(spark.createDataFrame(x, "symbol string, start_time long, close double"), KEY).filter("close is not null").orderBy("start_time").select("hurst", "lyapunov").collect() for x in (rows, with_gaps))
    assert one == two
    flat = chaos.chaos(spark.createDataFrame([("a", i, 0.0) for i in range(120)] + [("b", i, 5.0) for i in range(120)], "symbol string, start_time long, close double"), KEY)
    assert flat.filter("symbol = 'a' and hurst is not null").count() == 0 and flat.filter("lyapunov is not null or correlation_dimension is not null").count() == 0


def test_ladder():
    assert chaos.ladder(10, 100, 100) == [10, 15, 22, 33, 49, 73, 100] and chaos.ladder(10, 100, 20) == [10, 20] and chaos.ladder(10, 100, 22) == [10, 15, 22]


M = [1, 6, 8, 5, -1, -3, -2, 1, 2, 4, 3, 2]
HIGH = [10, 12, 14, 12, 9, 7, 8, 10, 12, 15, 14.5, 14]
DIF = [8, 10, 14, 9, 2, 1, 1, 2, 3, 4, 4, 3.5]


def diverged(spark, m=M, high=HIGH, dif=DIF, sign=1, open_=None, **switches):
    rows = []
    for t, (x, h, d) in enumerate(zip(m, high, dif)):
        close, o = h - 0.5, (open_ if open_ is not None else h - 0.4)
        v = dict(high=h, low=h - 1, close=close, open=o)
        if sign < 0:
            v = dict(high=-v["low"], low=-v["high"], close=-close, open=-o)
        rows.append(("test", "a", "q", 1, "1D", t, float(v["high"]), float(v["low"]), float(v["close"]), float(v["open"]), float(sign * d), float(sign * (d - x)), float(sign * x)))
    df = spark.createDataFrame(rows, "market string, symbol string, quote_currency string, ins_type int, timeframe string, start_time long, high double, low double, close double, open double, dif double, dea double, m double")
    last = ind.divergence(df, **switches).orderBy("start_time").collect()[-1]
    return last.top_divergence, last.bottom_divergence


def test_divergence_at_the_top(spark):
    assert diverged(spark) == (True, False)
    assert diverged(spark, threshold=4) == (True, False) and diverged(spark, threshold=5) == (False, False)


def test_divergence_at_the_bottom(spark):
    assert diverged(spark, sign=-1) == (False, True)
    # a pull back over zero ends a bottom at once, a top only past a third of its line
    dif = [*DIF[:5], -5, *DIF[6:]]
    assert diverged(spark, dif=dif) == (True, False) and diverged(spark, dif=dif, sign=-1) == (False, False) and diverged(spark, dif=dif, dea_pull=False) == (False, False)


@pytest.mark.parametrize(
    "given, found",
    [
        (dict(by_close=False), True), (dict(by_peak=False), True), (dict(by_close=False, by_peak=False), False), (dict(by_area=False), True), (dict(rate=0.2), True), (dict(by_area=False, rate=0.2), False), (dict(rate=0.2, open_=0.0), False), (dict(rate=0.2, open_=0.0, by_candle=False), True), (dict(rate=0.2, open_=14.2), True),
        (dict(pull=5.0), False), (dict(dea_pull=False), True), (dict(dea_pull=False, pull=0.9), True), (dict(dea_pull=False, pull=0.95), False), (dict(n=9), False), (dict(high=HIGH[:9] + [13, 12, 11]), False), (dict(m=[*M[:-1], 3.5]), False), (dict(dif=[-1, *DIF[1:]]), True),
        (dict(m=[-1, *M[1:]], dif=[-1, -1, *DIF[2:]], cross_zero=False), False), (dict(m=[-1, *M[1:]], dif=[-1, -1, *DIF[2:]]), True),
    ],
)
def test_switches_of_divergence(spark, given, found):
    assert diverged(spark, **given)[0] == found
