"""Accounts with holds, running totals of large keys, categories, tests of significance, and labels of both sides."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev, factors as fa, labels, models, performance as perf, signals, totals, walkforward as wf

ORDER = "account string, seq long, signal_id string, asset_key string, is_open boolean, is_failed boolean, is_fake boolean, settle_amount double, fee double"


def balances(spark, deposits, freezes, orders):
    d = spark.createDataFrame(deposits, "account string, seq long, amount double")
    f = spark.createDataFrame(freezes, "account string, seq long, signal_id string, asset_key string, amount double")
    rows = signals.account_balances(signals.account_entries(d, f, spark.createDataFrame(orders, ORDER)), 4).orderBy("account", "seq", "step").collect()
    return [(r.seq, r.kind, r.available_after, r.frozen_after, r.total_after) for r in rows]


def test_an_order_releases_its_freeze_and_is_settled(spark):
    got = balances(spark, [("a", 0, 1000.0), ("a", 9, -50.0)], [("a", 1, "s", "x", 300.0), ("a", 5, "t", "x", 100.0)], [("a", 2, "s", "x", True, False, False, 290.0, -1.0), ("a", 6, "t", "x", True, True, False, 90.0, -1.0), ("a", 8, "s", "x", False, None, None, 310.0, None)])
    assert got == [
        (0, "deposit", 1000, 0, 1000), (1, "freeze", 700, 300, 1000), (2, "unfreeze", 1000, 0, 1000), (2, "trade", 710, 0, 710), (2, "fee", 709, 0, 709),
        (5, "freeze", 609, 100, 709), (6, "unfreeze", 709, 0, 709), (8, "trade", 1019, 0, 1019), (9, "withdraw", 969, 0, 969),
    ]


def test_orders_without_one_freeze_move_nothing(spark):
    opens = lambda seq, signal, fake=False: ("a", seq, signal, "x", True, False, fake, 10.0, -1.0)
    got = balances(spark, [], [("a", 2, "s", "x", 5.0), ("a", 3, "s", "x", 6.0), ("a", 6, "t", "x", 7.0)], [opens(1, "s"), opens(4, "s"), opens(5, "u"), opens(7, "t", True), opens(8, "t"), opens(9, "t")])
    assert [(s, k) for s, k, *_ in got] == [(2, "freeze"), (3, "freeze"), (6, "freeze"), (8, "unfreeze"), (8, "trade"), (8, "fee")]
    assert got[-1][2:] == (-22.0, 11.0, -11.0)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_totals_in_any_blocks(spark, block):
    r = np.random.default_rng(2)
    rows = [(["a", "b", None][i % 3], int(r.integers(0, 40)), i, None if i % 7 == 0 else float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x double")
    got = totals.running(df, ["k"], ["t", "i"], block, sums={"s": F.col("x")}, lasts={"l": F.col("x")})
    state = {}
    for k, t, i, x in sorted(rows, key=lambda v: (str(v[0]), v[1], v[2])):
        s, last = state.get(k, (None, None))
        state[k] = s, last = (s if x is None else (s or 0) + x), (last if x is None else x)
        state[(k, i)] = s, last
    assert all(state[(v.k, v.i)] == (v.s, v.l) for v in got.collect()) and got.count() == 120


def test_categories_go_with_their_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("c", 2.0), ("x", 3.0), (None, 4.0)], "s string, v double")
    df = fa.encode(df, "s", "code", ["a", "b", "c"])
    assert [r.code for r in df.orderBy("v").collect()] == [0, 2, None, None] and fa.categorical_info(df) == {"code": 3}
    df.select("code", "v").join(df.select("v", "s"), "v").write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert fa.encoder_classes(back) == {"code": ["a", "b", "c"]}
    again = fa.encode_as(spark.createDataFrame([("c",)], "s string"), {"code": "s"}, fa.encoder_classes(back))
    assert again.first().code == 2 and fa.categorical_info(again) == {"code": 3}
    assert fa.categorical_info(fa.one_hot(df, "s", ["a", "b"]).select("s_a", "v")) == {"s_a": 2}


def test_trees_split_by_categories(spark):
    rows = [(i % 40, float(i % 40 in (3, 17, 30))) for i in range(800)]
    df = fa.with_categories(spark.createDataFrame(rows, "c int, label double"), "c", list(range(40)))
    model = models.train(df, ["c"], depth=1, rounds=1)
    tree = model.stages[-1].trees[0]
    assert "in {" in tree.toDebugString  # one split by a set tells all three apart
    with pytest.raises(ValueError):
        models.train(df, ["c"], classes=3, validation="label")


def test_binomial_and_paired_tests(spark):
    df = spark.createDataFrame([(3, 3), (0, 4), (7, 10), (0, 0), (60, 100), (900, 1000)], "w int, n int")
    got = [r.p for r in df.select(perf.binomial_test("w", "n").alias("p")).collect()]
    want = [sum(math.comb(n, k) for k in range(w, n + 1)) / 2**n if n else 1.0 for w, n in ((3, 3), (0, 4), (7, 10), (0, 0), (60, 100), (900, 1000))]
    assert got == pytest.approx(want, rel=1e-9) and perf.binomial_p(0, 0) == 1.0
    rows = [("a", 1.0, 0.5), ("a", 2.0, 1.0), ("a", 3.0, 2.5), ("b", 1.0, 0.0), ("c", 1.0, 0.5), ("c", 2.0, 1.5), ("d", None, 1.0)]
    got = {r.run_id: (r.n, r.t, r.p) for r in perf.paired_t_test(spark.createDataFrame(rows, "run_id string, ret double, bench double")).collect()}
    t = (2 / 3) / (np.std([0.5, 1.0, 0.5], ddof=1) / math.sqrt(3))
    assert got["a"][1] == pytest.approx(t) and got["a"][2] == pytest.approx(0.5 - t / (2 * math.sqrt(t * t + 2)))  # two degrees of freedom
    assert got["b"] == (1, 0.0, 1.0) and got["c"] == (2, None, None) and got["d"] == (0, 0.0, 1.0)


def test_signals_of_predictions(spark):
    df = spark.createDataFrame([([0.3, 0.7],), ([0.7, 0.3],), ([0.5, 0.5],), ([0.1, 0.2, 0.7],), ([0.7, 0.2, 0.1],), ([0.1, 0.8, 0.1],), (None,)], "p array<double>")
    assert [(r.s.side, r.s.confidence) for r in df.select(ev.to_signal(F.col("p")).alias("s")).collect()] == [("LONG", 0.7), ("SHORT", 0.7), ("NONE", None), ("LONG", 0.7), ("SHORT", 0.7), ("NONE", None), ("NONE", None)]
    df = spark.createDataFrame([(0.015,), (-0.5,), (0.01,), (None,)], "r double")
    assert [(r.s.side, r.s.confidence) for r in df.select(ev.return_signal(F.col("r")).alias("s")).collect()] == [("LONG", 0.75), ("SHORT", 1.0), ("NONE", None), ("NONE", None)]


def test_labels_of_both_sides(spark):
    from test_tables import bar, frame

    def label(bars, **k):
        rows = [bar(0, c=100.0, h=100.0, lo=100.0), *[bar(60_000 * (i + 1), h=float(h), lo=float(lo), c=(h + lo) / 2) for i, (h, lo) in enumerate(bars)]]
        return labels.triple_barrier(frame(spark, rows), side="both", **k).orderBy("start_time").first().label

    assert label([(103, 100)]) == 2 and label([(100, 97)]) == 0 and label([(103, 97)]) == 1 and label([(100.5, 99.5)]) == 1
    assert label([(100.5, 99.5)], classes=2) == 1 and label([(100.2, 99.4)], classes=2) == 0
    wide = dict(stop=0.05, classes=2)
    assert label([(103, 99), (100, 97)], **wide) == 1 and label([(100, 97), (103, 99)], **wide) == 0 and label([(103, 97)], **wide) == 1
    assert label([(103, 97)], conservative=False, stop=0.02) == 1  # both win


def test_parameter_stability(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3), (1, 6, None)], "a int, b int, c int")
    assert {r.parameter: (r.windows, r["values"], r.stability) for r in wf.parameter_stability(df, ["a", "b", "c"]).collect()} == {"a": (4, 1, "stable"), "b": (4, 2, "moderate"), "c": (3, 3, "unstable")}
    assert wf.parameter_stability(df.limit(1), ["a"]).count() == 0


def test_exits_at_any_time_are_those_of_a_long_horizon(spark):
    r = np.random.default_rng(6)
    close = (100 * np.exp(0.02 * r.normal(size=(2, 300)).cumsum(1))).tolist()
    bars = spark.createDataFrame([("ab"[k], i, c) for k in (0, 1) for i, c in enumerate(close[k])], "symbol string, start_time long, close double")
    opened = [(i, "ab"[i % 2], 1 if i % 3 else -1, close[i % 2][int(t)], int(t)) for i, t in enumerate(r.integers(0, 295, 60))]
    p = spark.createDataFrame(opened, "position_id long, symbol string, side int, cost double, opened long")
    for exits in (signals.first_exit, signals.trailing_exit):
        want = sorted(map(tuple, exits(p, bars, horizon=10_000).collect()))
        assert sorted(map(tuple, exits(p, bars).collect())) == want and len(want) > 30
    assert {r.exit_hit for r in signals.trailing_exit(p, bars).collect()} == {"stop", "trail"}
