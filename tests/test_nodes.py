"""Node expressions against pandas."""
import numpy as np
import pandas as pd
import pytest

from tidemark.functions import nodes as n
from tidemark.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return fixtures.event_bars(spark, SF).cache()


def check(bars, node, f):
    got = n.materialize(bars, {"x": node}).toPandas().sort_values(["symbol", "start_time"])
    want = got.groupby("symbol", group_keys=False).apply(lambda t: f(t), include_groups=False)
    np.testing.assert_allclose(got["x"].to_numpy(float), want.to_numpy(float), rtol=1e-7, atol=1e-9)


c, v = n.leaf("close"), n.leaf("volume")


@pytest.mark.parametrize("node, f", [
    (n.delta(n.mean(c, 5), 2), lambda t: t.close.rolling(5).mean().diff(2)),
    (n.rank(n.delta(c, 1)), lambda t: t.close.diff().rank(pct=True)),
    (n.ts_rank(c, 5), lambda t: t.close.rolling(5).rank(pct=True)),
    (n.decay(n.ts_max(c, 3), 4), lambda t: t.close.rolling(3).max().rolling(4).apply(lambda x: (x * [0.1, 0.2, 0.3, 0.4]).sum())),
    (n.sma(n.delta(c, 1), 5, 1), lambda t: t.close.diff().ewm(alpha=0.2, adjust=False).mean()),
    (n.where(c > n.delay(c, 1), c, 0.0), lambda t: pd.Series(np.where(t.close > t.close.shift(), t.close, 0.0), t.index)),
    (n.total(c * 2 - 1, 3) / n.mean(c, 3), lambda t: (2 * t.close - 1).rolling(3).sum() / t.close.rolling(3).mean()),
])
def test_node(bars, node, f):
    check(bars, node, f)


def test_equal_nodes_are_one_column(bars):
    a, b = n.mean(c, 5) - c, n.mean(n.leaf("close"), 5) + c
    df = n.materialize(bars, {"a": a, "b": b})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") <= 2
    assert set(df.columns) == set(bars.columns) | {"a", "b"}
