"""Recursive kernels against small golden series and plain loops."""
import numpy as np
import pytest

from tidemark.operators import scans

RNG = np.random.default_rng(1)
CLOSE = 100 + RNG.normal(size=80).cumsum()
HIGH, LOW = CLOSE + RNG.random(80), CLOSE - RNG.random(80)


def test_ema_is_the_recursion():
    y, want = None, []
    for c in CLOSE:
        y = c if y is None else y + 0.2 * (c - y)
        want.append(y)
    np.testing.assert_allclose(scans.ema(CLOSE, 9), want)


def test_ema_carries_over_a_null():
    np.testing.assert_allclose(scans.ewm(np.array([np.nan, 2.0, np.nan, 4.0]), 0.5), [np.nan, 2.0, np.nan, 3.0])


def test_rsi():
    x = np.array([1.0, 2, 3, 2, 4])
    got = scans.wilder_rsi(x, 2)
    assert np.isnan(got[:2]).all() and got[2] == 100 and got[3] == pytest.approx(100 - 100 / (1 + 0.5 / 0.5)) and got[4] == pytest.approx(100 - 100 / (1 + 1.25 / 0.25))
    assert (scans.wilder_rsi(np.ones(20), 14)[14:] == 0).all()


def test_kdj_flat_and_seed():
    k, d, j = scans.kdj(np.ones(12), np.ones(12), np.ones(12))
    assert np.isnan(k[:8]).all() and (k[8:] == 0).all() and (d[8:] == 0).all() and (j[8:] == 0).all()
    k, d, _ = scans.kdj(HIGH, LOW, CLOSE)
    hi, lo = HIGH[:9].max(), LOW[:9].min()
    assert k[8] == d[8] == pytest.approx(100 * (CLOSE[8] - lo) / (hi - lo))


def test_sar_follows_a_trend():
    up = np.arange(30.0)
    y, long = scans.sar(up + 1, up, up + 0.5)
    assert long.all() and (np.diff(y[1:]) > 0).all() and (y < up + 1).all()
    _, long = scans.sar(np.r_[up + 1, up[::-1]], np.r_[up, up[::-1] - 1], np.r_[up + 0.5, up[::-1] - 0.5])
    assert not long[-1]


def test_sar_by_hand():
    """Turns when the close passes it, from that bar's high; keeps the extreme; steps on the turning bar, too."""
    high, low, close = np.array([11.0, 12, 13, 12, 9]), np.array([10.0, 11, 12, 10, 7]), np.array([10.5, 11.5, 12.5, 9, 8])
    y, long = scans.sar(high, low, close)
    # 10 + .02 (11 - 10); + .04 (12 - 10.02); + .06 (13 - 10.0992) = 10.273248, passed by 9: the bar's high;
    # then from 12, af .02 + .02 = .04, ep 13: 12 + .04 (13 - 12)
    np.testing.assert_allclose(y, [10, 10.02, 10.0992, 12, 12.04])
    assert long.tolist() == [True, True, True, False, False]


def test_super_trend_sides():
    x = np.r_[np.arange(50.0), np.arange(50.0, 0, -1)]
    line, side = scans.super_trend(x + 0.5, x - 0.5, x)
    assert side[45] == 1 and side[-1] == -1 and line[45] < x[45] and line[-1] > x[-1]


def test_super_trend_by_hand():
    """Mean ranges 2, 2.25, 9.5 / 3; the first side is that of the close by the middle; it turns against the line before."""
    high, low, close = np.array([11.0, 12, 15]), np.array([9.0, 10, 10]), np.array([9.5, 10.5, 14.9])
    line, side = scans.super_trend(high, low, close, n=3, times=1.0)
    # close 9.5 under 10: upper band 12; 10.5 under 12: min(13.25, 12); 14.9 over 12: lower band max(12.5 - 9.5 / 3, 8.75)
    np.testing.assert_allclose(line, [12, 12, 12.5 - 9.5 / 3])
    assert side.tolist() == [-1, -1, 1]


def test_llt_and_super_smoother_start():
    c = np.array([10.0, 12, 11])
    a = 0.2
    second = a * 12 + (1 - a) * 10
    third = (a - a * a / 4) * 11 + a * a / 2 * 12 - (a - 3 * a * a / 4) * 12 + 2 * (1 - a) * second - (1 - a) ** 2 * second
    np.testing.assert_allclose(scans.llt(c), [10, second, third])
    k = np.exp(-np.sqrt(2) * np.pi / 10)
    c2, c3 = 2 * k * np.cos(np.sqrt(2) * np.pi / 10), -k * k
    np.testing.assert_allclose(scans.super_smoother(c)[:2], [10, (1 - c2 - c3) * 11 + (c2 + c3) * 10])


def test_frama_waits_for_its_window():
    got = scans.frama(HIGH, LOW, CLOSE)
    assert np.isnan(got[:9]).all() and not np.isnan(got[9:]).any()
    np.testing.assert_allclose(scans.frama(np.full(12, 3.0), np.full(12, 3.0), np.full(12, 3.0))[9:], 3.0)


def test_stoch_rsi_flat_and_start():
    k, d = scans.stoch_rsi(np.r_[np.full(14, np.nan), np.full(25, 60.0)])
    assert np.isnan(k[:30]).all() and (k[30:] == 100).all() and np.isnan(d[:34]).all() and (d[34:] == 100).all()


@pytest.mark.parametrize("f", [scans.llt, scans.super_smoother, scans.ultimate_smoother])
def test_filters_keep_a_constant(f):
    np.testing.assert_allclose(f(np.full(40, 7.0)), 7.0)


def test_kama_warm_up_and_flat():
    assert np.isnan(scans.kama(CLOSE)[:10]).all() and not np.isnan(scans.kama(CLOSE)[10:]).any()
    np.testing.assert_allclose(scans.kama(np.full(20, 3.0))[10:], 3.0)


def test_dmi_start_and_range():
    adx, pdi, mdi, adxr = scans.dmi(HIGH, LOW, CLOSE)
    assert np.isnan(pdi[:14]).all() and not np.isnan(pdi[14:]).any() and (0 <= adx[14:]).all() and (adx[14:] <= 100).all()
    np.testing.assert_allclose(adxr[14:20], adx[14:20])  # too few before
    np.testing.assert_allclose([adxr[20], adxr[21], adxr[30]], [(adx[20] + adx[14]) / 2, (adx[21] + adx[14]) / 2, (adx[30] + adx[23]) / 2])
    flat = np.full(20, 5.0)
    assert all(x[-1] == 100 for x in scans.dmi(flat, flat, flat)[1:3])


def test_flat_reflex_is_zero():
    assert all(np.isnan(f(np.ones(50))[:19]).all() and (f(np.ones(50))[19:] == 0).all() for f in (scans.reflex, scans.trendflex))


def test_student_p_values():
    from tidemark.operators.performance import _t_sf, binomial_p

    assert _t_sf(0.0, 5) == pytest.approx(0.5) and _t_sf(2.015, 5) == pytest.approx(0.05, abs=1e-4) and _t_sf(-2.015, 5) == pytest.approx(0.95, abs=1e-4) and _t_sf(1.96, 100000) == pytest.approx(0.025, abs=1e-4)
    assert binomial_p(3, 3) == pytest.approx(0.125) and binomial_p(0, 4) == pytest.approx(1.0)


def test_scan_of_one_row_and_none(spark):
    from tidemark.sources import fixtures

    bars = fixtures.event_bars(spark, "/root/testdata/sf0.001")
    one = scans.recursive_indicators(bars.limit(1)).collect()
    assert len(one) == 1 and one[0].rsi14 is None and one[0].ema9 == one[0].close
    assert scans.recursive_indicators(bars.limit(0)).count() == 0
