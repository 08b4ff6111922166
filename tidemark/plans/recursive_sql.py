"""SQL of the recursive indicators: one row after the other of each series, by a recursive table expression."""
from __future__ import annotations

import math

_A = math.exp(-math.sqrt(2) * math.pi / 10)
_S2, _S3 = 2 * _A * math.cos(math.sqrt(2) * math.pi / 10), -_A * _A
_S1 = 1 - _S2 - _S3
_B = math.exp(-1.414 * math.pi / 10)
_U2, _U3 = 2 * _B * math.cos(1.414 * math.pi / 10), -_B * _B
_U1 = (1 + _U2 - _U3) / 4
_L = 0.2


def _w(n: int, last: str = "current row") -> str:
    return f"(partition by symbol order by start_time rows between {n - 1} preceding and {last})"


def _full(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) over {_w(n)} >= {n} then {agg}({x}) over {_w(n)} end"


_ORD = "(partition by symbol order by start_time)"

#: What each bar knows from windows of the bars before.
_READY = f"""t0 as (select symbol, start_time, open, high, low, close, row_number() over {_ORD} as rn, lag(close) over {_ORD} as pc, lag(high) over {_ORD} as ph, lag(low) over {_ORD} as pl, lag(close, 2) over {_ORD} as pc2, lag(close, 10) over {_ORD} as c10 from b),
t1 as (select *, case when rn = 1 then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, abs(close - pc) as mv, case when rn = 2 then high - low when rn > 2 then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr2 from t0),
t2 as (select *, avg(tr) over {_w(14)} as atr14, avg(tr) over {_w(10)} as atr10, {_full('max', 'high', 9)} as hh, {_full('min', 'low', 9)} as ll, sum(mv) over {_w(10)} as path,
 case when rn >= 2 then case when tr2 > 0 then 100 * greatest(high - ph, 0) / tr2 else 100 end end as du, case when rn >= 2 then case when tr2 > 0 then 100 * greatest(pl - low, 0) / tr2 else 100 end end as dd,
 (max(high) over {_w(10, '5 preceding')} - min(low) over {_w(10, '5 preceding')} + max(high) over {_w(5)} - min(low) over {_w(5)}) / 5 as halves, (max(high) over {_w(10)} - min(low) over {_w(10)}) / 10 as whole from t1),
t3 as (select *, {_full('avg', 'du', 14)} as pdi, {_full('avg', 'dd', 14)} as mdi, case when hh is null then null when hh = ll then 0 else 100 * (close - ll) / (hh - ll) end as rsv,
 case when rn > 10 then pow((case when path > 0 then abs(close - c10) / path else 0 end) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) end as ksc, case when halves > 0 and whole > 0 then exp(-4.6 * ((ln(halves) - ln(whole)) / ln(2) - 1)) else 1 end as fa from t2),
t as (select *, case when pdi is null then null when pdi + mdi > 0 then 100 * abs(pdi - mdi) / (pdi + mdi) else 100 end as dx, avg(case when rn between 2 and 15 then greatest(close - pc, 0) end) over {_w(14)} as g14, avg(case when rn between 2 and 15 then greatest(pc - close, 0) end) over {_w(14)} as l14,
 (high + low) / 2 + 3 * atr14 as ub, (high + low) / 2 - 3 * atr14 as lb from t3)"""

_START = """select symbol, rn, start_time, close as e9, close as e12, close as e26, 0.0::double as dea, close as e20, (high - low)::double as eh, null::double as g, null::double as l, close as km, null::double as fr, close as llt, close as llt1, close as ss, null::double as ss1, close as us, null::double as us1,
 null::double as kk, null::double as dk, null::double as adx, low as sar, 0.02::double as af, high as ep, true as sl, ub as up, lb as dn, case when close > (high + low) / 2 then lb else ub end as st, case when close > (high + low) / 2 then 1.0 else -1.0 end::double as side from t where rn = 1"""

_STEP = f"""select t.symbol, t.rn, t.start_time, s.e9 + 0.2 * (close - s.e9), s.e12 + 2.0 / 13 * (close - s.e12), s.e26 + 2.0 / 27 * (close - s.e26),
 s.dea + 0.2 * ((s.e12 + 2.0 / 13 * (close - s.e12)) - (s.e26 + 2.0 / 27 * (close - s.e26)) - s.dea), s.e20 + 2.0 / 21 * (close - s.e20), s.eh + 2.0 / 11 * (high - low - s.eh),
 case when t.rn = 15 then g14 when t.rn > 15 then (s.g * 13 + greatest(close - pc, 0)) / 14 end, case when t.rn = 15 then l14 when t.rn > 15 then (s.l * 13 + greatest(pc - close, 0)) / 14 end,
 case when ksc is null then s.km else s.km + ksc * (close - s.km) end, case when t.rn >= 10 then fa * (high + low) / 2 + (1 - fa) * coalesce(s.fr, pc) end,
 case when t.rn = 2 then {_L} * close + {1 - _L} * s.llt else {_L - _L * _L / 4} * close + {_L * _L / 2} * pc - {_L - 3 * _L * _L / 4} * case when t.rn = 3 then pc else pc2 end + {2 * (1 - _L)} * s.llt - {(1 - _L) ** 2} * case when t.rn = 3 then s.llt else s.llt1 end end, s.llt,
 {_S1} * (close + pc) / 2 + {_S2} * s.ss + {_S3} * coalesce(s.ss1, s.ss), s.ss,
 case when t.rn <= 4 then close else {1 - _U1} * close + {2 * _U1 - _U2} * pc - {_U1 + _U3} * pc2 + {_U2} * s.us + {_U3} * s.us1 end, s.us,
 case when s.kk is null then rsv else s.kk + (rsv - s.kk) / 3 end, case when s.kk is null then rsv else s.dk + (s.kk + (rsv - s.kk) / 3 - s.dk) / 3 end, case when s.adx is null then dx else s.adx + 2.0 / 7 * (dx - s.adx) end,
 case when turn then case when s.sl then high else low end else y end, least(case when turn then 0.02 else s.af end + 0.02, 0.2), case when s.sl then greatest(high, s.ep) else least(low, s.ep) end, s.sl <> turn,
 nu, nd, case when close > s.st then nd else nu end, case when close > s.st then 1.0 else -1.0 end
 from s join t on t.symbol = s.symbol and t.rn = s.rn + 1, lateral (select s.sar + s.af * (s.ep - s.sar) as y) a, lateral (select case when s.sl then close < y else close > y end as turn) c,
 lateral (select case when close <= s.up then least(ub, s.up) else ub end as nu, case when close >= s.dn then greatest(lb, s.dn) else lb end as nd) d"""

_AFTER = f"""r as (select *, case when g is null then null when g + l > 0 then 100 * g / (g + l) else 0 end as rsi, ss + (first(ss) over {_w(20)} - ss) / 20 * 9.5 - avg(ss) over {_w(20)} as rx, ss - avg(ss) over {_w(20)} as tx, lag(adx, 6) over {_ORD} as adx6, lag(adx, 7) over {_ORD} as adx7, lag(eh, 9) over {_ORD} as eh9 from s),
fx as (select *, case when rn >= 20 then list_reduce(list(rx * rx) filter (where rn >= 20) over {_ORD}, lambda a, v: 0.96 * a + 0.04 * v) end as rm, case when rn >= 20 then list_reduce(list(tx * tx) filter (where rn >= 20) over {_ORD}, lambda a, v: 0.96 * a + 0.04 * v) end as tm from r),
q as (select symbol, start_time, count(*) over {_ORD} as n, rsi - min(rsi) over {_w(14)} as num, max(rsi) over {_w(14)} - min(rsi) over {_w(14)} as span from fx where rsi is not null),
q3 as (select symbol, start_time, n, sum(num) over {_w(3)} as num, sum(span) over {_w(3)} as span from q),
sk as (select *, case when span > 0 then 100 * num / span else 100 end as sk from q3 where n >= 17),
sd as (select *, list(sk) filter (where sk <> 0) over (partition by symbol order by start_time rows between unbounded preceding and 1 preceding) as past from sk),
o as (select fx.*, t.pdi, t.mdi, t.atr10, sd.sk as stoch_k, case when len(past) > 3 then (past[-1] + past[-2] + sd.sk) / 3 end as stoch_d from fx join t using (symbol, rn) left join sd on sd.symbol = fx.symbol and sd.start_time = fx.start_time)"""

#: Column of the query: expression over the table o.
COLUMNS = {
    "ema9": "e9", "rsi14": "rsi", "kama10": "case when rn > 10 then km end", "frama9": "fr", "llt9": "llt", "ss10": "ss", "us10": "us", "reflex20": "case when rm > 0 then rx / sqrt(rm) end", "trendflex20": "case when tm > 0 then tx / sqrt(tm) end", "k": "kk", "d": "dk", "j": "3 * kk - 2 * dk",
    "adx": "adx", "pdi": "pdi", "mdi": "mdi", "adxr": "(adx + coalesce(adx7, adx6, adx)) / 2", "sar": "sar", "st": "st", "macd_dif": "e12 - e26", "macd_dea": "dea", "kelt_lower": "e20 - 2 * atr10", "kelt_mid": "e20", "kelt_upper": "e20 + 2 * atr10", "chaikin": "100 * (eh - eh9) / eh9", "stoch_k": "stoch_k", "stoch_d": "stoch_d",
}


def recursive_tables(bars: str) -> str:
    """Up to the table o of all recursive values of the bars that the SQL `bars` gives."""
    return f"with recursive b as ({bars}),\n{_READY},\ns as ({_START} union all {_STEP}),\n{_AFTER}"


def recursive_sql(bars: str, digits: int = 6) -> str:
    """All recursive indicators of the bars."""
    cols = ", ".join(f"cast(round({x}, {digits}) + 0.0 as float) as {c}" for c, x in COLUMNS.items())
    return f"{recursive_tables(bars)}\nselect symbol, start_time, {cols}, sl as sar_long, cast(side as float) as st_side from o"
