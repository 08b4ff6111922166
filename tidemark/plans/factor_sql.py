"""SQL of single factors and the volume profile."""
from __future__ import annotations

_ORD = "(partition by symbol order by start_time)"


def _w(n: int) -> str:
    return f"(partition by symbol order by start_time rows between {n - 1} preceding and current row)"


def profile_tables(bars: str, n: int = 90) -> str:
    """Up to the table p (symbol, start_time, vp_distance, in_hvn, in_lvn), for prices of one and more."""
    return f"""with b as ({bars}),
w as (select symbol, start_time, close, case when count(high) over {_w(n)} >= {n} then list(struct_pack(h := high, l := low, v := volume)) over {_w(n)} end as a from b),
x as (select *, list_min(list_transform(a, lambda v: v.l)) as lo, list_max(list_transform(a, lambda v: v.h)) as hi from w),
e as (select *, list_transform(range(0, 21), lambda k: case when k = 20 then hi else lo + k * ((hi - lo) / 20) end) as edges from x where hi > lo),
v as (select *, list_transform(range(0, 20), lambda i: coalesce(list_sum(list_transform(list_filter(a, lambda q: greatest(len(list_filter(edges, lambda z: z < (q.h + q.l) / 2)) - 1, 0) = i), lambda q: q.v)), 0)) as vol from e),
q as (select *, list_sort(vol) as s, list_transform(edges, lambda z, k: round_even(z * 1000, 0) / 1000 - case when k = 1 then 0.001 else 0 end) as named, list_position(vol, list_max(vol)) as poc from v where list_max(vol) > 0),
m as (select symbol, start_time, close, (named[poc] + named[poc + 1]) / 2 as mid, s[16] + (s[17] - s[16]) * 0.2 as high, s[4] + (s[5] - s[4]) * 0.8 as low, list_transform(list_filter(range(1, 21), lambda i: named[i] <= close and close <= named[i + 1]), lambda i: vol[i]) as mine from q),
p as (select b.symbol, b.start_time, (m.close - mid) / mid as vp_distance, coalesce(cast(len(list_filter(mine, lambda v: v >= m.high)) > 0 as integer), 0) as in_hvn, coalesce(cast(len(list_filter(mine, lambda v: v <= m.low)) > 0 as integer), 0) as in_lvn
  from b left join m on m.symbol = b.symbol and m.start_time = b.start_time)"""


def custom_tables(bars: str) -> str:
    """Up to the table o with single factors by their default parameters: mean of least volumes, quadratic fit, run lengths,
    score of the bar before, spread, and spikes."""
    return f"""with recursive b as ({bars}),
t as (select *, row_number() over {_ORD} as rn, lag(close) over {_ORD} as pc, close / lag(close) over {_ORD} - 1 as r, ln(close) as lc, ln((high + low) / 2) as lm from b),
runs as (select symbol, rn, null::bigint as up_run, null::bigint as down_run, 0::bigint as u, 0::bigint as d from t where rn = 1
  union all select t.symbol, t.rn, n.u, n.d, n.u, n.d from runs a join t on t.symbol = a.symbol and t.rn = a.rn + 1, lateral (select case when close > pc then a.u + 1 when close < pc then 0 else a.u end as u, case when close < pc then a.d + 1 when close > pc then 0 else a.d end as d) n),
v0 as (select t.*, up_run, down_run, case when t.rn >= 20 then list_sort(list(volume) filter (volume is not null) over {_w(20)}) end as vols, case when count(close) over {_w(21)} >= 21 then list(close) over {_w(21)} end as cs,
  case when t.rn >= 20 and count(r) over {_w(20)} >= 5 then stddev_pop(r) over {_w(20)} end as vl, case when t.rn > 2 then (lag(lc) over {_ORD} - lag(lm) over {_ORD}) * (lag(lc) over {_ORD} - lm) end as p, greatest(r, 0 * r) as pos, greatest(-r, 0 * r) as neg from t join runs using (symbol, rn)),
v as (select *, list_avg(vols[:20]) as least_volume, lag(vl) over {_ORD} as pvl, list(vl) filter (vl is not null) over {_w(21)} as vls, lag(r) over {_ORD} as pr, lag(up_run) over {_ORD} as pu, lag(down_run) over {_ORD} as pd, case when rn > 60 then avg(p) over {_w(60)} end as mp,
  list_avg(cs) as mc, list_sum(list_transform(cs, lambda y, i: y * (i - 11))) / 770 as b1,
  quantile_cont(pos, 0.1) over {_w(60)} as pl, quantile_cont(pos, 0.9) over {_w(60)} as ph, quantile_cont(neg, 0.1) over {_w(60)} as nl, quantile_cont(neg, 0.9) over {_w(60)} as nh, case when rn >= 3 then avg(abs(r)) over {_w(3)} end as strength, case when rn >= 60 then quantile_cont(abs(r), 0.5) over {_w(60)} end as threshold from v0),
o as (select symbol, start_time, case when len(vols) >= 20 and least_volume > 0 and volume > 0 then least_volume / volume end as volume_average, mc - 11 * b1 + g * (121 - 110.0 / 3) as am_alpha, b1 - 22 * g as am_beta, g as am_gamma,
  case when sst > 1e-12 then 1 - greatest(sst - 770 * b1 * b1 - s2 * g * g, 0) / sst end as am_r2, up_run, down_run,
  case when rn > 20 then 0.4 * (least(pu, 12) - least(pd, 12) + 12) / 24 + 0.4 * (tanh(pr * 20) + 1) / 2 + 0.2 * case when pvl is null then 0.5 else 1 - len(list_filter(vls, lambda y: y <= pvl)) / len(vls) end end as simple_dmom, sqrt(greatest(-4 * mp, 0 * mp)) as simple_ar,
  r as ps_diff, pos as ps_pos, neg as ps_neg, case when rn >= 60 then case when ph > pl then (least(greatest(pos, pl), ph) - pl) / (ph - pl) else 0.5 end end as ps_pos_norm, case when rn >= 60 then case when nh > nl then (least(greatest(neg, nl), nh) - nl) / (nh - nl) else 0.5 end end as ps_neg_norm,
  strength as ps_strength, threshold as ps_threshold, cast(strength > threshold as integer) as ps_is_spike
  from v, lateral (select list_sum(list_transform(range(-10, 11), lambda i: pow(i * i - 110.0 / 3, 2))) as s2) z, lateral (select list_sum(list_transform(cs, lambda y, i: y * ((i - 11) * (i - 11) - 110.0 / 3))) / s2 as g, list_sum(list_transform(cs, lambda y: (y - mc) * (y - mc))) as sst) q)"""
