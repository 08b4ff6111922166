"""SQL of merged bars, fractals, strokes, zones and the sequential count: one row after the other by a recursive table expression."""
from __future__ import annotations

_ORD = "(partition by symbol order by start_time)"


def merged_tables(bars: str) -> str:
    """Up to the table m of merged bars (symbol, seq, ...) of the bars that the SQL `bars` gives."""
    return f"""with recursive b as ({bars}),
t as (select symbol, start_time, high, low, row_number() over {_ORD} as rn from b),
s as (select symbol, rn, start_time, 0 as seq, high as h, low as l, true as up, high as own_high, low as own_low from t where rn = 1
  union all select t.symbol, t.rn, t.start_time, s.seq + i.apart, case when i.apart = 1 then high when s.up then greatest(h, high) else least(h, high) end, case when i.apart = 1 then low when s.up then greatest(l, low) else least(l, low) end,
    case when i.apart = 1 then h < high else s.up end, high, low
  from s join t on t.symbol = s.symbol and t.rn = s.rn + 1, lateral (select case when (h >= high and l <= low) or (h <= high and l >= low) then 0 else 1 end as apart) i),
m as (select symbol, seq, min(start_time) as start_time, max(start_time) as end_time, arg_max(h, rn) as high, arg_max(l, rn) as low, any_value(up) as rising, count(*) as n_bars,
  arg_min(start_time, row(-own_high, rn)) as high_time, arg_min(start_time, row(own_low, rn)) as low_time, seq < max(seq) over (partition by symbol) as is_finished from s group by symbol, seq)"""


def fractal_sql(bars: str) -> str:
    w = "(partition by symbol order by seq)"
    return f"""{merged_tables(bars)},
n as (select *, lag(high) over {w} as h0, lag(low) over {w} as l0, lead(high) over {w} as h2, lead(low) over {w} as l2 from m),
f as (select *, case when h0 <= high and high >= h2 then 'top' when l0 >= low and low <= l2 then 'bottom' end as fractal from n)
select symbol, cast(seq as bigint) as seq, start_time, end_time, cast(high as float) as high, cast(low as float) as low, rising, n_bars, high_time, low_time, is_finished, fractal,
  case fractal when 'top' then h0 < low when 'bottom' then l0 > high end as gap from f"""


def sequence_sql(bars: str) -> str:
    """With the parameters that the operator takes by default."""
    setup = lambda less: f"case when rn >= 17 then count(*) filter ({less}) over (partition by symbol order by start_time rows between 12 preceding and 4 preceding) = 9 when rn >= 13 then count(*) filter ({less} and rn between 5 and 13) over {_ORD} = 9 else false end"
    since = "over (partition by symbol order by start_time rows between 12 preceding and current row)"
    turn = "case when abs(c.n) = 13 and t.rn > 5 and case when c.side > 0 then low >= c4 else high <= c4 end then 2 * c.n else c.n end"
    return f"""with recursive b as ({bars}),
t0 as (select symbol, start_time, high, low, close, row_number() over {_ORD} as rn, lag(close, 4) over {_ORD} as c4, lag(low, 2) over {_ORD} as l2, lag(high, 2) over {_ORD} as h2,
  lag(low) over {_ORD} as la, lag(low, 3) over {_ORD} as lc, lag(high) over {_ORD} as ha, lag(high, 3) over {_ORD} as hc from b),
t1 as (select *, {setup('close < c4')} as buys, {setup('close > c4')} as sells, max(high) filter (rn >= 5) {since} as top, min(low) filter (rn >= 5) {since} as bottom from t0),
t as (select *, case when buys then greatest(low, la) > greatest(l2, lc) else false end as buy, case when buys then false when sells then least(high, ha) < least(h2, hc) else false end as sell from t1),
s as (select symbol, rn, start_time, 0 as n, 0 as side, null::double as stop from t where rn = 1
  union all select t.symbol, t.rn, t.start_time, case when buy or sell or ended then 0 when a.side = 0 or abs(a.n) > 13 then a.n else r.n end, case when buy then 1 when sell then -1 when ended then 0 else a.side end, case when buy then top when sell then bottom when ended then null else a.stop end
  from s a join t on t.symbol = a.symbol and t.rn = a.rn + 1, lateral (select coalesce(a.side <> 0 and abs(a.n) <= 13 and a.side * (close - a.stop) >= 0, false) as ended) e,
  lateral (select a.n - case when abs(a.n) < 13 and t.rn > 2 and case when a.side > 0 then close < l2 else close >= h2 end then a.side else 0 end as n, a.side as side) c, lateral (select {turn} as n) r)
select symbol, start_time, n as td_count from s"""


def _carries(m: str, a: str, b: str, up: str) -> str:
    """Whether the merged bars m from place a to b (from 1) make a stroke."""
    x, y = f"{m}[{a}]", f"{m}[{b}]"
    top, bottom = (f"{pick}(list_transform({m}[{a}:{b}], lambda v: v.{c}))" for pick, c in (("list_max", "h"), ("list_min", "l")))
    holds = f"(({x}.h >= {y}.h and {x}.l <= {y}.l) or ({x}.h <= {y}.h and {x}.l >= {y}.l))"
    return f"({b} - {a} >= 4 and not {holds} and case when {up} then {y}.h >= {top} and {x}.l <= {bottom} else {y}.l <= {bottom} and {x}.h >= {top} end)"


def stroke_tables(bars: str) -> str:
    """Up to the table k of finished strokes of the bars that the SQL `bars` gives. m: merged bars of the stroke at hand; e: the
    place of its end, 0 for none; j: whether the newest merged bar is in m."""
    new = "struct_pack(h := t.high, l := t.low, th := t.high, tl := t.low, ht := t.start_time, lt := t.start_time, up := {up}, closed := false)"
    grown = """struct_pack(h := case when c.up then greatest(c.h, t.high) else least(c.h, t.high) end, l := case when c.up then greatest(c.l, t.low) else least(c.l, t.low) end, th := greatest(c.th, t.high), tl := least(c.tl, t.low),
      ht := case when t.high > c.th then t.start_time else c.ht end, lt := case when t.low < c.tl then t.start_time else c.lt end, up := c.up, closed := false)"""
    shut = "struct_pack(h := v.h, l := v.l, th := v.th, tl := v.tl, ht := v.ht, lt := v.lt, up := v.up, closed := true)"
    tops, bottoms = (lambda m, c="h": f"list_max(list_transform({m}, lambda v: v.{c}))"), (lambda m, c="l": f"list_min(list_transform({m}, lambda v: v.{c}))")
    return f"""with recursive b as ({bars}),
t as (select symbol, start_time, high, low, row_number() over {_ORD} as rn from b),
s as (select symbol, rn, {new.format(up="true")} as c, false as j, [{new.format(up="true")}][1:0] as m, null::boolean as up, null::double as hi, null::double as lo, 0 as e, null::boolean as done, [{new.format(up="true")}][1:0] as was, null::double as was_hi, null::double as was_lo from t where rn = 1
  union all select p.symbol, t.rn, g.c, t.rn > 2 and (p.j or not i.inside), case when w.split then x.m[z.e - 1:] else x.m end, case when w.split then not x.up when w.passed then null else x.up end,
    case when w.split then case when x.up then z.m[z.e].h else {tops("z.m[z.e - 1:]")} end when w.tip and x.up then x.m[len(x.m)].h else x.hi end,
    case when w.split then case when x.up then {bottoms("z.m[z.e - 1:]")} else z.m[z.e].l end when w.tip and not x.up then x.m[len(x.m)].l else x.lo end,
    case when w.split then len(x.m) - z.e + 2 when w.passed then 0 else z.e end, case when w.split then x.up end, case when w.split then x.m[:z.e + 1] end, case when x.up then z.m[z.e].h else x.m[2].h end, case when x.up then x.m[2].l else z.m[z.e].l end
  from s p join t on t.symbol = p.symbol and t.rn = p.rn + 1,
  lateral (select (p.c.h >= t.high and p.c.l <= t.low) or (p.c.h <= t.high and p.c.l >= t.low) as inside) i,
  lateral (select case when i.inside then {grown.replace("c.", "p.c.")} else {new.format(up="p.c.h < t.high")} end as c) g,
  lateral (select case when t.rn = 2 then p.m when i.inside then case when p.j then list_append(p.m[:-2], g.c) else p.m end else list_append(case when p.j then list_transform(p.m, lambda v: {shut}) else p.m end, g.c) end as m) a,
  lateral (select list_filter(a.m, lambda v: v.closed)[-3:] as f) f0,
  lateral (select p.up is null and len(f) = 3 as look, coalesce(len(f) = 3 and f[1].h < f[2].h and f[2].h > f[3].h, false) as top, coalesce(len(f) = 3 and f[1].l > f[2].l and f[2].l < f[3].l, false) as bottom) q,
  lateral (select case when q.look then list_concat(f, list_filter(a.m, lambda v: not v.closed)) else a.m end as m, case when q.look then case when q.bottom then true when q.top then false end else p.up end as up,
    case when q.look and q.bottom then {tops("a.m")} when q.look and q.top then f[2].h else p.hi end as hi, case when q.look and q.bottom then f[2].l when q.look and q.top then {bottoms("a.m")} else p.lo end as lo) x,
  lateral (select x.up is not null and len(x.m) >= 6 as on_, len(x.m) as n) y,
  lateral (select coalesce(y.on_ and p.e = 0 and case when x.up then x.lo > {bottoms("x.m")} else x.hi < {tops("x.m")} end, false) as passed,
    coalesce(y.on_ and p.e > 0 and p.e <> y.n and case when x.up then x.m[y.n].h > x.m[p.e].h else x.m[y.n].l < x.m[p.e].l end, false) as tip) w0,
  lateral (select case when not y.on_ or w0.passed then p.e when p.e = 0 then coalesce(list_filter(range(6, y.n + 1), lambda i: {_carries("x.m", "2", "i", "x.up")})[1], 0) when w0.tip then y.n else p.e end as e, x.m as m) z,
  lateral (select w0.passed, w0.tip, coalesce(y.on_ and p.e > 0 and {_carries("x.m", "z.e", "y.n", "not x.up")}, false) as split) w),
k as (select symbol, row_number() over (partition by symbol order by rn) - 1 as seq, done as rising, case when done then was[2].lt else was[2].ht end as start_time, case when done then was[-2].ht else was[-2].lt end as end_time,
  case when done then was[2].l else was[2].h end as start_value, case when done then was[-2].h else was[-2].l end as end_value, was_hi as high, was_lo as low, len(was) as n_merged from s where done is not null)"""


def stroke_sql(bars: str) -> str:
    return f"""{stroke_tables(bars)}
select symbol, seq, start_time, end_time, rising, cast(start_value as float) as start_value, cast(end_value as float) as end_value, cast(high as float) as high, cast(low as float) as low, n_merged from k"""


def zone_sql(bars: str) -> str:
    """Zones of the strokes: a leg is taken in, then zones are made and broken one step at a time."""
    return f"""{stroke_tables(bars)},
d as (select symbol, seq, start_time as s, end_time as e, high as h, low as l, max(seq) over (partition by symbol) as last_seq from k),
z as (select symbol, seq, last_seq, 0 as step, [struct_pack(s := s, e := e, h := h, l := l)] as legs, null::double as high, null::double as low, false as busy from d where seq = 0
  union all select z.symbol, coalesce(d.seq, z.seq), z.last_seq, z.step + 1, case when not z.busy then list_append(legs, struct_pack(s := d.s, e := d.e, h := d.h, l := d.l)) when gone then legs[2:] else legs end,
    case when not z.busy then z.high when gone or len(legs) < 3 then null else coalesce(z.high, top) end, case when not z.busy then z.low when gone or len(legs) < 3 then null else coalesce(z.low, bottom) end, not z.busy or (len(legs) >= 3 and (z.high is null and top > bottom or z.high is not null and gone))
  from z left join d on d.symbol = z.symbol and d.seq = z.seq + 1 and not z.busy,
  lateral (select list_min(list_transform(legs[:3], lambda v: v.h)) as top, list_max(list_transform(legs[:3], lambda v: v.l)) as bottom) n,
  lateral (select z.busy and len(legs) >= 3 and case when z.high is null then top <= bottom else len(list_filter(legs[4:], lambda v: v.l > z.high or v.h < z.low)) > 0 end as gone) g
  where z.busy or d.seq is not null),
seen as (select *, legs[1].s as start_time, list_filter(range(5, len(legs) + 1), lambda i: (low < legs[i].l and legs[i].l < high) or (low < legs[i].h and legs[i].h < high))[-1] as inside from z where not busy and high is not null),
best as (select symbol, start_time, max(step) as step, arg_max(case when inside is null then legs[-1].e else legs[inside - 1].e end, step) as end_time, arg_max(high, step) as high, arg_max(low, step) as low, arg_max(len(legs), step) as n_legs from seen group by symbol, start_time),
live as (select symbol, arg_max(high, step) is not null or arg_max(busy, step) as alive from z group by symbol)
select symbol, row_number() over w - 1 as seq, start_time, end_time, cast(high as float) as high, cast(low as float) as low, n_legs, not alive or lead(step) over w is not null as is_finished from best join live using (symbol) window w as (partition by symbol order by start_time)"""


def hurst_sql(bars: str) -> str:
    """With the parameters that the operator takes by default; all closes are positive."""
    return f"""with recursive b as ({bars}),
r as (select symbol, start_time, row_number() over {_ORD} as rn, ln(close / lag(close) over {_ORD}) as x from b),
w as (select symbol, start_time, rn, list(x) over (partition by symbol order by start_time rows between 99 preceding and current row) as xs from r),
l as (select symbol, start_time, list_filter(xs, lambda v: v is not null) as xs, len(list_filter(xs, lambda v: v is not null)) as n from w where rn >= 20),
size as (select 10 as k, 0 as i union all select cast(floor(k * 1.5) as integer), i + 1 from size where k < 100),
steps as (select symbol, start_time, k, xs[n - k + 1:] as part from l join size on k <= n where n > 20 union select symbol, start_time, n, xs from l where n >= 20 union select symbol, start_time, 10, xs[n - 9:] from l where n = 20),
each as (select symbol, start_time, k, unnest(part) as x, generate_subscripts(part, 1) as i, list_avg(part) as mean from steps),
path as (select symbol, start_time, k, x - mean as a, sum(x - mean) over (partition by symbol, start_time, k order by i) as c from each),
scaled as (select symbol, start_time, ln(k) as u, ln(greatest((max(c) - min(c)) / case when avg(a * a) > 0 then sqrt(avg(a * a)) else 0.0001 end, 1e-10)) as v from path group by symbol, start_time, k),
h as (select symbol, start_time, regr_slope(v, u) as hurst from scaled group by all)
select b.symbol, b.start_time, cast(hurst as float) as hurst from b left join h on h.symbol = b.symbol and h.start_time = b.start_time"""


def divergence_sql(bars: str, n: int = 60) -> str:
    """With the parameters that the operator takes by default: bars of each window are numbered from the newest, and runs from
    where the side of the histogram turns."""
    both = []
    for s, name in ((1, "top"), (-1, "bottom")):
        peak = "high" if s > 0 else "low"
        both.append(f"""
x_{name} as (select o.symbol, o.start_time as at_, o.rn - p.rn as i, least(o.rn, {n}, o.rn - 33) as size, {s} * p.m as m, {s} * p.dif as dif, {s} * p.dea as dea, {s} * p.close as close, {s} * p.open as open, {s} * p.{peak} as peak
  from o join o p on p.symbol = o.symbol and p.rn between o.rn - {n - 1} and o.rn and p.m is not null where o.m is not null),
t_{name} as (select symbol, at_, max(m) filter (i = 0) as m0, min(dif) filter (i < 3) as d3, arg_max(close < open or peak - close > close - open, row(peak, i)) filter (i < 4) as pushed from x_{name} group by all
  having max(size) >= 10 and max(m) filter (i = 0) < max(m) filter (i = 1) and max(m) filter (i = 1) < max(m) filter (i = 2) and max(m) filter (i = 2) > max(m) filter (i = 3) and min(dif) filter (i < 3) > 0 and max(m) filter (i = 0) >= 0),
s_{name} as (select x.*, pushed, coalesce(last_value(nullif(sign(m), 0) ignore nulls) over (partition by x.symbol, x.at_ order by i), 1) as side from x_{name} x join t_{name} t on t.symbol = x.symbol and t.at_ = x.at_ where i < size - 1),
c_{name} as (select *, case when lag(side) over (partition by symbol, at_ order by i) <> side then 1 else 0 end as turned from s_{name}),
r_{name} as (select *, sum(turned) over (partition by symbol, at_ order by i) as run from c_{name}),
g_{name} as (select symbol, at_, run, any_value(size) as size, any_value(pushed) as pushed, min(i) as begun, count(*) as n, max(close) as close, max(peak) as peak, max(dif) as dif, max(dea) as dea, min(dea) as low, max(m) as m, sum(m) as total, arg_min(m, i) as newest from r_{name} group by symbol, at_, run),
e_{name} as (select symbol, at_, min(run) as run from g_{name} where run >= 2 and run % 2 = 0 and n >= 3 group by all),
v_{name} as (select e.symbol, e.at_ from e_{name} e join g_{name} a on a.symbol = e.symbol and a.at_ = e.at_ and a.run = 0 join g_{name} z on z.symbol = e.symbol and z.at_ = e.at_ and z.run = e.run
  join (select e.symbol, e.at_, min(g.low) as pull, max(g.begun) as begun from e_{name} e join g_{name} g on g.symbol = e.symbol and g.at_ = e.at_ and g.run < e.run and g.run % 2 = 1 group by all) p on p.symbol = e.symbol and p.at_ = e.at_
  where z.size - p.begun > 3 and not (pull < 0 and {'abs(3 * pull) > z.dea' if s > 0 else 'true'}) and z.dea <> 0 and (z.dea - pull) / {'z.dea' if s > 0 else 'abs(z.dea)'} >= 0
    and (case when a.close > z.close then 1 else 0 end + case when a.peak > z.peak then 1 else 0 end) * (case when z.dif <> 0 and abs(a.dif / z.dif) < 0.9 then 1 else 0 end + case when a.total - a.newest < z.total - z.newest and a.m < z.m and a.pushed then 1 else 0 end) >= 1)""")
    return f"""with b as ({bars}),
f as (select *, row_number() over {_ORD} as rn, case when count(close) over f12 >= 12 and count(close) over f26 >= 26 then avg(close) over f12 - avg(close) over f26 end as dif from b
  window f12 as (partition by symbol order by start_time rows between 11 preceding and current row), f26 as (partition by symbol order by start_time rows between 25 preceding and current row)),
e as (select *, case when count(dif) over f9 >= 9 then avg(dif) over f9 end as dea from f window f9 as (partition by symbol order by start_time rows between 8 preceding and current row)),
o as (select *, dif - dea as m from e),{",".join(both)}
select o.symbol, o.start_time, t.at_ is not null as top_divergence, z.at_ is not null as bottom_divergence from o left join v_top t on t.symbol = o.symbol and t.at_ = o.start_time left join v_bottom z on z.symbol = o.symbol and z.at_ = o.start_time"""
