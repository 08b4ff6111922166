"""Signals, positions and the ledger as table jobs."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ops
from ..functions.scalars import quantize
from ..schema import KEY, TIME
from .carried import folded, scanned
from .totals import running


DAY = 86_400_000
#: Decimal places at which indicators are compared.
PLACES = 9


def dmi_signals(df: DataFrame, threshold: float = 25.0, peak: float = 70.0) -> DataFrame:
    """entry (1, -1, 0): ADXR comes over the threshold with ADX above it, on the side of the larger DI while the other
    doesn't rise. exit_long, exit_short: the DIs have turned against the side while ADX is over the threshold and rises,
    ADX falls from over the peak, or ADX and ADXR fall with ADX the lower. False and 0 where a value is missing; the values
    before the first bar that has any are that bar's own. Values are compared at PLACES places, as sums of moving windows
    differ in their last bits."""
    names = ("adx", "adxr", "pdi", "mdi")
    kept = df.columns
    df = df.withColumns({f"_now_{c}": F.round(c, PLACES) for c in names})
    df = df.withColumns({f"_{c}": F.coalesce(ops.delay(f"_now_{c}"), F.col(f"_now_{c}")) for c in names})
    adx, adxr, pdi, mdi = (F.col(f"_now_{c}") for c in names)
    cross = (F.col("_adxr") < threshold) & (adxr > threshold) & (adx > adxr)
    entry = F.when(cross & (pdi > mdi) & (mdi <= F.col("_mdi")), 1).when(cross & (pdi < mdi) & (pdi <= F.col("_pdi")), -1).otherwise(0)
    rising, falling = (adx > threshold) & (adx > F.col("_adx")), adx < F.col("_adx")
    tired = ((adx > peak) & falling) | ((adx < adxr) & (adxr < F.col("_adxr")) & falling)
    no = F.lit(False)
    out = {"entry": entry, "exit_long": F.coalesce((pdi < mdi) & rising, no) | F.coalesce(tired, no), "exit_short": F.coalesce((pdi > mdi) & rising, no) | F.coalesce(tired, no)}
    return df.withColumns(out).select(*[c for c in kept if c not in out], *out)


def hold_positions(df: DataFrame) -> DataFrame:
    """entry (1, -1, 0), exit_long and exit_short to the position held after each bar; an entry while holding is ignored.
    The next event depends on the position, so this is a scan of each series, with the position carried along."""
    return scanned(df, "position int", _Hold, ["entry", "exit_long", "exit_short"])


class _Hold:
    def __init__(self):
        self.now = 0

    def feed(self, rows):
        out = []
        for entry, long, short in zip(*(rows[c].tolist() for c in ("entry", "exit_long", "exit_short"))):
            if self.now:
                self.now = 0 if (long if self.now > 0 else short) else self.now
            else:
                self.now = int(entry)
            out.append(self.now)
        return {"position": out}


def backtest(df: DataFrame, amount: float = 100_000.0, leverage: float = 1.0, fee: float = 0.0) -> DataFrame:
    """Equity at each close of positions taken at the close before: compounded returns less a fee on each change."""
    held, r = F.coalesce(ops.delay("position"), F.lit(0)), F.coalesce(ops.returns(), F.lit(0.0))
    cost = fee * F.abs(F.col("position") - held)
    df = df.withColumns({"_s": F.greatest(1 + leverage * held * r - cost, F.lit(1e-9))})
    return df.withColumn("equity", amount * F.exp(F.sum(F.ln("_s")).over(ops.U()))).drop("_s")


def fills(orders: DataFrame, slippage: float = 0.0, fee_kind: str = "ratio", fee: float = 0.0005, places: int = 4, seed: int = 42) -> DataFrame:
    """Execution price within 1 +- slippage, size rounded toward zero, and the fee, negative."""
    price = F.col("price") * (1 + slippage * (2 * F.rand(seed) - 1)) if slippage else F.col("price")
    orders = orders.withColumn("fill_price", price).withColumn("fill_size", quantize(F.col("amount") / F.col("fill_price"), places, 2).cast("double"))
    charge = {"none": F.lit(0.0), "fixed": F.lit(-fee), "ratio": -fee * F.col("fill_price") * F.col("fill_size"), "unit": -fee * F.col("fill_size")}[fee_kind]
    return orders.withColumn("fee", charge)


def first_exit(positions: DataFrame, bars: DataFrame, stop: float = 0.05, target: float = 0.1, horizon: int | None = None) -> DataFrame:
    """For each open position (position_id, symbol, side, cost, opened) the first later bar at which stop or target is hit.
    With a horizon (ms) the join is on time buckets of that length, so that a position meets only the bars of two buckets;
    without one, positions are carried along the bars of their symbol until they are left."""
    if not horizon:
        return _carried_exits(positions, bars, lambda: _Exits(stop, target))
    p = positions.withColumn("_b", F.explode(F.array(F.floor(F.col("opened") / horizon), F.floor(F.col("opened") / horizon) + 1)))
    b = bars.withColumn("_b", F.floor(F.col(TIME) / horizon)).select("symbol", "_b", TIME, "close")
    j = p.join(b, ["symbol", "_b"]).filter((F.col(TIME) > F.col("opened")) & (F.col(TIME) <= F.col("opened") + horizon))
    move = F.col("side") * (F.col("close") / F.col("cost") - 1)
    hit = F.when(move <= -stop, "stop").when(move >= target, "target")
    j = j.withColumn("exit_hit", hit).filter("exit_hit is not null")
    return j.groupBy("position_id").agg(F.min(TIME).alias("exit_time"), F.min_by("exit_hit", TIME).alias("exit_hit"), F.min_by("close", TIME).alias("exit_price"))


def retention(gain: Column, reserve: float, keep: float, small: float, large: float) -> Column:
    """Share of a gain that is kept: `reserve` up to the small gain, `keep` from the large one, between them by the square
    of the way."""
    way = (gain - small) / (large - small) if large > small else F.lit(1.0)
    between = reserve + (keep - reserve) * way * way
    return F.when(gain <= small, F.lit(reserve)).when(gain >= large, F.lit(keep)).otherwise(F.greatest(F.least(between, F.lit(max(reserve, keep))), F.lit(min(reserve, keep))))


def _carried_exits(positions: DataFrame, bars: DataFrame, begin) -> DataFrame:
    """Exits of positions that are carried along the bars of their symbol; a bar at the time of opening isn't met."""
    kind = positions.schema["position_id"].dataType.simpleString()
    p = positions.select("symbol", F.col("opened").alias("_t"), F.lit(1).alias("_k"), "position_id", F.col("side").cast("double").alias("side"), F.col("cost").cast("double").alias("cost"))
    rows = p.unionByName(bars.select("symbol", F.col(TIME).alias("_t"), F.lit(0).alias("_k"), F.col("close").cast("double").alias("close")), allowMissingColumns=True)
    out = f"position_id {kind}, exit_time long, exit_hit string, exit_price double"
    return folded(rows, out, begin, ["_t", "_k", "position_id", "side", "cost", "close"], ["symbol"], ["_t", "_k"]).drop("symbol")


class _Exits:
    """Open positions of a symbol: left at the first close beyond stop or target."""

    def __init__(self, stop: float, target: float):
        self.stop, self.target = stop, target
        self.ids: list = []
        self.state = np.zeros((4, 0))  # side, cost, best gain since the target, line

    def left(self, x: np.ndarray) -> list[tuple[np.ndarray, str]]:
        return [(x <= -self.stop, "stop"), (x >= self.target, "target")]

    def feed(self, rows):
        out, new = [], []
        for t, is_position, position, side, cost, close in zip(*(rows[c].tolist() for c in ("_t", "_k", "position_id", "side", "cost", "close"))):
            if is_position:
                self.ids.append(position)
                new.append((side, cost, np.nan, -np.inf))
                continue
            if new:
                self.state, new = np.concatenate([self.state, np.array(new).T], axis=1), []
            if not self.ids:
                continue
            gone = np.zeros(len(self.ids), bool)
            for hit, name in self.left(self.state[0] * (close / self.state[1] - 1)):
                out += [{"position_id": self.ids[i], "exit_time": t, "exit_hit": name, "exit_price": close} for i in np.flatnonzero(hit & ~gone)]
                gone |= hit
            if gone.any():
                self.ids, self.state = [p for p, g in zip(self.ids, gone) if not g], self.state[:, ~gone]
        if new:
            self.state = np.concatenate([self.state, np.array(new).T], axis=1)
        return out

    def end(self):
        return []


class _Trail(_Exits):
    """Left at a stop before the target, and after it when the close comes to the line below the best gain."""

    def __init__(self, stop, target, reserve, keep, small, large):
        super().__init__(stop, target)
        self.shares = reserve, keep, small, large

    def left(self, x):
        reserve, keep, small, large = self.shares
        _, _, best, line = self.state
        past = ~np.isnan(best)
        stopped = ~past & (x <= -self.stop)
        since = past | (~stopped & (x >= self.target))
        best[since] = np.fmax(best, x)[since]
        way = (best - small) / (large - small) if large > small else np.ones(len(best))
        share = np.clip(reserve + (keep - reserve) * way * way, min(reserve, keep), max(reserve, keep))
        share = np.where(best <= small, reserve, np.where(best >= large, keep, share))
        line[since] = np.fmax(line, best * share)[since]
        return [(stopped, "stop"), (past & (x <= line), "trail")]


def trailing_exit(positions: DataFrame, bars: DataFrame, horizon: int | None = None, stop: float = 0.02, target: float = 0.05, reserve: float = 0.6, keep: float | None = None, small: float = 0.05, large: float = 0.15) -> DataFrame:
    """(position_id, exit_time, exit_hit, exit_price) of open positions (position_id, symbol, side 1 or -1, cost, opened)
    within `horizon` ms, or at any time: a stop before the target is reached; after that, a line that keeps a share of the best
    gain so far and never falls back, left when the close comes to it. The bar that reaches the target is no exit. With a
    horizon, positions meet the bars of two time buckets, and the rest are running extremes of each position; without one,
    they are carried along the bars of their symbol until they are left."""
    if not horizon:
        return _carried_exits(positions, bars, lambda: _Trail(stop, target, reserve, reserve if keep is None else keep, small, large))
    p = positions.withColumn("_b", F.explode(F.array(F.floor(F.col("opened") / horizon), F.floor(F.col("opened") / horizon) + 1)))
    b = bars.withColumn("_b", F.floor(F.col(TIME) / horizon)).select("symbol", "_b", TIME, "close")
    j = p.join(b, ["symbol", "_b"]).filter((F.col(TIME) > F.col("opened")) & (F.col(TIME) <= F.col("opened") + horizon))
    j = j.withColumn("_x", F.col("side") * (F.col("close") / F.col("cost") - 1))
    whole = Window.partitionBy("position_id")
    so_far = whole.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumns({"_stop": F.min(F.when(F.col("_x") <= -stop, F.col(TIME))).over(whole), "_break": F.min(F.when(F.col("_x") >= target, F.col(TIME))).over(whole)})
    stopped = F.col("_stop").isNotNull() & (F.col("_break").isNull() | (F.col("_stop") < F.col("_break")))
    j = j.withColumn("_best", F.when(~stopped & (F.col(TIME) >= F.col("_break")), F.max(F.when(F.col(TIME) >= F.col("_break"), F.col("_x"))).over(so_far)))
    j = j.withColumn("_line", F.max(F.col("_best") * retention(F.col("_best"), reserve, reserve if keep is None else keep, small, large)).over(so_far))
    hit = F.when(stopped & (F.col(TIME) == F.col("_stop")), "stop").when(~stopped & (F.col(TIME) > F.col("_break")) & (F.col("_x") <= F.col("_line")), "trail")
    j = j.withColumn("exit_hit", hit).filter("exit_hit is not null")
    return j.groupBy("position_id").agg(F.min(TIME).alias("exit_time"), F.min_by("exit_hit", TIME).alias("exit_hit"), F.min_by("close", TIME).alias("exit_price"))


def virtual_profits(orders: DataFrame) -> DataFrame:
    """Closing orders (position_id, seq, side 1 or -1, is_open, price, size) with the profit of what they close: the newest
    openings first. An opening that several orders close has the mean price of its closings so far. A scan of each
    position's orders that carries what is open; what is more than was opened closes nothing."""
    return scanned(orders, "virtual_pnl double", _Newest, ["side", "is_open", "price", "size"], ["position_id"], "seq").filter("not is_open")


class _Newest:
    def __init__(self):
        self.held: list[list[float]] = []  # cost, open size, closed size, mean closing price

    def feed(self, rows):
        out = []
        for side, is_open, price, size in zip(*(rows[c].tolist() for c in ("side", "is_open", "price", "size"))):
            left, pnl = abs(size), 0.0
            if is_open:
                self.held.append([price, size, 0.0, 0.0])
                left = 0.0
            while left > 0 and self.held:
                v = self.held[-1]
                part = min(left, v[1])
                if part > 0:
                    v[1], v[2] = v[1] - part, v[2] + part
                    v[3] += (price - v[3]) * part / v[2]
                    pnl += side * (v[3] - v[0]) * part
                    left -= part
                if v[1] <= 0:
                    self.held.pop()
            out.append(pnl)
        return {"virtual_pnl": out}


def profit_control(events: DataFrame, most_loss: float = 10.0, losses: int = 3, recovery: float = 5.0, wins: int = 2, hours: float = 24.0) -> DataFrame:
    """Signals of (strategy, time, profit) with whether they may trade: profit is null for a signal, a closed trade's profit
    ratio otherwise. Losses of more than `most_loss` percent, or so many in a row, pause the strategy; profits of
    `recovery` percent since then, so many wins in a row, or a signal `hours` after (0: never) resume it. At one time
    trades come before signals. A scan of each strategy's events with what it has lost and won carried along."""
    rows = scanned(events.withColumn("_s", F.col("profit").isNull()), "allowed boolean", lambda: _Control(most_loss, losses, recovery, wins, hours), ["time", "profit"], ["strategy"], ["time", "_s"])
    return rows.drop("_s").filter("profit is null")


class _Control:
    def __init__(self, most_loss, losses, recovery, wins, hours):
        self.limits = most_loss, losses, recovery, wins, hours
        self.resume()
        self.since = 0

    def resume(self):
        self.paused, self.lost, self.row, self.back, self.won = False, 0.0, 0, 0.0, 0

    def step(self, now, p) -> bool:
        most_loss, losses, recovery, wins, hours = self.limits
        if p != p:
            if self.paused and hours > 0 and now - self.since >= hours * 3_600_000:
                self.resume()
            return not self.paused
        if self.paused:
            self.back, self.won = self.back + 100 * p, self.won + 1 if p > 0 else 0
            if self.back >= recovery or self.won >= wins:
                self.resume()
        elif p < 0:
            self.lost, self.row = self.lost - 100 * p, self.row + 1
            if self.lost > most_loss or self.row >= losses:
                self.paused, self.since, self.back, self.won = True, now, 0.0, 0
        else:
            self.lost, self.row = 0.0, 0
        return True

    def feed(self, rows):
        profit = rows["profit"].astype(float).tolist()
        return {"allowed": [self.step(t, p) for t, p in zip(rows["time"].tolist(), profit)]}


def order_deltas(log: DataFrame) -> DataFrame:
    """Changes between an order's cumulative states (order_id, arrival, size, amount, fee); a state that comes late with a
    smaller size is dropped."""
    w = Window.partitionBy("order_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("_max", F.coalesce(F.max("size").over(w), F.lit(0.0))).filter(F.col("size") >= F.col("_max"))
    by = Window.partitionBy("order_id").orderBy("arrival")
    return log.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0.0)) for c in ("size", "amount", "fee")}).drop("_max")


def positions(log: DataFrame) -> DataFrame:
    """Order changes to positions: sizes opened and left, cost and close prices, profit, fees."""
    d = order_deltas(log)
    opened, closed = F.when(F.col("is_open"), F.col("d_size")), F.when(~F.col("is_open"), F.col("d_size"))
    o_amt, c_amt = F.when(F.col("is_open"), F.col("d_amount")), F.when(~F.col("is_open"), F.col("d_amount"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    p = d.groupBy("position_id").agg(zero(opened).alias("total_size"), zero(closed).alias("closed_size"), zero(o_amt).alias("total_amount"), zero(c_amt).alias("back_amount"), F.sum("d_fee").alias("fee"), F.max("side").alias("side"))
    p = p.withColumns({"cost_price": F.try_divide("total_amount", "total_size"), "close_price": F.try_divide("back_amount", "closed_size"), "size_left": F.col("total_size") - F.col("closed_size")})
    return p.withColumns({"pnl": F.col("side") * F.coalesce(F.col("closed_size") * (F.col("close_price") - F.col("cost_price")), F.lit(0.0)), "is_closed": F.abs("size_left") < 1e-9})


def mark(p: DataFrame, bars: DataFrame, at: str = "asof", block: int = DAY) -> DataFrame:
    """Each row of p (symbol, asof) with the close of the last bar at or before its time: union and carry forward, in blocks of
    time. A row or a bar without symbol or time meets none; a bar without a close leaves none."""
    b = bars.filter(F.col("symbol").isNotNull() & F.col(TIME).isNotNull()).select("symbol", F.col(TIME).alias("_t"), F.struct("close").alias("_c"), F.lit(0).alias("_k"))
    rest = p.drop("mark_price").withColumns({"_t": F.col(at), "_k": F.lit(1)})
    u = rest.unionByName(b, allowMissingColumns=True)
    u = running(u, ["symbol"], ["_t", "_k"], block, lasts={"_last": F.col("_c")}).filter("_k = 1")
    return u.withColumn("mark_price", F.when(F.col("_t").isNotNull(), F.col("_last.close"))).drop("_t", "_c", "_k", "_last")


def ledger(entries: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Running balances of an account's entries (account, seq, amount); `block` numbers of seq are summed at a time."""
    rows = running(entries, ["account"], ["seq"], block, sums={"balance_after": F.col("amount")})
    return rows.withColumn("balance_before", F.col("balance_after") - F.col("amount"))


def account_entries(deposits: DataFrame, freezes: DataFrame, orders: DataFrame) -> DataFrame:
    """What moves on each account: (account, seq, step, kind, signal_id, asset_key, available, frozen).

    deposits (account, seq, amount): deposit, or withdraw for a negative amount. freezes (account, seq, signal_id, asset_key,
    amount): the amount goes from available to frozen. orders (account, seq, signal_id, asset_key, is_open, is_failed,
    is_fake, settle_amount, fee): one that opens releases its asset's freeze of the same signal, and only if exactly one is
    held, is settled out of available money unless it failed; one that closes is settled into it. Settlements are of amounts over zero; fees
    are added as they are signed. Fake orders move nothing. Nulls count as zero or false.
    """
    zero, no = (lambda c: F.coalesce(F.col(c), F.lit(0.0))), (lambda c: F.coalesce(F.col(c), F.lit(False)))
    asset = ["account", "signal_id", "asset_key"]
    real = orders.filter(~no("is_fake"))
    held = freezes.select(*asset, "seq", zero("amount").alias("amount"), F.lit(True).alias("is_freeze")).unionByName(real.filter(no("is_open")).select(*asset, "seq", F.lit(False).alias("is_freeze")), allowMissingColumns=True)
    w = Window.partitionBy(*asset).orderBy("seq")
    held = held.withColumns({"_after": F.coalesce(F.lag("is_freeze").over(w), F.lit(False)), "_held": F.lag("amount").over(w)})
    # two freezes without an order between them can't be told apart any more: nothing is released from then on
    held = held.withColumn("_stuck", F.max(F.col("is_freeze") & F.col("_after")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    released = held.filter(~F.col("is_freeze") & F.col("_after") & ~F.col("_stuck")).select(*asset, "seq", F.col("_held").alias("amount"))
    done = real.join(released.select(*asset, "seq"), [*asset, "seq"], "left_semi").filter(~no("is_failed")).unionByName(real.filter(~no("is_open")))

    def rows(df, step, kind, available, frozen=None, keys=("signal_id", "asset_key")):
        found = [F.col(k).cast("string").alias(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("signal_id", "asset_key")]
        return df.select("account", "seq", F.lit(step).alias("step"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), *found, available.alias("available"), (F.lit(0.0) if frozen is None else frozen).alias("frozen"))

    settled = F.when(no("is_open"), -F.col("settle_amount")).otherwise(F.col("settle_amount"))
    parts = [
        rows(deposits, 0, F.when(zero("amount") > 0, "deposit").otherwise("withdraw"), zero("amount"), keys=()),
        rows(freezes, 0, "freeze", -zero("amount"), zero("amount")),
        rows(released, 0, "unfreeze", F.col("amount"), -F.col("amount")),
        rows(done.filter(zero("settle_amount") > 0), 1, "trade", settled),
        rows(done.filter(zero("fee") != 0), 2, "fee", F.col("fee")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def account_balances(entries: DataFrame, block: int = 1 << 20) -> DataFrame:
    """entries of account_entries() with the account's available, frozen and total balance after each."""
    rows = running(entries, ["account"], ["seq", "step"], block, sums={"available_after": F.col("available"), "frozen_after": F.col("frozen")})
    return rows.withColumn("total_after", F.col("available_after") + F.col("frozen_after"))


def time_window(signals: DataFrame, times: DataFrame, before: int, after: int) -> DataFrame:
    """Without opening signals within so many seconds of a listed time (ms); times are joined by buckets of the range."""
    size = (before + after) * 1000 + 1
    t = times.select(F.col("at"), F.explode(F.array(F.floor((F.col("at") - before * 1000) / size), F.floor((F.col("at") + after * 1000) / size))).alias("_b"))
    s = signals.withColumn("_b", F.floor(F.col("time") / size))
    near = (s["_b"] == t["_b"]) & (s["time"] >= t["at"] - before * 1000) & (s["time"] <= t["at"] + after * 1000) & s["is_open"]
    return s.join(t, near, "left_anti").drop("_b")


def rate_limit(signals: DataFrame, hours: float, most: int) -> DataFrame:
    """At most so many accepted signals in the last hours of an instance; rejected ones don't count, so this is a scan. A
    pause of that length forgets all before it, so the scans are of the stretches between pauses, not of whole instances;
    signals of equal time go by their other columns."""
    span = hours * 3_600_000
    rest = [c for c in signals.columns if c not in ("instance", "time")]
    order = Window.partitionBy("instance").orderBy("time", *rest)
    pause = F.when(F.col("time") - F.lag("time").over(order) < span, 0).otherwise(1)
    parts = signals.withColumn("_new", pause).withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["time", *rest], kind="stable")
        taken, keep = [], []
        for now in t["time"]:
            taken = [x for x in taken if now - x < span]
            keep.append(len(taken) < most)
            if keep[-1]:
                taken.append(now)
        return t[keep].drop(columns="_part")

    return parts.groupBy("instance", "_part").applyInPandas(run, signals.schema)


def profit_ratios(assets: DataFrame) -> DataFrame:
    """Of each execution that closes something: actual and virtual profit of its closing assets by their amount; without an
    amount there is no row."""
    shut = assets.filter(~F.col("is_open"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    g = shut.groupBy("execution_id").agg(F.sum(zero("actual_pnl") + zero("virtual_pnl")).alias("pnl"), F.sum("amount").alias("close_amount"))
    return g.filter("close_amount > 0").withColumn("profit_ratio", F.col("pnl") / F.col("close_amount"))


def totals(p: DataFrame, by: list[str]) -> DataFrame:
    """Sums of positions by any attributes, and each group's share of the whole amount."""
    g = p.groupBy(*by).agg(F.sum("pnl").alias("pnl"), F.sum("fee").alias("fee"), F.sum("total_amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.try_divide("amount", F.sum("amount").over(Window.partitionBy())))


def exit_rule(p: DataFrame, bars: DataFrame, rule: Column) -> DataFrame:
    """First bar after the opening at which a rule over position and bar columns holds."""
    j = p.join(bars.select("symbol", TIME, "close", "high", "low"), "symbol").filter((F.col(TIME) > F.col("opened")) & rule)
    return j.groupBy("position_id").agg(F.min(TIME).alias("exit_time"))
