"""Bars as streams."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schema import BAR_SCHEMA, KEY, TIME


def read_stream(spark, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """Landed Parquet bars, with an event timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("event_ts", F.timestamp_millis(TIME))


def without_duplicates(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each finished bar once; what comes later than the watermark is dropped."""
    return stream.filter("is_finished").withWatermark("event_ts", late).dropDuplicatesWithinWatermark([*KEY, TIME])


def merged(stream: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Tumbling merge into larger bars, given when the watermark has passed them."""
    w = F.window("event_ts", size)
    g = stream.withWatermark("event_ts", late).groupBy(*KEY, w.alias("w")).agg(
        F.min_by("open", TIME).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", TIME).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    return g.select(*KEY, F.unix_millis("w.start").alias(TIME), "open", "high", "low", "close", "volume", "amount", "n")


def _ema(n: int):
    def step(state, bar):
        y = bar["close"] if not state else state[0] + 2 / (n + 1) * (bar["close"] - state[0])
        return [y], y

    return step


def _rsi(n: int):
    """State: last close, changes so far, mean gain, mean loss; sums until there are n changes."""

    def step(state, bar):
        c = bar["close"]
        if not state:
            return [c, 0.0, 0.0, 0.0], None
        last, k, gain, loss = state
        up, down = max(c - last, 0.0), max(last - c, 0.0)
        gain, loss = (gain + up / n, loss + down / n) if k < n else ((gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n)
        value = None if k + 1 < n else 100 * gain / (gain + loss) if gain + loss else 0.0
        return [c, k + 1, gain, loss], value

    return step


def _atr(n: int):
    """State: last close, and up to n ranges."""

    def step(state, bar):
        span = bar["high"] - bar["low"]
        tr = span if not state else max(span, abs(bar["high"] - state[0]), abs(bar["low"] - state[0]))
        ranges = [*state[1:], tr][-n:]
        return [bar["close"], *ranges], sum(ranges) / len(ranges)

    return step


STEPS = {"ema": (_ema, 9), "rsi": (_rsi, 14), "atr": (_atr, 14)}
_KEYS = "market string, symbol string, quote_currency string, ins_type int, timeframe string, start_time long"
#: Rows that a state function hands on at once.
CHUNK = 10_000


def _stateful(stream: DataFrame, out: str, held: str, order: list[str], work: Callable, idle: int | None) -> DataFrame:
    """work(key, rows as dictionaries in order, held values or None) yields result rows and returns the new held values. The
    rows of a series in a micro-batch come in frames of no set order and are put in order first. idle: milliseconds without
    a row after which a series' state is given up; without it, states are kept for ever."""
    names = [c.split(" ")[0] for c in out.split(", ")]
    floats = {n: "float64" for n, c in zip(names, out.split(", ")) if c.endswith(" double")}

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        steps = work(key, rows.to_dict("records"), state.get if state.exists else None)
        done, new = [], None
        while True:
            try:
                done.append(next(steps))
            except StopIteration as end:
                new = end.value
                break
            if len(done) == CHUNK:
                yield pd.DataFrame(done, columns=names).astype(floats)
                done = []
        state.update(new)
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(done, columns=names).astype(floats)

    return stream.groupBy(*KEY).applyInPandasWithState(run, out, held, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def indicator_state(stream: DataFrame, kind: str = "ema", n: int | None = None, idle: int | None = None) -> DataFrame:
    """A recursive indicator (ema, rsi or atr) with a few numbers of state per series: finished bars commit it, others
    preview it. Bars at or before the last finished one of an earlier micro-batch are dropped."""
    make, default = STEPS[kind]
    step = make(n or default)

    def work(key, bars, state):
        held, last = state or ([], -1)
        held = list(held)
        for bar in bars:
            if bar[TIME] <= last:
                continue
            new, value = step(held, bar)
            yield (*key, bar[TIME], value, bool(bar["is_finished"]))
            if bar["is_finished"]:
                held, last = new, bar[TIME]
        return held, int(last)

    return _stateful(stream, f"{_KEYS}, {kind} double, is_finished boolean", "held array<double>, last long", [TIME, "is_finished"], work, idle)


def ema_state(stream: DataFrame, n: int = 9) -> DataFrame:
    return indicator_state(stream, "ema", n)


_BAR = ["open", "high", "low", "close", "volume", "amount"]


def filled(stream: DataFrame, idle: int | None = None) -> DataFrame:
    """Finished bars with synthetic ones in the gaps, however long, as fill_gaps makes them: the state of a series is its
    last bar and the volumes and amounts of up to five real ones."""
    from ..schema import TIMEFRAMES

    def work(key, bars, state):
        last, volumes, amounts = (list(x) for x in state) if state else ([], [], [])
        size = TIMEFRAMES[key[KEY.index("timeframe")]]
        for b in bars:
            if not b["is_finished"] or last and b[TIME] <= last[0]:
                continue
            if last:
                at, close, high, low = last
                mid, k = (high + low) / 2, int((b[TIME] - at) // size) - 1
                for i in range(1, k + 1):
                    o, c = close if i == 1 else mid, b["open"] if i == k else mid
                    yield (*key, int(at + i * size), o, max(o, c, high), min(o, c, low), c, sum(volumes) / len(volumes), sum(amounts) / len(amounts), True)
            yield (*key, b[TIME], *[b[x] for x in _BAR], bool(b.get("is_filled") or False))
            last, volumes, amounts = [float(b[TIME]), b["close"], b["high"], b["low"]], [*volumes, b["volume"]][-5:], [*amounts, b["amount"]][-5:]
        return last, volumes, amounts

    kinds = f"{_KEYS}, " + ", ".join(f"{c} double" for c in _BAR) + ", is_filled boolean"
    return _stateful(stream, kinds, "last array<double>, volumes array<double>, amounts array<double>", [TIME], work, idle)


def throttled(stream: DataFrame, ratio: float = 0.001, seconds: float = 10.0, idle: int | None = None) -> DataFrame:
    """Updates worth keeping, as throttle chooses them: the state of a series is the time, close and bar of the last kept."""

    def work(key, updates, state):
        held = list(state[0]) if state else []
        for b in updates:
            now, close = float(b["current_time"]), b["close"]
            if not held or b["is_finished"] or b[TIME] != held[2] or now - held[0] > 1000 * seconds or (close and abs(1 - held[1] / close) > ratio):
                yield (*key, b[TIME], int(now), close, bool(b["is_finished"]))
                held = [now, close, float(b[TIME])]
        return (held,)

    return _stateful(stream, f"{_KEYS}, current_time long, close double, is_finished boolean", "held array<double>", ["current_time"], work, idle)


def last_stored(stored: DataFrame, first: DataFrame, buffer: int) -> DataFrame:
    """The last `buffer` stored bars of each series before the time _first that `first` (key, _first) gives. Bars of twice
    that many timeframes are read; only series with fewer among them are looked for in the whole store."""
    from pyspark.sql import Window

    from ..schema import TIMEFRAMES

    size = F.try_element_at(F.create_map(*[F.lit(x) for pair in TIMEFRAMES.items() for x in pair]), F.col("timeframe"))
    first = first.withColumn("_since", F.col("_first") - 2 * buffer * size)
    bound = first.agg(F.min("_since").alias("low"), F.max("_first").alias("high"), F.count(F.lit(1)).alias("n"), F.count("_since").alias("known")).first()
    if not bound.n:
        return stored.limit(0)
    back = Window.partitionBy(*KEY).orderBy(F.desc(TIME))
    last = lambda rows: rows.filter(F.col(TIME) < F.col("_first")).withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= buffer).drop("_k", "_first", "_since")
    near = stored.filter(F.col(TIME) < bound.high)
    if bound.known == bound.n:
        near = near.filter(F.col(TIME) >= bound.low)
    near = near.join(first, KEY).filter(F.col("_since").isNull() | (F.col(TIME) >= F.col("_since")))
    enough = near.filter(F.col(TIME) < F.col("_first")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= buffer).drop("n")
    short = first.join(enough, KEY, "left_anti")
    found = last(near.join(enough, KEY, "left_semi"))
    if short.isEmpty():
        return found
    return found.unionByName(last(stored.join(short, KEY)))


def dual_mode(stored: Callable[[], DataFrame], factor: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], buffer: int = 360):
    """A foreachBatch function: the batch's series are joined to their last `buffer` stored bars, the batch factor runs over
    both, and the new rows go to the sink; so a live value is the batch value on the buffered tail."""

    def run(batch: DataFrame, number: int) -> None:
        new = batch.drop("event_ts")
        old = last_stored(stored(), new.groupBy(*KEY).agg(F.min(TIME).alias("_first")), buffer)
        both = old.select(*new.columns).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        sink(factor(both).filter("_new").drop("_new"), number)

    return run
