"""The structure of a price series: merged bars, fractals, strokes and pivot zones, and the sequential count.

Merged bars and strokes have fewer rows than bars and hang on what was merged before: they are folds with a carried state.
Fractals are windows over merged bars, zones a fold over strokes.
"""
from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import KEY, TIME
from .carried import folded, scanned

MERGED = "seq long, start_time long, end_time long, high double, low double, rising boolean, n_bars long, high_time long, low_time long, is_finished boolean"
STROKE = "seq long, rising boolean, start_time long, end_time long, start_value double, end_value double, high double, low double, n_merged long"
ZONE = "seq long, start_time long, end_time long, high double, low double, n_legs long, is_finished boolean"


class _Merged:
    """A bar that took in those that lie within it, or it within them."""

    __slots__ = ("high", "low", "rising", "first", "last", "n", "top", "top_time", "bottom", "bottom_time", "closed", "seq")

    def __init__(self, high, low, time, rising, seq):
        self.high = self.top = high
        self.low = self.bottom = low
        self.first = self.last = self.top_time = self.bottom_time = time
        self.rising, self.seq, self.n, self.closed = rising, seq, 1, False

    def holds(self, other) -> bool:
        return (self.high >= other.high and self.low <= other.low) or (self.high <= other.high and self.low >= other.low)

    def take(self, bar) -> None:
        pick = max if self.rising else min
        self.high, self.low = pick(self.high, bar.high), pick(self.low, bar.low)
        self.n, self.last = self.n + 1, bar.first
        if bar.high > self.top:
            self.top, self.top_time = bar.high, bar.first
        if bar.low < self.bottom:
            self.bottom, self.bottom_time = bar.low, bar.first

    def row(self) -> dict:
        return {"seq": self.seq, "start_time": self.first, "end_time": self.last, "high": self.high, "low": self.low, "rising": self.rising, "n_bars": self.n, "high_time": self.top_time, "low_time": self.bottom_time, "is_finished": self.closed}


class _Merge:
    """Bars into merged bars."""

    def __init__(self):
        self.last: _Merged | None = None

    def step(self, high, low, time) -> _Merged | None:
        """The merged bar that begins with this bar, if one does; the one before is closed then."""
        old = self.last
        bar = _Merged(high, low, time, True if old is None else old.high < high, 0 if old is None else old.seq + 1)
        if old is not None and old.holds(bar):
            old.take(bar)
            return None
        if old is not None:
            old.closed = True
        self.last = bar
        return bar

    def feed(self, rows):
        out = []
        for high, low, time in zip(rows["high"].tolist(), rows["low"].tolist(), rows[TIME].tolist()):
            old = self.last
            if self.step(high, low, time) is not None and old is not None:
                out.append(old.row())
        return out

    def end(self):
        return [] if self.last is None else [self.last.row()]


def merged_bars(bars: DataFrame, key=KEY) -> DataFrame:
    """Bars of which none lies within the one before: two such become one, with the greater high and low in a rise and the
    lesser in a fall; the first rises, later ones as their high is over that of the one before. is_finished is false for the
    last of a series. high_time, low_time: the first bar with the extreme. Highs and lows may not be null."""
    return folded(bars, MERGED, _Merge, ["high", "low", TIME], key)


def fractals(merged: DataFrame, key=KEY) -> DataFrame:
    """merged with fractal and gap: `top` where neither neighbour's high is over the bar's, else `bottom` where neither low is
    under it, else null, as for the first and the last; gap: the bar before ends short of it."""
    w = Window.partitionBy(*key).orderBy("seq")
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    rows = merged.withColumns({"_h0": before("high"), "_l0": before("low"), "_h2": after("high"), "_l2": after("low")})
    top = (F.col("_h0") <= F.col("high")) & (F.col("high") >= F.col("_h2"))
    bottom = (F.col("_l0") >= F.col("low")) & (F.col("low") <= F.col("_l2"))
    rows = rows.withColumn("fractal", F.when(top, "top").when(bottom, "bottom"))
    gap = F.when(F.col("fractal") == "top", F.col("_h0") < F.col("low")).when(F.col("fractal") == "bottom", F.col("_l0") > F.col("high"))
    return rows.withColumn("gap", gap).drop("_h0", "_l0", "_h2", "_l2")


def _carries(bars: list[_Merged], first: int, last: int, up: bool) -> bool:
    """Whether the way from one merged bar to another is long enough for a stroke and goes from extreme to extreme."""
    a, b = bars[first], bars[last]
    if last - first < 4 or a.holds(b):
        return False
    highest, lowest = max(x.high for x in bars[first : last + 1]), min(x.low for x in bars[first : last + 1])
    if up:
        return b.high >= highest and a.low <= lowest
    return b.low <= lowest and a.high >= highest


class _Stroke:
    """A stroke that isn't finished: bars[1] is where it begins; end is the place of its possible last bar, 0 if none."""

    def __init__(self, up: bool | None = None, bars=()):
        self.up, self.bars, self.end, self.high, self.low = up, list(bars), 0, None, None

    def begin(self) -> None:
        """The side is known once the last three closed bars make a strict top or bottom; earlier bars are forgotten."""
        closed = [b for b in self.bars if b.closed]
        if len(closed) < 3:
            return
        a, b, c = closed[-3:]
        if a.high < b.high > c.high:
            self.up, self.high, self.low = False, b.high, min(x.low for x in self.bars)
        if a.low > b.low < c.low:
            self.up, self.low, self.high = True, b.low, max(x.high for x in self.bars)
        self.bars = [a, b, c, *[x for x in self.bars if not x.closed]]

    def step(self, bar: _Merged | None) -> _Stroke | None:
        """The next stroke if this one is finished by the bar, or by what its last bar has taken in (None)."""
        if bar is not None:
            self.bars.append(bar)
        if self.up is None:
            self.begin()
        if self.up is None or len(self.bars) < 6:
            return None
        last = len(self.bars) - 1
        if not self.end:
            if (self.low > min(b.low for b in self.bars)) if self.up else (self.high < max(b.high for b in self.bars)):
                self.up = None  # the start was passed: look for another
                return None
            self.end = next((i for i in range(5, last + 1) if _carries(self.bars, 1, i, self.up)), 0)
            return None
        if self.end != last:
            tip, reached = self.bars[last], self.bars[self.end]
            if self.up and tip.high > reached.high:
                self.end, self.high = last, tip.high
            elif not self.up and tip.low < reached.low:
                self.end, self.low = last, tip.low
        if not _carries(self.bars, self.end, last, not self.up):
            return None
        # the way back from the end is a stroke of its own: this one is finished there
        after = _Stroke(not self.up, self.bars[self.end - 1 :])
        after.end = len(after.bars) - 1
        self.bars = self.bars[: self.end + 2]
        a, b = self.bars[1], self.bars[-2]
        self.high, self.low = (b.high, a.low) if self.up else (a.high, b.low)
        after.high, after.low = (max(x.high for x in after.bars), self.low) if after.up else (self.high, min(x.low for x in after.bars))
        return after

    def row(self, seq: int) -> dict:
        a, b = self.bars[1], self.bars[-2]
        times = (a.bottom_time, b.top_time) if self.up else (a.top_time, b.bottom_time)
        values = (a.low, b.high) if self.up else (a.high, b.low)
        return {"seq": seq, "rising": self.up, "start_time": times[0], "end_time": times[1], "start_value": values[0], "end_value": values[1], "high": self.high, "low": self.low, "n_merged": len(self.bars)}


class _Strokes:
    def __init__(self):
        self.merge, self.stroke, self.seq = _Merge(), None, 0

    def feed(self, rows):
        out = []
        for high, low, time in zip(rows["high"].tolist(), rows["low"].tolist(), rows[TIME].tolist()):
            first = self.merge.last is None
            bar = self.merge.step(high, low, time)
            if first:
                continue
            if self.stroke is None:
                self.stroke = _Stroke()  # the second bar only begins the search
                continue
            after = self.stroke.step(bar)
            if after is not None:
                out.append(self.stroke.row(self.seq))
                self.stroke, self.seq = after, self.seq + 1
        return out

    def end(self):
        return []


def strokes(bars: DataFrame, key=KEY) -> DataFrame:
    """Finished strokes between tops and bottoms of merged bars, five of these apart at least. A stroke goes on while its end
    is passed, and is finished when the way back from the end would be a stroke. A task holds the merged bars of the stroke
    at hand. Times are those of the bars with the extremes."""
    return folded(bars, STROKE, _Strokes, ["high", "low", TIME], key)


class _Zones:
    def __init__(self):
        self.legs: list[tuple] = []
        self.zone = self.found = None
        self.seq = 0

    def _settle(self) -> None:
        while len(self.legs) >= 3:
            if self.zone is None:
                high, low = min(x[2] for x in self.legs[:3]), max(x[3] for x in self.legs[:3])
                if high <= low:
                    del self.legs[0]
                    return
                self.zone = high, low
            elif any(low > self.zone[0] or high < self.zone[1] for _, _, high, low in self.legs[3:]):
                del self.legs[0]
                self.zone = None
            else:
                return

    def _model(self) -> dict:
        high, low = self.zone
        inside = [i for i in range(4, len(self.legs)) if low < self.legs[i][3] < high or low < self.legs[i][2] < high]
        end = self.legs[inside[-1] - 1][1] if inside else self.legs[-1][1]
        return {"start_time": self.legs[0][0], "end_time": end, "high": high, "low": low, "n_legs": len(self.legs)}

    def feed(self, rows):
        out = []
        for leg in zip(*(rows[c].tolist() for c in ("start_time", "end_time", "high", "low"))):
            self.legs.append(leg)
            self._settle()
            if self.zone is None:
                continue
            now = self._model()
            if self.found is not None and now["start_time"] > self.found["start_time"]:
                out.append({**self.found, "seq": self.seq, "is_finished": True})
                self.seq += 1
            self.found = now
        return out

    def end(self):
        return [] if self.found is None else [{**self.found, "seq": self.seq, "is_finished": self.zone is None}]


def pivot_zones(legs: DataFrame, key=KEY) -> DataFrame:
    """What three legs one after the other share (high: the least of their highs, low: the greatest of their lows) until a
    leg lies outside; then the search goes on from the second leg. end_time is that of the leg before the last one that
    has an end within. A task holds the legs of the zone at hand."""
    return folded(legs, ZONE, _Zones, ["start_time", "end_time", "high", "low"], key, "seq")


class _Sequence:
    """The sequential count of a series: a setup of bars whose closes all pass those some bars before, then a countdown."""

    def __init__(self, length=9, setup=4, back=2, reverse=4, most=13, perfect_setup=True, perfect_countdown=False):
        self.length, self.setup, self.back, self.reverse, self.most = length, setup, back, reverse, most
        self.perfect_setup, self.perfect_countdown = perfect_setup, perfect_countdown
        self.bars: deque = deque(maxlen=max(length + setup, back + most) + 2)  # (high, low, close)
        self.count, self.side, self.limit, self.eighth = 0, 0, None, None

    def _passed(self, side: int, perfect: bool) -> bool | None:
        """Whether the setup of a side stands: None if its closes do, but not the extremes that make it perfect."""
        bars = self.bars
        # the oldest bars that are kept count, not the newest, once more are kept than a setup needs
        if not all(side * (bars[self.setup + i][2] - bars[i][2]) < 0 for i in range(self.length)):
            return False
        if perfect:
            tips = [side * bars[-k][1 if side > 0 else 0] for k in (1, 2, 3, 4)]
            if max(tips[:2]) <= max(tips[2:]):
                return None
        return True

    def _set_up(self) -> bool:
        if len(self.bars) < self.length + self.setup:
            return False
        for side in (1, -1):
            found = self._passed(side, self.perfect_setup)
            if found is None:
                return False
            if found:
                since = list(self.bars)[self.setup :]
                self.count, self.side = 0, side
                self.limit = max(b[0] for b in since) if side > 0 else min(b[1] for b in since)
                return True
        return False

    def _reversed(self) -> bool:
        if len(self.bars) <= self.reverse + 1:
            return False
        high, low, _ = self.bars[-1]
        then = self.bars[-1 - self.reverse][2]
        return low >= then if self.side > 0 else high <= then

    def _count_down(self) -> None:
        if not self.side or abs(self.count) > self.most:
            return
        high, low, close = self.bars[-1]
        if self.side * (close - self.limit) >= 0:
            self.count, self.side, self.limit, self.eighth = 0, 0, None, None
            return
        if len(self.bars) < self.back + 1:
            return
        if abs(self.count) == self.most:
            if self._reversed():
                self.count *= 2
            return
        then = self.bars[-1 - self.back]
        if close < then[1] if self.side > 0 else close >= then[0]:
            if self.perfect_countdown and abs(self.count) == self.most - 1 and (low <= self.eighth if self.side > 0 else high >= self.eighth):
                return
            self.count -= self.side
            if abs(self.count) == 8:
                self.eighth = close
        if abs(self.count) == self.most and self._reversed():
            self.count *= 2

    def step(self, high, low, close) -> int:
        self.bars.append((high, low, close))
        if not self._set_up():
            self._count_down()
        return self.count

    def feed(self, rows):
        return {"td_count": [self.step(*x) for x in zip(*(rows[c].tolist() for c in ("high", "low", "close")))]}


def sequence(bars: DataFrame, key=KEY, **switches) -> DataFrame:
    """bars with td_count: negative counts of a buy countdown, positive ones of a sell countdown, doubled when the bar of the
    last count, or one after it, reverses. A new setup starts the count again; a close past all of the setup ends it.

    switches: length, setup, back, reverse, most (counts), perfect_setup, perfect_countdown.
    """
    return scanned(bars, "td_count int", lambda: _Sequence(**switches), ["high", "low", "close"], key)
