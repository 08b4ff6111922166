"""Scalar functions: timeframes, row keys, dates, decimals."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import TIMEFRAMES


def _map(pairs: dict):
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def tf_ms(tf) -> Column:
    """Milliseconds of a timeframe; null for ticks and unknown names."""
    return F.try_element_at(_map(TIMEFRAMES), F.col(tf) if isinstance(tf, str) else tf).cast("long")


def tf_from_ms(ms) -> Column:
    """The timeframe of so many milliseconds; 'tick' if there is none."""
    return F.coalesce(F.try_element_at(_map({v: k for k, v in TIMEFRAMES.items()}), (F.col(ms) if isinstance(ms, str) else ms).cast("long")), F.lit("tick"))


def row_key(symbol="symbol", quote="quote_currency", ins_type="ins_type", timeframe="timeframe") -> Column:
    return F.concat_ws("_", symbol, quote, F.col(ins_type).cast("string"), timeframe)


def parse_row_key(key) -> Column:
    """Struct (symbol, quote_currency, ins_type, timeframe); null for a key of another form."""
    p = F.split(key, "_")
    return F.when(F.size(p) == 4, F.struct(p[0].alias("symbol"), p[1].alias("quote_currency"), p[2].try_cast("int").alias("ins_type"), p[3].alias("timeframe")))


def to_ms(text) -> Column:
    """Milliseconds (UTC) of a date as yyyyMMdd, yyyy-MM-dd, with HH:mm, or with HH:mm:ss; null for another length or form."""
    c = F.col(text) if isinstance(text, str) else text
    by = {8: "yyyyMMdd", 10: "yyyy-MM-dd", 16: "yyyy-MM-dd HH:mm", 19: "yyyy-MM-dd HH:mm:ss"}
    out = None
    for n, pattern in by.items():
        got = F.try_to_timestamp(c, F.lit(pattern))
        out = F.when(F.length(c) == n, got) if out is None else out.when(F.length(c) == n, got)
    return F.unix_millis(out)


def to_ts(ms) -> Column:
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def fmt_ms(ms, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(to_ts(ms), pattern)


def is_same_day(a, b) -> Column:
    return F.to_date(to_ts(a)) == F.to_date(to_ts(b))


def ntz_ms(ts) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def quantize(x, n: int, mode: int = 2) -> Column:
    """To n places: mode 0 halves go down, 1 away from zero, 2 toward zero."""
    c = (F.col(x) if isinstance(x, str) else x).cast("decimal(38,18)")
    unit = F.lit(10**n).cast("decimal(18,0)")
    size = F.abs(c) * unit
    whole = F.floor(size).cast("decimal(38,0)")
    if mode == 1:
        whole = F.ceil(size).cast("decimal(38,0)")
    elif mode == 0:
        whole = whole + F.when(size - whole > F.lit("0.5").cast("decimal(2,1)"), 1).otherwise(0)
    return (F.signum(c.cast("double")) * whole.cast("double") / F.lit(float(10**n))).cast(f"decimal(38,{n})")
