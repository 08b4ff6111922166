"""Bar schema, keys and timeframes."""
from __future__ import annotations

#: A series of bars, and its order; start_time is BIGINT milliseconds UTC.
KEY = ["market", "symbol", "quote_currency", "ins_type", "timeframe"]
TIME = "start_time"
BAR_SCHEMA = (
    "market string, symbol string, quote_currency string, ins_type int, asset_type string, timeframe string, start_time long, end_time long, current_time long, "
    "open double, high double, low double, close double, volume double, amount double, is_finished boolean, is_filled boolean"
)
BAR_COLUMNS = [c.split(" ")[0] for c in BAR_SCHEMA.split(", ")]
#: Milliseconds of each timeframe.
TIMEFRAMES = {
    "1s": 1_000, "5s": 5_000, "15s": 15_000, "30s": 30_000, "1m": 60_000, "3m": 180_000, "5m": 300_000, "10m": 600_000, "15m": 900_000, "30m": 1_800_000, "1H": 3_600_000, "2H": 7_200_000,
    "4H": 14_400_000, "6H": 21_600_000, "8H": 28_800_000, "12H": 43_200_000, "1D": 86_400_000, "3D": 259_200_000, "1W": 604_800_000, "1M": 2_592_000_000,
}
