"""Hourly queries against their SQL on events that tie in time and number, or lack a number, a time, a type or a value."""
from collections import Counter

import duckdb
import pytest
from test_queries import canon

from tidemark.operators.bars import throttle
from tidemark.plans import registry
from tidemark.schema import BAR_COLUMNS, BAR_SCHEMA

#: Five types of 110 hours with gaps; each event stands three times, with values of its own, one copy after the other.
BASE = """select i // 2 as event_id, timestamp '2024-01-01' + to_minutes(cast(i // 2 * 7 + 60 * (i // 300) as integer)) as ts, i % 7 as user_id, substr('abcde', cast(1 + hash(i) % 5 as integer), 1) as event_type, round(hash(i, k) % 10000 / 100, 2) as value, '' as props
  from range(1900) r(i), range(3) s(k) order by i, k"""
ODD = {
    "ties": "select * from e",
    "no number": "select * replace (case when hash(value) % 4 = 0 then null else event_id end as event_id) from e",
    "no value": "select * replace (case when hash(value) % 3 = 0 then null else value end as value) from e",
    "no time": "select * replace (case when event_id % 90 = 3 then null else ts end as ts) from e",
    "no type": "select * replace (case when event_id % 6 = 3 then null else event_type end as event_type) from e",
    "old": "select * replace (ts - to_days(19725) as ts) from e",
}


def differ(spark, con, path, name):
    con.execute(f"create or replace view events as select * from '{path}/events.parquet{'' if (path / 'events.parquet').is_file() else '/*.parquet'}'")
    got, want = registry.queries()[name](spark, str(path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert len(want) > 0 and sorted(got.columns) == sorted(want.columns)
    got, want = Counter(canon(got)), Counter(canon(want[got.columns]))
    return ((got - want) + (want - got)).total()


def all_differ(spark, tmp_path, name, kinds=tuple(ODD)):
    con, found = duckdb.connect(), {}
    con.execute(f"create table e as {BASE}")
    for k in kinds:
        (tmp_path / k).mkdir()
        con.execute(f"copy ({ODD[k]}) to '{tmp_path}/{k}/events.parquet'")
        found[k] = differ(spark, con, tmp_path / k, name)
    return {k: n for k, n in found.items() if n}


@pytest.mark.parametrize("name", ["bars_1h", "b1_drop_stale", "b4_fill_gaps", "b5_fill_from_second", "b7_throttle", "s10_mark"])
def test_odd_events(spark, tmp_path, name):
    assert all_differ(spark, tmp_path, name) == {}


def test_ties_over_files(spark, tmp_path):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table e as {BASE}")
    (tmp_path / "events.parquet").mkdir()
    for k in range(3):  # each file holds the same events with other values, the later ones more of them
        con.execute(f"copy (select * replace (value + {k} as value) from e where event_id % 3 <= {k}) to '{tmp_path}/events.parquet/part-{k}.parquet'")
    assert differ(spark, con, tmp_path, "bars_1h") == 0


def test_odd_events_in_profiles(spark, tmp_path):
    assert all_differ(spark, tmp_path, "i41_volume_profile", ("no value", "no type")) == {}


def test_throttle_keeps_nan(spark):
    bar = {"market": "m", "symbol": "s", "quote_currency": "q", "ins_type": 1, "timeframe": "1H", "start_time": 0, "current_time": 0, "close": float("nan"), "is_finished": True}
    rows = spark.createDataFrame([tuple(bar.get(c) for c in BAR_COLUMNS)], BAR_SCHEMA)
    assert throttle(rows).filter("isnan(close) and open is null").count() == 1
