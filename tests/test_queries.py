"""Registered queries against their SQL."""
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(df):
    """Rows of strings and numbers, ordered by strings and whole numbers first: those don't hang on a last bit."""

    def one(v):
        if pd.isna(v):
            return "null"
        return float(v) if isinstance(v, (float, int, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    def key(row):
        exact = [isinstance(v, str) or v.is_integer() for v in row]
        return [repr(v) if e else "" for v, e in zip(row, exact)], [f"{v:.3g}" for v, e in zip(row, exact) if not e]

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=key)


def same(a, b):
    """Equal, or numbers that single precision tells apart by its last bit at most."""
    return a == b or not isinstance(a, str) and not isinstance(b, str) and math.isclose(a, b, rel_tol=2e-7)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(canon(got), canon(want)) if not all(map(same, a, b))] == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    registry.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_zones_of_the_query_are_its_sql_where_a_leg_left_the_newest(spark, tmp_path):
    """Swings of six days each; the last finished leg, from 30 to 20, breaks the zone, and none follows."""
    turns = [5, 0, 10, 3, 9, 8, 30, 20, 26]
    path = [turns[0]] + [a + (b - a) * k / 6 for a, b in zip(turns, turns[1:]) for k in range(1, 7)]
    moves = [path[0], *(b - a for a, b in zip(path, path[1:]))]
    con = duckdb.connect()
    con.execute("create table orders as select i as o_orderkey, 1 as o_custkey, 'F' as o_orderstatus, 250000 + 1000 * m as o_totalprice, timestamp '2000-01-01' + to_days(cast(i as integer)) as o_orderdate, 'a' as o_orderpriority from (select unnest(range(len($m))) as i, unnest($m) as m)", {"m": [float(m) for m in moves]})
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    got, want = registry.queries()["i50_pivot_zones"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["i50_pivot_zones"]).df()
    assert len(want) > 0 and canon(got) == canon(want[got.columns])


def test_models_read_the_bars_once(spark, monkeypatch):
    """Training goes over its rows many times; they are worked out from the tables once for all of it."""
    seen = spark.sparkContext.accumulator(0)
    bars = registry.weekly

    def counted(spark, d):
        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = bars(spark, d)
        return rows.mapInArrow(note, rows.schema)

    monkeypatch.setattr(registry, "weekly", counted)
    assert registry.queries()["t6_t9_e8_models"](spark, SMALL).count() == 2
    assert seen.value == bars(spark, SMALL).count()
