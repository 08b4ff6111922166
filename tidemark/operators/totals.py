"""Running values over keys of any size: sums and last values are taken in blocks of the order, and moved on by the blocks
before. A block is a range of the order column, so the cut is the same whenever it is computed, and a key that holds a
third of all rows is spread over as many tasks as it has blocks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, key: list[str], order: list[str], block: int, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each name, the sum of an expression, or its last value that isn't null, up to and with the row. order: the
    first column is a number, of which a block spans `block`; rows that are equal in all of it keep no order."""
    sums, lasts = sums or {}, lasts or {}
    names = [*sums, *lasts]
    rows = df.drop(*names).withColumns({f"_x_{n}": x for n, x in {**sums, **lasts}.items()}).withColumn("_block", F.floor(F.col(order[0]) / block))
    within = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    take = lambda n: F.sum(f"_x_{n}") if n in sums else F.last(f"_x_{n}", True)
    local = rows.withColumns({n: take(n).over(within) for n in names})
    ends = [F.sum(f"_x_{n}").alias(f"_e_{n}") if n in sums else F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in names]
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.groupBy(*key, "_block").agg(*ends)
    moved = moved.select(*key, "_block", *[(F.sum(f"_e_{n}") if n in sums else F.last(f"_e_{n}", True)).over(earlier).alias(f"_m_{n}") for n in names])
    out = {n: F.coalesce(F.col(n) + F.col(f"_m_{n}"), F.col(n), F.col(f"_m_{n}")) if n in sums else F.coalesce(n, f"_m_{n}") for n in names}
    keys = [local[k].eqNullSafe(moved[k]) for k in (*key, "_block")]
    both = local.join(moved, keys, "left").select(*[local[c] for c in local.columns], *[moved[f"_m_{n}"] for n in names])
    return both.withColumns(out).drop("_block", *[f"_{p}_{n}" for p in "xm" for n in names])
