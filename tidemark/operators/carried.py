"""Folds over long series: a state that outlives a batch.

Rows are dealt by key, sorted within their partition, and read in Arrow batches; each series' state goes from one batch to
the next. A task holds one batch and one state, however long a series is. A fold is an object with `feed(rows)`, which gets
the columns of the next rows of its series as arrays, and `end()`, called after the last ones.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import KEY, TIME


def _parts(batches, key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows with one key; a series that goes on in the next batch comes in several runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in key:
            code = pc.dictionary_encode(batch.column(batch.schema.get_field_index(k)), null_encoding="encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        edge = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:]):
            part = batch.slice(a, b - a)
            yield tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in key), part


def _columns(part: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {n: part.column(part.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}


def _dealt(df: DataFrame, key: list[str], time) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, *([time] if isinstance(time, str) else time))


def scanned(df: DataFrame, added: str, begin: Callable[[], object], columns: list[str], key=KEY, time=TIME) -> DataFrame:
    """df with the columns that `added` names: feed() gives an array for each, as long as its rows. Rows of equal time keep
    no order; nulls of numbers reach the fold as NaN, and NaN comes back as null."""
    new = StructType.fromDDL(added)
    df = df.drop(*new.fieldNames())
    schema = StructType([*df.schema.fields, *new.fields])
    types = to_arrow_schema(new)

    def run(batches):
        last = fold = None
        for k, part in _parts(batches, key):
            if fold is None or k != last:
                last, fold = k, begin()
            got = fold.feed(_columns(part, columns))
            arrays = [pa.array(got[f.name], f.type, from_pandas=True) for f in types]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *types.names])

    return _dealt(df, key, time).mapInArrow(run, schema)


def folded(df: DataFrame, schema: str, begin: Callable[[], object], columns: list[str], key=KEY, time=TIME) -> DataFrame:
    """Rows of the key and the columns of `schema`: feed() and end() give lists of rows as dictionaries, any number."""
    new = StructType.fromDDL(schema)
    out = StructType([*[df.schema[k] for k in key], *new.fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        last = fold = None
        rows: list[dict] = []

        def give(k, found):
            rows.extend({**dict(zip(key, k)), **r} for r in found)

        for k, part in _parts(batches, key):
            if fold is None or k != last:
                if fold is not None:
                    give(last, fold.end())
                last, fold = k, begin()
            give(k, fold.feed(_columns(part, columns)))
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows.clear()
        if fold is not None:
            give(last, fold.end())
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _dealt(df.select(*dict.fromkeys([*key, *([time] if isinstance(time, str) else time), *columns])), key, time).mapInArrow(run, out)
