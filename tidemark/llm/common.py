"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

_OWN_SCRATCH: list[str] = []
_OPEN = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local folder
    serves a local master, as in tests; on a cluster it would lose rows, so there it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_SCRATCH:
            _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp"))
        base = _OWN_SCRATCH[0]
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: later jobs start from the files and survive lost executors.
    Within `passing` the files go at its end, unless they stay: then at the end of the `passing` around that, if any."""
    path = scratch(df.sparkSession, name)
    made = _OPEN.__dict__.setdefault("made", [])
    if len(made) > stays:
        made[-1 - stays].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Tables that are cut within are deleted at the end. What leaves the block may only read those that stay."""
    made = _OPEN.__dict__.setdefault("made", [])
    made.append([])
    try:
        yield
    finally:
        for path in made.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def distinct_contents(rows: DataFrame, digest: str, text: str) -> DataFrame:
    """One row (digest, text) for each digest. The partial aggregation keeps one copy per scan task, so a text that a
    third of the rows share reaches its reducer as few rows."""
    return rows.groupBy(digest).agg(F.first(text).alias(text))


def sub_batches(texts: list[str], most_chars: int = 2_000_000):
    """Slices (from, to) of a list of texts, each of about most_chars characters: bounds what a Python worker holds."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most_chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def trim(cache: dict, limit: int) -> None:
    """Keep the earlier half of what a full cache may hold: what is frequent comes early."""
    early = dict(itertools.islice(cache.items(), limit // 2))
    cache.clear()
    cache.update(early)


def fill(cache: dict, keys, compute, limit: int) -> None:
    """Put compute(missing keys) into the cache; it is trimmed first when it would pass the limit."""
    missing = [k for k in keys if k not in cache]
    if cache and len(cache) + len(missing) > limit:
        trim(cache, limit)
        missing = [k for k in keys if k not in cache]
    if missing:
        cache.update(zip(missing, compute(missing)))


def least_hashes(rows: DataFrame, hashed: str, n: int) -> DataFrame:
    """The rows below a hash that about 1.5 n + 100 of them lie under: what a bounded sample is taken from, so that not
    every task sends n rows. It is the same at every size; with fewer rows than that all are kept."""
    share = (1.5 * n + 100) / max(rows.count(), 1)
    return rows if share >= 1 else rows.filter(F.col(hashed) < F.lit(int(-(2**63) + share * 2**64)))


def slices(texts: pa.Array, most_bytes: int = 4_000_000):
    """(from, rows) of parts of a string column, each of about most_bytes: what a Python worker turns into strings at once."""
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(size.searchsorted(before + most_bytes, "right")))
        yield at, end - at
        at = end


def give_back() -> None:
    """Give what a task has freed back to the system: Python workers live on and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def annotate(docs: DataFrame, text: str, added: str, work) -> DataFrame:
    """docs with the columns that `added` names, from work(texts), which gives an Arrow array for each; a null text is given
    as empty. Other columns pass through, those named as an output are replaced; the text may not be one. Texts are sent
    to Python once, and taken out of their batch part by part."""
    names = StructType.fromDDL(added).fieldNames()
    docs = docs.drop(*names)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for first, n in slices(batch.column(at)):
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *work([t or "" for t in part.column(at).to_pylist()])], names=[*batch.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(added).fields]))


def placed(rows: DataFrame, group: list[str], order: list[str], place: str) -> DataFrame:
    """rows, written to the shared folder, with their place (from 0) in the group by the order; nulls first, and rows that
    tie in all of it in any order. A group may hold any share of the rows: ranges of (group, order) are sorted, numbered
    each for itself, and moved on by what earlier ranges hold of the group. Only groups that go over a range's end need
    that, so as many rows as there are ranges at most are broadcast."""
    rows = rows.withColumn("_tm_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*group, *order, "_tm_row").withColumn("_tm_range", F.spark_partition_id())
    rows = cut(rows, "ranges")
    own = rows.withColumn(place, F.row_number().over(Window.partitionBy("_tm_range", *group).orderBy(*order, "_tm_row")).cast("long") - 1)
    held = rows.groupBy(*group, "_tm_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("_tm_range").rowsBetween(Window.unboundedPreceding, -1))
    moved = held.withColumn("_tm_before", before).filter("_tm_before > 0").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_tm_range").alias("_r"), "_tm_before")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = functools.reduce(lambda a, b: a & b, same, F.col("_tm_range") == F.col("_r"))
    out = own.join(F.broadcast(moved), on, "left").withColumn(place, F.col(place) + F.coalesce("_tm_before", F.lit(0)))
    return out.drop("_tm_row", "_tm_range", "_tm_before", "_r", *[f"_g{i}" for i in range(len(group))])
