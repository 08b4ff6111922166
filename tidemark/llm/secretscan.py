"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed. Pairs of blob and rule version that the ledger doesn't hold are scanned
once; the ledger keeps one row per such pair, with or without findings; findings are joined back to all paths.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Fixed patterns of the three base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
#: Further kinds of this scanner.
MORE = {
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
}
KINDS = (*BASE, *MORE)
RULES = hashlib.sha256("\n".join([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *(f"{k} {p.pattern}" for k, p in MORE.items())]).encode()).hexdigest()[:16]
LEDGER_SCHEMA = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's place in KINDS, kind, end), sorted; code points, end exclusive. Matches are leftmost and don't
    overlap within a kind; those that are too short are dropped after matching."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    for k, (kind, hint) in enumerate(zip(MORE, ("-----BEGIN ", "eyJ", "gh")), len(BASE)):
        if hint in text:
            found += [(m.start(), k, kind, m.end()) for m in MORE[kind].finditer(text)]
    return sorted(found)


def _show(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)


def _scan(batches):
    for batch in batches:
        blobs, rows = batch.column(0), []
        for first, n in common.slices(batch.column(1)):
            for text in batch.column(1).slice(first, n).to_pylist():
                found = scan_text(text)
                base = [x for x in found if x[1] < len(BASE)]
                rows.append((*[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(_show(base).encode()).hexdigest(), _show(found)))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([blobs, pa.array([RULES] * len(rows), pa.string()), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=[c.split(" ")[0] for c in LEDGER_SCHEMA.split(", ")])
    common.give_back()


def scan(versions: DataFrame, ledger_path: str, text: str = "text", blob: str = "blob") -> DataFrame:
    """versions with the digest of its whole text (null: empty) and the ledger's findings for it.

    ledger_path: Parquet table of LEDGER_SCHEMA, made if it isn't there; one writer at a time. Copies are scanned once and
    share their findings; rows repeat as given; an empty table gives no rows. Other columns pass through, but one named
    as an output is replaced.
    """
    spark = versions.sparkSession
    keyed = versions.withColumn(blob, F.sha2(common.whole(text), 256))
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)

    def ledger():
        """One row for each blob, should a pair have been written twice."""
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).filter(F.col("rules") == RULES).drop("rules")
        return rows.groupBy("blob").agg(*[F.first(c).alias(c) for c in rows.columns if c != "blob"])

    contents = common.distinct_contents(keyed.select(F.col(blob).alias("_tm_blob"), common.whole(text).alias("_tm_text")), "_tm_blob", "_tm_text")
    unseen = contents.join(ledger().select(F.col("blob").alias("_tm_blob")), "_tm_blob", "left_anti")
    unseen.mapInArrow(_scan, LEDGER_SCHEMA).write.mode("append").parquet(ledger_path)
    found = ledger().withColumnRenamed("blob", blob)
    return keyed.drop(*[c for c in found.columns if c != blob]).join(found, blob, "left")


def redact(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The text with each found span, or run of overlapping spans, replaced by [SECRET]; native expressions only. A null
    text stays null; a text without spans is unchanged."""
    pair = F.expr(f"transform(split({spans}, ','), s -> struct(cast(split(s, ':')[1] as int) as a, cast(split(s, ':')[2] as int) as b))")
    # spans are sorted by start: one is kept where it reaches past those before it, from where they end
    joined = F.aggregate(
        pair,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["b"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["a"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["a"] - acc["at"]), F.lit("[SECRET]"))).alias("out"),
                s["b"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return rows.withColumn(text, F.when(F.coalesce(F.length(spans), F.lit(0)) == 0, F.col(text)).otherwise(joined))


def query(spark, sf_dir: str) -> DataFrame:
    """The whole table as one version of each path, against a ledger of its own."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.scratch(spark, "blob-ledger"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
