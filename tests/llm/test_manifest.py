"""Merkle manifests against a plain tree, link by link and by spans."""
import hashlib
import itertools
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"  # leaf: a clashing name


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return h(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def climb(level, at):
    """Top of a level of digests, and (side, sibling) from the node upwards; None stands for no sibling."""
    path = []
    while len(level) > 1:
        other = at ^ 1
        path.append((other < at, level[other] if other < len(level) else None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at //= 2
    return level[0], path


def brute(rows):
    leaves = {}
    for r in rows:
        leaves.setdefault(r["lang"], []).append(r)
    parts = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    for p in parts:
        leaves[p].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    tops = [climb([leaf(r) for r in leaves[p]], 0)[0] for p in parts]
    for k, p in enumerate(parts):
        level = [leaf(r) for r in leaves[p]]
        for i, r in enumerate(leaves[p]):
            path = climb(level, i)[1] + climb(tops, k)[1]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            fold = leaf(r, int(changed))
            for left, other in path:
                fold = h(fold) if other is None else h(other, fold) if left else h(fold, other)
            root = climb(tops, 0)[0]
            yield (r["doc_id"], leaf(r), tops[k], root, h(*(o for _, o in path if o)), fold, fold == root)


def rows_of(n):
    langs = [None, "", "de", "en", "en", "en", "日本"]
    return [dict(doc_id=None if i % 41 == 7 else i // 2 * 3 - 9, text=[None, "", "ab" * i, "é\n"][i % 4], lang=langs[i % 7 if i % 5 else 3], source=[None, "w"][i % 2], n_chars=None if i % 6 == 1 else (1 << 63) - 1 if i == 30 else i, leaf="x") for i in range(n)]


@pytest.fixture
def answered(spark, tmp_path):
    numbers = itertools.count()

    def run(rows):
        path = str(tmp_path / str(next(numbers)))
        spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
        return sorted(map(tuple, manifest.query(spark, path).collect()), key=repr)

    return run


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_proofs_are_those_of_a_plain_tree(answered, n):
    rows = rows_of(n)
    assert answered(rows + rows[:3]) == sorted(brute(rows + rows[:3]), key=repr)


def test_empty_table(answered):
    assert answered([]) == []


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_any_span_of_links_gives_the_same(spark, stride):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows_of(70)], SCHEMA)
    leaves = docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("part"), manifest.leaf_digest(F.col("doc_id"), F.col("text")).alias("digest"))
    low, inner = manifest.manifest(leaves, ["doc_id", "digest"], stride)
    want_low, want_inner = manifest.manifest(leaves, ["doc_id", "digest"])
    got, want = (sorted(map(repr, manifest.climbed(a, b, "digest", ["doc_id", "digest"]).collect())) for a, b in ((low, inner), (want_low, want_inner)))
    assert got == want and inner.count() > want_inner.count()
    assert manifest.climbed(low, inner, "digest", ["doc_id"]).filter("folded = root").count() == 70


def test_many_langs_and_the_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, text, 'l' || (doc_id % 90) as lang, source, n_chars from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({manifest.SQL})").fetchall()
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 90)).select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(want) == sorted(brute([r.asDict() for r in rows]))
