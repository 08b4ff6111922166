"""Near copies of the pipeline against brute force over all pairs."""
import itertools

import numpy as np
from test_dealt import ODD, odd_docs

from tidemark.llm import common, nearcopies


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {None}


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def rows_of_near_copies():
    r = np.random.default_rng(4)
    base = [f"w{k}" for k in range(70)]
    out = []
    for i in range(80):  # one large bucket: copies with up to three words changed
        w = list(base)
        for k in r.integers(0, 70, int(r.integers(0, 4))):
            w[k] = f"x{i}"
        out.append(" ".join(w))
    for i in range(60):  # small ones
        w = [f"b{i}-{k}" for k in range(int(r.integers(5, 90)))]
        out += [" ".join(w), " ".join(w).upper() + " end", " ".join(w[: int(len(w) * 0.85)])]
    return out


def test_near_copies_are_brute_force(spark):
    texts = rows_of_near_copies()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text")
    docs = docs.union(rows).union(odd_docs(spark).selectExpr("doc_id + 100000", "text"))
    kept = docs.orderBy("doc_id").collect()
    want = {r.doc_id: kept[c].doc_id for r, c in zip(kept, brute([r.text or "" for r in kept]))}
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want
    assert nearcopies.near_copies(docs.limit(0)).count() == 0 and len(ODD) > 0


def test_stage_drops_copies_whose_fingerprints_are_far(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id for r in common.cut(p.keep_one_of_near_copies(spark, docs, sf), "test").collect()}
    assert got == {rows[i].doc_id for i in set(brute([r.text or "" for r in rows]))}


def test_large_buckets_of_unlike_texts_stay_in_parts(spark, monkeypatch):
    """One passage in many texts, some of them copies, with parts and blocks so small that all rounds and meetings are used."""
    r = np.random.default_rng(8)
    shared = " ".join(f"s{k}" for k in range(8))
    texts = []
    for i in range(300):
        own = [f"t{i}-{k}" for k in range(int(r.integers(6, 60)))]
        texts.append(" ".join([shared, *own]))
        if i % 6 == 0:
            texts += [" ".join([shared, *own, f"end{c}"]) for c in range(int(r.integers(1, 9)))]
    monkeypatch.setattr(nearcopies, "PART", 16)
    monkeypatch.setattr(nearcopies, "BLOCK", 32)
    monkeypatch.setattr(nearcopies, "COMMON", 10**9)  # no member is known as common, so the passage stays in prefixes
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in nearcopies.near_copies(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
