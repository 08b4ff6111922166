"""The pipeline's language stage on mixed and junk texts."""
import random

import corpus_pipeline as p


def planted(docs):
    """Texts half in one language and half in another, of four languages by turns, and of random letters."""
    by = {x: [r.text.split() for r in docs.filter(f"lang = '{x}' and n_chars > 600").orderBy("doc_id").limit(12).collect()] for x in ("en", "fr", "de", "es")}
    out = [" ".join(by[a][i][:50] + by[b][i + 1][:50]) for i in range(8) for a, b in (("en", "de"), ("fr", "es"), ("de", "fr"))]
    out += [" ".join(w for z in zip(*[v[i][:50] for v in by.values()]) for w in z) for i in range(8)]
    r = random.Random(1)
    return out + [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(80)) for _ in range(16)]


def test_unclear_texts_go_and_clear_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = planted(docs)
    rows = spark.createDataFrame([(10**6 + i, t, None, "planted", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in p.keep_clear_language(spark, docs.union(rows), sf).select("doc_id").collect()}
    assert sum(10**6 + i in kept for i in range(len(texts))) <= 0.1 * len(texts)
    assert sum(i < 10**6 for i in kept) >= 0.985 * docs.count()
