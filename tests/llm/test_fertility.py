"""Fertility rules against plain counts, whole encodings and quartiles taken by sorting."""
import math
import re
from collections import Counter

import pytest

from tidemark.llm import fertility

p = pytest.importorskip("public_tokenizers")
PATHS = (p.path("piece_bpe_32k.model"), p.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, other string"


def plain(text):
    """The base counts, by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def tokens(text):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = sentencepiece.SentencePieceProcessor(model_file=PATHS[0]), Tokenizer.from_file(PATHS[1])
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in first.encode(w)]
    n = Counter(ids)
    entropy = -sum(k / len(ids) * math.log2(k / len(ids)) for k in n.values())
    return len(ids), sum(len(second.encode(w, add_special_tokens=False).ids) for w in words), sum(first.is_byte(i) for i in ids), entropy


TEXTS = [None, "", " \n\t", "one", "a b c d e f a b c d e g", "x x x x x x x", "a b c d e a b c d e", "l 1\n\n \nl 1\r\nl 1\nl 1", "# $%& <p>| *", "a b c d", "日本語 の テスト 𠀀 🜁🜂", "Слово и дело " * 4, "w" * 5000 + " é" * 300, "z\x0bz\x0cz\x85z"]


def test_counts_and_tokens_of_texts(spark):
    rows = [(i, t, None, "n", "k", "o") for i, t in enumerate(TEXTS + TEXTS[:5])]
    got = fertility.judged(spark.createDataFrame(rows, SCHEMA), *PATHS)
    assert [f.name for f in got.schema][:3] == ["doc_id", "lang", "other"]
    for r in got.collect():
        text = TEXTS[r.doc_id % len(TEXTS)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text), text
        assert (r.n_tokens, r.n_tokens_other, r.n_bytes_alone, pytest.approx(r.entropy, abs=1e-9)) == tokens(text), text
        assert r.base_failed == (plain(text)[0] < 10 or 100 * plain(text)[4] > 20 * plain(text)[0])
        assert r.kept == (not r.base_failed)  # too few texts for bands


def test_scripts():
    assert [fertility.script_of(t) for t in ("", "12 ;", "abc", "été", "слово x", "日本の", "한국어", "日本", "—")] == ["none", "none", "latin", "latin", "cyrillic", "han", "hangul", "han", "none"]


def test_repeated_runs_of_random_words():
    import numpy as np

    r = np.random.RandomState(1)
    word, doc = r.randint(0, 3, 400), np.sort(r.randint(0, 9, 400))
    want = fertility.repeated(word, doc)
    runs = Counter((doc[i], *word[i : i + 5]) for i in range(396) if doc[i] == doc[i + 4])
    covered = {i + k for i in range(396) if doc[i] == doc[i + 4] and runs[(doc[i], *word[i : i + 5])] > 1 for k in range(5)}
    assert set(np.flatnonzero(want)) == covered


def test_verdicts_are_those_of_sorted_quartiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r.asDict() for r in fertility.judged(docs.unionByName(docs.limit(40)), *PATHS).collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        r["class"] = int(math.log2(max(r["n_tokens"], 1)))
    once = {(text[r["doc_id"]], r["lang"]): r for r in rows if not r["base_failed"]}.values()

    def band(key, of, measure):
        x = sorted(r[measure] for r in once if (r[key], r["class"]) == of)
        if len(x) < fertility.LEAST:
            return None
        low, high = (x[math.ceil(q * len(x)) - 1] for q in (0.25, 0.75))
        return low, high, max(high - low, fertility.FLOOR[measure])

    rejected = 0
    for r in rows:
        outer = inner = 0
        for m in fertility.FLOOR:
            b = band("lang", (r["lang"], r["class"]), m) or band("script", (r["script"], r["class"]), m)
            if b:
                outer += r[m] < b[0] - fertility.OUTER * b[2] or r[m] > b[1] + fertility.OUTER * b[2]
                inner += r[m] < b[0] - fertility.INNER * b[2] or r[m] > b[1] + fertility.INNER * b[2]
        assert r["kept"] == (not r["base_failed"] and outer == 0 and inner < 2)
        rejected += not r["kept"] and not r["base_failed"]
    assert len(rows) == 240 and rejected


def test_labelled_texts(spark):
    got = fertility.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in got.groupBy("quality").agg({"kept": "count"}).join(got.filter("kept").groupBy("quality").count().withColumnRenamed("count", "k"), "quality").selectExpr("quality", "k / `count(kept)` as share").collect()}
    assert share[1] > 0.96 and share[0] < 0.1


def test_empty_table(spark):
    assert fertility.judged(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
