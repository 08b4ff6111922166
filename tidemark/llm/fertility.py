"""Quality rules by tokeniser fertility.

Public vocabularies split each word of a text; characters per token, the share of tokens that stand for single bytes, and
the entropy of the tokens (against that of as many different ones) are its measures. Texts of one language and length
class lie close together in them. Their quartiles over all different texts give bands: a text outside an outer band of
one measure, or outside the inner bands of two, is rejected. Plain counts of words, symbols, repeated lines and repeated
runs of words come first.
"""
from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from . import common, tokencount

SYMBOLS = "#*$%&|<>"
SPACE = "".join(map(chr, [32, *range(9, 14)]))
#: Words that a Python worker keeps tokens of; longer words aren't kept.
WORDS, LONG = 300_000, 64
#: Different texts that a band rests on, at least; one of fewer is replaced by that of the script.
LEAST = 30
#: Quartile distances beyond the quartiles: outer and inner bands.
OUTER, INNER = 2.0, 1.5
#: Measures in whole steps, and the least quartile distance in steps: many copies or a narrow class make no band of nothing.
STEP = 256
FLOOR = {"chars": 13, "chars_other": 13, "byte_share": 5, "evenness": 5}
#: First code points of blocks and their script.
BLOCKS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
          (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han")]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = ", ".join(f"{c} long" for c in [*COUNTS, "n_tokens", "n_tokens_other", "n_bytes_alone"]) + ", entropy double, script string"
_LOADED: dict = {}


def _vocabularies(pieces: str, other: str):
    """A function that splits words, giving (ids of the first vocabulary, number of tokens of the other) for each; which ids
    stand for a byte; and the cache of words."""
    if (pieces, other) not in _LOADED:
        import sentencepiece

        first, count = sentencepiece.SentencePieceProcessor(model_file=pieces), tokencount.counter_of_words(other)
        alone = np.array([first.is_byte(i) for i in range(first.get_piece_size())], np.int64)

        def split(words: list[bytes]):
            texts = [w.decode("utf-8", "replace") for w in words]
            return zip(first.encode(texts, num_threads=1), count(texts))

        _LOADED[pieces, other] = split, alone, {}
    return _LOADED[pieces, other]


def repeated(word: np.ndarray, doc: np.ndarray, n: int = 5) -> np.ndarray:
    """Which words lie in a run of n words that their text has twice or more. Runs are sorted by a hash; runs of equal
    hash are compared."""
    covered = np.zeros(len(word), bool)
    start = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
    if not len(start):
        return covered
    h = doc[start].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ word[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    h, start = h[order], start[order]
    same = h[1:] == h[:-1]
    in_group = np.flatnonzero(np.append(False, same) | np.append(same, False))
    h, start = h[in_group], start[in_group]
    runs = np.column_stack([doc[start], *(word[start + k] for k in range(n))])
    if len(start) and (h[1:] == h[:-1]).any() and (runs[1:] != runs[:-1])[h[1:] == h[:-1]].any():  # equal hashes of unlike runs
        order = np.lexsort(runs.T)
        runs, start = runs[order], start[order]
    equal = (runs[1:] == runs[:-1]).all(1)
    start = start[np.append(False, equal) | np.append(equal, False)] if len(start) else start
    for k in range(n):
        covered[start + k] = True
    return covered


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if "\n" in text else []
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most of its letters and other signs from `A` on; `none` if there are none."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.searchsorted(np.array([b for b, _ in BLOCKS], np.uint32), points, "right")
    n = np.bincount(place, minlength=len(BLOCKS) + 1)[1:]
    totals: dict[str, int] = {}
    for (_, name), k in zip(BLOCKS, n):
        if name != "none":
            totals[name] = totals.get(name, 0) + int(k)
    best = max(totals, key=totals.get)
    return best if totals[best] else "none"


def measured(texts: list[str], pieces: str, other: str) -> list[pa.Array]:
    """The columns of ADDED for whole texts."""
    split, alone, cache = _vocabularies(pieces, other)
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    every = list(itertools.chain.from_iterable(words))
    ends = np.cumsum([0, *map(len, every)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(every))]).dictionary_encode()
    word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(texts)), counts)
    short = [w for w in names if len(w) <= LONG]
    common.fill(cache, short, split, WORDS)
    long = [w for w in names if len(w) > LONG]
    found = dict(zip(long, split(long)))
    each = [cache[w] if len(w) <= LONG else found[w] for w in names]
    sums = lambda x: np.bincount(doc, x[word] if len(names) else None, len(texts)).astype(np.int64)
    chars = np.array([len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in names], np.int64)
    width = np.fromiter((len(x) for x, _ in each), np.int64, len(each))
    tokens = sums(width)
    # tokens of all words, one text after the other
    flat, begin = np.fromiter(itertools.chain.from_iterable(x for x, _ in each), np.int64, int(width.sum())), np.cumsum(width) - width
    wide = width[word] if len(names) else np.zeros(0, np.int64)
    at = np.repeat((begin[word] if len(names) else wide) - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    of, token = np.repeat(doc, wide), flat[at]
    key, n = np.unique((of * len(alone) + token).astype(np.int32 if len(texts) * len(alone) < 1 << 31 else np.int64), return_counts=True)
    spread = np.bincount(key // len(alone), n * np.log2(n), len(texts))
    entropy = np.where(tokens > 0, np.log2(np.maximum(tokens, 1)) - spread / np.maximum(tokens, 1), 0.0)
    columns = [counts, sums(chars), np.array([sum(t.count(c) for c in SYMBOLS) for t in texts]), np.array([dup_lines(t) for t in texts]), np.bincount(doc, repeated(word, doc), len(texts)).astype(np.int64)]
    columns += [tokens, sums(np.fromiter((n for _, n in each), np.int64, len(each))), np.bincount(of, alone[token], len(texts))]
    return [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(np.maximum(entropy, 0.0)), pa.array([script_of(t) for t in texts], pa.string())]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _steps() -> dict[str, Column]:
    """The measures in whole steps, null where there are no tokens."""
    tokens = F.col("n_tokens")
    share = lambda a, b: F.floor(STEP * a / F.when(b > 0, b)).cast("long")
    return {
        "chars": share(F.col("word_chars"), tokens),
        "chars_other": share(F.col("word_chars"), F.col("n_tokens_other")),
        "byte_share": share(F.col("n_bytes_alone"), tokens),
        "evenness": F.when(tokens > 0, F.floor(STEP * F.col("entropy") / F.log2(tokens + 1.0)).cast("long")),
    }


def bands(rows: DataFrame) -> DataFrame:
    """(name, class, band) of each language and script, from rows (digest, lang, script, class, measures in steps): quartiles
    by exact counts of each step over all different texts; classes with too few texts are left out."""
    named = F.explode(F.array_compact(F.array(F.concat(F.lit("language "), "lang"), F.concat(F.lit("script "), "script"))))
    once = rows.groupBy("digest", "lang").agg(*[F.first(c).alias(c) for c in ("script", "class", *FLOOR)])
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("step")) for m in FLOOR]))
    counts = once.withColumn("name", named).select("name", "class", steps.alias("x")).filter("x.step is not null").groupBy("name", "class", "x.measure", "x.step").agg(F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy("name", "class", "measure")
    counts = counts.withColumn("up_to", F.sum("n").over(all_of.orderBy("step"))).withColumn("all", F.sum("n").over(all_of)).filter(F.col("all") >= LEAST)
    at = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("all"), F.col("step")))
    quartiles = counts.groupBy("name", "class", "measure").agg(at(0.25).alias("low"), at(0.75).alias("high"))
    floor = functools.reduce(lambda c, m: c.when(F.col("measure") == m, FLOOR[m]), FLOOR, F.when(F.lit(False), 0))
    quartiles = quartiles.withColumn("wide", F.greatest(F.col("high") - F.col("low"), floor).cast("long"))
    return quartiles.groupBy("name", "class").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high", "wide")))).alias("band"))


def judged(docs: DataFrame, pieces: str, other: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, without their texts, with the counts and measures of whole texts, base_failed and kept.

    pieces: a sentencepiece model with bytes to fall back on; other: a tokenizers file. lang may be null: the script's band
    holds then, as for languages with too few texts of a length; where the script has too few as well, no text is
    rejected by its measures. A null or empty text has no word and fails; a text is measured whole, however long; copies are
    judged alike, and count once in the bands of their language. Repeated rows stay, an empty table gives no rows, and
    columns with a name that is given are replaced.
    """
    names = [*StructType.fromDDL(ADDED).fieldNames(), *FLOOR, "base_failed", "kept"]
    clash = [c for c in names if c in (text, lang)]
    if clash:
        raise ValueError(f"{clash} are names of results")
    kept = [c for c in docs.columns if c not in (*names, text)]
    digest = docs.drop(*names).withColumn("_tm_digest", F.unhex(F.md5(common.whole(text))))
    rows = common.annotate(digest, text, ADDED, lambda texts: measured(texts, pieces, other)).drop(text)
    rows = rows.withColumns(_steps() | {"base_failed": base_failed(), "_tm_class": F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int")})
    rows = common.cut(rows, "measured")
    found = common.cut(bands(rows.filter(~F.col("base_failed")).select(F.col("_tm_digest").alias("digest"), F.col(lang).alias("lang"), "script", F.col("_tm_class").alias("class"), *FLOOR)), "bands")
    side = lambda kind: found.filter(F.col("name").startswith(kind)).select(F.substring("name", len(kind) + 1, 1 << 30).alias(f"_tm_{kind}"), F.col("class").alias("_tm_class"), F.col("band").alias(f"_tm_{kind}_band"))
    own, wider = (side(k) for k in ("language ", "script "))
    rows = rows.withColumns({"_tm_language ": F.col(lang), "_tm_script ": F.col("script")}).join(own, ["_tm_language ", "_tm_class"], "left").join(wider, ["_tm_script ", "_tm_class"], "left")
    band = F.coalesce("_tm_language _band", "_tm_script _band")

    def outside(times: float) -> Column:
        beyond = lambda m: (F.col(m) < band[m]["low"] - times * band[m]["wide"]) | (F.col(m) > band[m]["high"] + times * band[m]["wide"])
        return functools.reduce(lambda a, m: a + F.coalesce(beyond(m), F.lit(False)).cast("int"), FLOOR, F.lit(0))

    verdict = ~F.col("base_failed") & (outside(OUTER) == 0) & (outside(INNER) < 2)
    return rows.withColumn("kept", verdict).select(*kept, *names)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, by piece_bpe_32k and word_bpe_49k."""
    import public_tokenizers as p

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    with common.passing(spark):
        rows = judged(docs, p.path("piece_bpe_32k.model"), p.path("word_bpe_49k.json"))
        rows = rows.select("doc_id", *COUNTS, "base_failed", "kept", "script", "n_tokens", "n_tokens_other", "n_bytes_alone", "entropy")
        return common.cut(rows, "judged", stays=True)
