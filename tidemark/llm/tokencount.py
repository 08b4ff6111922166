"""Token counts by a digest cache.

The content of a text is normalised as far as the tokenizer cannot see the difference (runs of spaces and line ends
become one space, ends are trimmed), digested, and joined with the digest of tokenizer file and library to the stored
counts. Only distinct contents without a stored count are encoded; their counts are appended to the cache.
"""
from __future__ import annotations

import hashlib
import os
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .bpe import byte_chars

#: Distinct pieces of text that one Python worker keeps counts of.
PIECES = 400_000
CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
_LOADED: dict = {}
BYTES = dict(enumerate(byte_chars()))


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version: a new version of either starts new counts."""
    with open(path, "rb") as f:
        body = hashlib.sha256(f.read())
    if path.endswith(".json"):
        import tokenizers as lib
    else:
        import sentencepiece as lib
    body.update(f"{lib.__name__} {lib.__version__}".encode())
    return body.hexdigest()


def _letters(piece: str) -> tuple[str, ...] | None:
    """The words, as the model takes them, of a piece of ASCII letters, or of letters in composed form, and end marks."""
    word = piece.rstrip(".,;:!?")
    if not word.isalpha():
        return None
    low = word.lower()
    if not low.isascii():
        if "Σ" in word or not low.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        low = low.encode().decode("latin-1").translate(BYTES)
    return (low,) if len(word) == len(piece) else (low, piece[len(word) :])


def _counter(path: str):
    """Two functions: pieces of a text, and the counts of a list of pieces. A piece never shares a token with the next."""
    if path in _LOADED:
        return _LOADED[path]
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        drops_space = '"behavior":"Removed"' in tok.to_str().replace(" ", "")

        known: dict[str, int] = {}

        def whole(pieces):
            return [len(e.ids) for e in tok.encode_batch(pieces, add_special_tokens=False)]

        def plain(words):
            return [len(tok.model.tokenize(w)) for w in words]

        def count(pieces):
            """Letters with marks after them need no pattern: the library's model gets the letters and the marks.
            Anything else goes through the library's whole course."""
            split = [_letters(p) for p in pieces]
            common.fill(known, {w for x in split if x for w in x}, plain, PIECES)
            rest = iter(whole([p for p, x in zip(pieces, split) if x is None]))
            return [next(rest) if x is None else sum(map(known.__getitem__, x)) for x in split]

        def pieces(text):
            return text.replace("\n", " ").split(" ") if drops_space else [text]

        count = count if drops_space else whole
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(pieces):
            return [len(x) for x in model.encode(pieces, num_threads=1)]

        def pieces(text):
            return [text]
    _LOADED[path] = pieces, count, {}, drops_space if path.endswith(".json") else False
    return _LOADED[path]


def counter_of_words(path: str):
    """A function that counts the tokens of each of a list of words."""
    return _counter(path)[1]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts; pieces met before are taken from the worker's memory."""
    pieces, count, cache, by_word = _counter(path)
    out: list[int] = []
    for a, b in common.sub_batches(texts):
        if not by_word:
            out += count(texts[a:b])
            continue
        split = [pieces(t) for t in texts[a:b]]
        common.fill(cache, set().union(*split), count, PIECES)
        out += [sum(map(cache.__getitem__, x)) for x in split]
    return out


def _encode(path: str, tokenizer: str):
    def run(batches):
        for batch in batches:
            n = count_texts(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return run


def normalised(text, path: str):
    """Spaces and line ends collapse for a tokenizer that drops white space; other tokenizers see each of them."""
    if path.endswith(".json") and _counter(path)[3]:
        return F.trim(F.regexp_replace(text, "[ \\n]+", " "))
    return text


def token_counts(docs: DataFrame, path: str, cache_path: str, text: str = "text", content: str = "content", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the digest of its normalised text and the token count of the whole text (null: empty).

    path: a tokenizer file (.json: tokenizers, .model: sentencepiece). cache_path: Parquet table of CACHE_SCHEMA, made if
    it isn't there; one writer at a time. Repeated rows and copies share one count; an empty table gives no rows; other
    columns pass through, but a column named as one of the two outputs is replaced. Every text is encoded whole.
    """
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    keyed = docs.withColumn(content, F.sha2(normalised(common.whole(text), path), 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored():
        """One count for each content, should it have been appended twice."""
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    seen = stored().select(F.col("content").alias("_tm_content"))
    wanted = keyed.select(F.col(content).alias("_tm_content"), common.whole(text).alias("_tm_text"))
    misses = common.distinct_contents(wanted, "_tm_content", "_tm_text").join(seen, "_tm_content", "left_anti")
    misses.mapInArrow(_encode(path, tokenizer), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = stored().select(F.col("content").alias(content), F.col("n_tokens").alias(n_tokens))
    return keyed.drop(n_tokens).join(counts, content, "left")


def query(spark, sf_dir: str) -> DataFrame:
    """Counts by word_bpe_49k.json over the whole table, with a cache of its own, so that every text is a miss once."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(common.whole("text")).cast("long").alias("n_bytes"))
    found = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), common.scratch(spark, "token-cache"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
