"""BPE encoding and decoding by a prefix-sharing trie traversal.

For a fixed merge list, the last token of the encoding of a prefix depends on that prefix alone, and the encoding of a
word is found backwards from the last tokens of its prefixes. So distinct words go into a trie; a depth-first walk gives
each node its last-token state from those of its ancestors, once for all words below it; words are read off at the ends.
A sorted list of words with the lengths of common prefixes is such a trie, and going through it is the walk.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from . import common

#: Distinct pieces of text, words and token pairs that one Python worker keeps results of.
PIECES, WORDS, PAIRS = 300_000, 300_000, 1_000_000
#: Bytes of text that a task encodes at once, about.
SLICE = 8_000_000
SPACE = "\t-\r \x85\xa0  -     　"
_LOADED: dict = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    stands = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [stands[b] for b in range(256)]


class TrieBPE:
    """A tokenizer file of the kind with word ends: lower case, words by a pattern, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: rank of each pair of tokens that merges, and for each merged token its rank and halves
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[a, b] = r
            self.made.setdefault(a + b, (r, a, b))
        # a token is of use only if it can be made from single symbols
        self.inner = {t for t in self.vocab if not t.endswith(self.end) and (len(t) == 1 or t in self.made)}
        self.final = {t[: -len(self.end)] for t in self.vocab if t.endswith(self.end) and (len(t) == 1 + len(self.end) or t in self.made)}
        self.longest = max(map(len, self.inner | self.final))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", SPACE))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = str.maketrans({b: c for b, c in enumerate(byte_chars())})
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.shown = [str(i) for i in range(max(self.text_of, default=0) + 1)]
        self.known_pieces: dict[str, tuple[str, str]] = {}

    def _fits(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is just these two tokens. Undo the merges that made them, the latest
        first; at each step no merge across the border may come before the merge that was undone last."""
        before, rank, made = float("inf"), self.rank, self.made
        a, b = left, right
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                return False
            ra, rb = made.get(a, (-1,))[0], made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal pairs the one further left is merged first, so the right one is undone first
                before, a = ra, made[a][2]
            else:
                before, b = rb + 1, made[b][1]

    def _fit(self, key: tuple[str, str]) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        got = self.fits[key] = self._fits(*key)
        return got

    def _last(self, path: str, depth: int, last: list[str], tokens: set[str], end: str) -> str:
        """The last token of the encoding of path[:depth], from the last tokens of its proper prefixes. Just one token
        fits, so they may be tried in any order: the parent's token grown by a symbol, then the longest first."""
        grown = len(last[depth - 1]) + 1
        for size in (grown, *range(min(depth, self.longest), 0, -1)):
            token = path[depth - size : depth]
            if token in tokens:
                token += end
                if size == depth:
                    return token
                key = last[depth - size], token
                got = self.fits.get(key)
                if self._fit(key) if got is None else got:
                    return token
        raise ValueError(f"no encoding: {path[:depth]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word, a string of byte characters."""
        out: dict[str, list[str]] = {}
        last: list[str] = [""]  # last[d]: the state of the current trie path's node at depth d
        path, ends = "", len(self.end)
        for word in sorted(words):
            n = len(word)
            most = min(n, len(path) + 1) - 1
            shared = 0
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, n):
                last.append(self._last(word, depth, last, self.inner, ""))
            path = word[: n - 1]
            token = self._last(word, n, last, self.final, self.end)
            back, depth = [token], n - len(token) + ends
            while depth:
                token = last[depth]
                back.append(token)
                depth -= len(token)
            back.reverse()
            out[word] = back
        return out

    def split(self, piece: str) -> list[str]:
        """Words of a piece as byte characters; a special token is given as "\0" and its text."""
        word = piece.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word)):
            low = word.lower()
            if not low.isascii():
                if not low.isalpha():
                    return self._split(piece)
                low = low.encode().decode("latin-1").translate(self.bytes)
            return [low] if len(word) == len(piece) else [low, piece[len(word) :]]
        return self._split(piece)

    def _split(self, piece: str) -> list[str]:
        out = []
        for i, part in enumerate(self.specials.split(piece) if self.specials else [piece]):
            if i % 2:
                out.append("\0" + part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                out += [w.encode().decode("latin-1").translate(self.bytes) for w in self.words.findall(part)]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[tuple[str, str]]:
        """(ids joined by spaces, decoded text) of each piece; the ids of a word are decoded once for all pieces."""
        split = [self.split(p) for p in pieces]

        def fresh(words):
            got = self.encode_words([w for w in words if w[0] != "\0"])
            out, shown = [], self.shown
            for w in words:
                ids = [self.vocab[t] for t in got[w]] if w[0] != "\0" else [self.special[w[1:]]]
                out.append((" ".join([shown[i] for i in ids]), self.decode(ids)))
            return out

        common.fill(self.known, set().union(*split), fresh, WORDS)
        known = self.known
        return [known[words[0]] if len(words) == 1 else (" ".join([known[w][0] for w in words]), " ".join([known[w][1] for w in words])) for words in split]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes for a file without a decoder: the tokens joined by spaces; unknown ids are left out."""
        text_of = self.text_of
        return " ".join([text_of[i] for i in ids if i in text_of])

    def encode_array(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(ids joined by spaces, decoded text, number of ids) of each whole text. A piece never shares a token with the
        next, and decoding joins tokens by spaces, so the ids of a piece are found, and decoded, once for all its uses:
        Arrow tells the pieces apart and joins what is found for them."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        pieces = pc.list_flatten(split).dictionary_encode()
        names, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy(zero_copy_only=False)
        missing = [p for p in names if p not in self.known_pieces]
        if len(self.known_pieces) + len(missing) > PIECES:
            common.trim(self.known_pieces, PIECES)
            missing = [p for p in names if p not in self.known_pieces]
        self.known_pieces.update(zip(missing, self.encode_pieces(missing)))
        ids, decoded = zip(*map(self.known_pieces.__getitem__, names)) if names else ((), ())
        count = np.array([x.count(" ") + 1 if x else 0 for x in ids], np.int64)
        # pieces without a token go: white space of other kinds
        some = count[at] > 0 if len(at) else np.zeros(0, bool)
        starts = np.concatenate([[0], np.cumsum(some)])[ends]
        at = pa.array(at[some])

        def joined(found):
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(found, pa.large_string()).take(at)), pa.scalar(" ", pa.large_string()))

        tokens = np.concatenate([[0], np.cumsum(count[at.to_numpy(zero_copy_only=False)])])
        return joined(ids), joined(decoded), tokens[starts[1:]] - tokens[starts[:-1]]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """As encode_array, of a list, which is taken in parts."""
        out = []
        for a, b in common.sub_batches(texts):
            ids, decoded, n = self.encode_array(pa.array(texts[a:b], pa.large_string()))
            out += zip(ids.to_pylist(), decoded.to_pylist(), n.tolist())
        return out


def load(path: str) -> TrieBPE:
    if path not in _LOADED:
        _LOADED[path] = TrieBPE(path)
    return _LOADED[path]


def _sha256(texts: pa.Array) -> list[str]:
    """Digests of the UTF-8 of large strings, without a copy of each."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]


def _digests(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at, n in common.slices(batch.column(1), SLICE):
                ids, decoded, count = bpe.encode_array(pc.fill_null(batch.column(1).slice(at, n), ""))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(count, pa.int64()), pa.array(_sha256(ids), pa.string()), pa.array(_sha256(decoded), pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        bpe = load(path)
        for batch in batches:
            got = bpe.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            ids = [[int(i) for i in x[0].split()] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.string())], names=["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text (null: empty). Ties, repeated rows and empty tables need
    no care: every row is encoded for itself, without a shuffle. Other columns are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), common.whole(text).alias("text")).mapInArrow(_ids(path), f"id {kind}, ids array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes the whole table; the ids and the decoded text leave the task as digests."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.whole("text").alias("text"))
    out = docs.mapInArrow(_digests(public_tokenizers.path("word_bpe_49k.json")), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", "doc_id")
