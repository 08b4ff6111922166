"""Packing of token streams into fixed windows by order-preserving dynamic programming.

Documents stay in the order of their ids. Windows are cut at document or sentence boundaries so that padding plus
penalties for cuts inside documents is least. With p(i) the tokens before boundary i, a window (i, j] of at most `width`
tokens costs width - (p(j) - p(i)) + penalty(j), so best(j) = width - p(j) + penalty(j) + min over i of (best(i) + p(i)),
and that minimum over a sliding range is kept by a monotone queue. Windows whose length is a power of two need no padding:
they are looked up one by one, and cost one penalty, so that full windows aren't broken up for nothing.
"""
from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .bpe import byte_chars

#: Windows that are planned at once.
AT_ONCE = 128
#: Where a sentence has ended: an end mark, and white space behind it, as UTF-8.
_STOP = re.compile(rb"[.!?:;](?=[ \t-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
#: Runs of white space that only the tokenizer's own library takes.
_LONG = re.compile(r"\s{256}")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
assert array("I").itemsize == 4 and sys.byteorder == "little"
_LOADED: dict = {}


class Ids:
    """Token ids of whole texts of a byte-level tokenizers file.

    Where the file is a plain one (its merges in the order of their ids, the usual pattern, no prefix space), a second
    library with the same vocabulary gives the same ids in a third of the time (the tests compare them on all code
    points). A text that holds a special token's string or a very long run of white space, and any text of another file,
    goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        back = {c: b for b, c in enumerate(byte_chars())}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        order = [ids.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout")
        self.fast = None
        if plain and all(a < b for a, b in zip([-1, *order], order)) and all(c in back for t in ids for c in t) and all(c in ids for c in back):
            ranks = {bytes(back[c] for c in t): i for t, i in ids.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(model["vocab"].values(), default=0) + 1 + len(self.special), np.int64)  # bytes of each token
        for t, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.sizes[i] = len(t.encode()) if t in self.special else len(t)

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """(ids as little-endian unsigned 32-bit, token offsets after which a sentence has ended) of a text. A place where
        white space follows an end mark is never within a token of a byte-level file."""
        if self.fast is None or any(t in text for t in self.special) or _LONG.search(text):
            ids = array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            ids = array("I", self.fast(text)).tobytes()
        stops = [m.end() for m in _STOP.finditer(text.encode("utf-8", "surrogatepass"))]
        if not stops:
            return ids, np.zeros(0, np.int64)
        ends = self.sizes[np.frombuffer(ids, "<u4")].cumsum()
        at = np.searchsorted(ends, stops)
        return ids, at[ends[np.minimum(at, len(ends) - 1)] == stops] + 1


def load(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def plan(ends: list[int], inside: list[bool], width: int, penalty: int) -> list[int]:
    """Indexes of the boundaries at which windows end. ends: growing token offsets of boundaries, no two further apart
    than width; inside: whether a boundary lies within a document. The last window ends at the boundary among those of
    the last width tokens for which the cost is least for each token that is packed."""
    n = len(ends)
    at, best, back = [0, *ends], [0] * (n + 1), [0] * (n + 1)
    index = {0: 0}
    powers = [1 << k for k in range(width.bit_length()) if 1 << k < width and 16 << k >= width]
    queue: deque[int] = deque([0])
    for j in range(1, n + 1):
        p = at[j]
        while at[queue[0]] < p - width:
            queue.popleft()
        i = queue[0]
        cost = width - p + best[i] + at[i]
        for size in powers:
            k = index.get(p - size)
            if k is not None and best[k] + penalty < cost:
                cost, i = best[k] + penalty, k
        best[j], back[j] = cost + (penalty if inside[j - 1] else 0), i
        key = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
        index[p] = j
    j = min((k for k in range(1, n + 1) if at[k] > at[n] - width), key=lambda k: (best[k] / max(at[k], 1), -k))
    cuts = []
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def _last_sizes(left: int, width: int) -> list[int]:
    """The rest of a partition is cut into powers of two, which need no padding."""
    return [width] * (left // width) + [1 << k for k in range(width.bit_length() - 1, -1, -1) if left % width >> k & 1]


class Packer:
    """Takes documents in order and gives pieces (doc index, start, length, crc, doc tokens, window, offset)."""

    def __init__(self, width: int, penalty: int):
        self.width, self.penalty, self.window, self.held, self.tokens = width, penalty, 0, deque(), 0

    def add(self, key, ids: bytes, ends: np.ndarray):
        """ids includes the end token; ends: sentence ends within. The rows that are settled are given."""
        self.held.append((key, ids, ends, 0))
        self.tokens += len(ids) // 4
        if self.tokens >= AT_ONCE * self.width:
            yield from self._settle(False)

    def finish(self):
        if self.held:
            yield from self._settle(True)

    def _settle(self, last: bool):
        width = self.width
        marks, before = [], 0
        for _, ids, stops, start in self.held:
            n = len(ids) // 4 - start
            stops = stops - start
            marks += [before + stops[(stops > 0) & (stops < n)], [before + n]]
            before += n
        ends = np.concatenate(marks)
        inside = np.ones(len(ends), bool)
        inside[np.cumsum([len(m) for m in marks])[1::2] - 1] = False
        gaps = np.diff(ends, prepend=0)
        if gaps.max(initial=0) > width:  # a sentence longer than a window is cut where windows fill
            more = np.concatenate([end - gap + width * np.arange(1, -(-gap // width)) for end, gap in zip(ends, gaps) if gap > width])
            ends, inside = np.append(ends, more), np.append(inside, np.ones(len(more), bool))
            order = np.argsort(ends, kind="stable")
            ends, inside = ends[order], inside[order]
        ends, inside = ends.tolist(), inside.tolist()
        at = 0
        spans = []
        if ends:
            cuts = plan(ends, inside, width, self.penalty)
            if last:  # what follows the last full window goes into windows of powers of two
                cuts = [c for c in cuts if ends[c] <= before - before % width or ends[c] <= before - width]
            for c in cuts:
                spans.append((at, ends[c]))
                at = ends[c]
        if last:
            for size in _last_sizes(before - at, width):
                spans.append((at, at + size))
                at += size
        taken = 0
        for a, b in spans:
            taken = b
            yield from self._emit(b - a)
        self.tokens -= taken

    def _emit(self, size: int):
        offset = 0
        while offset < size:
            key, ids, stops, start = self.held[0]
            total = len(ids) // 4
            length = min(size - offset, total - start)
            yield key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, self.window, offset
            offset += length
            if start + length == total:
                self.held.popleft()
            else:
                self.held[0] = (key, ids, stops, start + length)
        self.window += 1


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, width: int, penalty: int, kind, keep: bool):
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        ids, packer = load(path), Packer(width, penalty)
        end = np.array([end_id], "<u4").tobytes()

        def rows(found):
            if not found:
                return []
            key, *rest = zip(*found)
            rest[4] = [base + w for w in rest[4]]
            names = ["id", *[c.split(" ")[0] for c in SCHEMA.split(", ")]]
            return [pa.RecordBatch.from_arrays([pa.array(key, kind), *[pa.array(x, pa.int64()) for x in rest]], names=names)]

        for batch in batches:
            found: list = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body, ends = ids.encode(text.as_py())
                found += packer.add(key, body + end, ends)
                if len(found) >= 10_000:
                    yield from rows(found)
                    found = []
            yield from rows(found)
        yield from rows(list(packer.finish()))
        if not keep:
            _LOADED.clear()
        common.give_back()

    return run


def pack(docs: DataFrame, path: str, end_id: int, width: int = 2048, penalty: int = 12, id_col: str = "doc_id", text: str = "text", partitions: int | None = None, keep: bool = True) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Documents are ordered by id (equal ids by their text's hash) over range partitions; each partition is packed on its
    own as a stream that holds AT_ONCE windows, so memory doesn't depend on the partition. A null text is empty and gives
    its end token; repeated rows are packed each; an empty table gives no rows; other columns are left out. sequence_id is
    the partition's number times 2^36 plus the window's number there. path: a byte-level tokenizers file. keep: whether a Python worker keeps the loaded tokenizer for its next task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), common.whole(text).alias("text"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return rows.mapInArrow(_pack(path, end_id, width, penalty, to_arrow_type(kind), keep), f"id {kind.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """The whole table in windows of 2048 tokens, each document ended by id 1; see pack() for nulls, repeats and ties."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
