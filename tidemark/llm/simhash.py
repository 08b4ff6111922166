"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 3 bits apart meet half way: one bit flipped in each leaves at most one bit between them. Every
distinct fingerprint emits all variants within half the radius, that is itself and each one-bit flip, once for each of
three blocks of bits that is masked out; of a pair that differs, some block holds a differing bit, and under that block's
mask at most two are left, so both emit a common variant. Variants are shuffled; colliding fingerprints are deduplicated
and verified; a task gives the links that join what it has found, not all pairs. Components are then joined by stars.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

#: Fixed constants of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SEED, RADIUS = 42, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(buf: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a buffer: those under 32 bytes by size, many at once; longer ones one by one."""
    out = np.empty(len(starts), np.uint64)
    raw = np.frombuffer(buf + b"\0" * 8, np.uint8)
    n = len(raw) - 7
    as64 = np.ndarray((n,), "<u8", raw, strides=(1,))
    as32 = np.ndarray((n,), "<u4", raw, strides=(1,))
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(33))
    u = np.uint64
    with np.errstate(over="ignore"):
        for size in range(32):
            idx = order[bounds[size] : bounds[size + 1]]
            for a in range(0, len(idx), 32768):
                part = idx[a : a + 32768]
                at = starts[part]
                h = np.full(len(part), (seed + P5 + size) & (1 << 64) - 1, np.uint64)
                for k in range(size // 8):
                    h ^= _rotl(as64[at + 8 * k] * u(P2), 31) * u(P1)
                    h = _rotl(h, 27) * u(P1) + u(P4)
                done = size // 8 * 8
                if size & 4:
                    h ^= as32[at + done].astype(np.uint64) * u(P1)
                    h = _rotl(h, 23) * u(P2) + u(P3)
                    done += 4
                for k in range(done, size):
                    h ^= raw[at + k].astype(np.uint64) * u(P5)
                    h = _rotl(h, 11) * u(P1)
                h ^= h >> u(33)
                h *= u(P2)
                h ^= h >> u(29)
                h *= u(P3)
                out[part] = h ^ (h >> u(32))
    view = memoryview(buf)
    for i in order[bounds[32] :]:
        out[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + sizes[i]], seed)
    return out


def shingle_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, their XXH64 hashes one text after the other): runs of words of other than white
    space (ASCII), A-Z lower-cased; a shorter text is one run, a text without a word has none."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    if not counts.sum():
        return counts, np.zeros(0, np.uint64)
    buf = b" ".join([b" ".join(s) for s in split if s])
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    first, after = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    word = np.repeat(np.cumsum(counts) - counts, shingles) + nth
    last = word + np.minimum(counts[doc], words) - 1
    return shingles, xxh64_slices(buf, first[word], after[last] - first[word])


def fingerprints(texts: list[str], words: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints of whole texts: a bit is set if it is set in over half the hashes of the shingles,
    repeats included. No word: zero."""
    shingles, h = shingle_hashes(texts, words)
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out.view(np.int64)
    doc = np.repeat(np.arange(len(texts)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    # bits are counted in byte lanes over at most 255 hashes of a document, then in full
    lead = np.flatnonzero(nth % 255 == 0)
    owner = doc[lead]
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        part = np.add.reduceat((h >> np.uint64(k)) & lanes, lead).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(part, edge, axis=0, dtype=np.int64)  # lane i counts bit 8 i + k
        over = 2 * total > shingles[owner[edge]][:, None]
        for lane in range(8):
            out[owner[edge]] |= over[:, lane].astype(np.uint64) << np.uint64(8 * lane + k)
    return out.view(np.int64)


def _prints(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        got = [fingerprints(texts[a:b]) for a, b in common.sub_batches(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], names=["id", "fp"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants() -> list[tuple[int, int]]:
    """(mask, flip) of every variant: a block masked out, and no bit or one of the others flipped. The masked bits of the
    flip hold the block's number plus one, so that variants of different blocks differ."""
    out = []
    for b, (lo, hi) in enumerate(BLOCKS):
        mask = (1 << 64) - 1 ^ ((1 << hi) - (1 << lo))
        out += [(_signed(mask), _signed((b + 1) << lo | flip)) for flip in [0, *(1 << i for i in range(64) if not lo <= i < hi)]]
    return out


def _near(fps: np.ndarray, pairs_of_one: int = 16) -> list[np.ndarray]:
    """Groups of a bucket's sorted distinct fingerprints that are linked among themselves. The fingerprints differ in few
    bits, so there are few flips of up to RADIUS of these: where a bucket holds more than `pairs_of_one` times as many
    fingerprints as there are flips, each flip of all fingerprints is looked up among them, with work in proportion to
    their number. In a smaller bucket each fingerprint is compared with those that no link has reached."""
    u, n = fps.view(np.uint64), len(fps)
    spread = _spread(u)
    flips = sum(math.comb(len(spread), k) for k in range(1, RADIUS + 1))
    if n > pairs_of_one * flips:
        masks = [sum(1 << b for b in c) for k in range(1, RADIUS + 1) for c in itertools.combinations(spread, k)]
        return [fps[g] for g in _groups(_looked_up(np.sort(u), np.argsort(u), masks))]
    out, left = [], np.arange(n)
    while len(left):
        group, todo = [left[0]], [left[0]]
        left = left[1:]
        while todo and len(left):
            hit = np.bitwise_count(u[left] ^ u[todo.pop()]) <= RADIUS
            new = left[hit]
            left = left[~hit]
            group.extend(new)
            todo.extend(new)
        if len(group) > 1:
            out.append(fps[np.array(group)])
    return out


def _looked_up(s: np.ndarray, place: np.ndarray, masks: list[int]) -> np.ndarray:
    """The least place that links reach from each fingerprint; s is sorted, place tells where each one stands. Labels go
    along the links until none changes, and jump to their own labels in between."""
    n = len(s)
    label = np.arange(n)
    while True:
        before = label.copy()
        for m in masks:
            want = s ^ np.uint64(m)
            at = np.minimum(np.searchsorted(s, want), n - 1)
            a = np.flatnonzero(s[at] == want)
            label[a] = np.minimum(label[a], label[at[a]])
        label = label[label]
        if np.array_equal(label, before):
            break
    out = np.empty(n, np.int64)
    out[place] = place[label]
    return out


def _groups(label: np.ndarray) -> list[np.ndarray]:
    """Places of equal labels, groups of one left out."""
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _spread(u: np.ndarray) -> list[int]:
    """Bits in which the bucket's fingerprints differ at all."""
    differ = int(np.bitwise_or.reduce(u ^ u[0]))
    return [b for b in range(64) if differ >> b & 1]


def _links(batches):
    """Rows (variant, fp) sorted by variant: links from the smallest fingerprint of each linked group to the others."""

    def give(key, fp):
        same = np.flatnonzero(key[1:] == key[:-1])
        if not len(same):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        a, b = [], []
        two = edge[size == 2]
        near = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= RADIUS]
        a.append(np.minimum(fp[near], fp[near + 1]))
        b.append(np.maximum(fp[near], fp[near + 1]))
        for e, s in zip(edge[size > 2], size[size > 2]):
            for group in _near(np.unique(fp[e : e + s])):
                low = group.min()
                rest = group[group != low]
                a.append(np.full(len(rest), low))
                b.append(rest)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last variant may go on in the next batch
        yield from give(key[:whole], fp[:whole])
        key, fp = key[whole:], fp[whole:]
    if len(key):
        yield from give(key, fp)


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b), a < b: enough links between distinct fingerprints at most RADIUS bits apart to join all that are linked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m, f in _variants()]))
    # a number of partitions that stays, as fingerprints are few bytes and their variants many
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(F.col(fp).alias("fp")).distinct().repartition(n, "fp").select("fp", pairs.alias("v"))
    rows = rows.select(F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("variant"), "fp")
    rows = rows.repartition(F.col("variant")).sortWithinPartitions("variant", "fp")
    return rows.mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of each node of an undirected graph given as (a, b): root is the component's smallest node.

    Large and small stars by turns, each a minimum per node and a join with it, until nothing changes; each round's edges
    and minima are written to the shared folder, so the lineage stays short. Minima are combined before the shuffle, and
    the joins are plain ones that the engine may split at a hot node.
    """
    with common.passing(edges.sparkSession):
        edges = _starred(edges, most_rounds)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _starred(edges: DataFrame, most_rounds: int) -> DataFrame:
    """(a, b): every node b with the smallest one a of its component."""
    edges = common.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()

    last = state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        low = common.cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "minima")
        # large star: each node's larger neighbours are joined to the least of it and its neighbours
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        edges = common.cut(large, "edges")
        # small star: each node and its smaller neighbours are joined to the least of these
        low = common.cut(edges.groupBy("b").agg(F.min("a").alias("low")), "minima")
        small = edges.join(low, "b").select("low", F.explode(F.array("a", "b")).alias("b"))
        edges = common.cut(small.select(F.col("low").alias("a"), "b").filter("a < b").distinct(), "edges")
        now = state(edges)
        if now == last:
            return common.cut(edges, "stars", stays=True)
        last = now
    raise RuntimeError("components: rounds are used up")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: component_id is the smallest id that links of RADIUS bits reach.

    Null texts are empty; texts without a word have fingerprint zero, linked like any other. Rows repeat as given; a row
    whose id is null keeps its fingerprint and takes part, but is never the smallest. An empty table gives no rows; other
    columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), common.whole(text).alias("text"))
    with common.passing(docs.sparkSession):
        prints = common.cut(rows.mapInArrow(_prints, f"id {kind}, fp long"), "prints", stays=True)
        reps = common.cut(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
        roots = components(common.cut(links(reps), "links"))
        named = reps.join(roots, reps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
        least = common.cut(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
        of = common.cut(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes", stays=True)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_duplicates() for nulls, repeats and ties."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
