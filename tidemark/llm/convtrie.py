"""A prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those that end there. Only sequences go on: their
prefixes are aggregated with their weights, and those that no longer sequence begins with, told by an anti-join, are the
leaves. A node belongs to the sequence with its smallest member; that sequence holds all nodes below on its own way, so
the nodes of a sequence are one path, and sums over a subtree are those of the paths through its top.

A prefix is known by its length and the sums of its turns' digests, each mixed with its place: sums can be taken in
blocks, so that a conversation of any length is spread over tasks. Blocks of 2**BLOCK places are summed each for itself
and moved on by the blocks before.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

BLOCK = 12
#: Ids of one piece of an end list.
PIECE = 4_096
WORD = r"[^\x20\x09-\x0D]+"
LANES = ["l0", "l1", "l2", "l3"]


def running(rows: DataFrame, group: list[str], place: str, sums: list[str]) -> DataFrame:
    """rows, read from files, with the sums of each column up to and with the row, in their group by place."""
    rows = rows.withColumn("_tm_block", F.shiftright(place, BLOCK))
    up_to = Window.partitionBy(*group, "_tm_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(*group, "_tm_block").agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
    earlier = Window.partitionBy(*group).orderBy("_tm_block").rowsBetween(Window.unboundedPreceding, -1)
    moved = blocks.select(*group, "_tm_block", *[F.sum(f"_b_{c}").over(earlier).alias(f"_b_{c}") for c in sums]).filter(f"_b_{sums[0]} is not null")
    moved = common.cut(moved, "block-sums")
    rows = rows.withColumns({c: F.sum(c).over(up_to) for c in sums}).join(moved, [*group, "_tm_block"], "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"_b_{c}", F.lit(0)) for c in sums}).drop("_tm_block", *[f"_b_{c}" for c in sums])


def _node(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", depth, *lanes)))


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) of messages (conv_id, turn, role, text): places from 0 by turn, null first, then by
    role and digest; a null role or text is empty; rows without a conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), common.whole("text")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = messages.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return common.placed(rows, ["conv_id"], ["turn", "role", "digest"], "place").select("conv_id", "place", "digest", "words")


def forked(rows: DataFrame, of: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from turns: the first h turns of conversation c - c % of, then those of c after its first h;
    h is the checksum of c's decimal digits modulo `most`. Gives (conv_id, depth, digest, words) and all (conv_id)."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    rows = common.cut(rows.withColumn("h", h), "turns")
    lead = rows.filter((F.col("place") < most - 1) & (F.col("conv_id") % of == 0)).groupBy(F.col("conv_id").alias("base"))
    lead = lead.agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("lead"))
    convs = rows.groupBy("conv_id").agg(F.first("h").alias("h")).withColumn("base", F.col("conv_id") - F.col("conv_id") % of).join(lead, "base", "left")
    convs = common.cut(convs.select("conv_id", F.coalesce(F.slice("lead", 1, F.col("h").cast("int")), F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")).alias("lead"), "h"), "leads")
    first = convs.select("conv_id", F.explode("lead").alias("x")).select("conv_id", (F.col("x.place") + 1).alias("depth"), "x.digest", "x.words")
    short = convs.select("conv_id", (F.size("lead") - F.col("h")).alias("shift")).filter("shift < 0")
    own = rows.filter("place >= h").join(short, "conv_id", "left").select("conv_id", (F.col("place") + 1 + F.coalesce("shift", F.lit(0))).alias("depth"), "digest", "words")
    return first.union(own), convs.select("conv_id")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words) of each prefix of each conversation, from its turns; depth 0 is the root."""
    mixed = [F.xxhash64(F.lit(k), "depth", "digest") for k in (1, 2)]
    lanes = [x for m in mixed for x in (m.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(m, 33))]
    own = rows.select("conv_id", "depth", "words", *[x.alias(c) for c, x in zip(LANES, lanes)], *[x.alias(f"own_{c}") for c, x in zip(LANES, lanes)])
    sums = running(common.cut(own, "mixed"), ["conv_id"], "depth", LANES)
    before = [F.col(c) - F.col(f"own_{c}") for c in LANES]
    below = sums.select("conv_id", "depth", _node(F.col("depth"), [F.col(c) for c in LANES]).alias("node"), _node(F.col("depth") - 1, before).alias("parent"), "words")
    root = _node(F.lit(0), [F.lit(0)] * 4)
    return below.union(convs.select("conv_id", F.lit(0).cast("long"), root, F.lit(None).cast("binary"), F.lit(0).cast("long")))


def _pieces(batches):
    """Rows (node, conv_id, range) sorted so: the ids of each node in pieces, comma-joined."""
    node, ids, at, n = None, [], None, 0

    def out():
        return pa.RecordBatch.from_pylist([{"node": node, "range": at, "nth": n, "ids": ",".join(map(str, ids))}], schema=pa.schema([("node", pa.binary()), ("range", pa.int32()), ("nth", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for key, conv, r in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (key != node or len(ids) == PIECE):
                yield out()
                ids, n = [], n + 1
            node, at = key, r
            ids.append(conv)
    if ids:
        yield out()


def _hashed(batches):
    """Rows (node, ids) sorted by node and piece: a hash of each node's whole list, taken piece by piece."""
    node, h = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == node:
                h.update(b",")
            else:
                if h is not None:
                    done.append((node, h.hexdigest()))
                node, h = key, hashlib.sha256()
            h.update(ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done])], names=["node", "ends_sha256"])
            done = []
    if h is not None:
        done.append((node, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (conv_id, node): the hash of the ids that end at a node, ascending and comma-joined. Ranges of
    (node, id) are joined into pieces; a node's pieces, 4,096 ids each or a range's, are hashed one after the other."""
    pieces = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").withColumn("range", F.spark_partition_id())
    pieces = common.cut(pieces.mapInArrow(_pieces, "node binary, range int, nth long, ids string"), "end-pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "range", "nth").select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(every: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations that `prefixes` gives:

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (of the
    subtree), saved_tokens (words that members share with the first of each node of the subtree), ends_sha256 (of the ids
    that end there). Repeated turns count as often as they stand; an empty table gives no rows.
    """
    every = common.cut(every, "prefixes")
    ends = common.cut(every.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("x")).select("conv_id", "x.node", F.col("x.depth").alias("length")), "ends")
    lists = common.cut(end_lists(ends), "end-lists")
    sequences = ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("length").alias("length"))
    sequences = common.cut(sequences.withColumnRenamed("node", "last"), "sequences")
    rows = common.cut(every.join(sequences.drop("last"), "conv_id"), "sequence-prefixes")
    proper = rows.filter("depth < length").select(F.col("node").alias("last")).distinct()
    leaves = sequences.join(proper, "last", "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # conv_id, from here on, is the sequence that a node belongs to
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "parent", "words")])
    nodes = common.cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    paths = nodes.groupBy("conv_id").agg(F.sum("saved").alias("path"), F.min("depth").alias("begin"), F.max("depth").alias("end"))
    paths = common.cut(paths, "paths")
    own = sequences.select("conv_id").join(paths.select("conv_id", "path"), "conv_id", "left").join(leaves, "conv_id", "left")
    through = rows.select("conv_id", "node").join(own, "conv_id").groupBy("node").agg(F.sum(F.coalesce("path", F.lit(0))).alias("through"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    up_to = running(nodes.withColumn("so_far", F.col("saved")), ["conv_id"], "depth", ["so_far"]).join(paths, "conv_id")
    up_to = common.cut(up_to.join(through, "node"), "sums")
    hung = up_to.filter("depth = begin and depth > 0").select("node", F.col("parent").alias("on"))
    children = hung.groupBy("on").agg(F.count(F.lit(1)).alias("hung"))
    parents = hung.join(nodes.select(F.col("node").alias("on"), F.col("conv_id").alias("above")), "on").select("node", "above")
    out = up_to.join(children, up_to.node == children.on, "left").join(parents, "node", "left").join(lists, "node", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("through") - F.col("so_far") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """The trie of the table's conversations, each rebuilt from the first turns of another and its own."""
    with common.passing(spark):
        rows = turns(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
        return common.cut(trie(prefixes(*forked(rows))), "trie", stays=True)


SQL = r"""
with recursive bits as (select i as b, cast(i as bigint) as v, 0 as k from range(256) t(i)
  union all select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
crc_table as materialized (select b, v from bits where k = 8),
crcs as (select conv_id, cast(conv_id as varchar) as s, 0 as i, cast(4294967295 as bigint) as v from (select distinct conv_id from conversations where conv_id is not null)
  union all select c.conv_id, c.s, c.i + 1, xor(c.v // 256, t.v) from crcs c join crc_table t on t.b = xor(c.v % 256, ascii(substr(c.s, c.i + 1, 1))) where c.i < length(c.s)),
convs as materialized (select conv_id, conv_id - conv_id % 20 as base, xor(v, 4294967295) % 4 as h from crcs where i = length(s)),
given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
hashed as (select conv_id, turn, role, sha256(length(role) || ':' || role || text) as t, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from given),
rows as materialized (select conv_id, t, w, row_number() over (partition by conv_id order by turn nulls first, role, t) - 1 as place from hashed),
parts as (select c.conv_id, 0 as later, r.place, r.t, r.w from convs c join rows r on r.conv_id = c.base and r.place < c.h
  union all select r.conv_id, 1, r.place, r.t, r.w from convs c join rows r on r.conv_id = c.conv_id and r.place >= c.h),
rebuilt as (select *, row_number() over (partition by conv_id order by later, place) as depth from parts),
every as materialized (select conv_id, depth, string_agg(t, '') over (partition by conv_id order by depth) as node, w from rebuilt
  union all select conv_id, 0, '', 0 from convs),
nodes as materialized (select node, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs, any_value(w) as w from every group by node),
ends as (select node, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends from (select conv_id, arg_max(node, depth) as node from every group by conv_id) group by node),
children as materialized (select substr(node, 1, length(node) - 64) as node, count(*) as n from nodes where depth > 0 group by 1),
below as (select substr(node, 1, 64 * unnest(range(depth + 1))) as node, (n_convs - 1) * w as saved, cast(node not in (select node from children) as bigint) as leaf from nodes),
sums as (select node, sum(saved) as saved, sum(leaf) as leaves from below group by node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from nodes n join sums s on s.node = n.node left join nodes p on n.depth > 0 and p.node = substr(n.node, 1, length(n.node) - 64)
left join children c on c.node = n.node left join ends e on e.node = n.node
"""
