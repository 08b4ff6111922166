"""A Merkle manifest of a table: one tree of digests for each language, and one above their tops.

Levels are built in blocks of 2**STRIDE neighbours, all blocks at once. A stored row links a node to its block's top, its
parent in the table, with what stands beside it on each level in between. A recursive query ascends from each leaf along
these links, appends the siblings and folds the digest that was handed in. With a stride of 1 a link is one level.

A node over two digests is the hash of both as hex text; the last node of a level may stand alone and is hashed alone.
Null fields, empty and long texts have digests like all others; a null language is a part of its own, the first; null ids
come first in theirs and are never tampered with. Rows with the same id follow each other by digest; rows that are equal
in all fields have equal digests, and each is a leaf. An empty table gives no rows; further columns are left out.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Levels that a link spans. Each step of the climb writes all its rows with the siblings so far; at 30 GB single levels
#: write some 12 times the input, spans of eight one and a half.
STRIDE = 8

_LEVELS = """aggregate(sequence(1, up), array(digests), (levels, k) -> concat(levels, array(transform(
    sequence(0, (size(element_at(levels, -1)) - 1) div 2), i -> unhex(sha2(concat(
        lower(hex(get(element_at(levels, -1), 2 * i))), coalesce(lower(hex(get(element_at(levels, -1), 2 * i + 1))), '')), 256))))))"""
_PATH = "transform(slice(levels, 1, up), (level, k) -> named_struct('left', shiftright(i, k) % 2 = 1, 'digest', get(level, shiftright(i, k) ^ 1)))"
_FOLD = """aggregate({path}, {digest}, (h, x) -> unhex(sha2(case when x.digest is null then lower(hex(h))
    when x.left then concat(lower(hex(x.digest)), lower(hex(h))) else concat(lower(hex(h)), lower(hex(x.digest))) end, 256)))"""
_BESIDE = "unhex(array_join(transform({path}, x -> hex(x.digest)), ''))"


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def _up(nodes: DataFrame, stride: int, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Of the nodes (part, pos, last, key, digest, further columns) of a level: their links (part, key, further columns, up,
    path, top), and the nodes `stride` levels up. last: the largest place of the part. up: the key of the block's top, null
    where that is the part's top, whose digest is `top` then. path: what stands beside the node on each level."""
    rows = nodes.withColumn("block", F.shiftright("pos", stride))
    rows = rows.groupBy("part", "block").agg(F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("part", "pos", "last")]))).alias("rows"))
    final, n = F.col("last") < (1 << stride), F.size("rows")
    rows = rows.withColumn("digests", F.col("rows.digest")).withColumn("up", F.when(~final, F.lit(stride)).when(n == 1, 0).otherwise(F.length(F.bin(n - 1))))
    rows = rows.withColumn("levels", F.when(F.col("up") == 0, F.array("digests")).otherwise(F.expr(_LEVELS))).drop("digests")
    rows = common.cut(rows, "manifest-blocks")
    top = F.get(F.element_at("levels", F.lit(-1)), F.lit(0))
    key = F.concat(F.lit(prefix), F.col("block").cast("string"), F.lit("/"), F.col("part"))
    links = rows.select("part", F.when(~final, key).alias("to"), F.when(final, top).alias("top"), "levels", "up", F.posexplode("rows").alias("i", "x"))
    links = links.select("part", "x.*", F.col("to").alias("up"), F.expr(_PATH).alias("path"), "top").drop("pos")
    return links, rows.filter(~final).select("part", F.col("block").alias("pos"), F.shiftright("last", stride).alias("last"), key.alias("key"), top.alias("digest"))


def _tree(nodes: DataFrame, stride: int, prefix: str) -> list[DataFrame]:
    """Links of all levels, the lowest first."""
    out = []
    while not out or not nodes.isEmpty():
        links, nodes = _up(nodes, stride, f"{prefix}{len(out) + 1}/")
        out.append(links)
    return out


def manifest(leaves: DataFrame, order: list[str], stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """Links of the leaves, and of all other nodes, from rows (part, digest, further columns). part: a string that is not
    null; leaves stand in their part by `order`. A part may hold any share of the rows."""
    rows = common.placed(leaves, ["part"], order, "pos")
    rows = common.cut(rows, "manifest-leaves")
    sizes = common.cut(rows.groupBy("part").agg(F.max("pos").alias("last")), "manifest-sizes")
    low, *high = _tree(rows.join(sizes, "part").withColumn("key", F.lit("")), stride, "p")
    ends = [links.filter("top is not null").select("part", F.col("top").alias("digest")).distinct() for links in (low, *high)]
    for more in ends[1:]:
        ends[0] = ends[0].union(more)
    parts = common.placed(ends[0].select(F.col("part").alias("name"), "digest", F.lit("").alias("part")), ["part"], ["name"], "pos")
    parts = common.cut(parts.withColumn("key", F.concat(F.lit("r/"), "name")), "manifest-parts")
    above = _tree(parts.drop("name").withColumn("last", F.lit(parts.count() - 1).cast("long")), stride, "r")
    in_part = lambda links: links.withColumn("up", F.coalesce("up", F.concat(F.lit("r/"), "part")))
    inner = [in_part(x).withColumn("root", F.lit(None).cast("binary")) for x in high] + [x.withColumn("root", F.col("top")) for x in above]
    every = inner[0].select("key", "up", "path", "top", "root")
    for more in inner[1:]:
        every = every.union(more.select("key", "up", "path", "top", "root"))
    return common.cut(in_part(low), "manifest-low"), common.cut(every, "manifest-links")


@contextmanager
def _any_rows(spark):
    """Spark ends a recursion past a million rows by default; a climb has as many rows as leaves on each step."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def climbed(low: DataFrame, inner: DataFrame, handed: str, keep: list[str]) -> DataFrame:
    """For each leaf: the columns `keep`, subroot, root, proof (the siblings up to the root, one after the other) and folded,
    the root that the digest in the column `handed` and these siblings lead to."""
    spark, names = low.sparkSession, ", ".join(keep)
    c_names = ", ".join(f"c.{k}" for k in keep)
    with _any_rows(spark):
        rows = spark.sql(
            f"""with recursive climb as (
              select {names}, up as at, {_FOLD.format(path="path", digest=handed)} as folded, {_BESIDE.format(path="path")} as proof, top as subroot, cast(null as binary) as root from {{low}}
              union all
              select {c_names}, n.up, {_FOLD.format(path="n.path", digest="c.folded")}, concat(c.proof, {_BESIDE.format(path="n.path")}), coalesce(c.subroot, n.top), n.root
              from climb c join {{inner}} n on n.key = c.at)
            select {names}, subroot, root, proof, folded from climb where at is null""",
            low=low, inner=inner,
        )
        return common.cut(rows, "manifest-climbed", stays=True)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, and the root it folds to after n_chars of some rows has been tampered with."""
    docs = common.table(spark, sf_dir, "documents")
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars").cast("decimal(20,0)") + 1 if i == 3 else c for i, c in enumerate(given)]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("part"), leaf_digest(*given).alias("digest"), F.when(tampered, leaf_digest(*changed)).alias("changed"))
    with common.passing(spark):
        low, inner = manifest(leaves, ["doc_id", "digest"])
        rows = climbed(low.withColumn("handed", F.coalesce("changed", "digest")), inner, "handed", ["doc_id", "digest"])
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


SQL = r"""
with recursive bits as (select i as b, cast(i as bigint) as v, 0 as k from range(256) t(i)
  union all select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
crc_table as materialized (select b, v from bits where k = 8),
crcs as (select doc_id, cast(doc_id as varchar) as s, 0 as i, cast(4294967295 as bigint) as v from (select distinct doc_id from documents where doc_id is not null)
  union all select c.doc_id, c.s, c.i + 1, xor(c.v // 256, t.v) from crcs c join crc_table t on t.b = xor(c.v % 256, ascii(substr(c.s, c.i + 1, 1))) where c.i < length(c.s)),
crc as (select doc_id, xor(v, 4294967295) as crc from crcs where i = length(s)),
fields as (select d.doc_id, coalesce('=' || lang, '') as part, coalesce(crc.crc % 7 = 0, false) and n_chars is not null as changed,
  coalesce(strlen(cast(d.doc_id as varchar)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a,
  coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as n, strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1) as n1, coalesce(strlen(text) || ':' || text, '-') as t
  from documents d left join crc on crc.doc_id = d.doc_id),
hashed as (select doc_id, part, sha256(a || n || t) as leaf, case when changed then sha256(a || n1 || t) else sha256(a || n || t) end as handed from fields),
leaves as materialized (select *, row_number() over (partition by part order by doc_id nulls first, leaf) - 1 as pos, row_number() over () as rid from hashed),
low as (select part, 0 as lvl, pos, leaf as d, count(*) over (partition by part) as n from leaves
  union all select part, lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), cast(ceil(max(n) / 2) as bigint) from low where n > 1 group by part, lvl, pos // 2),
tops as materialized (select part, d from low where n = 1),
parts as (select part, d, row_number() over (order by part) - 1 as pos, count(*) over () as n from tops),
high as (select 0 as lvl, pos, d, n from parts
  union all select lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), cast(ceil(max(n) / 2) as bigint) from high where n > 1 group by lvl, pos // 2),
beside as materialized (select part, 0 as tree, lvl, pos, d, n from low union all select '', 1, lvl, pos, d, n from high),
climb as (select rid, part, 0 as tree, 0 as lvl, pos, handed as h, '' as proof, false as done from leaves
  union all select c.rid, c.part, case when b.n = 1 then 1 else c.tree end, case when b.n = 1 then 0 else c.lvl + 1 end, case when b.n = 1 then p.pos else c.pos // 2 end,
    case when b.n = 1 then c.h when s.d is null then sha256(c.h) when c.pos % 2 = 1 then sha256(s.d || c.h) else sha256(c.h || s.d) end, c.proof || coalesce(s.d, ''), b.n = 1 and c.tree = 1
  from climb c join beside b on b.tree = c.tree and b.lvl = c.lvl and b.pos = c.pos and b.part = case when c.tree = 0 then c.part else '' end
  left join beside s on b.n > 1 and s.tree = c.tree and s.lvl = c.lvl and s.pos = xor(c.pos, 1) and s.part = b.part
  left join parts p on p.part = c.part where not c.done)
select l.doc_id, l.leaf, t.d as subroot, r.d as root, sha256(c.proof) as proof_sha256, c.h as folded_root, c.h = r.d as verified
from climb c join leaves l on l.rid = c.rid join tops t on t.part = l.part cross join (select d from high where n = 1) r where c.done
"""
