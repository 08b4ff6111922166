"""Exact top-k inner products by a dual-tree search over a cover tree.

A cover tree is fitted on a bounded sample; every vector, query or not, descends it to a leaf, so queries and data are
indexed together. Below the leaves, data lie in blocks and queries in groups of bounded size, each with the ball around its
rows; a leaf with a third of all rows is many blocks. First each group searches a block of its own leaf (and of near ones,
if that is small), which gives every query a kth score. Then pairs of nodes are descended from the root: a pair whose
centres and covering radii allow no product over the worst kth score below its query node is dropped with all pairs under
it. Pairs of leaves that are left give pairs of group and block, which are held against their own balls, best bounds first;
after the best ones the kth scores are taken again, and what they rule out isn't searched. Where vectors spread evenly in
many dimensions the balls rule out little, and the search is a blocked one over all pairs that are left.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Vectors that the tree is fitted on, at most; leaves; vectors of a block; scale of the integers.
SAMPLE, LEAVES, BLOCK, SCALE = 4_096, 128, 1_024, 64.0
#: Queries of a group; blocks that a task searches for a group at once; best blocks after which kth scores are taken again.
GROUP, CHUNK, EARLY = 512, 64, 16


@dataclass
class Tree:
    """Nodes level by level: centres, parents (root: itself), and the nodes of the last level, the leaves."""

    centres: np.ndarray
    parents: np.ndarray
    levels: list[np.ndarray]

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each row, its distance from the leaf's centre): at each level the nearest child."""
        at = np.zeros(len(x), np.int64)
        for nodes in self.levels[1:]:
            c = self.centres[nodes]
            d = (c**2).sum(1)[None, :] - 2 * x @ c.T
            d[self.parents[nodes][None, :] != at[:, None]] = np.inf
            at = nodes[d.argmin(1)]
        return at, np.sqrt(((x - self.centres[at]) ** 2).sum(1))

    def up(self, leaf_values: dict[int, float], join, none: float, moved: bool = False) -> np.ndarray:
        """A value of each node from those of the leaves below it; moved: the distance between centres is added on the way."""
        out = np.full(len(self.centres), none)
        for leaf, v in leaf_values.items():
            out[leaf] = v
        for nodes in self.levels[:0:-1]:
            for n in nodes:
                p = self.parents[n]
                step = float(np.sqrt(((self.centres[n] - self.centres[p]) ** 2).sum())) if moved else 0.0
                out[p] = join(out[p], out[n] + step)  # an infinite one stays so
        return out


def cover_tree(x: np.ndarray, leaves: int = LEAVES) -> Tree:
    """A cover tree of the rows of x. Each level halves the radius: centres of a level are farther apart than it, and every
    row is within it of some centre of the level. A level that would pass `leaves` centres is the last and keeps those that
    lie farthest from each other; with all rows at one place the root is the only leaf."""
    centres, parents, levels = [x[0]], [0], [np.zeros(1, np.int64)]
    owner = np.zeros(len(x), np.int64)
    radius = float(np.sqrt(((x - x[0]) ** 2).sum(1).max()))
    while radius > 1e-9 and len(levels) < 40:
        radius /= 2
        picks: list[tuple[int, np.ndarray]] = []
        new = np.zeros(len(x), np.int64)
        for node in levels[-1]:
            rest, pick = np.flatnonzero(owner == node), centres[node]
            while len(rest) and len(picks) <= leaves:
                near = ((x[rest] - pick) ** 2).sum(1) <= radius**2
                if near.any():
                    new[rest[near]] = len(centres) + len(picks)
                    picks.append((node, pick))
                    rest = rest[~near]
                if len(rest):
                    pick = x[rest[0]]
        if len(picks) > leaves:
            picks = []
            d = np.full(len(x), np.inf)
            pick = 0
            for _ in range(min(leaves, len(x))):
                picks.append((int(owner[pick]), x[pick]))
                d = np.minimum(d, ((x - x[pick]) ** 2).sum(1))
                pick = int(d.argmax())
                if d[pick] <= 0:
                    break
            have = {node for node, _ in picks}
            picks += [(int(n), centres[n]) for n in levels[-1] if n not in have]  # every node keeps a child
        first = len(centres)
        centres += [c for _, c in picks]
        parents += [n for n, _ in picks]
        levels.append(np.arange(first, len(centres)))
        owner = new
        if len(picks) >= leaves:
            break
    return Tree(np.array(centres), np.array(parents), levels)


def _ints(col, scale: float):
    v = F.col(col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & finite, F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("double")))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _assign(tree: Tree):
    def run(batches):
        for batch in batches:
            leaf, away = tree.descend(_matrix(batch.column(1))) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), pa.array(away)], names=["id", "v", "leaf", "away"])

    return run


BALL_SCHEMA = "leaf long, part long, n long, dim int, center binary, radius double, ids binary, rows binary"


def _pack(key, t):
    """A block of data or a group of queries: its ball, ids and rows (as 16-bit integers where they fit)."""
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], _matrix(t.column("v").combine_chunks())[order]
    c = x.mean(0)
    narrow = np.abs(x).max(initial=0) < 2**15
    return pa.table({
        "leaf": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()]), "n": pa.array([len(ids)]), "dim": pa.array([x.shape[1]], pa.int32()), "center": pa.array([c.tobytes()], pa.binary()),
        "radius": pa.array([float(np.sqrt(((x - c) ** 2).sum(1).max()))]), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "rows": pa.array([x.astype("<i2" if narrow else "<f8").tobytes()], pa.binary()),
    })


def _rows(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * dim * n else "<f8").reshape(n, dim).astype(np.float64)


def above(cq, rq, cd, rd):
    """No product of a vector in the ball (cq, rq) with one in the ball (cd, rd) is larger; rounding is allowed for."""
    top = (cq * cd).sum(-1) + rq * np.sqrt((cd**2).sum(-1)) + rd * np.sqrt((cq**2).sum(-1)) + rq * rd
    return top + 1e-9 * np.abs(top) + 1e-6


def node_pairs(tree: Tree, q_radius: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """(pairs of query leaf and data leaf that are left, pairs of nodes that were looked at): pairs are descended level by
    level; one whose bound lies under its query node's worst kth score goes with all pairs below. Both trees have at most
    `leaves` nodes a level, whatever the data. A radius below zero: nothing lies there."""
    children = {int(n): [] for n in range(len(tree.centres))}
    for n in range(1, len(tree.centres)):
        children[int(tree.parents[n])].append(n)
    pairs, looked = [(0, 0)], 0
    for depth in range(len(tree.levels)):
        q, d = np.array(pairs, np.int64).reshape(-1, 2).T
        looked += len(q)
        some = (q_radius[q] >= 0) & (radius[d] >= 0)
        q, d = q[some], d[some]
        ok = above(tree.centres[q], q_radius[q], tree.centres[d], radius[d]) >= floor[q]
        pairs = list(zip(q[ok].tolist(), d[ok].tolist()))
        if depth + 1 < len(tree.levels):
            pairs = [(a, b) for p, r in pairs for a in children[p] for b in children[r]]
    return pairs, looked


def _bounds(batches):
    """Rows (floor, balls of a group and of a block, keys): the pairs that their balls don't rule out, with their bound."""
    for batch in batches:
        t = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        cq, cd = (np.frombuffer(b"".join(t[c].to_pylist())).reshape(batch.num_rows, -1) for c in ("q_center", "center"))
        top = above(cq, t["q_radius"].to_numpy(), cd, t["radius"].to_numpy())
        floor = t["floor"].fill_null(float("-inf")).to_numpy(zero_copy_only=False)
        out = batch.select(["q_leaf", "q_part", "leaf", "part"])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(top)], names=[*out.schema.names, "top"]).filter(pa.array(top >= floor))


FOUND = "query_id long, vec_id long, score double"


def _search(k: int):
    """A group's queries against some blocks: what may be among the k best, given the kth scores so far."""

    def run(key, queries, blocks):
        ask = queries.to_pylist()
        if not ask or not blocks.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ask = ask[0]
        q, qid = _rows(ask["rows"], ask["dim"], ask["n"]), np.frombuffer(ask["ids"], "<i8")
        floor = np.array([-np.inf if f is None else f for f in ask["floors"]]) if ask["floors"] else np.full(len(q), -np.inf)
        found, held = [np.zeros((3, 0))], 0
        for b in blocks.sort_by([("top", "descending")]).to_pylist() if "top" in blocks.column_names else blocks.to_pylist():
            x, xid = _rows(b["rows"], b["dim"], b["n"]), np.frombuffer(b["ids"], "<i8")
            s = q @ x.T
            s[qid[:, None] == xid[None, :]] = -np.inf
            low = floor if len(xid) < k else np.maximum(floor, np.partition(s, len(xid) - k, axis=1)[:, len(xid) - k])
            i, j = np.nonzero((s >= low[:, None]) & (s > -np.inf))
            found.append(np.stack([i, j, s[i, j]]).astype(np.float64))
            found[-1][1] = np.arange(held, held + len(i))  # ids may need more than a double's digits: they are kept aside
            ids = np.append(ids, xid[j]) if held else xid[j]
            held += len(i)
            rows = np.concatenate(found, axis=1)
            place = rows[1].astype(np.int64)
            order = np.lexsort((ids[place], -rows[2], rows[0]))
            rows, place = rows[:, order], place[order]
            best = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0], "left") < k
            rows, ids = rows[:, best], ids[place[best]]
            rows[1], held, found = np.arange(rows.shape[1]), rows.shape[1], [rows]
            count = np.bincount(rows[0].astype(np.int64), minlength=len(q))
            last = np.cumsum(count) - 1
            full = count >= k
            floor[full] = np.maximum(floor[full], rows[2][last[full]])
        rows = found[0]
        return pa.table({"query_id": pa.array(qid[rows[0].astype(np.int64)]), "vec_id": pa.array(ids if held else np.zeros(0, np.int64)), "score": pa.array(rows[2])})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _look(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """Search pairs (q_leaf, q_part, leaf, part, chunk, top): a task takes a group and the blocks of one chunk."""
    ask = pairs.select("q_leaf", "q_part", "chunk").distinct()
    ask = ask.join(groups.select(F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), "n", "dim", "ids", "rows"), ["q_leaf", "q_part"])
    ask = ask.join(floors.select("q_leaf", "q_part", "floors"), ["q_leaf", "q_part"], "left") if floors is not None else ask.withColumn("floors", F.lit(None).cast("array<double>"))
    data = pairs.join(blocks.select("leaf", "part", "n", "dim", "ids", "rows"), ["leaf", "part"]).select("q_leaf", "q_part", "chunk", "top", "n", "dim", "ids", "rows")
    by = ["q_leaf", "q_part", "chunk"]
    ask = ask.withColumnsRenamed({c: f"a_{c}" for c in by})  # both sides come from the same pairs
    return ask.groupBy(*[f"a_{c}" for c in by]).cogroup(data.groupBy(*by)).applyInArrow(_search(k), FOUND)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE, sample: int = SAMPLE, leaves: int = LEAVES, block: int = BLOCK, group: int = GROUP, seen: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k largest inner products with the
    other rows, components as floor(scale * x), ties to the smaller id.

    Rows without an id, whose vector is null or empty, or holds null or a component that isn't finite, take no part;
    vectors of unequal lengths have no product and are an error. Rows with the query's own id are its own; repeated ids
    among candidates are kept as rows; of a query's repeated rows the one with the least vector asks. Sums stay exact while they are under 2^53.
    With no other row a query gives no rows; so does an empty table. Other columns are left out. seen: takes how many
    pairs there were and were searched, where it is given.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _ints(vector, scale).alias("v")).filter("id is not null and v is not null")
    taken = common.least_hashes(rows.withColumn("h", F.xxhash64("id")), "h", sample).orderBy("h", "id").limit(sample).collect()
    if not taken:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if lengths.lo != lengths.hi:
        raise ValueError(f"vectors of {lengths.lo} and of {lengths.hi} components")
    tree = cover_tree(np.array([r.v for r in taken]), leaves)
    placed = common.cut(rows.mapInArrow(_assign(tree), "id long, v array<double>, leaf long, away double"), "vectors")
    asks = F.col("id") % every == 0
    # leaves are bounded in number, so what is known of each may go to the driver
    known = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("queries"), F.max("away").alias("radius"), F.max(F.when(asks, F.col("away"))).alias("q_radius")).collect()
    radius = tree.up({r.leaf: r.radius for r in known}, max, float("-inf"), moved=True)
    q_radius = tree.up({r.leaf: r.q_radius for r in known if r.queries}, max, float("-inf"), moved=True)

    def dealt(df: DataFrame, count: str, size: int) -> DataFrame:
        many = F.element_at(F.create_map(*[F.lit(v) for r in known for v in (r.leaf, max(1, -(-r[count] // size)))]), F.col("leaf"))
        return df.withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), many.cast("long")))

    blocks = common.cut(dealt(placed, "n", block).groupBy("leaf", "part").applyInArrow(_pack, BALL_SCHEMA), "blocks")
    asking = common.cut(dealt(placed.filter(asks).groupBy("id").agg(F.min(F.struct("v", "leaf")).alias("m")).select("id", "m.*"), "queries", group), "queries")
    groups = common.cut(asking.groupBy("leaf", "part").applyInArrow(_pack, BALL_SCHEMA), "groups")

    # seeds: a block of each group's own leaf, and of the nearest leaves until k + 1 rows are surely there
    least = {r.leaf: -(-r.n // max(1, -(-r.n // block)) // 2) for r in known}  # a part by hash holds about n / parts rows
    seeds = []
    for r in known:
        if r.queries:
            have = 0
            near = np.argsort([((tree.centres[o.leaf] - tree.centres[r.leaf]) ** 2).sum() for o in known], kind="stable")
            for o in (known[i] for i in near):
                seeds.append((r.leaf, o.leaf))
                have += least[o.leaf]
                if have > 2 * k:
                    break
    seeds = spark.createDataFrame(seeds, "q_leaf long, leaf long")
    of = groups.select(F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"))
    start = blocks.groupBy("leaf").agg(F.min("part").alias("part"))
    first = of.join(F.broadcast(seeds), "q_leaf").join(start, "leaf").withColumns({"chunk": F.lit(0), "top": F.lit(0.0)})
    first = common.cut(first.select("q_leaf", "q_part", "leaf", "part", "chunk", "top"), "seed-pairs")
    found = common.cut(_top(_look(groups, blocks, first, None, k), k), "seeds")

    def floors_of(found: DataFrame) -> DataFrame:
        """(q_leaf, q_part, floors, floor): the kth score of each query of a group so far, in the order of ids, and the worst."""
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        each = asking.select(F.col("id").alias("query_id"), F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part")).join(kth, "query_id", "left")
        out = each.groupBy("q_leaf", "q_part").agg(F.sort_array(F.collect_list(F.struct("query_id", "kth"))).alias("f"), F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("floor"))
        return common.cut(out.select("q_leaf", "q_part", F.col("f.kth").alias("floors"), "floor"), "floors")

    floors = floors_of(found)
    worst = {r.q_leaf: r.w for r in floors.groupBy("q_leaf").agg(F.min("floor").alias("w")).collect()}
    left, looked = node_pairs(tree, q_radius, radius, tree.up(worst, min, float("inf")))
    wanted = spark.createDataFrame(left, "q_leaf long, leaf long")
    balls = groups.select(F.col("leaf").alias("q_leaf"), F.col("part").alias("q_part"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"))
    cross = balls.join(F.broadcast(wanted), "q_leaf").join(blocks.select("leaf", "part", "center", "radius"), "leaf").join(first.select("q_leaf", "q_part", "leaf", "part"), ["q_leaf", "q_part", "leaf", "part"], "left_anti")
    held = cross.join(floors.select("q_leaf", "q_part", "floor"), ["q_leaf", "q_part"])
    held = held.select("q_leaf", "q_part", "leaf", "part", "q_center", "q_radius", "center", "radius", "floor").mapInArrow(_bounds, "q_leaf long, q_part long, leaf long, part long, top double")
    place = F.row_number().over(Window.partitionBy("q_leaf", "q_part").orderBy(F.desc("top"), "leaf", "part")) - 1
    pairs = common.cut(held.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("int")), "pairs")

    early = pairs.filter(F.col("place") < EARLY)
    found = common.cut(_top(found.select("query_id", "vec_id", "score").union(_look(groups, blocks, early.withColumn("chunk", F.lit(0)), floors, k)), k), "early")
    floors = floors_of(found)
    rest = pairs.filter(F.col("place") >= EARLY).join(floors.select("q_leaf", "q_part", "floor"), ["q_leaf", "q_part"]).filter("top >= floor").drop("floor", "place")
    if seen is not None:
        n_blocks, n_groups = blocks.count(), groups.count()
        seen |= {"all": n_blocks * n_groups, "searched": first.count() + early.count() + rest.count(), "node_pairs": looked, "leaf_pairs": len(left)}
    found = _top(found.select("query_id", "vec_id", "score").union(_look(groups, blocks, rest, floors, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose id is divisible by 20, over the whole table; see top_k for nulls, ties and repeats."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select vec_id as id, list_transform(embedding, lambda e: floor(64 * cast(e as double))) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select q.id as query_id, c.id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.id <> c.id where q.id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
