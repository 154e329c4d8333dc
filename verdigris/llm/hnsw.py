"""Operator 7: nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their key. A shard's distinct vectors are the nodes of
one graph: levels that thin out geometrically, in which each node is placed by searching the
graph of those before it (and those of its own batch), and linked to diverse neighbours and
back. It is stored as flat neighbour arrays in a table in the shared folder. Queries meet each
shard in blocks; a search descends greedily from level to level and keeps the EF best at the
bottom. Shard results, with exact distances, are merged by rank. All is computed by differences
in double precision, within a shard on vectors moved to the median of each coordinate, so that
neither a far offset nor a few far vectors cost the others digits. Vectors whose magnitudes are
dozens of powers of ten apart (CLASS) are in different shards, in units of their own, so squares
stay within the range of a double; a query meets the shards of every class.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
rows without a key. Vectors of different lengths are in different shards and never meet.
Equal vectors are one node that names its smallest keys, as many as can be asked for, so a
group of copies costs one node in each shard and none is lost. Repeated rows (same key, same
vector) count once; rows that share the query's key are its own. Ties go to the smaller key.
Other columns are ignored. Fewer candidates than asked for give fewer rows, an empty table none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import written

#: Vectors in a shard, about, while there are at most MOST_SHARDS; queries in a block.
SHARD, MOST_SHARDS, BLOCK = 8192, 2048, 16_384
#: Links of a node on the bottom and above, candidates for links, breadth of a search.
LINKS, UPPER, CANDIDATES, EF = 32, 16, 64, 160
#: Nodes placed and queries searched at a time, and nodes that a search opens at a time.
BATCH, STEP = 256, 4
#: Powers of ten that a class of magnitude spans, and how far off a query may be in a shard's own unit.
CLASS, FAR = 64, 1e150


def diverse(x: np.ndarray, found: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of found, nearest first: those nearer to the node (far) than to any chosen before; then the rest."""
    if len(found) <= most:
        return found
    among = x[found] - x[found[0]]  # near each other: their own origin keeps the digits
    square = (among * among).sum(1)
    between = square[:, None] + square[None] - 2 * (among @ among.T)
    chosen, closest = [], np.full(len(found), np.inf)
    for k in range(len(found)):
        if far[k] < closest[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.minimum(closest, between[k], out=closest)
    if len(chosen) < most:
        left = np.setdiff1d(np.arange(len(found)), chosen)
        chosen += left[: most - len(chosen)].tolist()
    return found[chosen]


def squares(x: np.ndarray, a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows a of x to rows of q, by differences."""
    d = x[a] - q
    return np.einsum("ij,ij->i", d, d)


def beam(x: np.ndarray, flat: np.ndarray, entry: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ef nearest rows of x to each of the queries q, nearest first (-1 and infinity where
    there are none), by best-first search through the neighbours flat from an entry each."""
    n, rows = len(x), np.arange(len(q))
    ids, far, done = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf), np.ones((len(q), ef), bool)
    ids[:, 0], far[:, 0], done[:, 0] = entry, squares(x, entry, q), False
    seen = np.zeros((len(q), n), bool)
    seen[rows, entry] = True
    active = rows
    while True:
        open_ = np.where(done[active], np.inf, far[active])
        alive = np.isfinite(open_.min(1))
        active, open_ = active[alive], open_[alive]
        if not len(active):
            break
        best = np.argpartition(open_, min(STEP, ef) - 1, axis=1)[:, :STEP]
        r, c = np.nonzero(np.isfinite(np.take_along_axis(open_, best, 1)))
        slot = best[r, c]
        done[active[r], slot] = True
        near = flat[ids[active[r], slot]]
        codes = np.unique((r[:, None] * n + near)[near >= 0])
        r, near = codes // n, codes % n
        fresh = ~seen[active[r], near]
        r, near = r[fresh], near[fresh]
        if not len(r):
            continue
        seen[active[r], near] = True
        found = squares(x, near, q[active[r]])
        width = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)
        more_ids, more_far = np.full((len(active), width.max()), -1, np.int64), np.full((len(active), width.max()), np.inf)
        more_ids[r, place], more_far[r, place] = near, found
        all_ids, all_far = np.concatenate([ids[active], more_ids], 1), np.concatenate([far[active], more_far], 1)
        all_done = np.concatenate([done[active], more_ids < 0], 1)
        keep = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
        ids[active], far[active], done[active] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_far, all_done))
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


class Level:
    """One level while it is built: nodes are placed in order, a batch at a time."""

    def __init__(self, x: np.ndarray, most: int):
        self.x, self.most = x, most
        self.flat = np.full((len(x), 2 * most), -1, np.int32)
        self.count = np.zeros(len(x), np.int64)

    def prune(self, i: int, most: int) -> None:
        """Leave a node its diverse neighbours."""
        found = self.flat[i, : self.count[i]].astype(np.int64)
        far = squares(self.x, found, self.x[i])
        order = np.lexsort((found, far))
        kept = diverse(self.x, found[order], far[order], most)
        self.flat[i] = -1
        self.flat[i, : len(kept)], self.count[i] = kept, len(kept)

    def add(self, i: int, j: int) -> None:
        if self.count[i] == self.flat.shape[1]:
            self.prune(i, self.most)
        self.flat[i, self.count[i]] = j
        self.count[i] += 1

    def place(self, at: int, to: int, ids: np.ndarray, far: np.ndarray) -> None:
        """Place the nodes at to to, given what a search among those before found for each."""
        mine = np.arange(at, to)
        inner = ((self.x[at:to, None] - self.x[None, at:to]) ** 2).sum(-1) if to - at <= BATCH else None
        for i in mine.tolist():
            near = np.concatenate([ids[i - at], np.arange(at, i)])
            dist = np.concatenate([far[i - at], inner[i - at, : i - at]])
            sound = np.isfinite(dist) & (near >= 0)
            near, dist = near[sound], dist[sound]
            order = np.lexsort((near, dist))[:CANDIDATES]
            for j in diverse(self.x, near[order], dist[order], self.most // 2).tolist():
                self.add(i, j)
                self.add(j, i)

    def closed(self) -> np.ndarray:
        for i in np.flatnonzero(self.count > self.most).tolist():
            self.prune(i, self.most)
        return self.flat[:, : self.most].copy()


class Graph:
    """The graph over distinct vectors x. levels: (members, flat neighbours among them), the bottom
    first; a level's members are in the order in which they were placed, those of the level above
    first. Distances are of vectors moved and scaled to the shard, in double precision."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels
        self.middle, self.scale = frame(x)
        self.own = (x - self.middle) / self.scale
        self.parts = [self.own[m] for m, _ in levels]

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(rng.uniform(1e-12, 1, len(x))) / np.log(UPPER)).astype(int)
        order = np.argsort(-height, kind="stable")
        middle, scale = frame(x)
        own = (x - middle) / scale
        above: list[tuple[np.ndarray, np.ndarray]] = []  # neighbours and vectors of the levels above, topmost first
        levels = []
        for h in range(int(height.max(initial=0)), -1, -1):
            members = order[: int((height >= h).sum())]
            part = own[members]
            level = Level(part, LINKS if h == 0 else UPPER)
            for at in range(0, len(members), BATCH):
                to = min(len(members), at + BATCH)
                if at:
                    ids, far = beam(part[:at], level.flat[:at], descend(above, part[at:to], at), part[at:to], CANDIDATES)
                else:
                    ids, far = np.empty((to, 0), np.int64), np.empty((to, 0))
                level.place(at, to, ids, far)
            above.append((level.closed(), part))
            levels.append((members.astype(np.int32), above[-1][0]))
        return cls(x, levels[::-1])

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """About the ef nearest nodes of each query, nearest first, -1 where there are none."""
        with np.errstate(over="ignore"):
            q = np.clip((queries - self.middle) / self.scale, -FAR, FAR)
        above = [(flat, part) for (_, flat), part in zip(self.levels[:0:-1], self.parts[:0:-1])]
        (members, flat), part = self.levels[0], self.parts[0]
        ids, _ = beam(part, flat, descend(above, q, len(part)), q, min(ef, len(part)))
        return np.where(ids >= 0, members[ids], -1)


def frame(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The middle of vectors, by coordinate, which far ones do not move; and the power of ten that keeps
    squares of their class of magnitude within the range of a double, 1 for all but extreme ones."""
    top = float(np.abs(x).max(initial=0.0))
    return np.median(x, axis=0) if len(x) else np.zeros(x.shape[1]), 10.0 ** (CLASS * np.floor(np.log10(top) / CLASS + 0.5)) if top else 1.0


def descend(above: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, placed: int) -> np.ndarray:
    """Where to enter the level below for each query: the nearest found on the way down. A level's
    numbers hold on those below it; one not placed yet is left for the first."""
    at = np.zeros(len(q), np.int64)
    for flat, part in above:
        best = squares(part, at, q)
        moving = np.arange(len(q))
        while len(moving):
            near = flat[at[moving]].astype(np.int64)
            r, c = np.nonzero(near >= 0)
            far = np.full(near.shape, np.inf)
            far[r, c] = squares(part, near[r, c], q[moving[r]])
            k = far.argmin(1)
            found = far[np.arange(len(moving)), k]
            better = found < best[moving]
            step = near[np.arange(len(moving)), k][better]
            best[moving[better]] = found[better]
            moving = moving[better]
            at[moving] = step
    return np.where(at < placed, at, 0)


def distance(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows a to q; where squares leave the range of a double, by scaling."""
    d = a - q
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((d * d).sum(1))
    big = np.abs(d).max(1)
    odd = (~np.isfinite(out) | (out < 1e-150)) & (big > 0) & np.isfinite(big)
    out[odd] = big[odd] * np.sqrt(((d[odd] / big[odd, None]) ** 2).sum(1))
    return out


INDEX = "shard string, size int, vectors binary, first binary, ids binary, members array<binary>, links array<binary>"


def build_index(vectors: DataFrame, keep: int) -> DataFrame:
    """One row for each shard of vectors (shard string, id long, v array<double>)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        x, which = np.unique(flat.reshape(len(ids), -1)[order] + 0.0, axis=0, return_inverse=True)
        ids = ids[order]
        # nodes in the order of a draw, so that early ones spread over the shard
        draw = np.random.default_rng(11).permutation(len(x))
        back = np.empty(len(x), np.int64)
        back[draw] = np.arange(len(x))
        x, which = x[draw], back[which.ravel()]
        by = np.lexsort((ids, which))
        counts = np.bincount(which, minlength=len(x))
        nth = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
        named = by[nth < keep]
        first = np.concatenate([[0], np.cumsum(np.minimum(counts, keep))]).astype(np.int64)
        graph = Graph.build(x)
        row = {
            "shard": [table.column("shard")[0].as_py()],
            "size": [x.shape[1]],
            "vectors": [x.tobytes()],
            "first": [first.tobytes()],
            "ids": [ids[named].tobytes()],
            "members": [[m.tobytes() for m, _ in graph.levels]],
            "links": [[f.tobytes() for _, f in graph.levels]],
        }
        return pa.table(row, schema=pa.schema([("shard", pa.string()), ("size", pa.int32()), *((c, pa.binary()) for c in ("vectors", "first", "ids")), *((c, pa.list_(pa.binary())) for c in ("members", "links"))]))

    return written(vectors.groupBy("shard").applyInArrow(run, INDEX), "hnsw")


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["vectors"]).reshape(-1, row["size"])
    members = [np.frombuffer(m, np.int32) for m in row["members"]]
    levels = [(m, np.frombuffer(f, np.int32).reshape(len(m), -1)) for m, f in zip(members, row["links"])]
    return Graph(x, levels), np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int64)


def nearest(df: DataFrame, is_query, *, k: int = 10, ef: int = EF, shard_rows: int = SHARD, block_rows: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query(id column), the k nearest."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound).dropDuplicates(["id", "v"])
    rows = written(rows, "vectors")
    # vectors of one size and class of magnitude share shards, so that no far one takes others' digits
    power = F.floor(F.log10(F.array_max(F.transform("v", F.abs))) / CLASS + 0.5).cast("int")
    rows = rows.select("id", "v", F.size("v").alias("size"), power.alias("power"))
    sizes = rows.groupBy("size", "power").agg(F.count("*").alias("n"))
    sizes = sizes.select("size", "power", F.ceil(F.col("n") / F.greatest(F.lit(shard_rows), F.col("n") / MOST_SHARDS)).cast("int").alias("shards"))
    named = lambda n: F.concat_ws("/", "size", "power", n)
    dealt = rows.join(sizes, ["size", "power"])
    index = build_index(dealt.select(named(F.pmod(F.xxhash64("id"), F.col("shards"))).alias("shard"), "id", "v"), k + 1)
    queries = rows.where(is_query(F.col("id")))
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.drop("power").join(sizes, "size").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), named)).alias("shard"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).cast("int").alias("block"), "id", "v")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(mine: pa.Table, table: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if mine.num_rows:
            graph, first, ids = load(mine.to_pylist()[0])
            asked = table.column("id").to_numpy()
            vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
            for at in range(0, len(asked), BATCH):
                for query, q, nodes in zip(asked[at : at + BATCH].tolist(), vectors[at : at + BATCH], graph.search(vectors[at : at + BATCH], max(ef, k + 1))):
                    nodes = nodes[nodes >= 0]
                    found = [(float(d), int(i)) for d, n in zip(distance(graph.x[nodes], q), nodes) for i in ids[first[n] : first[n + 1]] if i != query]
                    for d, i in heapq.nsmallest(k, found):
                        for column, value in zip(out, (query, i, d)):
                            column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
