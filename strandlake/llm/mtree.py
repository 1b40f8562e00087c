"""Exact top-k search by inner product: best-first search of an M-tree.

Inner products become distances by one more component: x' = (x, sqrt(m - x.x)) with m the largest squared norm, q' = (q, 0);
then |q' - x'|^2 = q.q + m - 2 q.x, so the nearest have the highest scores.

The tree: a root of at most ROUTERS routing objects, below each as many nodes as its vectors need (a crowded one is dealt by
hash), and in each node pages of about PAGE entries. Every page keeps its routing object, its covering radius and its distance to
the parent's routing object; every entry its distance to the page's. A query takes pages by their least possible distance; it
computes a distance only where |d(q, parent) - d(parent, child)| leaves a chance. Each query first searches the node that
holds itself, and goes on with that bound through the others.

A lane is up to LANE nodes, a lot up to about 16,384 queries. They meet once, as one group of a task: each query of the lot goes through the nodes with
the bound it has so far, and those that take the same page at the same turn are measured together. A block of queries goes only to lanes in its reach.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null vec_id; equal vectors are
candidates each; ties go to the smaller vec_id; a query itself (its vec_id) is no candidate. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_texts, stage
from strandlake.llm.vectors import BLOCK, BLOCKS, NODE, STEP, best, chunked, matrix, meet, packed, padded, query_blocks, sample, unpacked, usable

ROUTERS, PAGE = 64, 128
#: Most nodes in a lane; a tree with few nodes has lanes of fewer, so that there are about LANES.
LANE, LANES = 8, 64
#: Components of queries that meet a lane at once (64 a query at least), and products of a query and a vector that are held at once.
LOT, HELD = 1 << 20, 1 << 20
#: Of a distance, and of the largest norm: well above what rounding takes from a distance (apart() loses about 1e-7 of the norm).
SLACK, ROUNDING = 1e-9, 1e-5
#: Below every score.
NONE = -(2**63) + 1


def lifted(v: np.ndarray, m: float) -> np.ndarray:
    """Rows with the component that makes inner products distances."""
    return np.column_stack([v, np.sqrt(np.maximum(m - (v * v).sum(1), 0))])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0))


def _assign(routers, m):
    def run(batches):
        r = routers.value
        for batch in batches:
            if batch.num_rows:
                d = apart(lifted(matrix(batch.column("v"), np.float64), m), r)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(d.argmin(1).astype(np.int32))], names=["vec_id", "v", "part"])

    return run


NODES = "part int, chunk int, radius double, ids binary, vectors binary, to_page binary, first binary, routing binary, page_radius binary, to_parent binary"


def _build(routers, m):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids, v, part = t.column("vec_id").to_numpy(), matrix(t.column("v"), np.int64), t.column("part")[0].as_py()
        x, parent = lifted(v.astype(np.float64), m), routers.value[part]
        pages = x[np.argsort(ids * np.int64(-7046029254386353131), kind="stable")[: -(-len(ids) // PAGE)]]
        d = apart(x, pages)
        page = d.argmin(1)
        order = np.lexsort((ids, d[np.arange(len(ids)), page], page))
        used, first = np.unique(page[order], return_index=True)
        to_page = d[order, page[order]]
        to_parent = np.sqrt(((pages[used] - parent) ** 2).sum(1))
        radius = float(np.sqrt(((x - parent) ** 2).sum(1)).max())
        one = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), t.column("chunk").slice(0, 1).combine_chunks(), pa.array([radius]), one(ids[order], np.int64), pa.array([packed(v[order])], pa.binary()), one(to_page, np.float64), one(np.append(first, len(ids)), np.int64), one(pages[used], np.float64), one(np.maximum.reduceat(to_page, first), np.float64), one(to_parent, np.float64)], names=[x.split()[0] for x in NODES.split(", ")])

    return run


class Queries:
    """A lot of queries, each with its k best (score, vec_id) so far, the score and the distance that are still of use to it."""

    def __init__(self, rows: list[dict], dims: int, m: float, k: int):
        ids = [np.frombuffer(r["qids"], np.int64) for r in rows]
        self.ids, self.m, self.k = np.concatenate(ids), m, k
        self.whole = np.concatenate([unpacked(r["queries"], len(i), dims) for r, i in zip(rows, ids)])
        self.lift = np.column_stack([self.whole.astype(np.float64), np.zeros(len(self.ids))])
        self.norm, self.most = (self.lift * self.lift).sum(1), np.abs(self.lift).max(1)
        self.least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows])
        self.bound = self.reach(slice(None))
        self.scores = np.full((len(self.ids), k), NONE, np.int64)
        self.found = np.full((len(self.ids), k), np.iinfo(np.int64).max, np.int64)

    def reach(self, rows) -> np.ndarray:
        far = np.sqrt(np.maximum(self.norm[rows] + self.m - 2.0 * self.least[rows], 0)) * (1 + SLACK) + ROUNDING * (1 + self.m) ** 0.5
        return np.where(self.least[rows] == NONE, np.inf, far)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores[i, j]: of the query rows[i] and the vector ids[j]; what is of use takes its place among the best."""
        r, e = np.nonzero(scores >= self.least[rows, None])
        last = np.where(self.scores[rows, -1] == self.least[rows], self.found[rows, -1], np.iinfo(np.int64).max)
        use = (ids[e] != self.ids[rows[r]]) & ((ids[e] <= last[r]) | (scores[r, e] > self.least[rows[r]]))
        r, e = r[use], e[use]
        if not len(r):
            return
        touched = np.unique(rows[r])
        q = np.concatenate([np.repeat(touched, self.k), rows[r]])
        s = np.concatenate([self.scores[touched].ravel(), scores[r, e].astype(np.int64)])
        i = np.concatenate([self.found[touched].ravel(), ids[e]])
        order = np.lexsort((i, -s, q))
        top = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.scores[touched], self.found[touched] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)
        self.least[touched] = np.maximum(self.least[touched], self.scores[touched, -1])
        self.bound[touched] = self.reach(touched)

    def best(self) -> pa.Table:
        r, c = np.nonzero(self.scores > NONE)
        return pa.table({"query_id": self.ids[r], "vec_id": self.found[r, c], "score": self.scores[r, c]})


class Node:
    """A node's arrays as they were packed; the entries of a page rise by their distance to its routing object."""

    def __init__(self, row: dict, parent: np.ndarray):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.parent, self.radius = parent, row["radius"]
        self.ids, self.to_page, self.first = read("ids", np.int64), read("to_page", np.float64), read("first", np.int64)
        self.whole = unpacked(row["vectors"], len(self.ids), len(parent) - 1)
        self.vectors = self.whole.astype(np.float64)
        self.most = float(np.abs(self.vectors).max())
        self.page_radius, self.to_parent = read("page_radius", np.float64), read("to_parent", np.float64)
        self.routing = read("routing", np.float64).reshape(len(self.to_parent), -1)

    def search(self, asked: Queries) -> None:
        """Best first for each query: in each turn, every query that has a page within its bound takes the nearest of those left."""
        near = np.sqrt(((asked.lift - self.parent) ** 2).sum(1))
        mine = np.flatnonzero(near - self.radius <= asked.bound)
        least = np.maximum(np.abs(near[mine, None] - self.to_parent) - self.page_radius, 0)
        chance = least <= asked.bound[mine, None]
        mine, least, chance = (x[chance.any(1)] for x in (mine, least, chance))
        if not len(mine):
            return
        # doubles hold the products exactly while they stay below 2**53
        exact = self.most * float(asked.most[mine].max()) * self.whole.shape[1] < 2**52
        d = np.full(least.shape, np.inf)
        pages = np.flatnonzero(chance.any(0))
        d[:, pages] = apart(asked.lift[mine], self.routing[pages])
        least = np.where(chance, np.maximum(least, d - self.page_radius), np.inf)
        order = np.argsort(least, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            on = np.flatnonzero(least[np.arange(len(mine)), order[:, turn]] <= np.minimum(asked.bound[mine], np.finfo(np.float64).max))
            if not len(on):
                return
            on = on[np.argsort(order[on, turn], kind="stable")]
            page, start = np.unique(order[on, turn], return_index=True)
            for p, at in zip(page.tolist(), np.split(on, start[1:])):
                rows, (a, z) = mine[at], self.first[p : p + 2].tolist()
                low, high = (d[at, p] - asked.bound[rows]).min(), (d[at, p] + asked.bound[rows]).max()
                a, z = a + np.searchsorted(self.to_page[a:z], low), a + np.searchsorted(self.to_page[a:z], high, "right")
                q = asked.lift[rows, :-1] if exact else asked.whole[rows]
                for i in range(a, z, max(1, HELD // len(rows))):  # a page of equal vectors is as large as its node
                    j = min(z, i + max(1, HELD // len(rows)))
                    asked.offer(rows, self.ids[i:j], q @ (self.vectors if exact else self.whole)[i:j].T)


FOUND = "query_id long, vec_id long, score long"


def _search(routers, m: float, k: int):
    def run(nodes: list[pa.RecordBatch], blocks: list[pa.RecordBatch]) -> pa.Table:
        asked = Queries([row for b in blocks for row in b.to_pylist()], routers.value.shape[1] - 1, m, k)
        for batch in nodes:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                Node(row, routers.value[row["part"]]).search(asked)
        return asked.best()

    return run


def _reach(routers, m: float, first: list[int], radius: list[float], lane: int):
    """The lanes that each block must go to: with nodes of a part whose ball a query's bound reaches. first: the number of each part's first node, and of all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = []
            for row in batch.to_pylist():
                asked = Queries([row], routers.value.shape[1] - 1, m, 1)
                parts = np.flatnonzero((apart(asked.lift, routers.value) - radius <= asked.bound[:, None]).any(0)).tolist()
                lanes.append(sorted({n // lane for p in parts for n in range(first[p], first[p + 1])}))
            if lanes:
                yield batch.append_column("lanes", pa.array(lanes, pa.list_(pa.int32())))

    return run


def mtree_top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by step, the k highest integer inner products."""
    spark = vectors.sparkSession
    whole = usable(vectors).withColumn("v", F.transform("v", lambda x: F.floor(scale * x)))
    told = whole.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.count("*")).first()
    if not told[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, m, n = told
    m = float(m)
    whole = padded(whole, dims)
    routers = spark.sparkContext.broadcast(lifted(sample(whole, min(ROUTERS, -(-n // NODE))), m))
    parts = len(routers.value)
    assigned = stage(whole.mapInArrow(_assign(routers, m), "vec_id long, v array<long>, part int"), "assigned")
    dealt = chunked(assigned)
    nodes = stage(dealt.groupBy("part", "chunk").applyInArrow(_build(routers, m), NODES), "nodes")
    queries = stage(dealt.where(F.col("vec_id") % step == 0), "queries")

    # a number for each node, by part; at most ROUTERS rows reach the driver
    first, radius, before = [0] * (parts + 1), [-np.inf] * parts, [0] * (parts + 1)
    for row in nodes.groupBy("part").agg(F.max("chunk").alias("last"), F.max("radius").alias("radius")).collect():
        first[row["part"] + 1], radius[row["part"]] = row["last"] + 1, row["radius"]
    for row in queries.groupBy("part").count().collect():
        before[row["part"] + 1] = row["count"]
    first, before = np.cumsum(first).tolist(), np.cumsum(before).tolist()
    of_part = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("part") + 1)
    number = (of_part(first) + F.col("chunk")).cast("int")
    lane, lot = max(1, min(LANE, first[-1] // LANES)), max(BLOCK, LOT // max(dims, 64))

    # a node's own queries come in lots too: its vectors may all be queries
    mine = queries.select(number.alias("lane"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(-(-NODE // lot))).cast("int").alias("lot"), F.lit(0).alias("block"), "vec_id", "v", F.lit(NONE).alias("least"))
    own = meet(nodes.withColumn("lane", number), stage(query_blocks(mine), "own"), _search(routers, m, k), FOUND)
    own = best(own, k, True).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("got")).where(F.col("got") == k)
    bounded = queries.join(own, F.col("vec_id") == F.col("query_id"), "left").withColumn("least", F.coalesce("least", F.lit(NONE)))

    # blocks hold queries of one part, whose reach is alike
    block = F.floor(F.pmod(F.xxhash64("vec_id"), F.greatest(of_part(before[1:]) - of_part(before[:-1]), F.lit(1))) / BLOCK)
    ready = bounded.withColumn("block", block).select("part", F.lit(0).alias("lane"), F.floor((of_part(before) + F.col("block") * BLOCK) / lot).cast("int").alias("lot"), F.expr(f"cast(part + {parts} * block as long)").alias("block"), "vec_id", "v", "least")
    sent = stage(map_texts(query_blocks(ready), _reach(routers, m, first, radius, lane), f"{BLOCKS}, lanes array<int>"), "sent")
    blocks = sent.withColumn("lane", F.explode("lanes")).drop("lanes")
    found = meet(nodes.withColumn("lane", F.floor(number / lane).cast("int")), blocks, _search(routers, m, k), FOUND)
    return best(found, k, True)
