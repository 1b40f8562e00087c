"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by its own codebook of CODES centroids (k-means on a sample of at most SAMPLE vectors, the
only fitted part); every vector is stored in the cell (i, j) of its halves' centroids. A query traverses cells by the sum of the two
distances, with a heap over the two sorted lists, until the cells taken hold `share` of all vectors. It is sent to just these cells, and
only their entries are ranked by exact distance; `compared` says how many. Cells are packed into nodes of bounded size (small
cells share one, a large cell is dealt over several, each of which meets the cell's queries), so no cell lands in one task.

On unclustered 64-dimensional vectors neighbours scatter over many cells, so `share` is large by default: see the README's recall.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with null vec_id; equal vectors are candidates
each; ties go to the smaller vec_id; a query itself (its vec_id) is no candidate. Shorter vectors count as padded with zeros. Extra columns are
ignored whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import stage
from strandlake.llm.vectors import BLOCK, NODE, STEP, best, chunked, matrix, padded, sample, usable

SAMPLE, CODES, SHARE = 16_384, 256, 0.3


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids from the first k rows on; a centroid that loses its members stays."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = squares(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, want: int):
    """Cells (i, j) by rising d1[i] + d2[j], from a heap over both orders, until their sizes sum to want. Yields (sum, i, j).

    A row of the table enters the heap when the row before it has been entered, so each cell is met once."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    x, y, size = d1[a].tolist(), d2[b].tolist(), sizes[np.ix_(a, b)].tolist()
    a, b, got, queue = a.tolist(), b.tolist(), 0, [(x[0] + y[0], 0, 0)]
    while queue and got < want:
        d, i, j = queue[0]
        got += size[i][j]
        yield d, a[i], b[j]
        if j + 1 < len(y):
            heapq.heapreplace(queue, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(queue)
        if not j and i + 1 < len(x):
            heapq.heappush(queue, (x[i + 1] + y[0], i + 1, 0))


def _cells(books):
    def run(batches):
        c1, c2 = books.value
        h = c1.shape[1]
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), np.float64)
                cell = squares(v[:, :h], c1).argmin(1) * len(c2) + squares(v[:, h:], c2).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    return run


def _taken(books, shared, want: int):
    """For each query and each part of the index with cells that it takes, these cells as bits from the part's first cell on."""

    def run(batches):
        c1, c2 = books.value
        sizes, part_of, first = shared.value
        h = c1.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            v, row, part, bits = matrix(batch.column("v"), np.float64), [], [], []
            for r, (a, b) in enumerate(zip(squares(v[:, :h], c1), squares(v[:, h:], c2))):
                mine = np.zeros(sizes.size, bool)
                mine[[i * len(c2) + j for _, i, j in traverse(a, b, sizes, want)]] = True
                mine &= sizes.ravel() > 0
                for p in np.unique(part_of[mine]).tolist():
                    row.append(r)
                    part.append(p)
                    bits.append(np.packbits(mine[first[p] : first[p + 1]]).tobytes())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(part, pa.int32()), pa.array(bits, pa.binary())], names=["vec_id", "v", "part", "bits"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches).sort_by([("cell", "ascending"), ("vec_id", "ascending")])
    one = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([t.column("part").slice(0, 1).combine_chunks(), t.column("chunk").slice(0, 1).combine_chunks(), one(t.column("vec_id").to_numpy(), np.int64), one(t.column("cell").to_numpy(), np.int32), one(matrix(t.column("v"), np.float64), np.float64)], names=["part", "chunk", "ids", "cells", "vectors"])


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    ids = np.ascontiguousarray(t.column("vec_id").to_numpy(), np.int64)
    yield pa.RecordBatch.from_arrays([t.column("part").slice(0, 1).combine_chunks(), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix(t.column("v"), np.float64).tobytes()], pa.binary()), pa.array([b"".join(t.column("bits").to_pylist())], pa.binary())], names=["part", "qids", "queries", "bits"])


def _rank(shared, k: int):
    """The k best of a node's entries in the cells that a query takes; `compared` (on the first of its rows) counts the distances computed."""

    def run(batches):
        first = shared.value[2]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.int32) - first[row["part"]]
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                qids = np.frombuffer(row["qids"], np.int64)
                q = np.frombuffer(row["queries"], np.float64).reshape(len(qids), -1)
                wanted = np.unpackbits(np.frombuffer(row["bits"], np.uint8).reshape(len(qids), -1), axis=1)
                norm = (x * x).sum(1)
                for i, qid in enumerate(qids.tolist()):
                    at = np.flatnonzero(wanted[i][cells])
                    at = at[ids[at] != qid]
                    d = norm[at] - 2 * (x[at] @ q[i])
                    if len(at) > k:  # those that rounding could bring among the k best
                        kth = np.partition(d, k - 1)[k - 1]
                        near = at[d <= kth + 1e-9 * (1 + abs(kth) + float(q[i] @ q[i]))]
                    else:
                        near = at
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))[:k]
                    out += [(qid, int(ids[near[j]]), float(exact[j]), 0 if place else len(at)) for place, j in enumerate(order)]
            if out:
                a, b, c, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()), pa.array(n, pa.int64())], names=["query_id", "vec_id", "score", "compared"])

    return run


def nearest(vectors: DataFrame, k: int = 10, share: float = SHARE, codes: int = CODES, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance), compared: for each vector whose vec_id is divisible by step, the k nearest found."""
    spark = vectors.sparkSession
    whole = usable(vectors, zero_too=False)
    told = whole.agg(F.max(F.size("v")), F.count("*")).first()
    if not told[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    whole = padded(whole, max(2, told[0]))
    drawn, n = sample(whole, SAMPLE), told[1]
    h = drawn.shape[1] // 2
    k1 = max(1, min(codes, len(drawn)))
    books = spark.sparkContext.broadcast((k_means(drawn[:, :h], k1), k_means(drawn[:, h:], k1)))
    placed = stage(whole.mapInArrow(_cells(books), "vec_id long, v array<double>, cell int"), "cells")
    table = np.zeros(k1 * k1, np.int64)
    for row in placed.groupBy("cell").count().collect():  # codes * codes rows at most
        table[row["cell"]] = row["count"]
    # neighbouring cells share a node where they are small; large ones are dealt over several
    parts = max(1, -(-n // NODE))
    number = np.maximum(np.cumsum(table) - 1, 0) * parts // n
    kinds, first = np.unique(number, return_index=True)
    part_of = np.searchsorted(kinds, number)
    shared = spark.sparkContext.broadcast((table.reshape(k1, k1), part_of, np.append(first, len(table))))
    cell_part = F.broadcast(spark.createDataFrame([(int(c), int(part_of[c])) for c in np.flatnonzero(table)], "cell int, part int"))
    dealt = chunked(placed.join(cell_part, "cell").select("vec_id", "v", "cell", "part"))
    nodes = stage(dealt.groupBy("part", "chunk").applyInArrow(_pack, "part int, chunk int, ids binary, cells binary, vectors binary"), "nodes")
    want = max(int(np.ceil(share * n)), min(n, 50 * k))
    queries = placed.where(F.col("vec_id") % step == 0).select("vec_id", "v").repartition(F.col("vec_id")).mapInArrow(_taken(books, shared, want), "vec_id long, v array<double>, part int, bits binary")
    queries = stage(queries, "queries")
    sizes = queries.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = queries.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    blocks = blocks.groupBy("part", "block").applyInArrow(_pack_queries, "part int, qids binary, queries binary, bits binary")
    # a block goes to each node of its part, by both numbers, so the nodes of one large cell are as many tasks' work as they need
    blocks = blocks.join(nodes.select("part", "chunk"), "part")
    found = stage(nodes.join(blocks, ["part", "chunk"]).mapInArrow(_rank(shared, k), "query_id long, vec_id long, score double, compared long"), "found")
    compared = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return best(found, k, False).join(compared, "query_id")
