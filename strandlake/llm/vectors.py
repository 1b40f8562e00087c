"""Packing vectors into bounded nodes and queries into blocks, and meeting of the two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most vectors in a node, and most queries in a block.
NODE, BLOCK = 4096, 256
#: Every hundredth row is a query.
STEP = 100


def usable(df: DataFrame, vector: str = "embedding", zero_too: bool = True) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that can be compared: not null or empty, all components finite.

    Shorter vectors count as padded with zeros to the longest. Null vec_id takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    whole = df.where(f"{vector} IS NOT NULL AND size({vector}) > 0 AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    whole = whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return whole if zero_too else whole.where(F.exists("v", lambda x: x != 0))


def padded(df: DataFrame, dims: int) -> DataFrame:
    return df.withColumn("v", F.when(F.size("v") == dims, F.col("v")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0).cast(df.schema["v"].dataType.elementType), dims)), 1, dims)))


def matrix(column, dtype) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def sample(df: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, the first by a hash of their id: the only vectors that reach the driver."""
    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow().column("v")
    return matrix(rows, np.float64)


def chunked(assigned: DataFrame, by: str = "part") -> DataFrame:
    """A chunk number: a part with more than NODE vectors is dealt by hash into as many chunks as it needs."""
    sizes = assigned.groupBy(by).agg(F.ceil(F.count("*") / NODE).cast("int").alias("chunks"))
    return assigned.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).drop("chunks")


def packed(a: np.ndarray) -> bytes:
    """Whole numbers, each in the fewest bytes (2, 4 or 8) that hold them all."""
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    kind = next(x for x in (np.int16, np.int32, np.int64) if np.iinfo(x).min <= low and high <= np.iinfo(x).max)
    return np.ascontiguousarray(a, kind).tobytes()


def unpacked(b: bytes, rows: int, dims: int) -> np.ndarray:
    """What packed() made of a matrix."""
    return np.frombuffer(b, f"i{len(b) // (rows * dims)}").astype(np.int64).reshape(rows, dims)


BLOCKS = "lane int, lot int, qids binary, queries binary, least binary"


def query_blocks(queries: DataFrame) -> DataFrame:
    """queries (lane, lot, block, vec_id, v, least) packed into a row for each lane, lot and block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        one = lambda c: t.column(c).slice(0, 1).combine_chunks()
        raw = lambda c: pa.array([t.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary())
        yield pa.RecordBatch.from_pydict({"lane": one("lane"), "lot": one("lot"), "qids": raw("vec_id"), "queries": pa.array([packed(matrix(t.column("v"), np.int64))], pa.binary()), "least": raw("least")})

    return queries.groupBy("lane", "lot", "block").applyInArrow(pack, BLOCKS)


def meet(nodes: DataFrame, blocks: DataFrame, search, schema: str) -> DataFrame:
    """search(rows of nodes, rows of blocks) for each lane and lot that any block is in: a node comes once for a lot of queries, not once for
    a block, and blocks are dealt by a shuffle: their copies are never gathered for a broadcast."""
    keys = ["lane", "lot"]
    wanted = nodes.join(blocks.select(*(F.col(c).alias(c) for c in keys)).distinct(), "lane")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = search(left.to_batches(), right.to_batches())
        pa.default_memory_pool().release_unused()
        return out

    return wanted.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id, with rank from 1."""
    order = F.desc("score") if descending else F.asc("score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
