"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct n-word shingles (words: runs without ASCII white space, A-Z lower-cased). Documents
with equal sets form one class; classes are compared. Shingles are ordered from rare to frequent (frequencies over all
documents, in a counting table of fixed size, ties by hash); two sets that reach the similarity share a shingle within
their first n - ceil(t * n) + 1, so only these prefixes are joined. A pair is dropped where the sizes differ too much
(length filter), where too few shingles follow the common one (positional filter), or where the counts in ranges of hash
values differ too much (suffix filter); the rest is verified once by exact intersection.

A shingle shared by a large group doesn't give all pairs of the group: first every member is compared with the member
that has fewest rarer shingles, then only pairs that are still in different components are compared. No link is lost.

Null or empty text: an empty set, linked with nothing. Very long texts: whole. Repeated rows are members of one class; ties in frequency go by
hash. Extra columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Words, chunks, map_texts, mix, stage
from strandlake.llm.components import connected_components, group_links, join_heavy, join_left_heavy, join_salted, kept_by_bits

#: log2 of the counting table's cells, and cells in a slab of it that is summed as one row.
CELLS, SLAB = 22, 1 << 16
RANGES = 64
#: Bytes of texts that a task hashes at once; hashing takes some 50 times as much.
PART = 1 << 18


def _counts(n: int):
    def run(batches):
        total = np.zeros(1 << CELLS, np.uint32)
        for batch in batches:
            for _, part in chunks((t.as_py() for t in batch.column(0)), PART):
                w = Words(part)
                for a, b in zip(w.first[:-1], w.first[1:]):
                    np.add.at(total, (w.shingles(n, a, b) & np.uint64((1 << CELLS) - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            yield pa.RecordBatch.from_pydict({"slab": pa.array(range(len(total) // SLAB), pa.int32()), "cells": pa.array([zlib.compress(total[i : i + SLAB].tobytes(), 1) for i in range(0, len(total), SLAB)], pa.binary())})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slab, total = None, np.zeros(SLAB, np.uint64)
    for batch in batches:
        slab = batch.column("slab")[0].as_py()
        for cells in batch.column("cells"):
            total += np.frombuffer(zlib.decompress(cells.as_py()), np.uint32)
    logs = np.minimum(65535, 2048 * np.log2(1.0 + total)).astype(np.uint16)  # the order is what counts
    yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "cells": pa.array([zlib.compress(logs.tobytes(), 1)], pa.binary())})


def shingle_frequencies(texts: DataFrame, n: int):
    """A broadcast table of frequency by hash cell, counted over all texts: 2**CELLS two-byte cells (8 MB) at any input size."""
    cells = map_texts(texts.select(F.col("text").cast("binary")), _counts(n), "slab int, cells binary")
    summed = cells.groupBy("slab").applyInArrow(_add, "slab int, cells binary")
    table = np.zeros(1 << CELLS, np.uint16)
    for row in summed.toLocalIterator():
        table[row.slab * SLAB : (row.slab + 1) * SLAB] = np.frombuffer(zlib.decompress(row.cells), np.uint16)
    return texts.sparkSession.sparkContext.broadcast(table)


def _distinct(w: Words, n: int, a: int, b: int) -> np.ndarray:
    return np.unique(w.shingles(n, a, b))


def _key(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


DOC = "doc_id long, tid long, n long, key long, key2 long, ranges array<short>, prefix array<long>"


def _prefixes(n: int, percent: int, table):
    def run(batches):
        freq, cuts = table.value, np.arange(1, RANGES, dtype=np.uint64) * np.uint64((1 << 64) // RANGES)
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for first, part in chunks((t.as_py() for t in batch.column("text")), PART):
                w, size, keys, ranges, prefix = Words(part), [], [], [], []
                for a, b in zip(w.first[:-1], w.first[1:]):
                    s = _distinct(w, n, a, b)
                    m = len(s)
                    size.append(m)
                    keys.append(_key(s))
                    ranges.append(np.minimum(np.diff(np.searchsorted(s, cuts), prepend=0, append=m), 32767).astype(np.int16))
                    p = m - (percent * m + 99) // 100 + 1 if m else 0
                    f = freq[s & np.uint64((1 << CELLS) - 1)]
                    if p < m // 2:  # only what may be in the prefix is sorted
                        keep = f <= np.partition(f, p - 1)[p - 1]
                        s, f = s[keep], f[keep]
                    prefix.append(s[np.lexsort((s, f))[:p]].view(np.int64))
                k = np.array(keys, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(first, len(part)), "tid": tids.slice(first, len(part)), "n": pa.array(size, pa.int64()), "key": pa.array(k[:, 0]), "key2": pa.array(k[:, 1]), "ranges": pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * RANGES, pa.int32()), pa.array(np.concatenate(ranges))),
                    "prefix": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix))),
                })

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for _, part in chunks((t.as_py() for t in batch.column("text")), PART):
                w = Words(part)
                sets = [_distinct(w, n, a, b) for a, b in zip(w.first[:-1], w.first[1:])]
                keys = np.array([_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[:, 0]), "key2": pa.array(keys[:, 1]), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep, last, x = [], None, None
            for i, (sa, sb) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                y = np.frombuffer(sb.as_buffer(), np.uint64)
                if last is None or not sa.equals(last):
                    last, x = sa, np.frombuffer(sa.as_buffer(), np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                if int((x[at] == y).sum()) >= need:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def viable_for(percent: int):
    """The length and the positional filter on two packed (place of the common shingle, set size) values."""

    def viable(o1: str, o2: str):
        p1, p2, n1, n2 = (f"shiftright({o1}, 32)", f"shiftright({o2}, 32)", f"({o1} & 4294967295L)", f"({o2} & 4294967295L)")
        need = f"(({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent})"
        return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND least({n1} - {p1}, {n2} - {p2}) >= {need}")

    return viable


def ngram_jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    docs has doc_id and text; percent: the least 100 * intersection / union."""
    return with_components(docs, n, percent).drop("tid", "component")


def with_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The join with two more columns that name rows and components where doc_ids are null or repeat: tid (xxhash64 of the text), component
    (the same for all rows of a component and for no others; null for an empty set)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    freq = shingle_frequencies(texts, n)
    rows = stage(map_texts(texts.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text")), _prefixes(n, percent, freq), DOC), "prefixes")
    # different sets with one 64-bit key (some 70 of 5 * 10**10 sets) get a key of both their hashes
    same = rows.where("n > 0").groupBy("key").agg(F.min("key2").alias("k2"), F.max("key2").alias("k3"), F.count("*").alias("times")).where("k2 <> k3").select("key", F.lit(True).alias("shared"), "times")
    same = stage(same, "keys")
    alike = same.agg(F.sum("times")).first()[0] or 0
    apart = (lambda df: join_left_heavy(df, same, ["key"], "times", alike).withColumn("key", F.when(F.col("shared"), F.xxhash64("key", "key2")).otherwise(F.col("key"))).drop("shared")) if alike else lambda df: df
    rows = apart(rows)
    classes = stage(rows.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("tid", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("tid"), F.count("*").alias("times")), "classes")
    entries = rows.where("n > 0").select("key", "n", F.posexplode("prefix").alias("pos", "s"))
    entries = entries.select("s", "key", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n")).alias("o"))
    ranges = stage(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges")), "ranges")

    texts = texts.where("text IS NOT NULL").withColumn("tid", F.xxhash64("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda c: ranges.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"))
        common = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda t, x: t + x)
        # suffix filter: what the ranges can have in common at most (a range that is full counts in full)
        full = F.array_max("ra") == 32767
        both = join_salted(join_salted(pairs, of("a"), ["a"], ["b"]), of("b"), ["b"], ["a"])
        close = both.where(full | ((100 + percent) * common >= percent * (F.col("na") + F.col("nb"))))
        close = stage(close.select("a", "b"), "close")
        wanted = close.selectExpr("explode(array(a, b)) key").distinct().join(classes, "key").select("tid", F.col("low").alias("doc_id"))
        wanted = stage(wanted, "wanted")
        few = kept_by_bits(texts, "tid", wanted)
        few = few.join(wanted, (few["tid"] == wanted["tid"]) & few["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        sets = map_texts(few.select(F.col("text").cast("binary").alias("text")), _sets(n), "key long, key2 long, shingles binary")
        sets = stage(apart(sets).groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")
        with_a = join_salted(close, sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), ["a"], ["b"])
        with_b = join_salted(with_a, sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), ["b"], ["a"])
        return map_texts(with_b, _verify(percent), "a long, b long")

    links = group_links(entries, viable_for(percent), verified)
    comp = connected_components(links)
    lows = classes.select("key", "low", "times").join(comp.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    ends = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    of = stage(lows.join(ends, "component").select("key", "component", "component_id", "times"), "members")
    # large classes are broadcast; empty sets meet nothing
    out = join_heavy(rows.where("n > 0").select("doc_id", "tid", "n", "key"), of, ["key"], "times", of.agg(F.sum("times")).first()[0] or 0)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "tid", "component")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "tid", F.lit(None).cast("long").alias("component"))
    return out.unionByName(empty)
