"""Genotype matrices in packed blocks: LD pairs and pruning, principal components, relatedness.

A site is a row over a fixed order of samples, cut into chunks: codes 0 to 2 are the dosage, 3 is missing. A row holds the genotypes that differ from an
absent one, four bytes each (slot * 4 + code, sorted), or two bit-planes of all genotypes where these are shorter. Work and what is shuffled follow the rows of
calls where few samples carry a site, and a quarter of a byte a genotype where many do.

calls: site, sample, a1, a2 (allele numbers whose sum is 0 to 2; anything else is an error), chrom and pos where places matter. A null allele is a missing
genotype. A genotype without a row is missing too, or with absent="reference" it is 0, as where only carriers are stored. Of rows
that repeat a genotype the largest dosage counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.operators.ranks import row_numbers
from strandlake.sources.tables import stage

#: Entries that a row of a chunk has in the mean, at most; most samples of a chunk; samples in a block of PCA's columns.
CHUNK, WIDEST, PIECE = 16_384, 1 << 19, 4096


@dataclass(frozen=True)
class Shape:
    """n samples in chunks, and the code of a genotype without a row; what tasks need to know of a matrix."""

    n: int
    chunk: int
    none: int = 3

    def width(self, chunk: int) -> int:
        return min(self.chunk, self.n - chunk * self.chunk)

    @property
    def chunks(self) -> int:
        return max(1, -(-self.n // self.chunk))


@dataclass(frozen=True)
class Packed:
    """sites: key columns, chunk, planes (binary, either form), n (called), x (sum of dosages), k (entries) by chunk; slots: sample, chunk, slot."""

    sites: DataFrame
    slots: DataFrame
    shape: Shape


def _words(width: int) -> int:
    return -(-width // 64)


def unpacked(planes: bytes, width: int) -> np.ndarray:
    """Codes of one or more sites' planes, a row each."""
    bits = np.frombuffer(planes, np.uint8).reshape(-1, 2, 8 * _words(width))
    code = np.unpackbits(bits, axis=2, bitorder="little", count=width)
    return code[:, 0] + 2 * code[:, 1]


def entries(planes: list[bytes], shape: Shape, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, code) of the genotypes of sites that differ from an absent one, by row and slot."""
    width = shape.width(chunk)
    got = []
    for b in planes:
        if len(b) == 16 * _words(width):  # the other form is shorter
            code = unpacked(b, width)[0]
            at = np.flatnonzero(code != shape.none)
            got.append((at * 4 + code[at]).astype(np.int32))
        else:
            got.append(np.frombuffer(b, np.int32))
    each = np.concatenate(got) if got else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(got)), [len(g) for g in got]), each >> 2, each & 3


def to_planes(b: bytes, width: int, none: int) -> bytes:
    """Planes of a row of entries."""
    each = np.frombuffer(b, np.int32)
    codes = np.full(64 * _words(width), 3, np.uint8)
    codes[:width] = none
    codes[each >> 2] = each & 3
    return np.packbits(np.stack([codes & 1, codes >> 1]), axis=1, bitorder="little").tobytes()


def pack(calls: DataFrame, absent: str = "missing", samples: DataFrame | None = None, chunk: int | None = None) -> Packed:
    """samples (sample): those of the matrix, if not all that calls has. chunk: so many samples; else as many as hold CHUNK entries of a site in the mean."""
    keys = [c for c in ("chrom", "pos", "site") if c in calls.columns]
    g = F.col("a1") + F.col("a2")
    code = F.when(g.isNull(), 0).when(g.between(0, 2), g + 1).otherwise(F.raise_error(F.lit("a dosage is not 0, 1 or 2")))
    calls = stage(calls.select(*keys, "sample", code.cast("int").alias("code")), "calls")
    names = stage(row_numbers((calls if samples is None else samples).select("sample").distinct(), "sample"), "samples")
    n = names.count()
    if chunk is None:
        told = calls.agg(F.count("*").alias("rows"), F.approx_count_distinct("site").alias("sites")).first()
        chunk = max(CHUNK, min(WIDEST, n * CHUNK * max(told.sites, 1) // max(told.rows, 1)))
    shape = Shape(n, chunk, 0 if absent == "reference" else 3)
    slots = stage(names.select("sample", F.floor(F.col("n") / chunk).cast("int").alias("chunk"), (F.col("n") % chunk).cast("int").alias("slot")), "slots")
    held = calls.join(slots, "sample").select(*keys, "chunk", (F.col("slot") * 4 + F.col("code")).alias("g"))
    if shape.chunks > 1:  # a site without rows in some chunk has a row there all the same
        held = held.unionByName(calls.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(shape.chunks - 1))).alias("chunk"), F.lit(None).cast("int").alias("g")))
    held = held.groupBy(*keys, "chunk").agg(F.collect_list("g").alias("g"))

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known, total, count = [], [], [], []
            for c, rows in zip(batch.column("chunk").to_pylist(), batch.column("g")):
                width = shape.width(c)
                at = np.sort(rows.values.to_numpy(zero_copy_only=False))
                at = at[np.append(at[1:] >> 2 != at[:-1] >> 2, True)] if len(at) else at  # the largest of a slot comes last
                codes = (at + 3) & 3
                differ = codes != shape.none
                got, dosage = ((at & ~3) + codes)[differ].astype(np.int32).tobytes(), codes[codes < 3]
                out.append(got if len(got) < 16 * _words(width) else to_planes(got, width, shape.none))
                known.append(len(dosage) + (width - len(codes) if shape.none == 0 else 0))
                total.append(int(dosage.sum(dtype=np.int64)))
                count.append(len(got) // 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("chunk"), pa.array(out, pa.binary()), *(pa.array(v, pa.int64()) for v in (known, total, count))], names=[*keys, "chunk", "planes", "n", "x", "k"])

    types = ", ".join(f"{k} {calls.schema[k].dataType.simpleString()}" for k in keys)
    return Packed(stage(held.mapInArrow(planes, f"{types}, chunk int, planes binary, n long, x long, k long"), "planes"), slots, shape)


# --- linkage


def _pair_sums(a: tuple, b: tuple, sizes: tuple[int, int], width: int, none: int, block: int = 4096) -> np.ndarray:
    """n, x, y, xx, yy, xy of all pairs of rows of two tiles (their entries), over what both know. Samples without an entry in either tile are
    only counted; the others are multiplied, `block` at a time."""
    slots, place = np.unique(np.concatenate((a[1], b[1])), return_inverse=True)
    out = np.zeros((6, *sizes))
    if none == 0:
        out[0] = width - len(slots)
    sides = []
    for (row, _, code), at in ((a, place[: len(a[1])]), (b, place[len(a[1]) :])):
        order = np.argsort(at, kind="stable") if len(slots) > block else slice(None)
        sides.append((row[order], at[order], code[order]))
    for low in range(0, len(slots), block):
        high = min(low + block, len(slots))
        parts = []
        for (row, at, code), size in zip(sides, sizes):
            if len(slots) > block:
                i, j = np.searchsorted(at, (low, high))
                row, at, code = row[i:j], at[i:j], code[i:j]
            full = np.full((size, high - low), none, np.uint8)
            full[row, at - low] = code
            known = (full < 3).astype(np.float32)
            x = full * known
            parts.append((known, x, x * x))
        (ka, xa, xxa), (kb, xb, xxb) = parts
        out += np.stack([ka @ kb.T, xa @ kb.T, ka @ xb.T, xxa @ kb.T, ka @ xxb.T, xa @ xb.T])  # sums of a block are whole numbers below 2^24
    return out.astype(np.int64)


def _r2(s: np.ndarray) -> np.ndarray:
    n, x, y, xx, yy, xy = s.astype(np.float64)
    low = (n * xx - x * x) * (n * yy - y * y)
    return np.where(low > 0, (n * xy - x * y) ** 2 / np.where(low > 0, low, 1), np.nan)


def site_pairs(packed: Packed, window: int, least: int = 10, above: float | None = None, tile: int = 128) -> DataFrame:
    """chrom, early, early_pos, late, late_pos, n, r2 of pairs of sites of one chromosome within the window, known together in at least so many samples;
    early comes first by pos, then site. r2 is null where one doesn't vary. above: only pairs over it.

    Sites lie in tiles inside position bins of the window's width; a tile meets itself and those of its bin and the next that its window reaches.
    With several chunks of samples each gives its sums, which are added up; with one, r2 is done where they are counted."""
    bin_ = F.floor(F.col("pos") / max(window, 1)).cast("long")
    placed = packed.sites.withColumn("bin", bin_)
    placed = placed.withColumn("tile", F.floor((F.row_number().over(W.partitionBy("chrom", "bin", "chunk").orderBy("pos", "site")) - 1) / tile).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "site", "planes")))
    tiles = placed.groupBy("chrom", "bin", "tile", "chunk").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), rows.alias("r"))
    tiles = stage(tiles.select("chrom", "bin", "tile", "chunk", "lo", "hi", *(F.col(f"r.{c}").alias(c) for c in ("pos", "site", "planes"))), "tiles")
    index = tiles.where("chunk = 0").select("chrom", "bin", "tile", "lo", "hi")
    other = index.select("chrom", F.col("bin").alias("bin_2"), F.col("tile").alias("tile_2"), F.col("lo").alias("lo_2"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"))
    near = index.join(other, ["chrom", "bin"]).where(((F.col("bin_2") > F.col("bin")) | (F.col("tile_2") >= F.col("tile"))) & (F.col("lo_2") - F.col("hi") <= window))
    second = tiles.select("chrom", "chunk", *(F.col(c).alias(f"{c}_2") for c in ("bin", "tile", "pos", "site", "planes")))
    met = near.select("chrom", "bin", "tile", "bin_2", "tile_2").join(tiles.drop("lo", "hi"), ["chrom", "bin", "tile"]).join(second, ["chrom", "chunk", "bin_2", "tile_2"])
    met = met.select("chrom", "chunk", ((F.col("bin") == F.col("bin_2")) & (F.col("tile") == F.col("tile_2"))).alias("same"), "pos", "site", "planes", "pos_2", "site_2", "planes_2")
    shape, single, names = packed.shape, packed.shape.chunks == 1, ("n", "x", "y", "xx", "yy", "xy")
    kind = packed.sites.schema["site"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c: batch.column(c)[i]
                chunk = one("chunk").as_py()
                at, at_2 = np.array(one("pos").as_py(), np.int64), np.array(one("pos_2").as_py(), np.int64)
                s = _pair_sums(entries(one("planes").as_py(), shape, chunk), entries(one("planes_2").as_py(), shape, chunk), (len(at), len(at_2)), shape.width(chunk), shape.none)
                use = at_2[None, :] - at[:, None] <= window
                if one("same").as_py():
                    use &= np.arange(len(at_2))[None, :] > np.arange(len(at))[:, None]
                if single:
                    use &= s[0] >= least
                    if above is not None:
                        with np.errstate(invalid="ignore"):
                            use &= _r2(s) > above
                a, b = np.nonzero(use)
                if len(a):
                    take = lambda c, j: one(c).values.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pa.array([one("chrom").as_py()] * len(a), pa.string()), take("site", a), pa.array(at[a]), take("site_2", b), pa.array(at_2[b]), *(pa.array(x[a, b]) for x in s)], names=["chrom", "early", "early_pos", "late", "late_pos", *names])

    pairs = met.mapInArrow(count, f"chrom string, early {kind}, early_pos long, late {kind}, late_pos long, {', '.join(f'{c} long' for c in names)}")
    if not single:
        pairs = pairs.groupBy("chrom", "early", "early_pos", "late", "late_pos").agg(*(F.sum(c).alias(c) for c in names))
    n, x, y, xx, yy, xy = (F.col(c).cast("double") for c in names)
    low = (n * xx - x * x) * (n * yy - y * y)
    out = pairs.where(F.col("n") >= least).select("chrom", "early", "early_pos", "late", "late_pos", "n", F.when(low > 0, F.pow(n * xy - x * y, F.lit(2)) / low).alias("r2"))
    return out if above is None else out.where(F.col("r2") > above)


def ld_prune(packed: Packed, r2: float = 0.1, window: int = 500_000, least: int = 10) -> DataFrame:
    """chrom, pos, site and kept for every site: kept ones of a chromosome within the window are pairwise at r2 or less.

    Sites are taken by pos, site: one stays unless an earlier one that stays is in LD with it. Links stream by in that order, a chromosome a task; what a task
    remembers are the sites of one window. Pairs with fewer than `least` common samples count as apart, as do pairs without r2."""
    kind = packed.sites.schema["site"].dataType.simpleString()
    text = kind == "string"
    plain = lambda c: F.col(c).cast("string" if text else "long").alias(c)
    links = site_pairs(packed, window, least, r2).select("chrom", plain("early"), plain("late"), "early_pos", "late_pos")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chrom, gone, behind = None, set(), deque()
        for batch in batches:
            out = ([], [])
            for c, early, late, pos in zip(*(batch.column(x).to_pylist() for x in ("chrom", "early", "late", "late_pos"))):
                if c != chrom:
                    chrom = c
                    gone.clear()
                    behind.clear()
                while behind and behind[0][0] < pos - window:
                    gone.discard(behind.popleft()[1])
                if late not in gone and early not in gone:
                    gone.add(late)
                    behind.append((pos, late))
                    out[0].append(c)
                    out[1].append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string() if text else pa.int64())], names=["chrom", "site"])

    in_order = links.repartition("chrom").sortWithinPartitions("chrom", "late_pos", "late", "early_pos", "early")
    dropped = in_order.mapInArrow(walk, f"chrom string, site {'string' if text else 'long'}").select("chrom", F.col("site").cast(kind).alias("site"), F.lit(True).alias("gone"))
    sites = packed.sites.where("chunk = 0").select("chrom", "pos", "site")
    return sites.join(stage(dropped, "dropped"), ["chrom", "site"], "left").select("chrom", "pos", "site", F.col("gone").isNull().alias("kept"))


# --- principal components


def tiles_of(packed: Packed, size: int) -> tuple[DataFrame, int]:
    """(slab, chunk, site, p, planes as arrays of about `size` sites; how many sites vary). p: the allele's frequency."""
    told = packed.sites.groupBy("site").agg((F.sum("x") / (2 * F.sum("n"))).alias("p")).where("p > 0 AND p < 1")
    told = stage(told, "frequencies")
    m = told.count()
    slab = F.pmod(F.xxhash64("site"), F.lit(max(1, -(-m // size)))).cast("int").alias("slab")
    rows = packed.sites.join(told, "site").select(slab, "chunk", F.struct("site", "p", "planes").alias("r"))
    tiles = rows.groupBy("slab", "chunk").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return stage(tiles.select("slab", "chunk", *(F.col(f"r.{c}").alias(c) for c in ("site", "p", "planes"))), "tiles"), m


def standard(row: np.ndarray, code: np.ndarray, p: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """((g - 2p) / sqrt(2p (1 - p)) of a genotype without a row, by site; how much more each entry has). A missing genotype is the mean, 0."""
    scale = 1 / np.sqrt(2 * p * (1 - p))
    plain = -2 * p * scale if none == 0 else np.zeros(len(p))
    return plain, np.where(code < 3, (code - 2 * p[row]) * scale[row], 0.0) - plain[row]


def _add_products(out: np.ndarray, to: np.ndarray, weight: np.ndarray, of: np.ndarray, block: np.ndarray, step: int = 32_768) -> None:
    """out[to] += weight * block[of], to in order."""
    for at in range(0, len(to), step):
        t = to[at : at + step]
        starts = np.flatnonzero(np.diff(t, prepend=-1))
        out[t[starts]] += np.add.reduceat(weight[at : at + step, None] * block[of[at : at + step]], starts, axis=0)


def _added(parts: DataFrame, key: str, value: str) -> DataFrame:
    """Sums of packed matrices by key, added up as they stream by in the keys' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=[key, value])
        for batch in batches:
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value)):
                got = np.frombuffer(v.as_buffer(), np.float64)
                if k != at:
                    if at is not None:
                        yield one()
                    at, total = k, got.copy()
                else:
                    total += got
        if at is not None:
            yield one()

    return parts.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, f"{key} int, {value} binary")


def _gram(df: DataFrame, value: str, cols: int) -> np.ndarray:
    """X'X of a matrix kept as packed blocks of rows; only cols * cols numbers reach the driver."""

    def run(batches):
        total = np.zeros((cols, cols))
        for batch in batches:
            for v in batch.column(value).to_pylist():
                x = np.frombuffer(v, np.float64).reshape(-1, cols)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cols * cols, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    got = df.select(value).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(cols * cols)
    for r in got:
        out[r["i"]] = r["v"]
    return out.reshape(cols, cols)


def _turned(df: DataFrame, key: str, value: str, t: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            got = [(np.frombuffer(v, np.float64).reshape(-1, t.shape[0]) @ t).tobytes() for v in batch.column(value).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(got, pa.binary())], names=[key, value])

    return df.select(key, value).mapInArrow(run, f"{key} int, {value} binary")


def _whitener(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    sure = values > 1e-12 * max(values.max(), 1e-300)
    return vectors * np.where(sure, 1 / np.sqrt(np.where(sure, values, 1)), 0)


def pca(packed: Packed, k: int = 32, rounds: int = 3, seed: int = 1, more: int = 10, slab: int = 512) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores: sample, pcs; loadings: site, loadings; singular values) of the standardised matrix over the root of its sites.

    A randomised range finder: k + more random columns go through the matrix and back `rounds` times, made orthonormal in between, then the matrix is
    looked at in their range. The matrix stays in tiles of about `slab` sites and a chunk of samples, as entries; its mean part is a product of sums. In a pass a
    task has a share of the slabs and one chunk: it gets the columns' blocks of that chunk once, then its tiles stream by. Square matrices of the columns reach
    the driver. The largest loading of a component is positive. Fewer samples or varying sites than k give fewer components."""
    tiles, m = tiles_of(packed, slab)
    shape = packed.shape
    k = max(0, min(k, shape.n, m))
    spark = packed.slots.sparkSession
    sample, site = packed.slots.schema["sample"].dataType.simpleString(), packed.sites.schema["site"].dataType.simpleString()
    if not k:
        return packed.slots.select("sample", F.array().cast("array<double>").alias("pcs")), spark.createDataFrame([], f"site {site}, loadings array<double>"), np.zeros(0)
    cols, scale, width = min(k + more, shape.n, m), 1 / np.sqrt(m), shape.width
    per = -(-shape.chunk // PIECE)  # pieces of a chunk; a piece is chunk * per + its place
    height = lambda piece: min(PIECE, width(piece // per) - piece % per * PIECE)
    pieces = [c * per + i for c in range(shape.chunks) for i in range(-(-width(c) // PIECE))]
    groups = max(1, min(-(-m // slab), 2 * spark.sparkContext.defaultParallelism))
    group = (F.col("slab") % groups).cast("int").alias("g")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    matrix = stage(tiles.select(group, "chunk", "slab", "p", "planes"), "matrix")

    def begin(batches):
        for batch in batches:
            for piece in batch.column("piece").to_pylist():
                got = np.random.default_rng([seed, piece]).standard_normal((height(piece), cols))
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["piece", "v"])

    def rows_of(batches):
        for batch in batches:
            for g, c, first, second, v, p, planes in zip(*(batch.column(x) for x in ("g", "chunk", "a", "b", "v", "p", "planes"))):
                if v.is_valid:
                    yield (g.as_py(), c.as_py()), first.as_py(), np.frombuffer(v.as_buffer(), np.float64).reshape(-1, cols), None
                else:
                    p = p.values.to_numpy()
                    row, slot, code = entries(planes.as_py(), shape, c.as_py())
                    yield (g.as_py(), c.as_py()), second.as_py(), None, (p, row, slot, *standard(row, code, p, shape.none))

    def forth(batches):
        """Blocks of the columns come before a task's tiles."""
        held, parts, block, plain_sum = None, [], None, None
        for at, slab_, v, tile in rows_of(batches):
            if at != held:
                held, parts, block = at, [], None
            if v is not None:
                parts.append(v)
                continue
            if block is None:
                block = np.concatenate(parts)
                plain_sum, parts = block.sum(0), []
            p, row, slot, plain, more_ = tile
            got = plain[:, None] * plain_sum
            _add_products(got, row, more_, slot, block)
            yield pa.RecordBatch.from_arrays([pa.array([slab_], pa.int32()), pa.array([(got * scale).tobytes()], pa.binary())], names=["slab", "u"])

    def back(batches):
        """A slab's block comes before its tile; a task gives its sums by piece."""

        def done():
            for i in range(-(-width(held[1]) // PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([held[1] * per + i], pa.int32()), pa.array([((total[i * PIECE : (i + 1) * PIECE] + plain_sum) * scale).tobytes()], pa.binary())], names=["piece", "v"])

        held, total, plain_sum, u = None, None, None, None
        for at, _, v, tile in rows_of(batches):
            if at != held:
                if held is not None:
                    yield from done()
                held, total, plain_sum = at, np.zeros((width(at[1]), cols)), np.zeros(cols)
            if v is not None:
                u = v
                continue
            p, row, slot, plain, more_ = tile
            plain_sum += plain @ u
            order = np.argsort(slot, kind="stable")
            _add_products(total, slot[order], more_[order], row[order], u)
        if held is not None:
            yield from done()

    def dealt(blocks: DataFrame) -> DataFrame:
        """Blocks (g, chunk, a, b, v) and the tiles of each (g, chunk), in one task."""
        own = matrix.select("g", "chunk", F.col("slab").alias("a"), F.col("slab").alias("b"), none("binary", "v"), "p", "planes")
        every = blocks.select("g", "chunk", "a", "b", "v", none("array<double>", "p"), none("array<binary>", "planes")).unionByName(own)
        return every.withColumn("tile", F.col("v").isNull()).repartition(groups * shape.chunks, "g", "chunk").sortWithinPartitions("g", "chunk", "a", "tile").drop("tile")

    def to_sites(v: DataFrame) -> DataFrame:
        each = v.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.floor(F.col("piece") / per).cast("int").alias("chunk"), (F.col("piece") - (1 << 30)).alias("a"), F.lit(0).alias("b"), "v")
        u = dealt(each).mapInArrow(forth, "slab int, u binary")
        return stage(_added(u, "slab", "u") if shape.chunks > 1 else u, "u")

    def to_samples(u: DataFrame) -> DataFrame:
        each = u.select(group, F.explode(F.sequence(F.lit(0), F.lit(shape.chunks - 1))).alias("chunk"), F.col("slab").alias("a"), F.lit(0).alias("b"), F.col("u").alias("v"))
        return stage(_added(dealt(each).mapInArrow(back, "piece int, v binary"), "piece", "v"), "v")

    orthonormal = lambda df, key, value: stage(_turned(df, key, value, _whitener(_gram(df, value, cols))), value)
    start = spark.range(shape.chunks * per).select(F.col("id").cast("int").alias("piece")).where(F.col("piece") <= pieces[-1]).mapInArrow(begin, "piece int, v binary")
    v = orthonormal(stage(start, "v"), "piece", "v")
    for _ in range(rounds):
        v = orthonormal(to_samples(orthonormal(to_sites(v), "slab", "u")), "piece", "v")
    u = to_sites(v)
    values, t = np.linalg.eigh(_gram(u, "u", cols))
    top = np.argsort(-values)[:k]
    singular, t = np.sqrt(np.maximum(values[top], 0)), t[:, top]
    inverse = np.where(singular > 1e-9 * max(singular[0], 1e-300), 1 / np.where(singular > 0, singular, 1), 0)

    def of_sites(batches):
        for batch in batches:
            for sites, got in zip(batch.column("site"), batch.column("u").to_pylist()):
                x = np.frombuffer(got, np.float64).reshape(-1, cols) @ (t * inverse)
                yield pa.RecordBatch.from_arrays([sites.values, pa.array(list(x), pa.list_(pa.float64()))], names=["site", "loadings"])

    loadings = stage(tiles.where("chunk = 0").select("slab", "site").join(u, "slab").mapInArrow(of_sites, f"site {site}, loadings array<double>"), "loadings")
    first = loadings.agg(*(F.max_by(F.col("loadings")[i], F.struct(F.round(F.abs(F.col("loadings")[i]), 9).alias("a"), F.col("site").alias("s"))).alias(f"s{i}") for i in range(k))).first()
    sign = np.array([1.0 if (first[f"s{i}"] or 0) >= 0 else -1.0 for i in range(k)])

    def of_samples(batches):
        for batch in batches:
            for piece, got in zip(batch.column("piece").to_pylist(), batch.column("v").to_pylist()):
                x = np.frombuffer(got, np.float64).reshape(-1, cols) @ (t * singular * sign)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), piece // per, np.int32)), pa.array(np.arange(len(x), dtype=np.int32) + piece % per * PIECE), pa.array(list(x), pa.list_(pa.float64()))], names=["chunk", "slot", "pcs"])

    scores = v.select("piece", "v").mapInArrow(of_samples, "chunk int, slot int, pcs array<double>").join(packed.slots, ["chunk", "slot"]).select("sample", "pcs")
    return scores, loadings.select("site", F.transform("loadings", lambda x, i: x * F.get(F.array(*map(F.lit, sign.tolist())), i)).alias("loadings")), singular


# --- relatedness


def relatedness(packed: Packed, least: float, block: int = 2048, slab: int = 256) -> DataFrame:
    """sample, sample2, n, k: pairs with standardised relatedness of at least `least` over the sites where both are called, and each sample with itself (k = 1).

    Where few samples carry a site and only pairs with entries at one site can reach `least`, the products are those of entries (see _by_entries). Else
    all pairs are multiplied (see _by_blocks)."""
    shape = packed.shape
    sites = packed.sites.groupBy("site").agg((F.sum("x") / (2 * F.sum("n"))).alias("p"), F.sum("k").cast("double").alias("k")).where("p > 0 AND p < 1")
    told = sites.agg(F.count("*").alias("m"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("products"), F.sum(2 * F.col("p") / (1 - F.col("p"))).alias("c")).first()
    if not told.m or 40 * told.products >= told.m * float(shape.n) ** 2:  # a product of entries is that much dearer than one of a block
        return _by_blocks(packed, least, block, slab)
    c = told.c if shape.none == 0 else 0.0
    own = stage(_own_sums(packed), "own")
    # k >= least is the same as s - least * gone12 + f1 + f2 >= bar
    bar = least * told.m - c if shape.none == 0 else 0.0
    if shape.none == 0:
        high = own.agg(F.max(F.col("a") + least * F.col("gone"))).first()[0] or 0.0
        if 2 * max(high, 0.0) >= bar - 1e-6 * (abs(bar) + 1):
            return _by_blocks(packed, least, block, slab)  # pairs without an entry in common can reach it
        bar = bar - 2 * max(high, 0.0) - 1e-6 * (abs(bar) + 1)
    found = _by_entries(packed, least, bar)
    side = lambda i: own.select(*(F.col(x).alias(f"{x}{i}") for x in ("slot", "sample", "a", "gone", "called")))
    both = found.join(side(1), found.i == F.col("slot1")).join(side(2), found.j == F.col("slot2"))
    n = (F.lit(told.m) - F.col("gone1") - F.col("gone2") + F.col("both")) if shape.none == 0 else F.col("shared")
    got = both.select(F.col("sample1").alias("sample"), F.col("sample2"), n.cast("long").alias("n"), ((F.lit(c) + F.col("a1") + F.col("a2") + F.col("s")) / n).alias("k")).where((F.col("n") > 0) & (F.col("k") >= least))
    self_ = own.select("sample", F.col("sample").alias("sample2"), ((F.lit(told.m) - F.col("gone")) if shape.none == 0 else F.col("called")).cast("long").alias("n"), F.lit(1.0).alias("k"))
    return got.unionByName(self_)


def _with_p(packed: Packed) -> DataFrame:
    told = packed.sites.groupBy("site").agg((F.sum("x") / (2 * F.sum("n"))).alias("p")).where("p > 0 AND p < 1")
    return packed.sites.select("site", "chunk", "planes").join(told, "site")


def _own_sums(packed: Packed) -> DataFrame:
    """sample, slot (of all), a (sum of an entry's excess times the site's plain value), gone (missing entries), called (others)."""
    shape = packed.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for c in np.unique(part.column("chunk").to_numpy()):
                    mine = part.filter(pa.array(part.column("chunk").to_numpy() == c))
                    p = mine.column("p").to_numpy()
                    row, slot, code = entries(mine.column("planes").to_pylist(), shape, int(c))
                    plain, more = standard(row, code, p, shape.none)
                    slots, where = np.unique(slot, return_inverse=True)
                    total = lambda w: np.bincount(where, w, len(slots))
                    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64) + int(c) * shape.chunk), pa.array(total(plain[row] * more)), pa.array(total(code == 3).astype(np.int64)), pa.array(total(code < 3).astype(np.int64))], names=["slot", "a", "gone", "called"])

    sums = _with_p(packed).mapInArrow(run, "slot long, a double, gone long, called long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("gone").alias("gone"), F.sum("called").alias("called"))
    all_ = packed.slots.select("sample", (F.col("chunk").cast("long") * shape.chunk + F.col("slot")).alias("slot"))
    return all_.join(sums, "slot", "left").na.fill(0, ["a", "gone", "called"])


def _by_entries(packed: Packed, least: float, bar: float) -> DataFrame:
    """i, j (slots of all, i < j), s (sum of products of the excess), shared (sites where both have an entry), both (where both are missing), of pairs with
    s - least * both of at least `bar`; without calls of absent genotypes, with s of at least least * shared.

    Each entry of a site goes to its sample with the site's later entries; a sample's products are added up where its rows stream by."""
    shape = packed.shape
    whole = _with_p(packed)

    def spread(batches):
        for batch in batches:
            for chunks, p, planes in zip(batch.column("c").to_pylist(), batch.column("p").to_pylist(), batch.column("planes").to_pylist()):
                got = []
                for c, b in sorted(zip(chunks, planes)):
                    _, slot, code = entries([b], shape, c)
                    got.append((slot.astype(np.int64) + c * shape.chunk) * 4 + code)
                each = np.concatenate(got)
                for low in range(0, len(each), 256):
                    some = each[low : low + 256]
                    rest = [each[low + i + 1 :].tobytes() for i in range(len(some))]
                    yield pa.RecordBatch.from_arrays([pa.array(some >> 2), pa.array((some & 3).astype(np.int8)), pa.array(np.full(len(some), p)), pa.array(rest, pa.binary())], names=["i", "code", "p", "rest"])

    def excess(code, p):
        scale = 1 / np.sqrt(2 * p * (1 - p))
        return np.where(code == 3, 2 * p, code) * scale if shape.none == 0 else (code - 2 * p) * scale

    def added(key, s, shared, both):
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        return (key[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in (s, shared, both)))

    def multiply(batches):
        def given(i, sums):
            j, s, shared, both = sums
            good = s - least * both >= bar if shape.none == 0 else s >= least * shared - 1e-6 * shared
            return pa.RecordBatch.from_arrays([pa.array(i[good]), pa.array(j[good]), *(pa.array(v[good]) for v in (s, shared, both))], names=["i", "j", "s", "shared", "both"])

        last, kept = None, None  # the sample whose rows may go on, and its sums so far
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                i, code, p = (part.column(x).to_numpy() for x in ("i", "code", "p"))
                rest = part.column("rest").to_pylist()
                size = np.array([len(r) // 8 for r in rest])
                each = np.frombuffer(b"".join(rest), np.int64)
                own, code_2, p = np.repeat(i, size), each & 3, np.repeat(p, size)
                code = np.repeat(code, size)
                gone = ((code == 3) & (code_2 == 3)).astype(np.int64)
                products = [each >> 2, excess(code, p) * excess(code_2, p), np.ones(len(each), np.int64), gone]
                if last is not None:
                    own = np.concatenate((np.full(len(kept[0]), last), own))
                    products = [np.concatenate((a, b)) for a, b in zip(kept, products)]
                key, *sums = added(own * shape.n + products[0], *products[1:])
                own, j, last = key // shape.n, key % shape.n, i[-1]
                cut = np.searchsorted(own, last)
                yield given(own[:cut], (j[:cut], *(v[:cut] for v in sums)))
                kept = [j[cut:], *(v[cut:] for v in sums)]
        if last is not None:
            yield given(np.full(len(kept[0]), last), kept)

    one = whole.groupBy("site", "p").agg(F.collect_list("chunk").alias("c"), F.collect_list("planes").alias("planes")) if shape.chunks > 1 else whole.select("site", "p", F.array("chunk").alias("c"), F.array("planes").alias("planes"))
    sent = one.mapInArrow(spread, "i long, code byte, p double, rest binary").repartition("i").sortWithinPartitions("i")
    return sent.mapInArrow(multiply, "i long, j long, s double, shared long, both long")


def _by_blocks(packed: Packed, least: float, block: int, slab: int) -> DataFrame:
    """All pairs: a task has a pair of sample blocks and all sites, which stream by in slabs of packed planes; it holds the two blocks' sums and gives the
    pairs that reach `least`, nothing else."""
    shape = packed.shape
    block = min(block, shape.chunk) // 8 * 8 or 8
    tiles, _ = tiles_of(packed, slab)
    per = -(-shape.chunk // block)
    blocks = max(1, -(-shape.n // block))
    wide = lambda b: min(block, shape.width(b // per) - (b % per) * block)
    used = [b for b in range(shape.chunks * per) if b % per * block < shape.width(b // per)]

    def cut(batches):
        """Each tile as one row for each of its sample blocks."""
        for batch in batches:
            for s, c, p, planes in zip(*(batch.column(x).to_pylist() for x in ("slab", "chunk", "p", "planes"))):
                full = 16 * _words(shape.width(c))
                bits = np.frombuffer(b"".join(x if len(x) == full else to_planes(x, shape.width(c), shape.none) for x in planes), np.uint8).reshape(len(p), 2, -1)
                mine = [b for b in used if b // per == c]
                got = [np.ascontiguousarray(bits[:, :, b % per * block // 8 : b % per * block // 8 + -(-wide(b) // 8)]).tobytes() for b in mine]
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(mine), pa.int32()), pa.array(mine, pa.int32()), pa.array([p] * len(mine), pa.list_(pa.float64())), pa.array(got, pa.binary())], names=["slab", "b", "p", "planes"])

    rows = tiles.mapInArrow(cut, "slab int, b int, p array<double>, planes binary")
    sent = rows.withColumn("o", F.explode(F.array(*map(F.lit, used)))).select(F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "slab", "b", "p", "planes").repartition(max(1, blocks * (blocks + 1) // 2), "b1", "b2").sortWithinPartitions("b1", "b2", "slab", "b")

    def decoded(planes: bytes, p: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.frombuffer(planes, np.uint8).reshape(len(p), 2, -1)
        code = np.unpackbits(bits, axis=2, bitorder="little", count=wide(b))
        code = code[:, 0] + 2 * code[:, 1]
        known = code < 3
        return np.where(known, (code - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None], 0.0), known.astype(np.float64)

    def multiply(batches):
        def done():
            b1, b2 = pair
            with np.errstate(invalid="ignore", divide="ignore"):
                k = sums / counts
            good = (k >= least) & (counts > 0)
            if b1 == b2:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            x, y, n, got = (b1 % per) * block + i, (b2 % per) * block + j, counts[i, j], k[i, j]
            if b1 == b2:
                own = np.arange(len(counts))
                x, y, n, got = np.append(x, b1 % per * block + own), np.append(y, b1 % per * block + own), np.append(n, np.diag(counts)), np.append(got, np.ones(len(own)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b1 // per, np.int32)), pa.array(x.astype(np.int32)), pa.array(np.full(len(x), b2 // per, np.int32)), pa.array(y.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(got)], names=["c1", "s1", "c2", "s2", "n", "k"])

        pair, first, sums, counts = None, None, None, None
        for batch in batches:
            for b1, b2, s, b, p, planes in zip(*(batch.column(x).to_pylist() for x in ("b1", "b2", "slab", "b", "p", "planes"))):
                if (b1, b2) != pair:
                    if pair is not None:
                        yield done()
                    pair, sums, counts = (b1, b2), np.zeros((wide(b1), wide(b2))), np.zeros((wide(b1), wide(b2)))
                z, known = decoded(planes, np.array(p), b)
                if b == b1 and b1 != b2:
                    first = (z, known)
                    continue
                a = first if b1 != b2 else (z, known)
                sums += a[0].T @ z
                counts += a[1].T @ known
        if pair is not None:
            yield done()

    found = sent.mapInArrow(multiply, "c1 int, s1 int, c2 int, s2 int, n long, k double")
    of = lambda i, name: packed.slots.select(F.col("chunk").alias(f"c{i}"), F.col("slot").alias(f"s{i}"), F.col("sample").alias(name))
    named = found.join(of(1, "sample"), ["c1", "s1"]).join(of(2, "sample2"), ["c2", "s2"])
    # samples are numbered in their order, so the first of a pair is the smaller
    return named.select("sample", "sample2", "n", "k")
