"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts anywhere else.

Finding where to look. Every string of `length` bytes is tied to one of its windows of GRAM bytes, the one with the smallest hash
(leftmost of equals), its anchor; equal strings have equal anchors. Consecutive starts with one anchor form a run, whose context is
the bytes from its first start to the end of its last string. Only anchors that occur twice or more can hold repeats; where all
runs of an anchor have one context, all their strings are repeats, and equal contexts are merged before anything is sorted.

Sorting. The different contexts of repeated anchors, dealt by anchor into packs of about PACK bytes, are sorted by two-stage suffix
sorting: suffixes that are smaller than their successors are sorted directly (to the depth of `length`), all others are induced by
one scan over the buckets of their first symbols; strings are repeats where adjacent common prefixes reach `length`. An anchor
with more than MOST different contexts would overfill a task: its contexts are split by where the anchor lies in their strings, in ranges of WIDTHS places.
Strings of one range have all bytes but so many in common ground, so the bytes around the anchor are a longer anchor of their own; the parts are
merged where equal and sorted in the same way, and split again if they are still too many (in a range of one place equal strings are one context).

Equal contexts are known by 64 bits (a polynomial of the bytes mixed with their CRC-32); strings found by sorting are compared symbol by symbol.

Null text: empty. Very long texts: in overlapping segments, whole. Texts shorter than `length` keep everything. Copies and repeated rows are
repeats of each other (whole texts go where they reach `length`). Matches never cross documents. Extra columns are ignored whatever their
names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Rolling, chunks, map_texts, mix, stage
from strandlake.llm.components import join_heavy, join_left_heavy, kept_by_bits

GRAM = 128
PACK = 1 << 19
MOST, WIDTHS = 4_000, (32, 4, 1)
#: Bytes of texts that a task looks at together, and suffixes that are compared together.
PART_BYTES, SLICE = 1 << 19, 1 << 16
#: Bytes of one text that are looked at together; the low bits of a sliding minimum hold the place.
SEGMENT, PLACE_BITS = 1 << 22, 24


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w items, by its start (two running minima over blocks of w)."""
    n = len(x) - w + 1
    whole = -(-len(x) // w) * w
    blocks = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(buf: np.ndarray, bounds: np.ndarray, length: int):
    """The runs of a buffer that holds texts one after the other (text i: bounds[i] to bounds[i + 1]).

    (text, first start in the text, number of starts, anchor hash, context hash), a row each."""
    gram = min(GRAM, max(1, length // 2))
    if len(buf) < length:
        return None
    rolling = Rolling(buf)
    h = rolling.windows(gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = sliding_minimum((h & ~place) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    anchor = (low & place).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(bounds, start, side="right") - 1
    valid = start + length <= bounds[text + 1]
    start, anchor, text = start[valid], anchor[valid], text[valid]
    if not len(start):
        return None
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    s, n = start[new], np.diff(new, append=len(start))
    a, t = anchor[new], text[new]
    view = memoryview(np.ascontiguousarray(buf))
    crc = np.fromiter((zlib.crc32(view[x:y]) for x, y in zip(s.tolist(), (s + n - 1 + length).tolist())), np.uint64, len(s))
    context = mix(mix(rolling.spans(s, s + n - 1 + length) + (a - s).astype(np.uint64)) ^ crc)
    return t, s - bounds[t], n, h[a], context


RUN = "t1 long, t2 long, h long, c long, s long, n int"


def _runs(length: int):
    def emit(t1, t2, found, shift=0):
        t, s, n, h, c = found
        return pa.RecordBatch.from_arrays([t1.take(pa.array(t)), t2.take(pa.array(t)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s + shift), pa.array(n.astype(np.int32))], names=["t1", "t2", "h", "c", "s", "n"])

    def run(batches):
        for batch in batches:
            for first, part in chunks((t.as_py() for t in batch.column("text")), PART_BYTES):
                t1, t2 = batch.column("t1").slice(first, len(part)), batch.column("t2").slice(first, len(part))
                long = [i for i, t in enumerate(part) if len(t) > SEGMENT]
                for i in long:  # in segments that overlap by what a string needs
                    for at in range(0, len(part[i]) - length + 1, SEGMENT):
                        piece = np.frombuffer(part[i], np.uint8)[at : at + SEGMENT + length - 1]
                        if (found := runs(piece, np.array([0, len(piece)]), length)) is not None:
                            yield emit(t1.slice(i, 1), t2.slice(i, 1), found, at)
                    part[i] = b""
                found = runs(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), length)
                if found is not None:
                    yield emit(t1, t2, found)

    return run


class Suffixes:
    """Two-stage suffix sorting of contexts, to the depth of `length`."""

    SYMBOLS = 7  # of nine bits in a key

    def __init__(self, contexts: list[bytes], length: int):
        self.length = length
        joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
        self.base = np.cumsum([0, *(len(c) + 1 for c in contexts)])
        joined[self.base[1:] - 1] = 0  # ends of contexts: smaller than any byte
        self.n = len(joined)
        self.t = np.concatenate([joined, np.zeros(2 * length + 600, np.int16)])
        self.rolling = Rolling(self.t)
        key = np.zeros(len(self.t) - self.SYMBOLS, np.int64)
        for j in range(self.SYMBOLS):
            key <<= 9
            key |= self.t[j : j + len(key)]
        self.key = key

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), SLICE):
            x, y = a[at : at + SLICE], b[at : at + SLICE]
            out[at : at + SLICE] = self.rolling.spans(x, x + size) == self.rolling.spans(y, y + size)
        return out

    def rises(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor."""
        step = np.diff(self.t[: self.n].astype(np.int32), append=-1)  # what follows the last symbol is smaller
        at = np.where(step != 0, np.arange(self.n, dtype=np.int32), np.int32(self.n - 1))
        return step[np.minimum.accumulate(at[::-1])[::-1]] > 0

    def sort_directly(self, b: np.ndarray) -> np.ndarray:
        """b's suffixes in order: by keys of SYMBOLS symbols, skipping what all members of a tied group have in common."""
        b = b[np.argsort(self.key[b], kind="stable")]
        k = self.key[b]
        g = np.cumsum(np.diff(k, prepend=k[:1] - 1) != 0, dtype=np.int32)
        del k
        active, part, d = np.arange(len(b), dtype=np.int32), b, np.full(len(b), self.SYMBOLS, np.int32)
        while True:
            on = (np.bincount(g)[g] > 1) & (d < self.length)
            active, part, g, d = active[on], part[on], g[on], d[on]
            if not len(part):
                return b
            first = np.flatnonzero(np.diff(g, prepend=-1))
            number = np.cumsum(np.diff(g, prepend=g[:1] - 1) != 0, dtype=np.int32) - 1
            for step in (256, 128, 64, 32, 16, 8):
                equal = self.same(part + d, part[first][number] + d, step)
                d = d + np.int32(step) * np.logical_and.reduceat(equal, first)[number]
                d = np.minimum(d, self.length)
            k = self.key[part + d]
            order = np.lexsort((k, number))
            part, d, k, number = part[order], d[order], k[order], number[order]
            b[active] = part  # groups keep their places, so sorted members go where the group stands
            g = np.cumsum((np.diff(number, prepend=-1) != 0) | (np.diff(k, prepend=k[:1]) != 0), dtype=np.int32)
            d = d + self.SYMBOLS

    def order(self) -> np.ndarray:
        """All suffixes in order."""
        t, rising = self.t[: self.n], self.rises()
        sorted_b = self.sort_directly(np.flatnonzero(rising))
        first = t[sorted_b]
        from_b = np.searchsorted(first, np.arange(258))
        pieces: list[list[np.ndarray]] = [[] for _ in range(257)]
        pieces[0].append(np.array([self.n - 1]))  # the last suffix stands first of all
        out = []
        for c in range(257):
            wave = np.concatenate(pieces[c]) if pieces[c] else np.zeros(0, np.int64)
            falling = [wave]
            while len(wave):  # runs of one symbol induce inside their own bucket
                wave = wave[wave > 0] - 1
                wave = wave[(t[wave] == c) & ~rising[wave]]
                falling.append(wave)
            bucket = np.concatenate([*falling, sorted_b[from_b[c] : from_b[c + 1]]])
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[t[before] > c]
            symbol = t[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            edge = np.flatnonzero(np.diff(symbol, prepend=-1))
            for x, y in zip(edge, np.append(edge[1:], len(symbol))):
                pieces[symbol[x]].append(before[x:y])
        return np.concatenate(out)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, up to `length`; full ones are compared symbol by symbol too."""
        got = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            more = got + step <= self.length
            got[more] += step * self.same(a[more] + got[more], b[more] + got[more], step)
            step >>= 1
        full = np.flatnonzero(got == self.length)
        for at in [*range(0, self.length - self.SYMBOLS, self.SYMBOLS), self.length - self.SYMBOLS] if self.length >= self.SYMBOLS else []:
            full = full[self.key[a[full] + at] == self.key[b[full] + at]]
        if self.length >= self.SYMBOLS:
            wrong = got == self.length
            wrong[full] = False
            got[wrong] = 0
        return got

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """By position: whether one of the first starts[i] strings of context i begins there and is a repeat of another."""
        wanted = self.begun(starts)
        sa = self.order()
        sa = sa[wanted[sa]]
        out = np.zeros(self.n, bool)
        for at in range(0, len(sa) - 1, SLICE):
            a, b = sa[at : at + SLICE], sa[at + 1 : at + 1 + SLICE]
            a = a[: len(b)]
            full = self.common(a, b) >= self.length
            out[a[full]] = True
            out[b[full]] = True
        return out

    def begun(self, starts: np.ndarray) -> np.ndarray:
        """By position: whether one of the first starts[i] strings of context i begins there."""
        return np.arange(self.n) < np.repeat(self.base[:-1] + starts, np.diff(self.base))


def _sort_pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        contexts, n, m = t.column("bytes").to_pylist(), t.column("n").to_numpy(), t.column("m").to_numpy()
        s = Suffixes(contexts, length)
        hit = s.repeated(n)
        hit |= s.begun(np.where(m > 1, n, 0))
        # a context ends in positions that are no starts, so no run of hits crosses contexts
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        lo, hi = edge[0::2], edge[1::2]
        of = np.searchsorted(s.base, lo, side="right") - 1
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays([t.column("h").combine_chunks().take(take), t.column("c").combine_chunks().take(take), pa.array((lo - s.base[of]).astype(np.int32)), pa.array((hi - s.base[of]).astype(np.int32))], names=["h", "c", "lo", "hi"])

    return run


def _contexts(length: int):
    """Bytes of each context that a text stands for."""

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                out += [(w["h"], w["c"], w["n"], w["m"], w["crowd"], text[w["s"] : w["s"] + w["n"] - 1 + length]) for w in wanted]
            for i in range(0, len(out), 4096):
                h, c, n, m, crowd, data = zip(*out[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.int64()), pa.array(crowd, pa.bool_()), pa.array(data, pa.binary())], names=["h", "c", "n", "m", "crowd", "bytes"])

    return run


PART = "h0 long, c0 long, shift int, h long, c long, n int, m long, bytes binary"


def _split(length: int, width: int):
    """Parts of contexts: the starts whose strings have the anchor in one range of `width` places; h is then the hash of what these have in common ground."""
    gram = min(GRAM, max(1, length // 2))
    place = np.uint64((1 << PLACE_BITS) - 1)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, n = row["bytes"], row["n"]
                rolling = Rolling(np.frombuffer(data, np.uint8))
                anchor = int(np.argmin(rolling.windows(gram)[: length - gram + 1] & ~place))
                j = 0
                while j < n:
                    g = (anchor - j) // width
                    end = min(n, anchor - g * width + 1)
                    core = data[anchor - g * width : anchor - (g + 1) * width + 1 + length]
                    part = data[j : end - 1 + length]
                    two = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=g.to_bytes(4, "little")).digest(), "little", signed=True)
                    out.append((row["h"], row["c"], j, two(core), two(part), end - j, row["m"], part))
                    j = end
                if len(out) >= 4096:
                    yield _rows(out, PART)
                    out = []
            if out:
                yield _rows(out, PART)

    return run


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), named)], names=[c for c, _ in named])


def crowds(contexts: DataFrame, most: int, label: str) -> DataFrame:
    """contexts with crowd: whether their anchor has more than `most`."""
    counts = stage(contexts.groupBy("h").agg(F.count("*").alias("times")).withColumn("crowd", F.col("times") > most), "counts")
    return stage(join_heavy(contexts, counts, ["h"], "times", counts.agg(F.sum("times")).first()[0] or 0), label)


def sorted_repeats(contexts: DataFrame, length: int, most: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(h, c, spans: array of (lo, hi)) of the starts that are repeats; contexts (staged): h, c, n, m, bytes, crowd."""
    few = contexts.where("NOT crowd")
    total = few.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    packs = max(1, total // PACK)
    # a pack takes long for its bytes, so packs are dealt over many tasks by number and not joined into fewer
    tasks = min(packs, 16 * int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = few.drop("crowd").withColumn("pack", F.pmod(F.xxhash64("h"), F.lit(packs)).cast("int")).repartition(int(tasks), "pack")
    found = dealt.groupBy("pack").applyInArrow(_sort_pack(length), "h long, c long, lo int, hi int")
    found = stage(found.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "found")
    if not widths or not contexts.where("crowd").limit(1).count():
        return found
    parts = stage(map_texts(contexts.where("crowd").drop("crowd"), _split(length, widths[0]), PART), "parts")
    merged = parts.groupBy("h", "c").agg(F.first("n").alias("n"), F.sum("m").alias("m"), F.first("bytes").alias("bytes"))
    merged = crowds(stage(merged, "merged"), most if len(widths) > 1 else 1 << 62, "contexts")
    # a context that occurs several times is a repeat of itself, so those that stand alone are sorted with the others all the same
    deeper = sorted_repeats(merged, length, most, widths[1:])
    deeper = stage(parts.groupBy("h", "c").agg(F.count("*").alias("times")).join(deeper, ["h", "c"]), "found")
    back = join_heavy(parts.select("h0", "c0", "shift", "h", "c"), deeper, ["h", "c"], "times", deeper.agg(F.sum("times")).first()[0] or 0)
    moved = back.select(F.col("h0").alias("h"), F.col("c0").alias("c"), F.transform("spans", lambda x: F.struct((x["lo"] + F.col("shift")).alias("lo"), (x["hi"] + F.col("shift")).alias("hi"))).alias("spans"))
    return found.unionByName(moved.groupBy("h", "c").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept, at, removed, count = [], 0, 0, 0
                for x, y in sorted((s["x"], s["y"] - 1 + length) for s in spans):
                    if x > at or not count:
                        kept.append(text[at:x])
                        count += 1
                        removed += y - x
                        at = y
                    elif y > at:
                        removed += y - at
                        at = y
                kept.append(text[at:])
                out.append((removed, count, hashlib.sha256(b"".join(kept)).hexdigest(), b"".join(kept)))
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary())], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeats(docs: DataFrame, length: int = 400, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(base: doc_id, t1, t2, n_bytes, sha256 of every row; cut: t1, t2, n_removed, n_spans, kept_sha256, kept of every text that loses bytes)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    base = named.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    occ = map_texts(named.where(F.octet_length("text") >= length).select("t1", "t2", F.col("text").cast("binary").alias("text")), _runs(length), RUN)
    occ = stage(occ, "runs")
    known = occ.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("times > 1").select("h", (F.col("c1") == F.col("c2")).alias("lone"), "times")
    known = stage(known, "anchors")
    total = known.agg(F.sum("times")).first()[0] or 0
    dup = stage(join_heavy(kept_by_bits(occ, "h", known), known, ["h"], "times", total), "repeated")
    # one text stands for a context
    reps = dup.where("NOT lone").groupBy("h", "c").agg(F.count("*").alias("m"), F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.first("s").alias("s"), F.first("n").alias("n"))
    reps = crowds(stage(reps, "contexts"), most, "contexts")
    slim = dup.groupBy("t1", "t2", "s").agg(F.first("h").alias("h"), F.first("c").alias("c"), F.first("n").alias("n"), F.first("lone").alias("lone"))
    slim = stage(slim, "places")
    one = base.groupBy("t1", "t2").agg(F.min("doc_id").alias("low"), F.sum(F.when(F.col("doc_id").isNull(), 1).otherwise(0)).alias("nulls"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"))
    one = one.join(slim.select("t1", "t2").distinct(), ["t1", "t2"])
    # of all copies of a text only the one with the smallest id moves
    place = lambda d: F.xxhash64("t1", "t2", d).alias("place")
    one = stage(one.withColumn("place", place("low")), "kept")
    whole = kept_by_bits(named.where(F.octet_length("text") >= length).withColumn("place", place("doc_id")), "place", one.select("place"))
    texts = whole.join(one.withColumnsRenamed({"t1": "u1", "t2": "u2"}).drop("place"), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("low")))
    texts = stage(texts.select("t1", "t2", F.col("text").cast("binary").alias("text"), (F.col("ids") + F.col("nulls") < F.col("rows")).alias("again")), "texts")
    if texts.where("again").limit(1).count():  # rows that are equal in doc_id and text
        texts = texts.dropDuplicates(["t1", "t2"])
    wanted = reps.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "c", "s", "n", "m", "crowd")).alias("wanted"))
    contexts = stage(map_texts(texts.join(wanted, ["t1", "t2"]).select("text", "wanted"), _contexts(length), "h long, c long, n int, m long, crowd boolean, bytes binary"), "bytes")
    found = stage(reps.select("h", "c", F.col("m").alias("times")).join(sorted_repeats(contexts, length, most), ["h", "c"]), "found")
    placed = join_heavy(slim.where("NOT lone"), found, ["h", "c"], "times", total).select("t1", "t2", "s", F.explode("spans").alias("x"))
    spans = slim.where("lone").selectExpr("t1", "t2", "s x", "s + n y").unionByName(placed.selectExpr("t1", "t2", "s + x.lo x", "s + x.hi y"))
    per_text = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("x", "y")).alias("spans"))
    cut = map_texts(texts.join(per_text, ["t1", "t2"]).select("t1", "t2", "text", "spans"), _cut(length), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return base, cut


def digest(docs: DataFrame, length: int = 400, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    base, cut = repeats(docs, length, most)
    on = ["t1", "t2"]
    cut = stage(cut.drop("kept"), "cut")
    times = base.where(F.col("n_bytes") >= length).groupBy(*on).agg(F.count("*").alias("times"))
    cut = stage(cut.join(times, on), "cut")
    out = join_left_heavy(base.where(F.col("n_bytes") >= length), cut, on, "times", cut.agg(F.sum("times")).first()[0] or 0)
    short = base.where(F.col("n_bytes") < length)  # meets nothing
    out = out.unionByName(short.select("*", *(F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("n_removed", "n_spans", "kept_sha256"))))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def deduplicated(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with text cut; bytes that no longer form a character become U+FFFD."""
    _, cut = repeats(docs, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit("second"), text)})
    cut = cut.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.make_valid_utf8(F.col("kept").cast("string")).alias("_kept"))
    out = keyed.join(cut, ["_t1", "_t2"], "left")
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce("_kept", "text"))).select(*docs.columns)
