"""Substring dedup: near-duplicate paragraphs by MinHash banding, verified by exact Jaccard, removed by components.

Units of a text are its paragraphs: lines of at least `least_words` words, and the runs of shorter lines (between blank or long lines) that
have as many; the whole text where it has neither; and passages, which run over line ends. A passage begins at an anchor, a word whose shingle
has the smallest hash in some window, and has `least_words` words. The windows are so wide that texts with PASSAGE words in common have
a whole passage in common, wherever it stands and whatever is around it.

Paragraphs meet by bands of their MinHash signature. Bands and rows are tuned: the fewest bands whose chance of a collision at
the wanted similarity is at least `recall`. Of two similar passages few shingles differ, and where these are fewer than SHINGLE an edit
stands at an end. As a passage's first shingle is its anchor, passages that begin alike have all but so many of their first shingles in common: this
run is their band; passages with an equal run are similar, and need no other check (one that repeats a shingle meets like a paragraph). Units
with equal shingles form one class, counted before the shuffle. Colliding paragraphs are compared by exact Jaccard of their five-word shingle sets (words as in ngram_join); connected components are
the clusters. Of each cluster the first unit by doc_id, then place, stays; all others go but those that overlap it (units of one text that differ by
a few words are no repeat).

Null text or text without words: no units. Fewer than SHINGLE words: one shingle of them all. Very long texts: whole. Null doc_id comes last. Equal
texts are repeats of each other; rows that are equal in doc_id and text share a result row. Ties go to the smaller place. Extra columns are ignored
whatever their names; empty tables give no rows. Classes and shingles are known by 64-bit hashes: of n units, n * n / 2**65 pairs are
taken for equal by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import Words, chunks, drop_stages, map_texts, mix, stage, staged
from strandlake.llm.components import connected_components, group_links, join_heavy, join_salted, kept_by_bits
from strandlake.llm.ngram_join import viable_for

SHINGLE, PASSAGE = 5, 50
CELLS = 256
CELL_COLUMNS = tuple(f"b{i}" for i in range(CELLS // 64))


def bands_for(similarity: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows) with the longest rows, at 8 bands at most, that find a pair at the similarity with the wanted chance."""
    for rows in range(most_rows, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands <= 8:
            return max(1, bands), rows
    return 1, 1


def anchors(h: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Which shingles have the smallest hash of some window of `width` shingles of one text (text: by shingle its number, -1 outside)."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(len(h), bool)

    def slide(f, x, size):
        have = 1
        while have < size:
            by = min(have, size - have)
            x = f(x[: len(x) - by], x[by:])
            have += by
        return x

    whole = (text[:n] == text[width - 1 :]) & (slide(np.minimum, text, width) >= 0)
    low = np.where(whole, slide(np.minimum, h, width), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return (h == slide(np.maximum, np.concatenate([edge, low, edge]), width)) & (h > 0)


def all_shingles(w: Words):
    """By word the number of its text; by word but the last few the hash of the shingle that it begins, and whether this ends in the same text."""
    text = np.searchsorted(w.base, w.start, side="right") - 1
    shingle = np.full(max(len(text) - SHINGLE + 1, 0), SHINGLE, np.uint64)
    for i in range(SHINGLE):
        shingle = mix(shingle + w.hash[i : i + len(shingle)])
    return text, shingle, text[: len(shingle)] == text[len(text) - len(shingle) :]


def units(w: Words, least_words: int):
    """(first word, end word, is a passage) of the units, and by word the hash of its shingle (0: none)."""
    n = len(w.start)
    text, shingle, inside = all_shingles(w)
    after = w.first[text + 1]  # by word, the end of its text
    shingle = np.where(inside, shingle, 0)
    line = np.searchsorted(np.flatnonzero(w.buf == 10), w.start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    end = np.append(first[1:], n)
    long = end - first >= least_words
    # paragraphs: a line goes on with the one before where both are short, no blank line is between and the text is the same
    goes_on = np.zeros(len(first), bool)
    goes_on[1:] = ~long[1:] & ~long[:-1] & (np.diff(line[first]) == 1) & (np.diff(text[first]) == 0)
    block = np.flatnonzero(~goes_on)
    begin, stop = first[block], np.append(first[block[1:]], n)
    keep = stop - begin >= least_words
    begin, stop = begin[keep], stop[keep]
    bare = np.setdiff1d(text, text[begin])
    # passages
    order, of = mix(shingle ^ np.uint64(0x9FB21C651E98DF25)), np.where(inside, text[: len(shingle)], -1)
    width = max(1, PASSAGE - least_words - SHINGLE + 2)
    short = np.flatnonzero(anchors(order, of, width))
    short = short[short + least_words <= after[short]]
    a = np.concatenate([begin, w.first[bare], short])
    e = np.concatenate([stop, w.first[bare + 1], short + least_words])
    is_short = np.arange(len(a)) >= len(a) - len(short)
    _, at = np.unique(a.astype(np.int64) * (n + 1) + e, return_index=True)
    return a[at], e[at], is_short[at], shingle


def _classes(w: Words, a: np.ndarray, e: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """The hash of each unit's shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(shingle != 0, mix(shingle), 0), dtype=np.uint64)])
    last = len(sums) - 1
    pid = mix(sums[np.clip(e - SHINGLE + 1, 0, last)] - sums[np.clip(a, 0, last)] + (e - a).astype(np.uint64))
    for i in np.flatnonzero(e - a < SHINGLE):
        pid[i] = mix(w.shingles(SHINGLE, a[i], e[i]) + np.uint64(e[i] - a[i]))[0]
    return pid


def apart_for(least_words: int, similarity: float) -> int:
    """How many shingles a similar short passage may lack, where an edit that costs so few must stand at an end; -1 where it need not."""
    m = least_words - SHINGLE + 1
    k = int(m * (1 - similarity) / (1 + similarity) + 1e-9)
    return k if k < SHINGLE and (m - 2 * k) * (1 - similarity) >= 2 * k * similarity - 1e-9 else -1


UNIT = "doc_id long, t long, x int, y int, n int, pid long, run boolean, keys array<long>"


def _units(least_words: int, similarity: float, bands: int, rows: int):
    """Units with their class pid and their keys: the bands that the class falls in, or for passages (run) the first shingles, all but so many as
    a similar one may lack. Keys depend on the class and run alone, so of equal classes near each other only the first has keys."""
    by = np.random.default_rng(7).integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    apart = apart_for(least_words, similarity)

    def keys_of(w, a, e, is_short, shingle, pid):
        inner = is_short & (apart >= 0)
        if inner.any():  # a passage that repeats a shingle is banded like the other units
            order = np.argsort(shingle, kind="stable")
            before = np.full(len(shingle) + 1, -1)
            before[order[1:]] = np.where(shingle[order[1:]] == shingle[order[:-1]], order[:-1], -1)
            at = np.flatnonzero(inner)
            inner[at] = np.maximum.reduceat(before, np.stack([a[at], e[at] - SHINGLE + 1], 1).ravel())[0::2] < a[at]
        new = np.zeros(len(a), bool)
        for group in (np.flatnonzero(inner), np.flatnonzero(~inner & (e - a >= SHINGLE))):
            new[group[np.unique(pid[group], return_index=True)[1]]] = True
        runs, banded = np.flatnonzero(new & inner), np.flatnonzero(new & ~inner)
        many = np.zeros(len(a), np.int64)
        many[runs], many[banded] = 1, bands
        offsets = np.concatenate([[0], np.cumsum(many)])
        keys = np.zeros(offsets[-1], np.uint64)
        if len(runs):
            keys[offsets[runs]] = mix(_classes(w, a[runs], e[runs] - apart, shingle) + np.uint64(bands))
        if len(banded):
            edges = np.stack([a[banded], e[banded] - SHINGLE + 1], 1).ravel()
            padded = np.append(shingle, np.uint64(0))
            for b in range(bands):
                h = np.full(len(banded), b, np.uint64)
                for r in range(rows):
                    h = mix(h + np.minimum.reduceat(padded * by[b * rows + r], edges)[0::2])
                keys[offsets[banded] + b] = h
        return inner, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))

    def run(batches):
        for batch in batches:
            for f, part in chunks(batch.column("text").to_pylist()):
                w = Words(part)
                if not len(w.start):
                    continue
                a, e, is_short, shingle = units(w, least_words)
                pid = _classes(w, a, e, shingle)
                is_run, keys = keys_of(w, a, e, is_short, shingle, pid)
                text = np.searchsorted(w.base, w.start[a], side="right") - 1
                take = pa.array(text + f)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(take), batch.column("t").take(take), pa.array((w.start[a] - w.base[text]).astype(np.int32)), pa.array((w.end[e - 1] - w.base[text]).astype(np.int32)),
                    pa.array((e - a).astype(np.int32)), pa.array(pid.view(np.int64)), pa.array(is_run), keys,
                ], names=["doc_id", "t", "x", "y", "n", "pid", "run", "keys"])

    return run


def sets_of(texts: list[bytes]):
    """Of texts of SHINGLE words or more: by text its number of different shingles, these in order, one text after the other, and by text
    which of CELLS cells they fall in, as bits of CELLS / 64 longs."""
    w = Words(texts)
    text, shingle, inside = all_shingles(w)
    text, shingle = text[: len(shingle)][inside], shingle[inside]
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    bits = np.zeros((len(texts), CELLS), np.uint8)
    bits[text, shingle >> np.uint64(64 - CELLS.bit_length() + 1)] = 1
    return np.bincount(text, minlength=len(texts)), shingle, np.packbits(bits, axis=1).view(np.int64)


def _sets(batches):
    seen = set()  # rows that are equal in doc_id and text give their units once
    for batch in batches:
        pids, pieces = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            if wanted[0]["pid"] not in seen:
                seen.add(wanted[0]["pid"])
                pids += [u["pid"] for u in wanted]
                pieces += [text[u["x"] : u["y"]] for u in wanted]
        for first, part in chunks(pieces):
            size, shingle, cells = sets_of(part)
            offsets = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(shingle.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(pids[first : first + len(part)], pa.int64()), packed, *(pa.array(c) for c in cells.T.copy())], names=["key", "shingles", *CELL_COLUMNS])


def _shingles(batches):
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("shingles")]
        keys = np.repeat(batch.column("key").to_numpy(), [len(s) for s in sets])
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(sets))], names=["key", "s"])


def _verify(similarity: float):
    def flat(column: pa.Array):
        size = np.array([len(s) for s in column.to_pylist()], np.int64) // 8
        return size, np.frombuffer(b"".join(column.to_pylist()), np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                (na, a), (nb, b) = flat(part.column("sa")), flat(part.column("sb"))
                pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                # a set holds a shingle once, so what stands twice in a pair is common
                each, rank = np.unique(np.concatenate([a, b]), return_inverse=True)
                key = np.sort(pair * len(each) + rank)
                common = np.bincount(key[1:][key[1:] == key[:-1]] // max(1, len(each)), minlength=len(na))
                keep = np.flatnonzero((common > 0) & (common >= similarity * (na + nb - common) - 1e-9))
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def alike(percent: int):
    """viable_for, and a bound by cells: each cell that one set has and the other lacks holds a shingle that they don't share."""
    by_place = viable_for(percent)

    def viable(o1: str, o2: str):
        n1, n2 = f"({o1}.o & 4294967295L)", f"({o2}.o & 4294967295L)"
        need = f"(({percent} * ({n1} + {n2}) + {99 + percent}) div {100 + percent})"
        alone = lambda a, b: " + ".join(f"bit_count({a}.{c} & ~{b}.{c})" for c in CELL_COLUMNS)
        return by_place(f"{o1}.o", f"{o2}.o") & F.expr(f"{n1} - ({alone(o1, o2)}) >= {need} AND {n2} - ({alone(o2, o1)}) >= {need}")

    return viable


def repeated_paragraphs(docs: DataFrame, similarity: float = 0.8, least_words: int = 25, recall: float = 0.98) -> DataFrame:
    """One row for each unit of a cluster: doc_id, t (hash of the text), x, y (bytes), n (words), cluster, first_doc_id, removed."""
    bands, rows = bands_for(similarity, recall)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("t", F.xxhash64("text"))
    as_bytes = named.select("doc_id", "t", F.col("text").cast("binary").alias("text"))
    begun = staged()
    found = stage(map_texts(as_bytes, _units(least_words, similarity, bands, rows), UNIT), "units")
    units_kept = staged()
    classes = found.groupBy("pid").agg(F.count("*").alias("times"))
    keys = found.select(F.explode("keys").alias("s"), "pid", "run")
    shared = keys.groupBy("s").agg(F.min("pid").alias("low"), F.max("pid").alias("high"), F.count("*").alias("rows")).where("low <> high").drop("high")
    shared = stage(shared, "shared")
    colliding = stage(kept_by_bits(keys, "s", shared).distinct(), "keys")
    colliding = stage(join_heavy(colliding, shared, ["s"], "rows", shared.agg(F.sum("rows")).first()[0] or 0), "colliding")
    drop_stages(units_kept, but_last=1)
    # passages with a run in common are similar: each is linked with the first that has the run
    ends = colliding.where("run AND low <> pid").select(F.col("low").alias("a"), F.col("pid").alias("b")).distinct()
    links_kept = staged()
    wanted = stage(colliding.where("NOT run").select("pid").distinct(), "wanted")
    reps = kept_by_bits(found, "pid", wanted).groupBy("pid").agg(*(F.first(c).alias(c) for c in ("doc_id", "t", "x", "y"))).join(wanted, "pid", "left_semi")
    lists = reps.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("t_")).agg(F.collect_list(F.struct("pid", "x", "y")).alias("wanted"))
    lists = stage(lists.withColumnRenamed("t_", "t"), "lists").withColumnRenamed("t", "t_")
    near = kept_by_bits(as_bytes, "t", lists.select(F.col("t_").alias("t")))
    texts = near.join(lists, (near["t"] == lists["t_"]) & near["doc_id"].eqNullSafe(lists["d"])).select("text", "wanted")
    sets = stage(map_texts(texts, _sets, "key long, shingles binary, " + ", ".join(f"{c} long" for c in CELL_COLUMNS)).groupBy("key").agg(*(F.first(c).alias(c) for c in ("shingles", *CELL_COLUMNS))), "sets")
    drop_stages(links_kept, but_last=1)

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}"))
        both = join_salted(join_salted(pairs, of("a"), ["a"], ["b"]), of("b"), ["b"], ["a"])
        return map_texts(both, _verify(similarity), "a long, b long")

    # Colliding classes meet by the rarest shingles of their sets (as many as a similar pair must share one of), so a band with many
    # unlike classes doesn't give all their pairs; pairs whose cells differ too much are left out before they are made.
    sets_kept = staged()
    each = stage(map_texts(sets, _shingles, "key long, s long"), "shingles")
    often = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    size = F.count("*").over(W.partitionBy("key"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.coalesce("f", F.lit(1)), "s")) - 1
    placed = each.join(often, "s", "left").withColumns({"n": size, "pos": place})
    percent = round(100 * similarity)
    first = placed.where(F.col("pos") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100"))
    packed = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n")).alias("o")
    entries = first.where("f IS NOT NULL").join(sets.select("key", *CELL_COLUMNS), "key").select("s", "key", F.struct(packed, *CELL_COLUMNS).alias("o"))
    entries = stage(entries, "entries")
    drop_stages(sets_kept, but_last=1)
    links = group_links(entries, alike(percent), verified)
    comp = connected_components(links.unionByName(ends)).select(F.col("node").alias("pid"), "component")
    cluster = classes.join(comp, "pid", "left").where("times > 1 OR component IS NOT NULL").select("pid", F.coalesce("component", "pid").alias("cluster"), "times")
    cluster = stage(cluster, "cluster")
    drop_stages(units_kept, but_last=1)
    total = cluster.agg(F.sum("times")).first()[0] or 0
    members = stage(join_heavy(kept_by_bits(found.drop("run", "keys"), "pid", cluster), cluster, ["pid"], "times", total), "members")
    drop_stages(begun, but_last=1)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "t", "x", F.col("y"))
    first = members.groupBy("cluster").agg(F.min(place).alias("kept"), F.max(place).alias("last"), F.count("*").alias("rows"))
    # a cluster whose units all overlap the first one, in one row, is no repeat; rows that are equal in doc_id and text are more than one
    again = stage(named.groupBy("doc_id", "t").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("d"), F.col("t").alias("t_")), "again")
    twice = kept_by_bits(members, "t", again.select(F.col("t_").alias("t"))).join(again, members["doc_id"].eqNullSafe(again["d"]) & (members["t"] == again["t_"]), "left_semi").select("cluster").distinct()
    beside = lambda p: (p["d"] == F.col("kept.d")) & (p["t"] == F.col("kept.t")) & (p["x"] < F.col("kept.y"))
    first = first.join(twice.withColumn("twice", F.lit(True)), "cluster", "left").where(F.col("twice").isNotNull() | ~beside(F.col("last"))).select("cluster", "kept", "rows")
    out = join_heavy(members, stage(first, "first"), ["cluster"], "rows", total).withColumn("removed", ~beside(place))
    return out.select("doc_id", "t", "x", "y", "n", "cluster", F.when(F.col("kept.d") < 2**63 - 1, F.col("kept.d")).alias("first_doc_id"), "removed")


def documents_with_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per document that has a repeated paragraph: doc_id, n_repeated, n_removed, n_removed_bytes, spans (byte ranges that
    go, joined), first_doc_ids (where the units of its clusters stay)."""
    found = repeated_paragraphs(docs, **options)
    per = found.groupBy("doc_id", "t").agg(
        F.count("*").alias("n_repeated"),
        F.count_if("removed").alias("n_removed"),
        F.sort_array(F.collect_list(F.when(F.col("removed"), F.struct("x", "y")))).alias("gone"),
        F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )
    begun = F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.array().cast("array<struct<x:int,y:int>>").alias("done"))

    def step(a, s):
        apart = s["x"] > a["y"]
        done = F.when(apart & (a["y"] >= 0), F.concat(a["done"], F.array(F.struct(a["x"].alias("x"), a["y"].alias("y"))))).otherwise(a["done"])
        return F.struct(F.when(apart, s["x"]).otherwise(a["x"]).alias("x"), F.greatest(a["y"], s["y"]).alias("y"), done.alias("done"))

    merged = F.aggregate("gone", begun, step, lambda a: F.when(a["y"] >= 0, F.concat(a["done"], F.array(F.struct(a["x"].alias("x"), a["y"].alias("y"))))).otherwise(a["done"]))
    out = per.withColumn("merged", merged)
    bytes_ = F.aggregate("merged", F.lit(0).cast("long"), lambda a, s: a + (s["y"] - s["x"]))
    spans = F.array_join(F.transform("merged", lambda s: F.concat_ws(":", s["x"], s["y"])), ",")
    return out.select("doc_id", "n_repeated", "n_removed", bytes_.alias("n_removed_bytes"), spans.alias("spans"), "first_doc_ids")
