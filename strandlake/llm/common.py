"""Shared pieces: reading tables, cutting lineage, and hashing of byte ranges with numpy."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Bytes of rows that go to a Python worker at once.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a new temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def map_texts(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) for rows that hold texts: batches of about BATCH bytes instead of 10,000 rows, so neither the executor nor its Python worker holds a
    task's texts at once, and a worker that waits for its next task holds no old batches. From here on the session has this batch size."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInArrow(run, schema)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage, and a lost executor costs no recomputation.

    The files go when the driver's Python ends; drop_stages() does it sooner, once no result needs them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many stages are kept, for drop_stages(since=...)."""
    return len(_WRITTEN)


def drop_stages(since: int = 0, but_last: int = 0) -> None:
    """Delete the files of the stages written after the first `since`, but for the last ones. Nothing that is still read may depend on them."""
    upto = max(since, len(_WRITTEN) - but_last)
    gone = _WRITTEN[since:upto]
    del _WRITTEN[since:upto]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already: the shared folder's own cleaning takes them
            return


atexit.register(drop_stages)

#: Base of the rolling hash modulo 2**64 (odd, so it has an inverse), and the multipliers of the mixer.
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(kind)
    if got is None or len(got) < n:
        m = max(n, 1 << 16) * 5 // 4
        step = np.full(m, base, np.uint64)
        step[0] = 1
        got = _POWERS[kind] = np.cumprod(step)
    return got[:n]


class Rolling:
    """Hashes of any byte ranges of one buffer, each in constant time (prefix sums of a polynomial)."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = buf.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers("pow", BASE, n)
        np.cumsum(terms, out=self.sums[1:])
        self.back = _powers("inv", pow(BASE, -1, 1 << 64), n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of each window of k bytes, by its start."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.back[:n])


class Words:
    """Words (runs of bytes other than ASCII white space) of several texts at once, lower-cased (A-Z), with hashes.

    start, end: byte offsets in buf; text: the number of each word's text; first: by text, the number of its first word."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        self.base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        gap = WHITE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(self.buf) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.hash = Rolling(self.buf).spans(self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)

    def shingles(self, n: int, a: int, b: int) -> np.ndarray:
        """Hashes of the n-word shingles of words a to b in order; of fewer words, one hash of them all; of none, nothing."""
        h = self.hash[a:b]
        if not len(h):
            return h
        n = min(n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out + h[i : len(h) - n + 1 + i])
        return out


def chunks(texts, size: int = 1 << 20):
    """(first row, list of the texts as bytes) of consecutive rows of about size bytes; null counts as empty."""
    part, first, total = [], 0, 0
    for i, t in enumerate(texts):
        t = t or b""
        part.append(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"))
        total += len(part[-1])
        if total >= size:
            yield first, part
            part, first, total = [], i + 1, 0
    if part:
        yield first, part
