"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word backs off to its n-grams of CHARS characters,
those unknown too to shorter ones, down to single characters. The language with the highest sum over all words of the text wins;
its share under a softmax of the summed log scores is the confidence.

Words: runs of letters, lower-cased. Learning takes at most about `most_docs` documents of each language (a hash threshold from the
counts of all rows picks them evenly), and keeps every word and n-gram of these, so the model that each task holds is bounded by this
parameter and by no other. Words and n-grams are known by 64-bit hashes. Texts are scored in slices of about SLICE characters, many at
once; a longer text is cut between words, so memory is bounded and no word is left out.

Null or empty text, or one without a letter: `und`, score 0. Very long texts: as any other. Ties go to the smaller language name. Repeated rows
each get a row; empty tables give none; nothing learned: `und`. Other columns pass; own columns named lang_pred and score are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Rolling, map_texts, mix, stage

#: Longest character n-gram of the backoff.
CHARS = 4
#: About how many documents of a language are learned from.
MOST_DOCS = 1000
#: Characters that are scored at once (for eight languages; fewer where there are more).
SLICE = 1 << 19
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(buf).spans(start, end)


def gram_hashes(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place on."""
    h = np.full(len(at), n, np.uint64)
    for i in range(n):
        h = mix(h + buf[at + i])
    return h


def _pieces(text, n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def learning_sample(docs: DataFrame, most_docs: int) -> DataFrame:
    """About most_docs rows of each language, or all where there are fewer: evenly, by a hash of the row."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n_lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("learn")), F.lit(1_000_000)) * F.col("n_lang") < F.lit(1_000_000 * most_docs)
    sizes = stage(sizes, "languages")
    # a few languages hold most rows: their sizes are broadcast where they are few enough, so no text is shuffled by its language
    return known.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(draw)


class Known:
    """Sorted hashes, each with a row of log frequencies by language."""

    def __init__(self, keys: np.ndarray, table: np.ndarray):
        self.keys, self.table = keys, table

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is known) of each hash."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


class Model:
    """Log frequencies over the languages, of words and of n-grams."""

    def __init__(self, langs: list[str], words: Known, grams: Known):
        self.langs, self.words, self.grams = langs, words, grams

    def unseen(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word, the mean score of its n-grams of CHARS characters (one blank on either side counts): each by the mean of its longest
        known parts, at a fixed price a step of length. A shorter word is one n-gram."""
        size = end - start + 2
        offset = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(offset, size)
        last = np.repeat(size, size) - 1
        blank = (inside == 0) | (inside == last)
        text = np.where(blank, 32, buf[np.where(blank, 0, np.repeat(start - 1, size) + inside)]).astype(np.uint64)
        window = np.flatnonzero(inside <= np.maximum(last + 1 - CHARS, 0))
        score = np.full((len(window), len(self.langs)), math.log(1e-6) - CHARS)
        left = np.arange(len(window))
        for n in range(CHARS, 0, -1):
            total, count = np.zeros((len(left), len(self.langs))), np.zeros(len(left), np.int64)
            for i in range(CHARS - n + 1):
                at = window[left] + i
                ok = np.flatnonzero(at < len(text))
                ok = ok[inside[at[ok]] + n - 1 <= last[at[ok]]]
                # the window's own word only
                ok = ok[inside[at[ok]] == inside[window[left[ok]]] + i]
                if n == 1:
                    ok = ok[~blank[at[ok]]]
                row, known = self.grams.find(gram_hashes(text, at[ok], n))
                total[ok[known]] += self.grams.table[row[known]]
                count[ok[known]] += 1
            some = count > 0
            score[left[some]] = total[some] / count[some, None] - (CHARS - n)
            left = left[~some]
            if not len(left):
                break
        each = np.maximum(size - CHARS + 1, 1)
        return np.add.reduceat(score, np.cumsum(each) - each) / each[:, None]

    def totals(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log scores by language, number of words) of each piece of text."""
        total, count = np.zeros((len(pieces), len(self.langs))), np.zeros(len(pieces), np.int64)
        low = [p.lower() for p in pieces]
        buf = code_points("\n".join(low) + "\n")
        edge = np.flatnonzero(np.diff(letters()[buf].astype(np.int8), prepend=0))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return total, count
        of = np.searchsorted(np.cumsum([len(p) + 1 for p in low]), start, side="right")
        count += np.bincount(of, minlength=len(pieces))
        if self.langs:
            kinds, first, which = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
            row, known = self.words.find(kinds)
            score = np.zeros((len(kinds), len(self.langs)))
            score[known] = self.words.table[row[known]]
            if not known.all():
                score[~known] = self.unseen(buf, start[first[~known]], end[first[~known]])
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            total[of[begin]] = np.add.reduceat(score[which], begin)
        return total, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        most, pieces, of, size = max(4096, SLICE * 8 // max(8, len(self.langs))), [], [], 0

        def score():
            t, c = self.totals(pieces)
            np.add.at(total, of, t)
            np.add.at(count, of, c)

        for i, text in enumerate(texts):
            for piece in between_words(text, most) if text else ():
                pieces.append(piece)
                of.append(i)
                size += len(piece)
                if size >= most:
                    score()
                    pieces, of, size = [], [], 0
        if pieces:
            score()
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        best = total.argmax(1)
        share = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
        return [(self.langs[b], float(s)) if c else ("und", 0.0) for b, s, c in zip(best, share, count)]


def between_words(text: str, size: int):
    """Pieces of about size characters; none ends inside a word."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _hashed(batches):
    """Words (n = 0) and n-grams by their hashes."""
    for batch in batches:
        text, n = batch.column("g").to_pylist(), batch.column("n").to_numpy()
        buf = code_points("".join(text)).astype(np.uint64)
        size = np.fromiter(map(len, text), np.int64, len(text))
        start, h = np.cumsum(size) - size, np.zeros(len(text), np.uint64)
        for level in np.unique(n).tolist():
            at = np.flatnonzero(n == level)
            h[at] = gram_hashes(buf, start[at], level) if level else word_hashes(buf, start[at], start[at] + size[at])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(h.view(np.int64)), batch.column("k")], names=["lang", "n", "h", "k"])


def train(docs: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    """Count words and character n-grams in Spark; the driver gets the hashes and counts of the learning sample (docs: doc_id, lang, text)."""
    words = learning_sample(docs, most_docs).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("g"))
    counts = stage(words.groupBy("lang", "g").agg(F.count("*").alias("k")), "words")
    pieces = counts.select("lang", F.lit(0).alias("n"), "g", "k")
    for n in range(1, CHARS + 1):
        padded = F.concat(F.lit(" "), "g", F.lit(" ")) if n > 1 else F.col("g")
        pieces = pieces.unionByName(counts.select("lang", F.lit(n).alias("n"), F.explode(_pieces(padded, n)).alias("g"), "k").where(F.length("g") == n))
    got = pieces.groupBy("lang", "n", "g").agg(F.sum("k").alias("k")).mapInArrow(_hashed, "lang string, n int, h long, k long").toArrow()
    coded = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else None
    if coded is None:
        nothing = Known(np.zeros(0, np.uint64), np.zeros((0, 0)))
        return Model([], nothing, nothing)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    met = coded.dictionary.to_pylist()
    langs = sorted(met)
    lang = np.array([langs.index(x) for x in met])[coded.indices.to_numpy()]
    n, k, h = got.column("n").to_numpy(), got.column("k").to_numpy().astype(float), got.column("h").to_numpy().view(np.uint64)
    # additive smoothing by 0.1, over the kinds that a language has and one more
    norm = np.log(np.array([[k[at].sum() + 0.1 * at.sum() + 1 for at in ((lang == x) & (n == level) for x in range(len(langs)))] for level in range(CHARS + 1)]))

    def known(wanted: np.ndarray, h: np.ndarray) -> Known:
        keys, first, row = np.unique(h, return_index=True, return_inverse=True)
        table = math.log(0.1) - norm[n[wanted][first]]
        table[row, lang[wanted]] = np.log(k[wanted] + 0.1) - norm[n[wanted], lang[wanted]]
        return Known(keys, table)

    whole, parts = np.flatnonzero(n == 0), np.flatnonzero(n > 0)
    model = Model(langs, known(whole, h[whole]), known(parts, h[parts]))
    del got, coded
    pa.default_memory_pool().release_unused()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        known = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                got = known.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*others, "lang_pred", "score"])

    kept = docs.select(*others)
    return map_texts(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string", "score double"]))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
