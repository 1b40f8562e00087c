"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import codecs
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, chat_format, language_id, mixing, ngram_join, paragraph_dedup, pii, suffix_dedup
from strandlake.llm.common import BATCH, map_texts
from strandlake.llm.components import connected_components, join_heavy, kept_by_bits
from strandlake.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    """Rows of the texts, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "key": F.lit("x"), "size": F.lit(0), "h": F.lit(2.0), **more})


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


# --- components


def test_components_and_bitmap(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.range(5000).selectExpr("id", "if(id < 3000, 1, id) k")
    right = rows.groupBy("k").agg(F.count("*").alias("times"), F.max("id").alias("top"))
    assert sorted(map(tuple, join_heavy(rows, right, ["k"], "times", 5000).collect())) == sorted(map(tuple, rows.join(right.drop("times"), "k").collect()))
    table = spark.range(1000).select(F.xxhash64("id").alias("t"), "id")
    assert {r.id for r in kept_by_bits(table, "t", table.where("id < 50")).collect()} >= set(range(50))


# --- n-gram join


def brute_join(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else (frozenset([tuple(w)]) if w else frozenset())
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(n)
    texts = [None, "", "  \t", "one", "ONE", "one two", "one  two", "éa B c d e f", "Éa b c d e f"]
    for size in (8, 40, 300):
        seed = words(rng, size).split()
        for k in range(9):
            w = seed[:]
            for _ in range(k % 5):
                w[rng.randrange(size)] = "zz" + str(rng.randrange(99))
            texts.append(" ".join(w))
        texts += [" ".join(seed)] * 3
    texts += [words(rng, 60) for _ in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs(spark, texts), n, percent).collect()}
    assert got == brute_join(list(enumerate(texts)), n, percent)


def test_ngram_join_where_sets_share_a_key(spark, monkeypatch):
    """Different sets whose first hash is equal are told apart by the second; one very long text stands among them."""
    monkeypatch.setattr(ngram_join, "_key", lambda s, real=ngram_join._key: (real(s)[0] % 5, real(s)[1]))
    rng = random.Random(2)
    texts = [words(rng, 40) for _ in range(12)] + [words(rng, 60_000)]
    texts += [t + " tail" for t in texts[:4]] + [texts[12] + " tail"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs(spark, texts)).collect()}
    assert got == brute_join(list(enumerate(texts)), 3, 90)


def test_ngram_join_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.ngram_jaccard_join(docs(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_shingles, r.component_id or -1) for r in ngram_join.ngram_jaccard_join(rows).collect())
    assert got == [(False, 2, 5), (False, 2, 5), (True, 0, -1), (True, 2, 5)]


# --- suffix arrays


@pytest.mark.parametrize("length", [4, 9, 40])
def test_two_stage_sort(length):
    rng = random.Random(length)
    for trial in range(25):
        letters = b"ab" if trial % 2 else b"abcdefg"
        contexts = [bytes(rng.choice(letters) for _ in range(rng.randrange(length, 90))) for _ in range(rng.randrange(1, 7))]
        contexts.append(contexts[0][:-1] + b"\xff")
        s = suffix_dedup.Suffixes(contexts, length)
        order = s.order()
        text = s.t[: s.n].tolist()
        assert sorted(order.tolist()) == list(range(s.n))
        assert all(text[a : a + length] <= text[b : b + length] for a, b in zip(order[:-1], order[1:]))


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(spark, most):
    rng = random.Random(9)
    passage, copy = words(rng, 30), words(rng, 80)
    texts = [None, "", "short", copy, copy, copy + "!", words(rng, 20) + passage + words(rng, 5), passage + words(rng, 9), "é" * 90, "ab" * 150, passage[:49], words(rng, 4000)]
    texts += [words(rng, 3) + passage + words(rng, 3) for _ in range(6)]
    got = [tuple(r) for r in suffix_dedup.digest(docs(spark, texts), 50, most).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == brute_cut(texts, 50)
    twice = spark.createDataFrame([(1, copy), (1, copy), (None, copy)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.digest(twice, 50).collect()] == [len(copy)] * 3
    assert suffix_dedup.digest(docs(spark, []).limit(0), 50).count() == 0


@pytest.mark.parametrize("most", [20_000, 2])
def test_suffix_dedup_of_a_passage_that_many_texts_share(spark, most):
    """One anchor with many contexts: with most = 2 it is split again and again, and gives the same."""
    rng = random.Random(10)
    passage = words(rng, 15)[:48]
    texts = [words(rng, 12) + " " + passage + " " + words(rng, 12) for _ in range(14)]
    texts += [t[20:] + words(rng, 3) for t in texts[:5]] + ["ab" * 60, passage + "zz", "q" + passage + "zz"]
    got = [tuple(r) for r in suffix_dedup.digest(docs(spark, texts), 50, most).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == brute_cut(texts, 50)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_suffix_dedup_of_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    got = [tuple(r) for r in suffix_dedup.digest(df, 400).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == brute_cut(texts, 400)


def test_deduplicated_texts(spark):
    rng = random.Random(2)
    p = words(rng, 40)
    got = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs(spark, ["head " + p, p + " tail", None, "x"]), 60).collect()}
    assert got[2] is None and got[3] == "x" and p[10:60] not in got[0] + got[1] and got[0].startswith("head") and got[1].endswith("tail")


# --- paragraphs


def test_paragraph_dedup(spark):
    rng = random.Random(4)
    sentence = lambda k: (words(rng, k).capitalize() + ".")
    passage = " ".join(sentence(9) for _ in range(7))
    para = words(rng, 60).split()
    near = para[:]
    near[30] = "changed"
    texts = [f"{sentence(8)} {passage} {sentence(12)}", f"{passage}\n{sentence(30)}", sentence(40), " ".join(para) + "\n" + sentence(30), sentence(26) + "\n" + " ".join(near), None, "", "short line\nshort line", words(rng, 3000)]
    got = {r.doc_id: r for r in paragraph_dedup.documents_with_repeats(docs(spark, texts)).collect()}
    assert set(got) == {0, 1, 3, 4}
    assert got[0].n_removed == 0 and got[1].n_removed >= 1 and 0 in got[1].first_doc_ids
    assert got[3].n_removed == 0 and got[4].n_removed == 1 and got[4].first_doc_ids == [3]
    start, end = map(int, got[4].spans.split(":"))
    assert texts[4].encode()[start:end].decode() == " ".join(near)
    assert paragraph_dedup.documents_with_repeats(docs(spark, []).limit(0)).count() == 0


def test_paragraph_dedup_whatever_the_line_breaks(spark):
    rng = random.Random(21)
    wrapped = lambda t, k: "\n".join(" ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    verse, short, inner, edited = (wrapped(words(rng, 60), 6), words(rng, 12), words(rng, 50).split(), words(rng, 120).split())
    texts = [verse, verse, short, short, "ab cd", "ab cd"]  # all lines under 25 words: exact copies
    texts += [wrapped(words(rng, 31) + " " + " ".join(inner) + " " + words(rng, 33), k) for k in (7, 11)]  # one passage across other line breaks
    texts += [words(rng, 40) + " " + " ".join(inner) + " " + words(rng, 40)]  # and inside a line, without stops
    for k in (0, 1):
        w = edited[:]
        w[60] = f"zz{k}"
        texts.append(words(rng, 90) + " " + " ".join(w) + " " + words(rng, 90))
    texts += [words(rng, 300), wrapped(words(rng, 200), 9), words(rng, 4) + "\n" + words(rng, 60), words(rng, 54)]  # nothing repeats in these
    got = {r.doc_id: r for r in paragraph_dedup.documents_with_repeats(docs(spark, texts)).collect()}
    assert sorted(got) == list(range(11))
    assert [got[i].n_removed > 0 for i in range(11)] == [False, True, False, True, False, True, False, True, True, False, True]
    assert [got[i].n_removed_bytes for i in (1, 3, 5)] == [len(verse), len(short), 5]
    for i in (7, 8):
        x = texts[i].replace("\n", " ").index(" ".join(inner))
        for span in got[i].spans.split(","):
            a, b = map(int, span.split(":"))
            assert x <= a < b <= x + len(" ".join(inner))


def test_planted_passages_are_found_wherever_they_stand(spark):
    """Passages of 50 to 90 words at random places of two or more texts, and clean texts. Brute force: all texts with 50 words in a row that
    stand in another text are found, and none without 25."""
    rng = random.Random(22)
    texts = [words(rng, rng.randrange(20, 400)).split() for _ in range(160)]
    for k in range(50):
        passage = words(rng, rng.randrange(50, 91)).split()
        for i in rng.sample(range(120), 2):
            at = rng.randrange(len(texts[i]) + 1)
            texts[i][at:at] = passage
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    whole = [wrapped(w, rng.choice([8, 20, 1000])) for w in texts]
    def sharing(n):
        where = {}
        for i, t in enumerate(whole):
            w = t.split()
            for j in range(len(w) - n + 1):
                where.setdefault(tuple(w[j : j + n]), set()).add(i)
        return {i for s in where.values() if len(s) > 1 for i in s}

    got = {r.doc_id for r in paragraph_dedup.documents_with_repeats(docs(spark, whole)).collect()}
    assert len(sharing(50)) > 50 and sharing(50) <= got <= sharing(25)


def test_tuned_bands():
    for s, recall in ((0.8, 0.98), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = paragraph_dedup.bands_for(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall


# --- language ID


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "and", "ing", "wh", "sh"], "de": ["sch", "der", "und", "ung", "keit"], "fr": ["eau", "oi", "que", "é", "le"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40)))
    rows = [(i, make(lang), lang) for i in range(150) for lang in [rng.choice(list(parts))]] + [(900, None, "en"), (901, "12 !? _", "en"), (902, "", None), (903, "theand", None), (904, "²½ ٣", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "held_out": language_id.held_out()})
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df.where("NOT held_out"))).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:150])
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902, 904)] == [("und", 0.0)] * 4 and got[903].lang_pred == "en"
    nothing = language_id.identify(df, language_id.train(df.limit(0)))
    assert language_id.identify(df.limit(0), language_id.train(df)).count() == 0
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_backoff_equals_plain_counting(spark):
    """Every total against a plain version with dictionaries of strings; no word or n-gram of the sample is left out."""
    rng = random.Random(16)
    rows = [(i, words(rng, 40) + (" \u00e9t\u00e9 na\u00efve" if i % 2 else " \u6f22\u5b57"), "xx" if i % 2 else "yy") for i in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {}
    for _, t, lang in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for n, g in [(0, w), *((1, c) for c in w), *((n, f" {w} "[i : i + n]) for n in (2, 3, 4) for i in range(len(w) + 3 - n))]:
                counts.setdefault((n, lang), {}).setdefault(g, 0)
                counts[n, lang][g] += 1
    norm = {key: np.log(sum(c.values()) + 0.1 * len(c) + 1) for key, c in counts.items()}
    seen = lambda n, g: any(g in counts[n, lang] for lang in ("xx", "yy"))
    row = lambda n, g: np.array([np.log(counts[n, lang].get(g, 0) + 0.1) - norm[n, lang] for lang in ("xx", "yy")])

    def plain(word):
        if seen(0, word):
            return row(0, word)
        padded, total = f" {word} ", 0
        parts = [padded[i : i + 4] for i in range(len(padded) - 3)] or [padded]
        for g in parts:
            for n in range(min(4, len(g)), 0, -1):
                at = [row(n, g[i : i + n]) for i in range(len(g) - n + 1) if seen(n, g[i : i + n])]
                if at:
                    total = total + sum(at) / len(at) - (4 - n)
                    break
            else:
                total = total + np.log(1e-6) - 4
        return total / len(parts)

    texts = [words(rng, 30), "a", "zq", "\u00e9t\u00e9x a\u6f22b \u03a3", rows[3][1], "qqqqqqqqqq", "a1b2c3", "b\u00e9"]
    got, n = model.totals(texts)
    for t, total, k in zip(texts, got, n):
        found = re.findall(r"[^\W\d_]+", t.lower())
        assert k == len(found) and np.allclose(total, sum(map(plain, found)))
    long = " ".join(texts * 300)
    assert model.predict([long, None])[0][0] == model.langs[int(np.argmax(sum(got)))]
    cut = list(language_id.between_words(long, 100))
    assert "".join(cut) == long and np.allclose(model.totals(cut)[0].sum(0), model.totals([long])[0][0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_language_id_on_rows_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held_out", language_id.held_out())
    got = language_id.identify(df, language_id.train(df.where("NOT held_out"))).where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").selectExpr("count(*) n", "count_if(lang = lang_pred) k").first()
    assert got.n > 20 and got.k >= 0.97 * got.n


# --- BPE

HARD = ["a", "B", "é", "É", "e\u0301", "İ", "Σ", "ß", "½", "²", "٣", " ", "\t", "\x1c", "\x85", "\u200b", "\u00a0", "'s", "'LL", "<|endoftext|>", "!", "@#", "\U0001f600", "漢", "7", "_", "ﬁ", "\n", "ẞ", "\x00"]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(vocabulary())
    rng = random.Random(8)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randrange(40))) for _ in range(400)] + ["", " ", "a" * 9000, "".join(rng.choice("abcdethin") for _ in range(6000)), words(rng, 500)]
    rows = bpe.encode_documents(docs(spark, [*texts, None]), vocabulary()).orderBy("doc_id").collect()
    digests = {r.doc_id: r for r in bpe.digest_documents(docs(spark, texts), vocabulary()).collect()}
    for r, t in zip(rows, texts):
        want = whole.encode(t, add_special_tokens=False)
        ids = list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
        assert ids == want.ids and r.n_tokens == len(ids) and r.decoded == whole.decode(want.ids, skip_special_tokens=False)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(r.ids).hexdigest() and digests[r.doc_id].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert rows[-1].n_tokens == 0 and rows[-1].decoded == ""


def test_transducer_takes_symbols_in_any_parts_and_holds_few():
    b = bpe.Bpe(vocabulary())
    rng = random.Random(3)
    for letters in ("abcdethin", "th", "aeiou'"):
        for size in (1, 2, 7, 4 * b.lookahead + rng.randrange(3000)):
            symbols = [rng.choice(letters) for _ in range(size)]
            symbols[-1] += b.end
            assert list(b.stream([symbols[:9], symbols[9:]])) == b.merged(symbols[:])
            machine, got, at = bpe.Transducer(b), [], 0
            while at < size:
                n = rng.randrange(1, machine.size)
                got += machine.push(symbols[at : at + n])
                assert len(machine.held) < machine.size
                at += n
            assert got + machine.finish() == b.merged(symbols[:])
    assert ["".join(p) for p in b.symbols("\u00e9a")] == ["".join(b.letters[x] for x in "\u00e9a".encode()) + b.end] and list(b.symbols("")) == []
    long = "ab" * 4 * b.lookahead
    assert "".join(map("".join, b.symbols(long))) == long + b.end and len(list(b.symbols(long))) == 2


def test_every_word_goes_through_the_transducer(monkeypatch):
    b, met = bpe.Bpe(vocabulary()), []
    monkeypatch.setattr(b, "stream", lambda s, real=b.stream: met.append(1) or real(s))
    b.encode("one two one three")
    assert len(met) == 3


def test_decoder_reads_ids_in_any_parts():
    b, rng = bpe.Bpe(vocabulary()), random.Random(4)
    ids = b.encode(words(rng, 200)) + struct.pack("<I", 2**31)
    machine, out, at = bpe.Decoder(b), "", 0
    while at < len(ids):
        n = 4 * rng.randrange(1, 9)
        out += machine.push(ids[at : at + n])
        at += n
    assert out == b.decode(ids) == " ".join(b.tokens[i] for i in struct.unpack(f"<{len(ids) // 4 - 1}I", ids[:-4]))


def test_text_machine_and_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randrange(12)))
        machine = bpe.Utf8()
        cut = rng.randrange(len(data) + 1)
        got = machine.push(data[:cut]) + machine.push(data[cut:]) + machine.flush()
        assert got == codecs.decode(data, "utf-8", "replace")
    b = bpe.Bpe(vocabulary())
    assert b.text(b.encode("Voilà 漢字 the end 42")) == "voilà 漢字 the end 4 2 "


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = lambda s: sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(12)
    letters = ["a", "Z", "9", "0", "1", ".", "@", "-", "_", " ", "+", "(", ")", "%", "é", "\U0001f600", "b.c", "@d.e", "4111111111111111", "10.0.0.255", "+1 (555) 010-9999"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "a" * 50_000, "1" * 40_000, "a.b@" * 900, "x@" + "y." * 20_000 + "z", "1 " * 30_000, "9.9.9.9 " * 3000]
    got = pii.find_pii(docs(spark, texts).withColumn("base", F.lit(1))).select("doc_id", pii.written(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(13)
    texts = [f"{words(rng, 12)} mailto: user{i}@mail{i}.example.com {words(rng, 9)} 77{i} {words(rng, 5)}" for i in range(30)]
    texts += [f"{words(rng, 12)} mailto: someone{i}@localhost {words(rng, 9)}" for i in range(3)] + ["clean words only 12345 here"]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    for i in (30, 31, 32):
        (span,) = got[i].added
        assert span.kind == "email" and texts[i][span.start : span.end] == f"someone{i - 30}@localhost"
    assert not any(got[i].added for i in got if i not in (30, 31, 32))
    spans = pii.all_spans(F.col("base"), F.col("added"))
    text = pii.find_pii(docs(spark, texts)).where("doc_id IN (0, 31, 33)").select("doc_id", pii.redacted(F.col("text"), spans).alias("t")).collect()
    for r in text:
        assert ("[EMAIL]" in r.t) == (r.doc_id != 33) and "@" not in r.t


def test_added_spans_hold_against_planted_identifiers(spark):
    """Precision and recall of what the patterns add: identifiers of forms that no base pattern takes, beside labels, among numbers that are none."""
    rng = random.Random(17)
    label = {"ip": ("host", "up"), "phone": ("Call", "now")}
    texts, planted = [], {}
    for i in range(60):
        ip, phone = ".".join(str(rng.randrange(256)) for _ in range(4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        texts.append(f"{words(rng, 8)} host {ip} up {words(rng, 5)} Call {phone} now {words(rng, 6)} in {rng.randrange(1900, 2100)} the {rng.randrange(99)}")
    for i in range(60, 80):
        kind = ("ip", "phone")[i % 2]
        value = f"10.0.{i}.x{i}" if kind == "ip" else f"555-0{i}-99{i}"
        left, right = label[kind]
        texts.append(f"{words(rng, 7)} {left} {value} {right} {words(rng, 7)} in {rng.randrange(1900, 2100)} v{i}")
        planted[i] = (kind, value)
    extra = {c: F.lit(1) for c in ("_row", "_d", "_t", "_text", "base", "s", "start", "type", "word", "w")}
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, texts, **extra)).collect()}
    found = {(i, s.kind, texts[i][s.start : s.end]) for i, r in got.items() for s in r.added}
    want = {(i, *v) for i, v in planted.items()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    assert all(got[0][c] == 1 for c in ("_row", "_d", "_t", "s", "w"))


def test_shapes(spark):
    values = ["user7@Mail12.example.com", "4111111111111111", "10.0.255.1234", "a1", "+44", "12345678901234567890123"]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "v string").select(pii.shape(F.col("v")).alias("s")).collect()]
    assert got == ["a9@Aa9.a.a", "9{16}", "9.9.9.9{4}", "a9", "+9", "12345678901234567890123"]


# --- chats


def test_chats_round_trip(spark):
    rng = random.Random(14)
    nasty = ["\\", "#", "<", "###", "### User: ", " </turn>", "\n", ":", "é", "\\0", "\\1", ""]
    rows, want = [], {}
    for c in range(40):
        turns = [("system" if k == 0 and c % 3 == 0 else ("user", "assistant")[(k + (c % 3 == 0)) % 2], "".join(rng.choice(nasty) for _ in range(rng.randrange(9)))) for k in range(rng.randrange(1, 7))]
        want[c] = turns
        rows += [(c, k, r, t, 7) for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, "assistant", "first", 7), (101, 0, "user", None, 7), (101, 1, "user", "again", 7), (102, 0, "robot", "x", 7), (103, 0, None, "y", 7)]
    chats = chat_format.parse_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")))
    got = {r.conv_id: r for r in chats.collect()}
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert [chat_format_text(s.text) for s in got[c].segments if s.loss] == [t for r, t in turns if r == "assistant"]
        assert got[c].formatted == "".join(s.text for s in got[c].segments) and got[c].first_bad is None
    assert [(got[c].valid, got[c].first_bad) for c in (100, 101, 102, 103)] == [(False, 0), (False, 1), (False, 0), (False, 0)]
    assert [(t.role, t.text) for t in got[101].turns] == [("user", ""), ("user", "again")] and got[103].turns[0].role == ""
    assert chat_format.format_chats(chats.limit(0).selectExpr("conv_id", "0L turn", "'' role", "'' text")).count() == 0


def chat_format_text(escaped):
    marks = chat_format.DEFAULT.marks
    return re.sub(r"\\(\d)", lambda m: marks[int(m[1])], escaped)


# --- mixing




def test_mixing(spark):
    rng = random.Random(15)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, "", " \t"]
    long = spark.createDataFrame([(1, "w " * 300_000, "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    assert sorted((r["size"], r.copies <= 2) for r in mixing.mix_sources(long).collect()) == [(2, True), (300_000, True)]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 150, "big").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    got = mixing.mix_sources(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in got)
    total, target, taken = sum(size.values()), {}, {}
    for r in got:
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total and sum(taken.values()) <= 1.5 * total
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    names = ("_row", "_s", "_d", "_t", "same", "picked", "place", "slot", "upto", "finish", "bucket", "h0", "weight")
    more = mixing.mix_sources(df.repartition(7).withColumns({c: F.lit(c) for c in names})).collect()
    assert {r.doc_id: r.taken for r in more} == {r.doc_id: r.taken for r in got} and all(r[c] == c for r in more for c in names)


def test_mixing_of_equal_rows_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(None, "d e", "s")] * 2, "doc_id long, text string, source string")
    got = mixing.mix_sources(rows).collect()
    assert len(got) == 7 and all(r.copies in (0, 1, 2) for r in got) and 15 <= sum(r.taken for r in got) <= 28.5
    assert mixing.mix_sources(rows.limit(0)).count() == 0


def test_ngram_join_tasks_hold_little():
    """What a task takes beside its batch and the counting table doesn't follow the batch: 4 MB of texts, far below that times the hashing's share."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{i * 7919 % 10_007}" for i in range(700)]
    texts = pa.array([" ".join(words[i % 97 :] + [str(i)]).encode() for i in range(1100)], pa.binary())
    batch = pa.RecordBatch.from_pydict({"text": texts})
    named = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1100)), "tid": pa.array(range(1100)), "text": texts})

    class Table:
        value = np.zeros(1 << ngram_join.CELLS, np.uint16)

    for run, given, most in ((ngram_join._counts(3), batch, 45), (ngram_join._sets(3), batch, 25), (ngram_join._prefixes(3, 90, Table), named, 25)):
        tracemalloc.start()
        rows = sum(out.num_rows for out in run(iter([given])))
        peak = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        assert rows and peak < most, (run, peak)


def test_suffix_dedup_tasks_hold_little():
    """Runs of 4 MB of texts, and a pack of 1 MB: what a task takes beside its batch."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = pa.array([rng.integers(97, 123, 4000, dtype=np.uint8).tobytes() for _ in range(1000)], pa.binary())
    ids = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["t1", "t2", "text"])
    contexts = [texts[i].as_py()[at : at + 600] for i in range(36) for at in range(0, 3400, 70)]
    n = len(contexts)
    pack = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(contexts, pa.binary()), pa.array([201] * n, pa.int32()), pa.array([1] * n)], names=["h", "c", "bytes", "n", "m"])
    for f, given, most in ((suffix_dedup._runs(400), batch, 60), (suffix_dedup._sort_pack(400), pack, 95)):
        for _ in f(iter([given.slice(0, 50)])):  # tables of powers and the like
            pass
        tracemalloc.start()
        for _ in f(iter([given])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most


def test_texts_go_to_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('words ', 1000) text")
    got = map_texts(rows, sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 1.1 * BATCH < sum(r.bytes for r in got) / 4
