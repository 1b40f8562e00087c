"""The pipeline's stages against plain versions, with nulls, empty and very long texts, repeated rows and empty tables."""

import re
import struct

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs(spark, rows):
    """Rows with more columns, whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "size": F.lit(1), "copies": F.lit(9), "base": F.lit(2), "ids": F.lit(3)})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    assert stage(spark, docs(spark, []), "").count() == 0


def test_language_stage(spark):
    en, de = "the house and the garden of the old man ", "das haus und der garten von dem alten mann "
    rows = [(i, (en if i % 2 else de) * (1 + i % 4), "en" if i % 2 else "de", "s", 5) for i in range(60)]
    rows += [(100, "12 -- 7", "en", "s", 1), (101, None, "en", "s", 2), (102, "", None, None, None), (103, en * 3000, None, "s", 3), (None, de, None, None, None), (7, rows[7][1], "en", "s", 5)]
    got = rows_of(corpus_pipeline.identify_language(spark, docs(spark, rows), ""))
    want = [(d, t, "en" if "the" in t else "de", s, n) for d, t, _, s, n in rows if t and re.search("[a-z]", t)]
    assert got == sorted(want, key=repr)


def test_personal_data_stage(spark):
    rows = [
        (1, "write to ann.b@mail.example.org or +44 20 7946 0958 now", "en", "s", 0), (2, "at 10.0.0.255 and 10.0.0.256, card 4111 1111 1111 1111", "en", "s", 0),
        (3, None, None, None, None), (4, "", "en", "s", 0), (5, "nothing here", "en", "s", 0), (6, "a@b.co " * 20_000, "en", "s", 0), (5, "nothing here", "en", "s", 0), (None, "x@y.zz", "en", "s", 0),
    ]
    got = rows_of(corpus_pipeline.redact_personal_data(spark, docs(spark, rows), ""))
    text = {1: "write to [EMAIL] or [PHONE] now", 2: "at [IP] and 10.0.0.256, card [CARD]", 6: "[EMAIL] " * 20_000, None: "[EMAIL]"}
    want = [(d, text.get(d, t), lang, s, n if t is None else len(text.get(d, t))) for d, t, lang, s, n in rows]
    assert got == sorted(want, key=repr)


def test_mixing_stage(spark):
    rows = [(i, "w " * (1 + i % 13), "en", ["a", "b", "c", None][i % 4], 1) for i in range(400)] + [(900, None, "en", "a", 1), (901, "", "en", "b", 1), (3, rows_text := "w " * 4, "en", None, 1)]
    assert rows_text
    got = corpus_pipeline.mix(spark, docs(spark, rows), "").collect()
    size = lambda t: len((t or "").split())
    by, times = {}, {}
    for d, t, _, s, _ in rows:
        by[s] = by.get(s, 0) + size(t)
    taken = {}
    for r in got:
        assert (r.doc_id, r.text, r.lang, r.source, r.n_chars) in rows and size(r.text)
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    assert max(times.values()) <= 4 and max(n for k, n in times.items() if k[0] != 3) <= 2
    # weights 5, 2, 1, 5 of 150 % of all, none above twice its source
    weight, total, target, rest = {"a": 5, "b": 2, "c": 1, None: 5}, 1.5 * sum(by.values()), {}, dict.fromkeys(by)
    while rest:
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * by[s]]
        for s in over or list(rest):
            target[s] = 2.0 * by[s] if over else level * weight[s]
            del rest[s]
    assert all(abs(taken.get(s, 0) - target[s]) <= 30 for s in by)
    assert rows_of(corpus_pipeline.mix(spark, docs(spark, rows).repartition(5), "")) == sorted((tuple(r) for r in got), key=repr)


def test_encoding_stage(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello World, hello!", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "long " * 60_000 + "x" * 5_000, "en", "s", 1), (1, "Hello World, hello!", "en", "s", 1), (None, "Ünïcode 你好 \U0001f600", "de", None, 2)]
    lib = Tokenizer.from_file(corpus_pipeline.vocabulary())
    lib.no_truncation()
    lib.no_padding()
    got = rows_of(corpus_pipeline.encode(spark, docs(spark, rows), "").select("doc_id", "lang", "source", "n_tokens", F.hex("ids").alias("ids")))
    want = []
    for d, t, lang, s, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, lang, s, len(ids), struct.pack(f"<{len(ids)}I", *ids).hex().upper()))
    assert got == sorted(want, key=repr)
