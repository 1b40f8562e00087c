"""Line dedup against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandlake.llm.line_dedup import drop_repeated_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=5, least_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    place = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(place(d))
    gone = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone or place(d) == gone[key(x)]]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def told(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit("x"), "h1": F.lit(1), "gone": F.lit(0), "lines": F.lit(2), "last": F.lit(9)})
    return sorted((tuple(r) for r in drop_repeated_lines(docs, **how).collect()), key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "É", "DELTA"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    dress = lambda s: rng.choice(["", " ", "\t\x0b"]) + (s.upper() if rng.random() < 0.2 and "É" not in s else s) + rng.choice(["", "\r", " \x0c", "  "])
    rows = [(i // 2 if i % 9 == 0 else i, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    rows += [(None, rows[3][1]), (None, rows[5][1]), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, pool[0] * 3 + "\n"), (10, rows[4][1]), (10, rows[4][1])]
    assert told(spark, rows) == brute(rows)
    assert told(spark, rows, least_docs=3, least_chars=10) == brute(rows, 3, 10)


def test_lines_edges(spark):
    assert told(spark, []) == []
    stop, line = "0123456789" * 4, "a line that every document of this group holds, word by word"
    # 40 code points count, 39 do not; five documents count, four do not; rows of one doc_id are one document
    rows = [(i, f"{stop}\n{stop[:39]}\n" + ("four only, but long enough to count as a line" if i < 4 else "x")) for i in range(5)] + [(4, line), (4, line), (4, line), (4, line), (4, line)]
    assert told(spark, rows) == brute(rows)
    # a third of all rows with one line, another third repeated whole; a text of very many lines, all of them repeated
    many = "\n".join(f"{line} {i}" for i in range(20_000))
    rows = [(i, f"{line}\n{i}") for i in range(4500)] + [(99_999, f"{line}\nonce more")] * 4500 + [(200_000 + i, many) for i in range(6)]
    got = told(spark, rows)
    assert got == brute(rows)
    assert sum(r[3] for r in got) == 4500 + 5 * 20_000
