"""Conversation repair against brute force over whole edit strings, and its pieces against one another."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandlake.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Cheapest (cost, audit) by all edit strings, states kept apart, strings compared whole."""
    ways = {0: (0, "", ())}

    def inserts(ways):
        for _ in range(3):
            for s, (cost, audit, turns) in list(ways.items()):
                to = R.NEXT[s]
                new = (cost + 3, audit + "I", (*turns, (R.NAMES[to], "")))
                if to not in ways or new[:2] < ways[to][:2]:
                    ways[to] = new
        return ways

    ways, seen, faults = inserts(ways), set(), []
    for role, text in rows:
        bare = text.strip(R.WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        after = {}
        for s, (cost, audit, turns) in ways.items():
            options = [(s, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((R.NEXT[s], 3 + more, "R", ((R.NAMES[R.NEXT[s]], text),)))
                if role[:1] in R.KEEP[s]:
                    options.append((R.KEEP[s][role[:1]], more, "K", ((role, text),)))
            for to, price, edit, said in options:
                new = (cost + price, audit + edit, turns + said)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        ways = inserts(after)
    cost, audit, turns = min(w for s, w in ways.items() if s in R.ENDS)
    return faults, cost, audit, turns


def brute(rows):
    """rows (conv_id, turn, role, text) in order."""
    out, by = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for c, held in by.items():
        faults, cost, audit, turns = plain([(r, x) for _, r, x in held])
        known = {t for t, _, _ in held if t is not None}
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        told = "\n".join(f"{r}:{x}" for r, x in turns)
        out[c] = (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), bad, max(known) - min(known) + 1 - len(known) if known else 0, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"piece": F.lit("x"), "at": F.lit(1), "part": F.lit(2), "h": F.lit(3), "none": F.lit(True)})


def in_order(df):
    return [tuple(r) for r in df.orderBy("conv_id", "turn", F.coalesce("role", F.lit(" ")), F.xxhash64(F.coalesce("text", F.lit(" "))), "text").select("conv_id", "turn", "role", "text").collect()]


def told(df):
    done = R.repair(df)
    return {r[0]: tuple(r)[1:] for r in R.with_sha256(done).collect()}, done


def made(seed, conversations, turns):
    rng, rows = random.Random(seed), []
    texts = ["Well. ", "Yes!", "no", " ", "", "and then\t", "Why?\r", "x" * 50_000 + "."]
    for c in range(conversations):
        for t in range(rng.randrange(1, turns)):
            rows.append((c if c else None, t if rng.random() < 0.9 else rng.choice([None, 2, 90]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts[:6]) + (f"{t}." if rng.random() < 0.7 else "") if rng.random() < 0.97 else rng.choice([None, *texts])))
    return rows


def test_repair_against_brute_force(spark):
    df = table(spark, made(1, 120, 14)).cache()
    got, done = told(df)
    assert got == brute(in_order(df))
    assert done.long.count()  # at the ends of ranges
    assert {r.conv_id for r in done.turns().collect()} == set(got)


def test_pieces(spark):
    """A conversation with over a third of all rows, in pieces; a fifth of its rows are one row again and again."""
    rng = random.Random(2)
    rows = made(3, 40, 12) + [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c!", "d? "]) + str(t // 3) + rng.choice(["", "."])) for t in range(9000)] + [(5, 77, "user", "again.")] * 2500
    df = table(spark, rows).cache()
    got, done = told(df)
    assert got == brute(in_order(df))
    assert done.pieces.where("conv_id = 5").count() >= 3


def test_trail_compares_and_verifies():
    rng = random.Random(4)
    for modulus in (R.MODULUS, 5):  # with five hashes most comparisons clash
        trail, nodes, known = R.Trail(modulus), [0], {0: ""}
        for _ in range(400):
            at = rng.choice(nodes[-30:])
            new = trail.add(at, rng.choice("DIKR"))
            nodes.append(new)
            known[new] = known[at] + trail.edit[new]
        assert all(trail.text(n) == s for n, s in known.items())
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert trail.less(a, b) == (known[a] < known[b])


def test_edges(spark):
    assert told(spark.createDataFrame([], SCHEMA))[0] == {}
    rows = [(1, 0, "assistant", "Hi.")]
    assert told(table(spark, rows))[0][1][5:7] == (3, "IK")
    broken = R.damaged(table(spark, [(c, t, "assistant", None if t == 3 else "So. Is it?") for c in (None, 1, 2) for t in (None, *range(30))]))
    want = []
    for c in (None, 1, 2):
        for t in (None, *range(30)):
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            text = " " if t == 3 else "So. Is it?"
            want += [(c, t, "user" if k == 4 else "assistant", "" if k == 1 else text.translate({46: None, 33: None, 63: None}) if k == 2 else text)] * {0: 0, 3: 2}.get(k, 1)
    assert sorted(map(repr, map(tuple, broken.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("entry", range(4))
def test_audits_from_every_state(entry):
    """Pieces put together give what the whole gives."""
    rng = random.Random(entry)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "x"]), rng.choice([R.FINE, R.FINE, R.TRUNCATED, R.BLANK, R.DUPLICATE])) for _ in range(rng.randrange(1, 12))]
        cut = rng.randrange(len(rows) + 1)
        whole, first = R.audits(rows, entry), R.audits(rows[:cut], entry)
        second = [R.audits(rows[cut:], s) for s in range(4)]
        for z in range(4):
            ways = [(first[s][0] + second[s][z][0], first[s][1] + second[s][z][1]) for s in range(4) if first[s] and second[s][z]]
            assert (min(ways) if ways else None) == whole[z]
