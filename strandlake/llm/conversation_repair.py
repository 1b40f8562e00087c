"""Conversation structure repair: the cheapest edits that make a conversation's roles follow `(s?(ua)+)?`, with their audit.

Faults, the first of a row counts: blank (no character but ASCII white space), duplicate (role and text stood earlier), truncated (the last
such character is none of `.!?`). Edits: Keep (0), Rerole to user or assistant (3), Delete (4; all that a blank or duplicate row can
get), Insert an empty turn of user or assistant (3); a truncated row that stays costs 3 more. A role counts by its first letter. Of the cheapest
edits those win whose initials in order, the audit, are least by code point.

The edits are found by dynamic programming over four states (nothing yet, after system, after user, after assistant). Audits share their
prefixes as linked nodes, each with its ancestors at powers of two and a rolling hash of its whole string (class Trail). Equal costs are
decided at the first place where two audits differ, found by lifting both while the hashes differ; that what stands before is equal
is verified node by node, and a clash of hashes makes the comparison go character by character.

Rows are taken by conversation, then turn (null first), role, hash of the text, text. Rows are sorted by ranges of this order, so
a conversation of any share of all rows is spread over tasks. A task settles the conversations that lie whole within it. Those at a range's ends, and
those of more than PIECE rows, are cut into pieces of at most PIECE rows. A piece gives its cheapest audit from every state to every state; pieces are then
put together in order, which carries only costs and audits, and edited each on its own. What a task holds is a piece, and of a long
conversation its audit, a character an edit.

Null role or text count as one space. Null conv_id is a conversation of its own. Repeated rows are duplicates; texts of any length
are looked at whole; an empty table gives no conversations. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import stage
from strandlake.llm.components import join_left_heavy

PIECE = 4096
WHITE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED, FINE = range(4)
#: States: nothing yet, after system, after user, after assistant. What user and assistant (the only role a turn may have next) lead to.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
ENDS = (0, 3)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MODULUS, FACTOR = (1 << 61) - 1, 0x1F35_7A5C_93D1_0B47


class Trail:
    """Strings of edits as linked nodes; node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, edit: str) -> int:
        new, up, k = len(self.edit), [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * FACTOR + ord(edit)) % self.modulus)
        self.up.append(up)
        return new

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _lifted(self, node: int, depth: int) -> int:
        away = self.depth[node] - depth
        while away:
            k = away.bit_length() - 1
            node = self.up[node][k]
            away -= 1 << k
        return node

    def _equal(self, a: int, b: int) -> bool:
        while a != b:
            if self.edit[a] != self.edit[b] or not a or not b:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string is smaller than b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, depth), self._lifted(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._equal(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.edit[x] == self.edit[y] or not self._equal(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]


class Best:
    """The cheapest way into each state; equal costs go to the smaller audit."""

    def __init__(self, trail: Trail):
        self.trail, self.ways = trail, [None] * 4

    def offer(self, state: int, cost: int, node: int, edit: str) -> bool:
        old = self.ways[state]
        if old is not None and cost > old[0]:
            return False
        new = self.trail.add(node, edit)
        if old is not None and cost == old[0] and not self.trail.less(new, old[1]):
            return False
        self.ways[state] = (cost, new)
        return True

    def insert(self) -> "Best":
        again = True
        while again:
            again = False
            for s in range(4):
                if self.ways[s] is not None:
                    again |= self.offer(NEXT[s], self.ways[s][0] + 3, self.ways[s][1], "I")
        return self


def audits(rows: list[tuple[str, int]], entry: int) -> list[tuple[int, str] | None]:
    """rows (role, fault): cost and audit of the best edits from a state to each state."""
    trail = Trail()
    best = Best(trail)
    best.ways[entry] = (0, 0)
    best.insert()
    for role, fault in rows:
        after = Best(trail)
        for s, way in enumerate(best.ways):
            if way is None:
                continue
            cost, node = way
            after.offer(s, cost + 4, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            cost += 3 * (fault == TRUNCATED)
            kept = KEEP[s].get(role[:1])
            if kept is not None:
                after.offer(kept, cost, node, "K")
            after.offer(NEXT[s], cost + 3, node, "R")
        best = after.insert()
    return [None if w is None else (w[0], trail.text(w[1])) for w in best.ways]


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """rows (role, text) after the edits, which begin in a state."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        to = KEEP[state][role[:1]] if edit == "K" else NEXT[state]
        out.append((role if edit == "K" else NAMES[to], text))
        state = to
    return out


def fault_of(text: str, seen: bool) -> int:
    bare = text.rstrip(WHITE)
    return BLANK if not bare else DUPLICATE if seen else FINE if bare[-1] in ".!?" else TRUNCATED


def illegal_in(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")
TURNS = "turns array<struct<role: string, text: string>>"
REPORT = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string"


def _turns(found: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [t for turns in found for t in turns]
    ends = [0]
    for turns in found:
        ends.append(ends[-1] + len(turns))
    pair = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())], names=["role", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)


def _sorted_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


class _Rows:
    """Output rows of a fixed schema, handed on in batches."""

    def __init__(self, types: dict[str, pa.DataType | None]):
        self.types, self.held, self.size = types, [], 0

    def put(self, weight: int, **values) -> bool:
        self.held.append(values)
        self.size += weight
        return self.size > 1 << 20 or len(self.held) >= 5000

    def batch(self) -> pa.RecordBatch:
        held, self.held, self.size = self.held, [], 0
        get = lambda c, kind: _turns([r.get(c) or [] for r in held]) if kind is None else pa.array([r.get(c) for r in held], kind)
        return pa.RecordBatch.from_arrays([get(c, kind) for c, kind in self.types.items()], names=list(self.types))


LONG, TEXT = pa.int64(), pa.string()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: a report with turns of each conversation that lies whole in it and has at most PIECE rows, else its rows with piece and place."""
    out = _Rows({"whole": pa.bool_(), "conv_id": LONG, "piece": LONG, "at": LONG, "turn": LONG, "role": TEXT, "text": TEXT, **{c: LONG for c in COUNTS}, "audit": TEXT, "turns": None})
    held, conv, part, edge, n = [], None, 0, True, 0

    def cut() -> bool:
        """Hand the held rows on as a piece."""
        nonlocal n
        full = False
        for turn, role, text in held:
            full = out.put(len(text), whole=False, conv_id=conv, piece=(part << 32) + n // PIECE, at=n, turn=turn, role=role, text=text)
            n += 1
        held.clear()
        return full

    def settle() -> bool:
        seen, rows = set(), []
        for _, role, text in held:
            rows.append((role, fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        ways = [(*w, s) for s, w in enumerate(audits(rows, 0)) if w is not None and s in ENDS]
        cost, audit, _ = min(ways)
        turns = edited([(r, t) for _, r, t in held], audit, 0)
        known = {t for t, _, _ in held if t is not None}
        count = lambda kind: sum(f == kind for _, f in rows)
        full = out.put(sum(len(t) for _, _, t in held), whole=True, conv_id=conv, blank=count(BLANK), duplicate=count(DUPLICATE), truncated=count(TRUNCATED), illegal=illegal_in([r for r, _ in rows]), gaps=max(known) - min(known) + 1 - len(known) if known else 0, cost=cost, audit=audit, turns=turns)
        held.clear()
        return full

    first = True
    for part, key, turn, role, text in _sorted_rows(batches, "part", "conv_id", "turn", "role", "text"):
        if first:
            first, conv = False, key
        elif key != conv:
            if cut() if edge else settle():
                yield out.batch()
            conv, edge, n = key, False, 0
        held.append((turn, role, text))
        if len(held) >= PIECE:
            edge = True
            if cut():
                yield out.batch()
    if held:
        cut()
    if out.held:
        yield out.batch()


def _groups(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same first `width` values."""
    key, held = None, []
    for row in rows:
        if row[:width] != key:
            if held:
                yield key, held
            key, held = row[:width], []
        held.append(row[width:])
    if held:
        yield key, held


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece: what joins it to its neighbours, its counts, and its best audits from every state to every state."""
    kinds = {"conv_id": LONG, "none": pa.bool_(), "piece": LONG, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "role_1": TEXT, "role_2": TEXT, "turn_1": LONG, "turn_2": LONG, "n_turns": LONG, "ways": pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("cost", LONG), ("audit", TEXT)]))}
    out = _Rows(kinds)
    for (conv, none, piece), held in _groups(_sorted_rows(batches, "conv_id", "none", "piece", "at", "turn", "role", "text", "later"), 3):
        rows = [(role, fault_of(text, later)) for _, _, role, text, later in held]
        known = [t for _, t, *_ in held if t is not None]
        ways = [{"a": a, "z": z, "cost": w[0], "audit": w[1]} for a in range(4) for z, w in enumerate(audits(rows, a)) if w is not None]
        count = lambda kind: sum(f == kind for _, f in rows)
        if out.put(16 * len(rows), conv_id=conv, none=none, piece=piece, blank=count(BLANK), duplicate=count(DUPLICATE), truncated=count(TRUNCATED), illegal=illegal_in([r for r, _ in rows]), role_1=rows[0][0][:1], role_2=rows[-1][0][:1], turn_1=min(known, default=None), turn_2=max(known, default=None), n_turns=len(set(known)), ways=ways):
            yield out.batch()
    if out.held:
        yield out.batch()


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: a row with the report of each conversation (piece null), and one with each piece's state before it and its part of the audit."""
    out = _Rows({"conv_id": LONG, "none": pa.bool_(), "piece": LONG, **{c: LONG for c in COUNTS}, "audit": TEXT, "state": pa.int32()})
    columns = ("conv_id", "none", "piece", "blank", "duplicate", "truncated", "illegal", "role_1", "role_2", "turn_1", "turn_2", "n_turns", "ways")
    for (conv, none), held in _groups(_sorted_rows(batches, *columns), 2):
        best, taken = {0: (0, "")}, []
        total, role, turn, low, distinct = [0] * 4, None, None, None, 0
        for _, b, d, t, i, role_1, role_2, turn_1, turn_2, n_turns, ways in held:
            crossing = 0 if role is None else illegal_in([role, role_1])
            total = [x + y for x, y in zip(total, (b, d, t, i + crossing))]
            role = role_2
            if turn_1 is not None:
                distinct += n_turns - (turn == turn_1)  # turns ascend, so pieces share at most the one where they meet
                low, turn = turn_1 if low is None else low, turn_2
            after = {}
            for w in ways:
                if w["a"] in best:
                    cost, audit = best[w["a"]]
                    new = (cost + w["cost"], audit + w["audit"], w["a"], w["audit"])
                    if w["z"] not in after or new < after[w["z"]]:
                        after[w["z"]] = new
            taken.append({z: (a, own) for z, (_, _, a, own) in after.items()})
            best = {z: (c, s) for z, (c, s, _, _) in after.items()}
        cost, audit, state = min((*best[s], s) for s in ENDS if s in best)
        gaps = turn - low + 1 - distinct if low is not None else 0
        if out.put(len(audit), conv_id=conv, none=none, **dict(zip(COUNTS, (*total, gaps, cost))), audit=audit):
            yield out.batch()
        for row, ways in zip(reversed(held), reversed(taken)):
            state, own = ways[state]
            if out.put(len(own), conv_id=conv, none=none, piece=row[0], audit=own, state=state):
                yield out.batch()
    if out.held:
        yield out.batch()


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows({"conv_id": LONG, "piece": LONG, "turns": None})
    for (conv, none, piece), held in _groups(_sorted_rows(batches, "conv_id", "none", "piece", "at", "role", "text", "audit", "state"), 3):
        turns = edited([(r, t) for _, r, t, _, _ in held], held[0][3], held[0][4])
        if out.put(sum(len(t) for _, t in turns), conv_id=None if none else conv, piece=piece, turns=turns):
            yield out.batch()
    if out.held:
        yield out.batch()


@dataclass(frozen=True)
class Repaired:
    """whole: conv_id, counts, cost, audit and turns of conversations that one task settled. long: the same but turns of those in pieces;
    pieces: conv_id, piece (ascending), turns of these."""

    whole: DataFrame
    long: DataFrame
    pieces: DataFrame

    def turns(self) -> DataFrame:
        """conv_id, piece, turns of all conversations."""
        return self.whole.select("conv_id", F.lit(0).cast("long").alias("piece"), "turns").unionByName(self.pieces)


def repair(rows: DataFrame) -> Repaired:
    """rows: conv_id, turn, role, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    good = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    # equal rows are alike, so which of them comes first is no matter: a running number lets their ranges be cut too
    keyed = good.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange("conv_id", "turn", "role", "h", "m").sortWithinPartitions("conv_id", "turn", "role", "h", "text", "m")
    schema = f"whole boolean, conv_id long, piece long, at long, turn long, role string, text string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, {TURNS}"
    settled = stage(dealt.withColumn("part", F.spark_partition_id().cast("long")).drop("h", "m").mapInArrow(_settle, schema), "settled")
    whole = settled.where("whole").select("conv_id", *COUNTS, "audit", "turns")

    same = ["none", "conv_id", "role", "h1", "h2"]
    cut = settled.where("NOT whole").select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "piece", "at", "turn", "role", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    place = F.struct("piece", "at")
    again = stage(cut.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"), "again")
    flagged = join_left_heavy(cut, again, same, "times", again.agg(F.sum("times")).first()[0] or 0)
    flagged = stage(flagged.select("none", "conv_id", "piece", "at", "turn", "role", "text", F.coalesce(F.col("first") != place, F.lit(False)).alias("later")), "flagged")
    by_piece = flagged.repartition("none", "conv_id", "piece").sortWithinPartitions("none", "conv_id", "piece", "at")
    ways = by_piece.mapInArrow(_ways, "conv_id long, none boolean, piece long, blank long, duplicate long, truncated long, illegal long, role_1 string, role_2 string, turn_1 long, turn_2 long, n_turns long, ways array<struct<a: int, z: int, cost: long, audit: string>>")
    ways = ways.repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", "piece")
    joined = stage(ways.mapInArrow(_join_up, f"conv_id long, none boolean, piece long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, state int"), "joined")
    long = joined.where("piece IS NULL").select(F.when(~F.col("none"), F.col("conv_id")).alias("conv_id"), *COUNTS, "audit")
    how = joined.where("piece IS NOT NULL").select("none", "conv_id", "piece", "audit", "state")
    todo = flagged.join(how, ["none", "conv_id", "piece"]).repartition("none", "conv_id", "piece").sortWithinPartitions("none", "conv_id", "piece", "at")
    pieces = stage(todo.mapInArrow(_edit, f"conv_id long, piece long, {TURNS}"), "pieces")
    return Repaired(whole, long, pieces)


def with_sha256(done: Repaired) -> DataFrame:
    """Reports with repaired_sha256: `role:text` of a conversation's turns, joined by line feeds. Those in pieces are hashed piece by piece, as they stream by."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    short = done.whole.select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, ([], [])
        for none, conv, told in _sorted_rows(batches, "none", "conv_id", "told"):
            if (none, conv) != key:
                if state is not None:
                    out[0].append(None if key[0] else key[1])
                    out[1].append(state.hexdigest())
                key, state, begun = (none, conv), hashlib.sha256(), False
            if told is not None:
                state.update((("\n" if begun else "") + told).encode("utf-8", "surrogatepass"))
                begun = True
        if state is not None:
            out[0].append(None if key[0] else key[1])
            out[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], LONG), pa.array(out[1], TEXT)], names=["id", "repaired_sha256"])

    told = done.pieces.select(F.col("conv_id").isNull().alias("none"), "conv_id", "piece", F.when(F.size("turns") > 0, F.array_join(line, "\n")).alias("told"))
    hashed = told.repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", "piece").mapInArrow(digest, "id long, repaired_sha256 string")
    return short.unionByName(done.long.join(hashed, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; nulls: one space) with faults by the checksum of `conv_id:turn`: a twentieth each is dropped, emptied, bare of `.!?`, repeated, said by the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return by.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")
