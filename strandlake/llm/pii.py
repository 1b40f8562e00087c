"""Personal data: base patterns, and contextual extraction bootstrapped from them. DataFrame functions only.

Base matches (email, ip, card, phone) are the seeds. What stands around and in them induces lexical patterns of a kind:
the word on the left, the word on the right, both words together, and the shape of the token itself (letters and digits by
class). Each pattern extracts every token that it fits: its confidence is the summed score of the identifiers among these, divided by all of
them. For a word on one side these are all occurrences of the word in the corpus (`the` scores near 0, a label like `Tel:` near 1); for pairs
and shapes, all seeds and identifier-like tokens (a digit or @ in it, not part of a seed) that fit. Such a token scores by the patterns that
extract it (noisy or; a shape counts half, so that the form of a token never decides alone). Both scores are recomputed in turn over the graph of
patterns and instances; tokens that end above `least_score`, by patterns above `least_confidence`, from at least `least_seeds` different
seed values, become spans of the pattern's kind. Base spans always stay.

Positions count code points, end exclusive. Null or empty text: no spans. Repeated rows are judged alike and each gets a row. Ties between kinds
of one token go to the kind listed first. Spans of different kinds may overlap; an added span never overlaps a base one. Very long texts
and words are taken whole. Other columns pass whatever their names; own ones named base and added are replaced; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import stage

LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, a test that must hold before it is tried). Each finds what the plain pattern of its kind finds, without
#: retrying inside a run of characters that has failed already, so very long runs stay linear.
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: An identifier-like token: begins and ends with a letter, digit or plus, and holds a digit or @.
INNER = r"A-Za-z0-9@+._%:/-"
TOKEN = rf"(?<![{INNER}])[.:/_%@-]*+(?=[{INNER}]*[0-9@])[A-Za-z0-9+](?:[{INNER}]*[A-Za-z0-9])?"
BLOCK = 512
PLACE = ("_d", "_t", "start", "end", "kind")
EDGE = ("kind", "type", "word")
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside lambdas an expression would be computed anew for every item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """Sums of all earlier items, by blocks so that long arrays stay near linear. lengths is a bound value (see let)."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.greatest((F.size(lengths) - 1) / BLOCK, F.lit(0)).cast("int"))
    starts = F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    ahead = let(starts, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
    return let(ahead, lambda sums: F.transform(lengths, lambda _, i: F.get(sums, (i / BLOCK).cast("int")) + total(F.slice(lengths, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))


def blanks(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def found(text: Column, pattern: str, holds: str) -> Column:
    """Leftmost matches that don't overlap, with their places and the words beside them."""

    def spans(gaps: Column, hits: Column, ahead: Column) -> Column:
        def span(h: Column, i: Column) -> Column:
            start = F.get(ahead, i) + F.length(F.get(gaps, i))
            left = F.lower(F.substring_index(F.rtrim(blanks(F.get(gaps, i))), " ", -1))
            right = F.lower(F.substring_index(F.ltrim(blanks(F.get(gaps, i + 1))), " ", 1))
            return F.struct(start.cast("int").alias("start"), (start + F.length(h)).cast("int").alias("end"), h.alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(hits, span)

    def placed(v: Column) -> Column:
        lengths = F.transform(v["hits"], lambda h, i: F.length(F.get(v["gaps"], i)) + F.length(h))
        return let(let(lengths, running), lambda ahead: spans(v["gaps"], v["hits"], ahead))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    some = text.contains(holds) & text.rlike(pattern) if holds else text.rlike(pattern)
    return F.when(some, let(parts, placed)).otherwise(F.lit(None).cast(SPAN))


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)
    each = F.transform(places, lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value, left, right>> by kind as listed, then start."""
    def of(kind: str) -> Column:
        good = F.filter(found(text, *BASE[kind]), lambda s: holds(kind, s["value"]))
        named = F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "value", "left", "right"))))
        return F.coalesce(named, F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"))

    return F.concat(*map(of, BASE))


def shape(value: Column) -> Column:
    """Runs of letters as a or A; of up to three digits as 9, of more with their number."""
    letters = F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A")
    longer = F.regexp_replace(letters, "(?<![0-9])[0-9]{1,3}(?![0-9])", "9")
    for n in range(4, 20):
        longer = F.regexp_replace(longer, f"(?<![0-9{{]){'[0-9]' * n}(?![0-9}}])", f"9{{{n}}}")
    return longer


def patterns_of(s: Column) -> Column:
    """(type, word) of each pattern that fits a span; very long words stand by a digest."""
    brief = lambda w: F.when(F.length(w) <= 64, w).otherwise(F.md5(w.cast("binary")))
    row = lambda kind, w: F.struct(F.lit(kind).alias("type"), w.alias("word"))
    both = F.when((s["left"] != "") & (s["right"] != ""), F.concat_ws(" ", brief(s["left"]), brief(s["right"])))
    some = F.array(row("left", brief(s["left"])), row("right", brief(s["right"])), row("both", both), row("shape", brief(shape(s["value"]))))
    return F.filter(some, lambda p: p["word"] != "")


def noisy_or(confidence: Column, type_: Column) -> Column:
    weighted = F.least(confidence, F.lit(0.999)) * F.when(type_ == "shape", 0.5).otherwise(1.0)
    return 1 - F.exp(F.sum(F.log1p(-weighted)))


def find_pii(docs: DataFrame, rounds: int = 3, least_seeds: int = 3, least_confidence: float = 0.5, least_score: float = 0.6) -> DataFrame:
    """docs with base array<struct<kind, start, end, ...>> and added array<struct<kind, start, end>>."""
    others = [c for c in docs.columns if c not in ("base", "added")]
    # the given columns travel in one struct, so that no name of theirs can clash
    keyed = docs.select(F.struct(*others).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    based = keyed.select("_row", "_d", "_t", base_spans(F.col("_text")).alias("base"))
    seeds = stage(based.where(F.size("base") > 0).select("_d", "_t", F.explode("base").alias("s")).select("_d", "_t", "s.kind", "s.start", "s.end", "s.value", patterns_of(F.col("s")).alias("patterns")), "seeds")
    worded = seeds.select("kind", "value", F.inline("patterns"))
    each = worded.groupBy(*EDGE, "value").agg(F.count("*").alias("n"))
    scored = each.groupBy(*EDGE).agg(F.sum("n").alias("n_seeds"), F.count("*").alias("values")).where(F.col("values") >= least_seeds)
    scored = stage(scored, "patterns")
    tokens = keyed.select("_d", "_t", F.explode(found(F.col("_text"), TOKEN, "")).alias("s")).select("_d", "_t", "s.start", "s.end", "s.value", patterns_of(F.col("s")).alias("patterns"))
    taken = seeds.select("_d", "_t", F.col("start").alias("s0"), F.col("end").alias("e0")).distinct()
    clash = tokens["_d"].eqNullSafe(taken["_d"]) & (tokens["_t"] == taken["_t"]) & (tokens["start"] < taken["e0"]) & (taken["s0"] < tokens["end"])
    tokens = tokens.join(taken, clash, "left_anti").select("_d", "_t", "start", "end", F.inline("patterns"))
    tokens = stage(tokens.join(scored.select("type", "word").distinct(), ["type", "word"], "left_semi"), "tokens")
    # what a pattern extracts at all: a word on one side, wherever it stands; a pair or a shape, among seeds and tokens
    everywhere = keyed.select(F.explode(F.split(F.lower("_text"), r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("uses"))
    sides = scored.where("type IN ('left', 'right')").select(*EDGE, F.col("word").alias("w")).join(everywhere, "w").select(*EDGE, "uses")
    among = worded.select("type", "word").where("type IN ('both', 'shape')").unionByName(tokens.select("type", "word").where("type IN ('both', 'shape')"))
    among = scored.select(*EDGE).join(among.groupBy("type", "word").agg(F.count("*").alias("uses")), ["type", "word"]).select(*EDGE, "uses")
    scored = scored.join(sides.unionByName(among), list(EDGE)).withColumn("confidence", F.col("n_seeds") / F.greatest("uses", "n_seeds"))
    scored = stage(scored, "patterns")
    edges = stage(tokens.join(scored.select(*EDGE), ["type", "word"]), "edges")
    extra = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if not edges.limit(1).count():  # no pattern extracts a token beside the seeds
        return based.select("_row.*", "base", extra.alias("added"))
    # each round: instances by their patterns, then patterns by their instances
    for _ in range(rounds):
        score = edges.join(scored.select(*EDGE, "confidence"), list(EDGE)).groupBy(*PLACE).agg(noisy_or(F.col("confidence"), F.col("type")).alias("score"))
        score = score.select(*(F.col(c).alias(f"{c}2") for c in PLACE), "score")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}2")) for c in PLACE))
        gained = edges.join(score, same).groupBy(*EDGE).agg(F.sum("score").alias("gained"))
        scored = scored.drop("confidence").join(gained, list(EDGE), "left").withColumn("confidence", F.least((F.col("n_seeds") + F.coalesce("gained", F.lit(0.0))) / F.greatest("uses", "n_seeds"), F.lit(1.0)))
        scored = stage(scored.drop("gained"), "patterns")
    sure = edges.join(scored.where(F.col("confidence") >= least_confidence).select(*EDGE, "confidence"), list(EDGE))
    sure = sure.groupBy(*PLACE).agg(noisy_or(F.col("confidence"), F.col("type")).alias("score")).where(F.col("score") >= least_score)
    rank = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind"))
    best = sure.groupBy("_d", "_t", "start", "end").agg(F.max_by("kind", F.struct("score", -rank)).alias("kind"))
    added = stage(best.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added")), "added")
    found_ = added.select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2"), "added")
    joined = based.join(found_, based["_d"].eqNullSafe(found_["_d2"]) & (based["_t"] == found_["_t2"]), "left")
    return joined.select("_row.*", "base", F.coalesce("added", extra).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(base: Column, added: Column) -> Column:
    """Both, by kind as listed, then start."""
    slim = F.concat(F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), added)
    by = F.transform(slim, lambda s: F.struct(F.array_position(F.array(*map(F.lit, BASE)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.sort_array(by)


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first to start stands for all."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        part = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], part).alias("parts"))

    whole = F.aggregate(order, begun, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
