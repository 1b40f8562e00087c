"""A corpus pipeline of five stages over documents: language ID, near-duplicate join, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as Parquet and
reads it again. All but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, language_id, mixing, ngram_join, pii
from strandlake.llm.common import stage, table
from strandlake.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows whose language is known and not held out; a document without a letter (`und`: null and empty texts too) goes. lang becomes
    the prediction. Rows are judged one by one, whole texts of any length, repeated rows each; null ids, sources and n_chars stay as they are; an empty table gives none."""
    model = language_id.train(docs.where(~language_id.held_out()))
    got = language_id.identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return got.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingle sets reach a similarity of 0.8, one row stays: the one with the smallest
    doc_id (null last), then hash of the text, then lang, source and n_chars. Documents without words (null and empty texts too) stay, of rows
    equal in doc_id and text one. Texts of any length are compared whole; other columns go; an empty table gives none."""
    joined = stage(ngram_join.with_components(docs, n=5, percent=80).select("doc_id", "tid", "n_shingles", "component"), "joined")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    at = joined.where("n_shingles > 0").groupBy("component", place.alias("place")).agg(F.count("*").alias("times"))
    first = at.groupBy("component").agg(F.min(F.struct("place", "times")).alias("f"))
    keep = first.select(F.col("f.place.doc_id").alias("d"), F.col("f.place.tid").alias("tid"), F.col("f.times").alias("times"))
    keep = stage(keep.unionByName(joined.where("n_shingles = 0").select(F.col("doc_id").alias("d"), "tid", F.lit(1).cast("long").alias("times")).distinct()), "keep")
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("tid"))
    on = lambda k: (rows["tid"] == k["tid"]) & rows["doc_id"].cast("long").eqNullSafe(k["d"])
    once, more = keep.where("times = 1"), keep.where("times > 1")
    kept = rows.join(once, on(once), "left_semi").select(*COLUMNS)
    if not more.limit(1).count():
        return kept
    again = rows.join(more, on(more), "left_semi").groupBy("doc_id", "tid").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return kept.unionByName(again.select("doc_id", "r.*").select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; n_chars follows. A null text stays null with its n_chars, an empty one empty; texts of any length are searched
    whole; rows with one doc_id and text are redacted alike; an empty table gives none."""
    found = pii.find_pii(docs.select(*COLUMNS))
    spans = pii.all_spans(F.col("base"), F.col("added"))
    out = found.withColumn("text", pii.redacted(F.col("text"), spans))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the result as often as the mix takes it, not at all where it has no words (null and empty texts too). Null is a source of its own, the
    last; equal rows are taken alike, ties go by the hash of the id; an empty table gives none."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian 32-bit) of each document of the mix. A null text counts as empty and has no ids; texts of any length are
    encoded whole, repeated rows each; an empty table gives none."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("bpe", encode),
]

#: Learned language scores and merge lists are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
