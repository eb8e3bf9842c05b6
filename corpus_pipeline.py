"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, lines, neardup, quality
from tidemark.llm.common import written
from tidemark.llm.queries import tokenizer

#: The stage links from 0.80 up. 38 bands of 5 rows miss a pair at the threshold with probability 3e-7, and then only if no other path links it.
NEAR = neardup.MinHash(percent=80, bands=38, rows=5)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules; null and empty texts don't. Repeated rows stay or go alike.

    The judged table is written before it is filtered: Spark would push the filter below the projections that make
    the verdict and write their expressions out into each other.
    """
    return written(quality.quality_rules(docs).select(*COLUMNS, "kept")).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document that loses all its lines goes, one without any line stays.

    Rows that repeat an id and a text count as one document, so they keep their lines.
    """
    d = lines.dedup_lines(docs).filter("n_removed < n_lines OR n_lines = 0")
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, linked by a similarity of 0.80 or more of five-word shingles: the first by id.

    Rows that repeat an id and a text are one document: of them the least by the other columns stays. Documents without
    words are linked with nothing and stay; so do those with a null id, one for each text.
    """
    found = neardup.near_duplicates(docs, NEAR).filter("first").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text", F.struct(*rest).alias("rest")).groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.min("rest").alias("rest"))
    kept = one.join(found, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    return kept.select("doc_id", "text", "rest.*").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark; documents without words stay."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    clean = docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash")), "left_anti")
    return clean.select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (little-endian unsigned 32-bit integers), with the text they decode to; a null text has no ids and decodes to an empty one."""
    return bpe.encode(docs.select(*COLUMNS), *tokenizer(), decoded=True).select("doc_id", "lang", "source", "n_tokens", "tokens", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: Near-duplicate removal and byte-level BPE aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale-factor folder; each stage's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
