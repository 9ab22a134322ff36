"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.

1. ``quality``        documents that the ordinal classifier rejects go (P(good) below one half)
2. ``line_dedup``     lines found in three documents or more stay in the one with the largest id
3. ``near_copies``    of each component of the 5-word Jaccard join the smallest id stays
4. ``decontaminate``  documents that hold a benchmark item go
5. ``tokenize``       the rest becomes token ids; decoding restores the text

Rows that no decision concerns pass unchanged; a row without an id has no copies and is
kept by stages 3 and 4, where decisions are by id.  Rows that share an id stand and fall
together there.  ``n_chars`` follows the text.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from growthlab.llm import bpe, jaccard_tiles, latent_decontamination, line_runs, ordinal_quality  # noqa: E402
from growthlab.session import ensure_checkpoint_dir, scratch_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (doc_id, distinct)."""
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, n_slots = ordinal_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal_quality.score(docs.select(*COLUMNS), model, n_slots).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_runs.repeated_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    size = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))
    return rows.select("doc.doc_id", text.alias("text"), "doc.lang", "doc.source", size.alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_tiles.jaccard_components(docs)
    return _without(docs.select(*COLUMNS), found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = latent_decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs.select(*COLUMNS), leaks.select("doc_id").distinct())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256)."""
    rows = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("tokenize", tokenize)]
#: The classifier, the latent search and the merges have no SQL form; tests/llm compares
#: the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
