"""One query per operator: each applies it to its whole table and derives the digest
columns of its contract from the operator's outputs."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlab.llm import bpe, collocations, conversation_repair, html_layout, jaccard_tiles, language_id, latent_decontamination, line_runs, ordinal_quality, phrase_dedup, quality_rules, secret_scan, token_counts
from growthlab.llm.oracles import ORACLES  # noqa: F401
from growthlab.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_phrase_dedup(spark, sf_dir):
    rows = phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_latent_decontamination(spark, sf_dir):
    return latent_decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_secret_scan(spark, sf_dir):
    rows = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op4_line_runs(spark, sf_dir):
    rows = line_runs.repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_bpe(spark, sf_dir):
    rows = bpe.encode_decode(table(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_jaccard_tiles(spark, sf_dir):
    return jaccard_tiles.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark, sf_dir):
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "full/1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.POLICIES["base/1"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), "kept", "fail_bits")


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_id.identify(docs)
    return rows.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_ordinal_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, n_slots = ordinal_quality.train(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.score(docs, model, n_slots).select("doc.doc_id", "expected_grade", "p_ok", "p_good", "kept")


@query
def op10_html_layout(spark, sf_dir):
    return html_layout.render_pages(table(spark, sf_dir, "pages"))


@query
def op12_token_counts(spark, sf_dir):
    rows = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc.doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations")).drop("repaired")


@query
def op11_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents")).drop("cut")
