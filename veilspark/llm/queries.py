"""The operators as queries over the standard tables; production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm_lm, html_extract, jaccard_orders, kn_quality, langid, packing, quality_rules, slots, suffix_dedup
from .common import text_batches
from .oracle import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of doc_id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def op1_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every text under a hidden Markov model of nine tenths of them."""
    return hmm_lm.score(_table(spark, sf_dir, "documents"), _remainder(10) == 0)


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 by virtual slots; law ``bytes``."""
    rows = slots.shard(_table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def op3_host_suffix_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by a model of two thirds of them."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _remainder(3) == 1)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op5_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles overlap by three quarters."""
    return jaccard_orders.join_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text under a model of trusted ones, and whether its language's quantile keeps it."""
    return kn_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certified quality rules for every document, by language."""
    rows = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path() -> str:
    """The byte-level BPE file of the public tokenizers that are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as best fit decreasing finds."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with its edits and place."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 50-byte strings, removed from all but the document with the least id."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_hidden_markov_lm, op2_virtual_slots, op3_host_suffix_extraction, op4_viterbi_language, op5_multi_order_join,
        op6_kneser_ney_quality, op7_risk_controlled_rules, op8_best_fit_packing, op9_qgram_decontamination, op10_suffix_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
