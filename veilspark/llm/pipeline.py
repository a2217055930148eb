"""The stages of the corpus pipeline. Each works on all that its predecessor kept.

Odd rows, the same in all stages: a null text is an empty one; the quality rules reject it for its few words, the others
leave it alone. Empty tables give empty tables. Rows may repeat, ids may be null or repeat, texts may have any length, and
further columns, whatever their names, are handed on by all stages but the last, which returns places only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_orders, packing, quality_rules, suffix_dedup
from .common import materialise
from .queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels, carry=docs.columns).where("kept").select(*[F.col(f"row.{c}") for c in docs.columns])


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages. Documents of which nothing is left go; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = suffix_dedup.remove_repeats(docs, carry=rest).where("length(kept_text) > 0 or n_removed = 0")
    named = kept.select("doc_id", F.col("kept_text").alias("text"), *[F.col(f"row.{c}").alias(c) for c in rest])
    return named.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id. A row that repeats its id and text
    goes too. Rows without an id stay if their class has no document with one."""
    found = materialise(jaccard_orders.join_components(docs), "pipeline-classes")
    repeated = not found.groupBy("doc_id", "text_crc32").count().where("count > 1").isEmpty()
    heads = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("head"), "text_crc32").distinct()
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(heads, docs["doc_id"].eqNullSafe(heads["head"]) & (crc == heads["text_crc32"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 1024 tokens: where each piece of each document goes. A null or empty text is the end id alone."""
    return packing.pack(docs, tokenizer_path())
