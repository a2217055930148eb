"""Corpus preparation: quality rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import pipeline
from veilspark.llm.common import materialise

#: (name, function) of each stage; a function takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.
STAGES = [
    ("quality_rules", pipeline.quality_rules_stage),
    ("ngram_jaccard_join", pipeline.jaccard_stage),
    ("suffix_dedup", pipeline.suffix_stage),
    ("benchmark_decontamination", pipeline.decontaminate_stage),
    ("best_fit_packing", pipeline.packing_stage),
]
#: Suffix hashes, edit distances and subword tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
