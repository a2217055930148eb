"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veilspark.plans import catalog

QUERIES = ("text_anonymize", "text_anonymize_cards_mail", "bank_card_detect", "email_mask", "phone_detect", "id_card_validate", "deny_list", "tokenize_fallback", "priority_resolve", "pii_report", "pages_email_mask")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the JVM's readers
    found = catalog.queries()
    times = {}
    for name in QUERIES:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "texts_per_sec": round(texts / times["text_anonymize"], 1), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
