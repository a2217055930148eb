"""The text plan on streams. It keeps no state, so it runs in append mode unchanged."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import PiiConfig
from ..functions.masks import Rewrite
from ..plans.pipeline import anonymize


def read_texts(spark: SparkSession, path: str, schema: str, source: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def anonymize_stream(
    stream: DataFrame, path: str, checkpoint: str, text_col: str = "text", config: PiiConfig | None = None, rewrites: Mapping[str, Rewrite] | None = None, sink: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Anonymize what arrives and append it to ``path``; exactly once for file sinks. ``once``: all there is, then stop."""
    writer = anonymize(stream, text_col, config, rewrites).writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
