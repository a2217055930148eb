"""Texts and request tables in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.validators import request_error


def read_texts(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    """Any source that Spark reads; ``text`` gives a column ``value``."""
    return spark.read.format(source).options(**options).load(path)


def split_requests(requests: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the others with the reason (column error). Bad rows never fail a job."""
    col = lambda name: F.col(name) if name in requests.columns else None
    checked = requests.withColumn("error", request_error(F.col(text_col), col("score_threshold"), col("keep_prefix"), col("keep_suffix")))
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def parse_form(df: DataFrame) -> DataFrame:
    """Form fields of image requests: JSON arrays of types and allowed texts, and a colour as R,G,B."""
    return df.withColumns({
        "entities": F.from_json("entities", "array<string>"), "allow_list": F.from_json("allow_list", "array<string>"),
        "fill_color": F.transform(F.split("fill_color", ","), lambda x: F.try_to_number(F.trim(x), F.lit("999")).cast("int")),
    })


def envelope(df: DataFrame, data: str, error: str | None = None) -> DataFrame:
    """code, message, data of a response for each row: 200, or 400 with the error's text."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.select(F.when(failed, 400).otherwise(200).alias("code"), F.when(failed, F.col(error) if error else F.lit("")).otherwise("success").alias("message"), F.when(~failed, F.col(data)).alias("data"))


def health(spark: SparkSession) -> DataFrame:
    """One row: whether the engine answers, its version and that of Spark."""
    from .. import __version__

    return spark.range(1).select(F.lit("healthy").alias("status"), F.lit(__version__).alias("version"), F.version().alias("engine"))


def entity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in C.ENTITIES], "entity_type string")


def mosaic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.MOSAIC_STYLES), "name string, description string")


def write_json(df: DataFrame, path: str, column: str = "result") -> None:
    """One JSON object on each line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
