"""Queries of requests, settings, custom parts and overlaps. Made inputs as in the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..config import PiiConfig
from ..functions.masks import Rewrite, requested_rewrites
from ..functions.spans import SPANS, find_spans
from ..operators.extraction import ListModel, with_extractions, with_tokens
from ..operators.resolve import best_by_position, drop_contained, merge_phones
from ..sources.texts import envelope, health, split_requests
from ..streaming.pipeline import anonymize_stream, read_texts
from . import pipeline as P
from .catalog import CARDS_AND_MAIL, MAILS, SPAN_ROWS, TALK, _docs, _made, _only, request_rows, validation_rows

REFERENCES = """SELECT o_orderkey, 'see ORD-' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ' and ORD-' || CAST(o_custkey AS STRING) ELSE '' END || ' or u@qq.com' AS text FROM orders"""
#: Spans that often lie at one place, or inside others of their type; some have no score.
CROWDED = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 2 WHEN 0 THEN 'CN_NAME' ELSE 'CN_ADDRESS' END AS entity_type,
 CAST(l_partkey % 3 AS INT) AS s, CAST(l_partkey % 3 + 2 + l_suppkey % 3 AS INT) AS e, CAST(l_quantity AS INT) % 7 / 10.0 AS score FROM lineitem"""
KEY = "0123456789abcdef"
SETTINGS = {"SCORE_THRESHOLD_EMAIL": "0.8", "score_threshold_id_card": "0.4", "SCORE_THRESHOLD_DEFAULT": "0.1", "NAME_DENY_LIST": " and ,, 张三丰"}


class OrderNumbers:
    """A custom recognizer."""

    entities = ("ORDER_NO",)

    def spans(self, text):
        return find_spans(text, r"ORD-\d{4,}", "ORDER_NO", 0.6)


def _rows(df: DataFrame, *keys: str, column: str = "pii_spans") -> DataFrame:
    found = P.entity_rows(df, list(keys), column)
    return found.withColumnsRenamed({"text": "value", "original_text": "value"}).select(*keys, "entity_type", F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"), "score", "value")


def request_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests find that ask for analysis only: their operators play no part."""
    good, _ = split_requests(request_rows(spark, sf_dir))
    return _rows(P.anonymize_requests(good.drop("operators"), config=_only(*CARDS_AND_MAIL)), "doc_id", column="pii_entities")


def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = P.anonymize(_made(spark, sf_dir, MAILS, "customer"), config=_only(C.EMAIL))
    return P.with_json(done).select("c_custkey", "result")


def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = split_requests(validation_rows(spark, sf_dir))
    rows = good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "error"))
    return envelope(rows, "doc_id", "error").select("code", "message", F.coalesce(F.col("data").cast("string"), F.lit("none")).alias("data"))


def custom_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer of the user's own beside the built-in one for mail; its type has no rewrite."""
    config = PiiConfig().add_recognizer(OrderNumbers()).replace(entities=("ORDER_NO", C.EMAIL))
    done = P.anonymize(_made(spark, sf_dir, REFERENCES, "orders"), config=config)
    return done.select("o_orderkey", "anonymized_text", F.size("pii_entities").cast("long").alias("n_entities"))


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names count anywhere, allowed ones are dropped from what the model finds; blanks are no names."""
    config = PiiConfig(entities=(C.NAME,), ie_column="ie").update_name_lists(allow=["", " 李雷 "], deny=[" 张三丰 ", "  ", "and"])
    rows = with_extractions(_made(spark, sf_dir, TALK, "customer"), lambda: ListModel({"姓名": ["张三丰", "李雷"]}))
    return _rows(P.analyze(rows, config=config), "c_custkey")


def extraction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only names are asked for, so no address is found."""
    rows = with_extractions(_made(spark, sf_dir, TALK, "customer"), lambda: ListModel({"姓名": ["张三丰", "李雷"], "地址": ["北京市朝阳区建国路"]}), keys=("姓名",))
    return _rows(P.analyze(rows, config=_only(C.NAME, C.ADDRESS, ie_column="ie")), "c_custkey")


def replace_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, MAILS, "customer")
    return P.anonymize(rows, config=_only(C.EMAIL), rewrites={C.EMAIL: Rewrite("replace", new_value="[MAIL]")}).select("c_custkey", "anonymized_text")


def requested_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask that a request asks for, and an operator that nobody knows, which leaves the default."""
    asked = requested_rewrites({C.EMAIL: {"type": "mask", "keep_prefix": 1, "keep_suffix": 2, "masking_char": "#"}, C.BANK_CARD: {"type": "unknown"}})
    return P.anonymize(_docs(spark, sf_dir), config=_only(*CARDS_AND_MAIL), rewrites=asked).select("doc_id", "anonymized_text")


def encrypt_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted values differ from the plain ones and can be decrypted with the key."""
    hidden = Rewrite("encrypt", key=KEY).apply(C.NAME, F.col("c_name"))
    rows = _docs(spark, sf_dir, "customer").select("c_custkey", "c_name", hidden.alias("hidden"))
    return rows.select("c_custkey", F.aes_decrypt(F.unbase64("hidden"), F.lit(KEY.encode())).cast("string").alias("decrypted"), F.contains("hidden", F.col("c_name")).alias("shown"))


def _grouped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = _made(spark, sf_dir, sql, "lineitem")
    span = F.struct("l_linenumber", F.struct("entity_type", F.col("s").alias("start"), F.col("e").alias("end"), F.col("score").cast("double").alias("score"), F.col("l_linenumber").cast("string").alias("text")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(span)), lambda v: v["x"]).cast(SPANS).alias("spans"))


def _kept(df: DataFrame, spans) -> DataFrame:
    return df.select("l_orderkey", F.inline(spans)).select("l_orderkey", F.col("text").cast("int").alias("l_linenumber"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "score")


def settings_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from settings by name, over made spans."""
    return _kept(_grouped(spark, sf_dir, SPAN_ROWS), P.thresholded(F.col("spans"), PiiConfig.from_env(SETTINGS)))


def position_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_grouped(spark, sf_dir, CROWDED), best_by_position(F.col("spans")))


def contained_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_grouped(spark, sf_dir, CROWDED), drop_contained(F.col("spans")))


def phone_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_grouped(spark, sf_dir, SPAN_ROWS), merge_phones(F.col("spans")))


def tokenize_plugged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer of the user's own; where it fails the rules cut."""

    def make():
        def tokenizer(text: str) -> list[str]:
            if len(text) % 5 == 0:
                raise ValueError(text)
            return text.split(" ")

        return tokenizer

    rows = with_tokens(_docs(spark, sf_dir, "conversations"), make)
    return rows.select("conv_id", "turn", F.array_join("tokens", "|").alias("tokens"))


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a run leaves behind."""
    metrics = Observation(f"texts-{uuid.uuid4().hex}")
    P.observed(P.anonymize(_made(spark, sf_dir, MAILS, "customer"), config=_only(C.EMAIL)), metrics).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([metrics.get], "n_texts long, n_with_pii long, n_entities long")


def stream_email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text plan on a stream of the documents, into files."""
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = _docs(spark, sf_dir).select("doc_id", "text").schema
    stream = read_texts(spark, f"{sf_dir}/documents.parque[t]", schema)  # a pattern: streams take no single file
    anonymize_stream(stream, f"{folder}/out", f"{folder}/state", config=_only(C.EMAIL)).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "anonymized_text")


def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(spark).select("status")


FUNCTIONS = (
    request_analyze, json_results, response_envelope, custom_recognizer, name_lists, extraction_keys, replace_operators, requested_operators, encrypt_rewrite, settings_by_name,
    position_best, contained_drop, phone_merge, tokenize_plugged, request_metrics, stream_email_mask, service_health,
)
