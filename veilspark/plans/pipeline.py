"""Detection and anonymization of text columns: narrow plans without a shuffle, the same in batch and streams."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as C
from ..config import PiiConfig
from ..functions.masks import DEFAULT_REWRITES, Rewrite, mask, mask_email
from ..functions.spans import no_spans
from ..functions.tokenize import boost
from ..operators.recognizers import scan
from ..operators.resolve import by_priority, drop_contained

#: Operators of a request by type.
OPERATORS = "map<string,struct<type:string,keep_prefix:int,keep_suffix:int,masking_char:string,mask_email_domain:boolean>>"
ENTITY = "struct<entity_type:string,start:int,end:int,score:double,original_text:string,anonymized_text:string>"


def thresholded(spans: Column, config: PiiConfig, explicit: Column | None = None) -> Column:
    """The default threshold holds first; then an explicit one (``explicit``: by row, null where there is none), or that
    of the type."""
    floor = F.filter(spans, lambda s: s["score"] >= config.default_threshold)
    if explicit is not None:
        return F.when(explicit.isNull(), thresholded(spans, config)).otherwise(F.filter(floor, lambda s: s["score"] >= explicit))
    if config.score_threshold is not None:
        return F.filter(floor, lambda s: s["score"] >= config.score_threshold)
    limits = dict(config.thresholds)
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else None
    limit = lambda s: F.coalesce(F.element_at(table, s["entity_type"]), F.lit(config.default_threshold)) if table is not None else F.lit(config.default_threshold)
    return F.filter(floor, lambda s: s["score"] >= limit(s))


def resolved_spans(text: Column, scanned: Column, config: PiiConfig, explicit: Column | None = None) -> Column:
    """Scanned spans after duplicates, context, thresholds (``explicit``: by row), the allow list and priorities."""
    spans = drop_contained(scanned)
    if config.context_boost:
        spans = boost(spans, text, C.CONTEXT_WORDS)
    spans = F.filter(spans, lambda s: s["score"] >= config.default_threshold)
    if config.allow_list:
        spans = F.filter(spans, lambda s: ~s["text"].isin(list(config.allow_list)))
    return by_priority(thresholded(spans, config, explicit), config.priorities)


def analyze(df: DataFrame, text_col: str = "text", config: PiiConfig | None = None, out: str = "pii_spans") -> DataFrame:
    """``df`` with the spans of personal data in ``text_col``. Null and empty texts have none."""
    config = config or PiiConfig()
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = df.withColumn(out, scan(text, config))  # a projection of its own: scans run once
    return scanned.withColumn(out, F.when(F.size(out) > 0, resolved_spans(text, F.col(out), config)).otherwise(no_spans()))


def replacement(s: Column, rewrites: Mapping[str, Rewrite]) -> Column:
    """What a span becomes; types without a rule become <TYPE>."""
    value = F.concat(F.lit("<"), s["entity_type"], F.lit(">"))
    for entity, rule in reversed(rewrites.items()):
        value = F.when(s["entity_type"] == entity, rule.apply(entity, s["text"])).otherwise(value)
    return value


def rewritten(text: Column, entities: Column) -> Column:
    """The text with each entity replaced; entities are in order and don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, e: F.struct(e["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, e["start"] - s["at"]), e["anonymized_text"]).alias("out"))
    return F.aggregate(entities, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))


def anonymize(df: DataFrame, text_col: str = "text", config: PiiConfig | None = None, rewrites: Mapping[str, Rewrite] | None = None) -> DataFrame:
    """``df`` with anonymized_text and pii_entities. ``rewrites`` override the defaults by type. A null text stays null."""
    rules = {**DEFAULT_REWRITES, **(rewrites or {})}
    found = analyze(df, text_col, config, "pii_entities")
    entity = lambda s: F.struct(s["entity_type"], s["start"], s["end"], s["score"], s["text"].alias("original_text"), replacement(s, rules).alias("anonymized_text"))
    named = found.withColumn("pii_entities", F.transform("pii_entities", entity).cast(f"array<{ENTITY}>"))
    return named.withColumn("anonymized_text", F.when(F.size("pii_entities") == 0, F.col(text_col)).otherwise(rewritten(F.col(text_col), F.col("pii_entities"))))


def requested(operator: Column, s: Column, default: Column) -> Column:
    """What a span becomes by an operator of a request: mask and fake can be asked for, anything else leaves the default."""
    prefix, suffix, char = F.coalesce(operator["keep_prefix"], F.lit(0)), F.coalesce(operator["keep_suffix"], F.lit(0)), F.coalesce(operator["masking_char"], F.lit("*"))
    hidden = mask(s["text"], prefix, suffix, char)
    hidden = F.when(F.coalesce(operator["mask_email_domain"], F.lit(False)) & s["text"].contains("@"), mask_email(s["text"], prefix, char)).otherwise(hidden)
    made = reduce(lambda out, e: F.when(s["entity_type"] == e, Rewrite("fake").apply(e, s["text"])).otherwise(out), C.ENTITIES, default)
    return F.when(operator["type"] == "mask", hidden).when(operator["type"] == "fake", made).otherwise(default)


def anonymize_requests(requests: DataFrame, text_col: str = "text", config: PiiConfig | None = None) -> DataFrame:
    """:func:`anonymize` for a table of requests whose rows say what they want, in columns that may be missing or null:
    entities (array of types), score_threshold, and operators (:data:`OPERATORS`, by type). Rows are taken to be valid
    (:func:`veilspark.sources.texts.split_requests`); types that nobody knows are never found."""
    config = config or PiiConfig()
    text = F.coalesce(F.col(text_col), F.lit(""))
    explicit = F.col("score_threshold") if "score_threshold" in requests.columns else None
    wanted = F.col("entities") if "entities" in requests.columns else None
    operators = F.col("operators").cast(OPERATORS) if "operators" in requests.columns else None
    found = requests.withColumn("pii_entities", scan(text, config))
    if wanted is not None:
        found = found.withColumn("pii_entities", F.when(wanted.isNull(), F.col("pii_entities")).otherwise(F.filter("pii_entities", lambda s: F.array_contains(wanted, s["entity_type"]))))
    found = found.withColumn("pii_entities", F.when(F.size("pii_entities") > 0, resolved_spans(text, F.col("pii_entities"), config, explicit)).otherwise(no_spans()))

    def entity(s: Column) -> Column:
        new = replacement(s, DEFAULT_REWRITES)
        if operators is not None:
            new = requested(F.try_element_at(operators, s["entity_type"]), s, new)
        return F.struct(s["entity_type"], s["start"], s["end"], s["score"], s["text"].alias("original_text"), new.alias("anonymized_text"))

    named = found.withColumn("pii_entities", F.transform("pii_entities", entity).cast(f"array<{ENTITY}>"))
    return named.withColumn("anonymized_text", F.when(F.size("pii_entities") == 0, F.col(text_col)).otherwise(rewritten(F.col(text_col), F.col("pii_entities"))))


def entity_rows(df: DataFrame, keys: list[str], column: str = "pii_spans") -> DataFrame:
    """One row for each span or entity. An outer generator, as Spark puts a filter of its own below others: with all that
    finds the spans in it, several times over."""
    return df.select(*keys, F.explode_outer(column).alias("_span")).where(F.col("_span").isNotNull()).select(*keys, "_span.*")


def with_json(df: DataFrame, text_col: str = "text", out: str = "result") -> DataFrame:
    """The result object of each row as JSON, as a service would return it."""
    return df.withColumn(out, F.to_json(F.struct(F.col(text_col).alias("original_text"), "anonymized_text", "pii_entities", (F.size("pii_entities") > 0).alias("has_pii"))))


def anonymize_distinct(df: DataFrame, text_col: str = "text", config: PiiConfig | None = None, rewrites: Mapping[str, Rewrite] | None = None) -> DataFrame:
    """As :func:`anonymize`, working once on each distinct text; worth it where the work by text is dear (a model)."""
    texts = df.select(text_col).where(F.col(text_col).isNotNull()).distinct().withColumn("text_hash", F.xxhash64(text_col))
    done = anonymize(texts, text_col, config, rewrites).select(F.col(text_col).alias("done_text"), "text_hash", "anonymized_text", "pii_entities")
    # null texts need no partner and meet no key; a text of many rows is a key that adaptive execution splits
    rows = df.where(F.col(text_col).isNotNull()).withColumn("text_hash", F.xxhash64(text_col))
    joined = rows.join(done, (rows["text_hash"] == done["text_hash"]) & (F.col(text_col) == F.col("done_text")), "left").drop("text_hash", "done_text")
    rest = anonymize(df.where(F.col(text_col).isNull()), text_col, config, rewrites)
    return joined.unionByName(rest.select(*joined.columns))


def observed(df: DataFrame, metrics: Observation, column: str = "pii_entities") -> DataFrame:
    """``df``, with counts that are gathered while an action runs (no pass of their own): rows, rows with an entity, entities."""
    n = F.size(column)
    return df.observe(metrics, F.count(F.lit(1)).alias("n_texts"), F.count_if(n > 0).alias("n_with_pii"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_entities"))


def report(df: DataFrame, keys: list[str], column: str = "pii_entities") -> DataFrame:
    """Counts of entities and of rows with one, by keys and type."""
    rows = df.withColumn("row_id", F.monotonically_increasing_id()).select(*keys, "row_id", F.inline(column))
    each = rows.groupBy(*keys, "entity_type", "row_id").count()
    return each.groupBy(*keys, "entity_type").agg(F.sum("count").alias("n_entities"), F.count(F.lit(1)).alias("n_texts"))
