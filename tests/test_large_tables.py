"""What shows only in tables larger than those of the tests: large keys, rows for many tasks."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark import constants as C
from veilspark.functions import validators as V
from veilspark.functions.spans import find_spans
from veilspark.operators.resolve import by_priority
from veilspark.plans import catalog
from veilspark.plans import pipeline as P

DIR = "/root/testdata/sf0.001"
KEYS = [0, 1, 65535, 65536, 65538, 65541, 16777219, 2**40 + 6]


def both(spark, folder, table, rows, kind, name):
    """Rows of a query, and of its SQL, over one made table."""
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    listed = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    return listed(catalog.queries()[name](spark, str(folder)).toPandas()), listed(con.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["image_entity_rows", "image_redact", "image_request_redact"])
def test_images_of_large_keys(spark, tmp_path, name):
    rows, other = both(spark, tmp_path, "customer", [(k,) for k in KEYS], "c_custkey long", name)
    assert rows == other


def test_orders_that_occur_twice(spark, tmp_path):
    orders = [(k, k * 7) for k in range(200)]
    rows, other = both(spark, tmp_path, "orders", orders + orders[:150], "o_orderkey long, o_custkey long", "id_card_detect")
    assert rows == other and len(set(rows)) < len(rows)


def test_birth_dates_without_a_parser(spark):
    """All days around each month's end; a parser throws for each wrong one, which costs most of the time of a repair."""
    values = [f"{y}{m:02d}{d:02d}" for y in (1896, 1899, 1900, 1904, 1999, 2000, 2024, 2025, 2100) for m in range(14) for d in (0, 1, 28, 29, 30, 31, 32)] + ["1990010", "19900101\n", "１９９００１０１", None]
    last = datetime.date(2025, 1, 1)

    def day(v):
        try:
            return v is not None and len(v) == 8 and v.isascii() and datetime.date(1900, 1, 1) <= datetime.date(int(v[:4]), int(v[4:6]), int(v[6:])) <= last
        except ValueError:
            return False

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", V.is_birth_date(F.col("v"), last).alias("ok"))
    assert "timestamp" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.v, r.ok) for r in rows.collect()] == [(v, day(v)) for v in values]


@pytest.mark.parametrize("name", ["context_boost", "email_rules", "phone_detect", "id_card_detect", "id_card_ocr_repair", "passport_detect", "name_lists", "allow_list", "image_entity_rows"])
def test_texts_in_many_tasks(spark, name):
    """The rows of one small file go to all tasks, and what finds spans in them isn't repeated in a filter below."""
    df = catalog.queries()[name](spark, DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert not [x for x in plan.splitlines() if "Filter (" in x and ("RLIKE" in x or "Contains(" in x)]


def test_spans_are_computed_once(spark):
    """A fold over spans takes them as they are; it named them three times, and all that computes them as often."""
    spans = spark.createDataFrame([("a@b.org",)], "text string").select(by_priority(find_spans(F.col("text"), "@", C.EMAIL, 1.0)).alias("p"))
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_phones_inside_other_characters(spark):
    """The rule has no borders but for digits; the SQL of text_anonymize knows cards and mail only."""
    df = spark.createDataFrame([(1, 'token = "18945874088f67dc02ebee7da3"'), (2, "f699e44f19092102589454a79f5d9b")], "doc_id long, text string")
    found = {r.doc_id: [(e.entity_type, e.original_text) for e in r.pii_entities] for r in P.anonymize(df).collect()}
    assert found == {1: [(C.PHONE, "18945874088")], 2: [(C.PHONE, "19092102589")]}
