import duckdb
import pytest

import __spark_entry__ as entry
from veilspark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LARGE = {"text_anonymize"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "anonymized_text", "n_entities", "entities"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    rows = catalog.queries()[name](spark, DIR).toPandas()
    assert len(rows.columns) and (len(rows) or name in ("bank_card_detect", "deny_list", "email_detect"))
    if name in catalog.oracle_sql():
        other = duck.execute(catalog.oracle_sql()[name]).df()
        columns = sorted(rows.columns)
        assert columns == sorted(other.columns)
        listed = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
        assert listed(rows) == listed(other)
