"""Every query by its name: columns and types of its contract, one row for each row of its table, and SQL where there is some."""

import duckdb
import pandas as pd
import pytest

from veilspark.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op2": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op3": "page_id:bigint url:string text:string n_chars:bigint",
    "op4": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op5": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op6": "doc_id:bigint perplexity:double kept:boolean",
    "op7": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op8": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op9": "doc_id:bigint item_id:bigint edits:int",
    "op10": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract(spark, name):
    df = queries.queries()[name](spark, DIR)
    op = name.split("_")[0]
    types = dict(df.dtypes)
    assert all(types[c.split(":")[0]] == c.split(":")[1] for c in COLUMNS[op].split())
    rows = df.toPandas()
    table, key = ("pages", "page_id") if op == "op3" else ("documents", "doc_id")
    ids = duckdb.sql(f"SELECT {key} FROM '{DIR}/{table}.parquet'").df()[key].tolist()
    if op == "op8":
        assert set(rows[key]) == set(ids)
    elif op != "op9":
        assert sorted(rows[key]) == sorted(ids)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        other = con.execute(queries.oracle_sql()[name]).df()
        columns = sorted(rows.columns)
        listed = lambda df: sorted([None if pd.isna(v) else str(v) for v in r].__repr__() for r in df[columns].astype(object).itertuples(index=False))
        assert listed(rows) == listed(other)
