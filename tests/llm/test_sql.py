"""Queries of the training-data operators that SQL can say equal their SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from loopwright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_manifest", "op12_exact", "op13_phrases"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    said = con.sql(ORACLE_SQL[name])
    assert sorted(said.columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in said.columns) for r in df.collect()) == Counter(said.fetchall())
