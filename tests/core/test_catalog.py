"""Every registered query runs on the smallest tables, and equals its SQL where it has one."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from loopwright.catalog import ORACLE_SQL, QUERIES
from loopwright.operators import solver
from loopwright.plans import views as views_module
from loopwright.schema import Config

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    def value(x):
        x = None if isinstance(x, float) and math.isnan(x) else x
        return round(x, 3) if isinstance(x, float) else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr), columns


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n in ORACLE_SQL])
def test_query_equals_its_sql(spark, views, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain([[r[c] for c in columns] for r in df.collect()], columns)
    said = views.sql(ORACLE_SQL[name])
    order = [said.columns.index(c) for c in sorted(said.columns)]
    assert got == plain([[r[i] for i in order] for r in said.fetchall()], sorted(said.columns))


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n not in ORACLE_SQL])
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_solver_queries_read_the_whole_table_and_anneal_in_full(spark, monkeypatch):
    keys = [r[0] for r in duckdb.sql(f"SELECT c_custkey FROM '{SF}/customer.parquet'").fetchall()]
    sizes = Counter(str(k // views_module.NEIGHBOURHOOD) for k in keys)
    asked, sweep = [], solver.sweep
    monkeypatch.setattr(solver, "sweep", lambda *args: asked.append(args) or sweep(*args))
    rows = QUERIES["solve_partition"](spark, SF).collect()
    assert asked[0][3] == Config().iterations == 8000
    assert len(sizes) > 1 and max(sizes.values()) <= views_module.NEIGHBOURHOOD
    housed = Counter()
    for r in rows:
        housed[r["area"], r["run"]] += r["houses"]
    assert housed == {(area, run): n for area, n in sizes.items() for run in (0, 1)}
    stops = Counter()
    for r in QUERIES["solve_tours"](spark, SF).collect():
        stops[r["area"]] += r["stops"]
    assert stops == sizes
    pairs = {(r["i"], r["j"]) for r in QUERIES["dist_house_pairs"](spark, SF).collect()}
    assert {(i, j) for i, j in pairs if i != j} == {(str(i), str(j)) for i in keys for j in keys if i != j and i // views_module.NEIGHBOURHOOD == j // views_module.NEIGHBOURHOOD}
