import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables")


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p2_found", "p4_found"} <= set(q)
    df = entry.entry(spark)
    assert df.columns == ["level", "source", "chart_type", "axis", "score", "n_instances", "chart_type_accuracy"] and df.count() > 0


@pytest.mark.parametrize("name", ["c_breakdown", "c_taxonomy", "c_three_way", "c_image_join", "p4_taxonomy"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    flat = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((flat(r) for r in df.select(*cols).collect()), key=key) == sorted(map(flat, want), key=key)
