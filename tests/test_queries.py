"""Every registered query runs; those with SQL agree with it on the smallest tables."""

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = plans.oracle_sql().get(name)
    if sql:
        r = duck.sql(sql)
        at = [r.columns.index(c) for c in columns]
        assert got == sorted((tuple(_norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_llm_is_separate():
    import pathlib

    for p in pathlib.Path("tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text()
