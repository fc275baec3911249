"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(rows):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return str(v) if isinstance(v, (bool, str)) else str(float(v)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_twin(spark, twin, name):
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    sql = twin.sql(__spark_entry__.oracle_sql()[name])
    assert columns == sorted(sql.columns)
    assert same(found.select(*columns).collect()) == same(sql.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
