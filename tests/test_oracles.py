"""Every query with an oracle gives DuckDB's rows on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__
from lendspark import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower()

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canonical(got.select(*columns).collect()) == canonical([[r[i] for i in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", ["random_split", "gbt_scores", "feature_importance"])
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
