"""The training-data queries against their DuckDB twins."""

import duckdb
import pytest

from lorestone.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    twin = c.execute(ORACLE_SQL[name])
    columns = [d[0] for d in twin.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in twin.fetchall())
