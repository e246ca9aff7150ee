"""The queries of this subpackage that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from brindle.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("null" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(db.sql(queries.oracle_sql()[name]).df())
