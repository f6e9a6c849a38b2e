"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

from tamis.registry import QUERIES, SQL
from tamis.sources.views import TABLES


#: Queries without SQL; tests/test_units.py has them against numpy.
TESTED_ELSEWHERE = {"embedding_rank"}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0
    return v


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in SQL:
        assert name in TESTED_ELSEWHERE
        return
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    is_float = {d[0]: str(d[1]) in ("DOUBLE", "FLOAT") for d in want.description}
    assert is_float == {c: t in ("double", "float") for c, t in df.dtypes}
    want = rows(want.fetchall(), columns)
    got = rows([tuple(r) for r in got], df.columns)
    assert len(got) == len(want) and got == want
