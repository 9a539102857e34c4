"""Corpus queries that have a SQL form, against DuckDB."""

import duckdb
import pytest

from brookmill.llm import queries
from brookmill.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, FOLDER)
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(ours.columns) == sorted(names)
    norm = lambda v: round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    a = sorted([tuple(norm(r[c]) for c in sorted(names)) for r in ours.collect()], key=repr)
    b = sorted([tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()], key=repr)
    assert a == b
