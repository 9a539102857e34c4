"""Every relational query against its SQL form in DuckDB."""

import duckdb
import pytest

from brookmill.plans import catalog
from brookmill.sources.tables import TABLES

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda v: float(f"{v:.15g}") if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module", params=FOLDERS)
def duck(request):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{request.param}/{name}.parquet')")
    return con, request.param


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    duck, folder = duck
    ours = catalog.QUERIES[name](spark, folder)
    got = duck.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(ours.columns) == sorted(names)
    assert canonical([tuple(r) for r in ours.collect()], ours.columns) == canonical(got.fetchall(), names)
