"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from driftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations labels embeddings benchmark events orders lineitem customer part supplier nation region".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall()), key=str)
    got = sorted(([plain(r[c]) for c in sorted(names)] for r in rows), key=str)
    assert got == want
