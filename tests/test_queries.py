"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidewell.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
UNORDERED_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (str, bool)) else plain(float(v)) if not float(v).is_integer() else int(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def test_all_have_sql_but_a_few():
    assert set(QUERIES) - set(ORACLES) == UNORDERED_ONLY and set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = db.execute(ORACLES[name])
    got, want = rows(df.columns, df.collect()), rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(UNORDERED_ONLY))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "confidence", "n", "bytes_read", "bytes_written"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
