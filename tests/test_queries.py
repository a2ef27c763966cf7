"""Every registered query of the document operators against its DuckDB SQL, or, without SQL, for its own rules."""

import datetime
import math
import os

import duckdb
import pytest

from skein.plans import catalog as _catalog  # noqa: F401
from skein.plans import derived as _derived  # noqa: F401
from skein.plans import live as _live  # noqa: F401
from skein.plans import registry as catalog
from skein.plans import splits as _splits  # noqa: F401
from skein.plans import steps as _steps  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)
    if isinstance(a, datetime.datetime):
        return a.replace(tzinfo=None) == b.replace(tzinfo=None)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=lambda r: [str(v) for v in r])
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(([r[k] for k in at] for r in rel.fetchall()), key=lambda r: [str(v) for v in r])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows, "nothing came out"
    assert any(any(v not in (None, "", 0, False) for v in r) for r in rows), "only empty values"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
