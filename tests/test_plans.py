"""Every plan of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from factweave.plans import catalogue, report_catalogue, site_catalogue  # noqa: F401 (adds its plans)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(rows):
    shown = lambda v: "\0" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan_equals_sql(spark, sf_dir, db, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = db.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in order]).collect())) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_has_every_plan(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
