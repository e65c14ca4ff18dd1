"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver repeats this at sf0.01; ``scripts/check_oracle.py`` runs any sf)."""

import duckdb
import pytest

from paths import SF_SMALL
from panelkit.plans import registry

registry.load_all()

import importlib.util  # noqa: E402
import os  # noqa: E402

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(__file__), "..", "scripts", "check_oracle.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        assert len(df.columns) > 0
        return
    cur = con.execute(registry.ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert check.rows_of(df.columns, rows) == check.rows_of(dcols, drows)
