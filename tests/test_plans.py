"""Every query with an SQL text gives that text's rows."""

import duckdb
import pytest

from courtspark.plans import registry
from courtspark.sources.views import GIVEN


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    rows = got.collect()
    assert plain(rows) == plain(want)
    assert rows or name in ("g12_goals",)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
