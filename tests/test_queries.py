"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from marquee.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def plain(df, names):
    rows = df[names].astype(object).where(df[names].notna(), None).values.tolist()
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) > 0
    names = sorted(got.columns)
    stamps = lambda df: df.assign(**{c: df[c].astype("datetime64[us]").astype(str) for c in df if "datetime" in str(df[c].dtype)} | {c: df[c].map(lambda x: None if x is None or x != x else str(x)[:10]) for c in df if c in ("day", "weekend")})
    assert plain(stamps(got), names) == plain(stamps(want), names)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
