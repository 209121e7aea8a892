"""The queries of the problems over the small tables; those with SQL against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from leafmill.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert rows or name.endswith("_found")
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(rows) == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())
