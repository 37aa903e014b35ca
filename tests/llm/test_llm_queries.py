import duckdb
import pytest
from seqloom.llm import queries

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{PATH}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, PATH).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    want = want.df()

    def rows(frame):
        return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert len(got) == len(want)
    clean = lambda x: [r.replace(".0,", ",").replace(".0]", "]") for r in x]
    assert clean(rows(got)) == clean(rows(want))
