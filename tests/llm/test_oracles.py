import duckdb
import pytest

from plumage.llm.queries import oracle_sql, queries
from tests.test_oracle import TABLES, compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    df = queries()[name](spark, sf_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], cols, want) == 0
