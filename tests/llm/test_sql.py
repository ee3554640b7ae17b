import duckdb
import pytest

from tessera.llm import queries
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and len(want) > 100
    assert sorted(map(tuple, got[names].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[names].astype(str).to_numpy().tolist()))
