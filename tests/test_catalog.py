import os

import pytest

from fakturnik.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_every_statement_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.oracle_sql()) > 70


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["first_values", "dates_labelled", "address_parts", "regions_kept", "token_cells", "p4_found", "p4_profile_revised"])
def test_queries_give_the_rows_of_their_statement(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got = catalog.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    text = lambda x: "null" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    mine = sorted(tuple(text(v) for v in r) for r in got.select(*cols).collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert mine == sorted(tuple(text(v) for v in r) for r in want)
