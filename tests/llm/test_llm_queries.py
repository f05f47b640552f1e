"""The registered queries of the text problems, on the smallest tables."""

from pathlib import Path

import pytest

from crowdsignal.llm.queries import ORACLE, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["p1_found", "p1_rates", *[n for n in QUERIES if not n.startswith("p1_")]])
def test_query(spark, duck, name, rows):
    out = QUERIES[name](spark, str(FOLDER))
    if name in ORACLE:
        expected = duck.execute(ORACLE[name])
        order = [d[0] for d in expected.description]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(out.columns) == sorted(order)
        assert rows(out.select(*order)) == sorted(expected.fetchall(), key=key)
    else:
        assert out.count() > 0
