"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import pytest

from crowdsignal.plans import factor_queries, general, posts_queries, stream_queries

FOLDER = Path("/root/testdata/sf0.001")
PARTS = (general, posts_queries, factor_queries, stream_queries)
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def table(frame):
    def cell(x):
        if x is None or x != x or str(x) in ("<NA>", "NaT"):
            return "null"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{0.0 if math.isclose(x, 0, abs_tol=5e-7) else x:.6f}"
        return str(x)

    frame = frame[sorted(frame.columns)]
    frame = frame.astype({c: str for c, t in frame.dtypes.items() if str(t).startswith("datetime")})
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for part in PARTS for n in part.QUERIES])
def test_query(spark, duck, name):
    part = next(p for p in PARTS if name in p.QUERIES)
    out = part.QUERIES[name](spark, str(FOLDER))
    if name not in part.ORACLE:
        assert out.columns and out.count() >= 0
        return
    ours, theirs = out.toPandas(), duck.execute(part.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table(ours) == table(theirs)


@pytest.mark.parametrize("name", ["trade_date_roll", "rank_ic_summary", "rank_ic_by_forum_weekly", "ls_backtest_summary", "ols_pooled_by_forum", "event_car", "event_car_by_forum", "xs_spearman", "p2_found", "p2_profiles", "p4_found", "link_rate_rollup", "scored_pipeline"])
def test_plans_have_no_join_without_a_key(spark, name):
    part = next(p for p in PARTS if name in p.QUERIES)
    plan = part.QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_read_only_what_is_used(spark):
    plan = posts_queries.bot_author_days(spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<author:string,created:string>" in plan
    plan = posts_queries.top10_per_forum(spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(subreddit), IsNotNull(ticker)]" in plan and "struct<subreddit:string,ticker:string>" in plan


def test_the_library_imports_no_llm_code():
    import crowdsignal

    root = Path(crowdsignal.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "crowdsignal.llm" in p.read_text()]
