import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators import quality
from crowdsignal.operators.calendar import closes, session_calendar
from crowdsignal.operators.events import case_study, event_windows, market_returns, mean_car, mean_car_of_all, mention_spikes

D0 = dt.date(2021, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def test_spikes(spark):
    cells = spark.createDataFrame([(day(k), "A", n, m) for k, (n, m) in enumerate([(1, 0.5), (2, 0.5), (10, 0.5)])] + [(day(0), "B", 10, -0.1), (day(0), "C", 2, 0.3)], "d date, ticker string, n bigint, m double")
    out = mention_spikes(cells).collect()
    assert [(r["ticker"], r["n"], round(r["p99"], 6)) for r in out] == [("A", 10, 9.84)]
    assert {r["ticker"] for r in mention_spikes(cells, floor=2.0).collect()} == {"A", "C"}


def test_windows(spark):
    closed_on = {"A": [100.0 * 1.01**k for k in range(40)], "B": [50.0] * 40, "N": [None] * 20 + [7.0] * 20}
    prices = spark.createDataFrame([(day(k), s, c) for s, cs in closed_on.items() for k, c in enumerate(cs)], "date date, symbol string, close double")
    calendar = session_calendar(prices)
    closed = closes(prices, calendar)
    events = spark.createDataFrame([(day(k), t) for k, t in [(10, "A"), (11, "A"), (29, "A"), (30, "A"), (25, "N"), (15, "Z")]], "d date, ticker string")
    out = event_windows(events, closed, calendar)
    assert {(r["d"], r["ticker"]) for r in out.select("d", "ticker").distinct().collect()} == {(day(11), "A"), (day(29), "A")}
    first = out.where(F.col("d") == day(11)).orderBy("offset").collect()
    assert [r["offset"] for r in first] == list(range(-10, 11))
    assert first[0]["ar"] == pytest.approx(0.01 - 0.005) and first[1]["car"] == pytest.approx(2 * (0.01 - 0.005))
    means = {r["offset"]: r for r in mean_car(out).collect()}
    assert means[0]["n_events"] == 2 and means[-10]["se"] == pytest.approx(0, abs=1e-12)
    forums = spark.createDataFrame([("x",), ("y",)], "subreddit string")
    by_forum = {(r["subreddit"], r["offset"]): (r["n_events"], r["mean_car"]) for r in mean_car_of_all(out.withColumn("subreddit", F.lit("x")), forums).collect()}
    assert len(by_forum) == 42 and by_forum["y", 3] == (0, 0.0) and by_forum["x", 3][0] == 2


def test_events_between_sessions_count_as_the_next_one(spark):
    sessions = [k for k in range(60) if day(k).weekday() < 5]
    prices = spark.createDataFrame([(day(k), s, 100.0 + (k * k) % 7 + j) for k in sessions for j, s in enumerate("AB")], "date date, symbol string, close double")
    calendar = session_calendar(prices)
    closed = closes(prices, calendar)
    saturday = next(k for k in range(25, 60) if day(k).weekday() == 5)
    events = spark.createDataFrame([(day(saturday), "A"), (day(saturday + 2), "A"), (day(-3), "A"), (day(90), "A")], "d date, ticker string")
    out = event_windows(events, closed, calendar)
    cars = {d: [r["car"] for r in out.where(F.col("d") == d).orderBy("offset").collect()] for d in (day(saturday), day(saturday + 2))}
    assert out.select("d").distinct().count() == 2 and cars[day(saturday)] == cars[day(saturday + 2)] and len(cars[day(saturday)]) == 21


def test_market_of_a_symbol(spark):
    r = spark.createDataFrame([(0, "SPY", 0.5), (0, "A", 0.1), (1, "A", 0.2)], "i int, ticker string, ret double")
    assert {x["i"]: x["market"] for x in market_returns(r).collect()} == {0: 0.5, 1: None}
    assert {x["i"]: x["market"] for x in market_returns(r, "QQQ").collect()} == {0: pytest.approx(0.3), 1: 0.2}


def test_case_study(spark):
    cells = spark.createDataFrame([(day(0), "A", 5, 0.1), (day(9), "A", 1, 0.1), (day(0), "GME", 1, 0.2), (day(0), "Z", 99, 0.2)], "d date, ticker string, n bigint, m double")
    closed = spark.createDataFrame([(day(0), "A", 1.0), (day(1), "A", 2.0), (day(9), "A", 3.0)], "d date, ticker string, close double")
    out = sorted(map(tuple, case_study(cells, closed, "2021-01-01", "2021-01-05").collect()))
    assert out == [(day(0), "A", 5, 0.1, 1.0), (day(1), "A", 0, None, 2.0)]
    more = closed.union(closed.limit(1).withColumn("ticker", F.lit("GME")))
    assert {r["ticker"] for r in case_study(cells, more, "2021-01-01", "2021-01-05").collect()} == {"GME"}


@pytest.fixture
def posts(spark):
    rows = [("a", "x", "2021-01-01 10:00:00"), ("b", "x", "2021-01-02 10:00:00"), ("c", "y", "2021-01-02 10:00:00")]
    return spark.createDataFrame(rows, "doc_id string, subreddit string, t string").withColumn("created_utc", F.to_timestamp("t")).withColumn("text", F.lit("some text"))


def test_reports(spark, posts):
    forums = spark.createDataFrame([("x",), ("absent",)], "subreddit string")
    assert {r["subreddit"]: r["n_rows"] for r in quality.coverage(posts, forums).collect()} == {"x": 2, "absent": 0}
    daily = quality.daily_counts(posts, ["x", "y"], rolling=2).orderBy("day").collect()
    assert [(r["x"], r["y"], r["total"], r["rolling_mean"]) for r in daily] == [(1, 0, 1, None), (1, 1, 2, 1.5)]
    assert [(r["x"], r["total"]) for r in quality.daily_counts(posts, ["x"]).orderBy("day").collect()] == [(1, 1), (1, 2)]
    scored = spark.createDataFrame([("a", "x", "T", 0.0), ("a", "x", "U", 1.0), ("c", "y", "T", 0.5), ("q", "z", "T", None)], "doc_id string, subreddit string, ticker string, score_pos double")
    rates = {r["subreddit"]: (r["n_posts"], r["n_linked"], r["link_rate"]) for r in quality.link_rates(posts, scored).collect()}
    assert rates == {"x": (2, 1, 0.5), "y": (1, 1, 1.0), "z": (0, 1, None), "TOTAL": (3, 3, 1.0)}
    assert [tuple(r) for r in quality.top_tickers(scored, 1).collect()] == [("T", 3)]
    assert [tuple(r) for r in quality.ticker_shares(scored, [1]).collect()] == [(1, 3, 0.75)]
    assert {(r["subreddit"], r["ticker"]) for r in quality.top_per_forum(scored, 1).collect()} == {("x", "T"), ("y", "T"), ("z", "T")}
    bins = {r["bin"]: r["n"] for r in quality.score_histogram(scored, ["score_pos"], 4).collect()}
    assert bins == {1: 1, 3: 1, 4: 1}
    assert quality.scored_totals(scored).collect()[0]["n_docs"] == 3
    assert quality.scored_totals(scored.limit(0)).collect()[0]["tickers_per_doc"] is None
    busy = posts.withColumn("author", F.lit("me"))
    assert [(r["author"], r["n"]) for r in quality.busy_author_days(busy, over=1).collect()] == [("me", 2)]


def test_daily_counts_of_every_forum(spark):
    rows = [("x", "2021-01-01 10:00:00"), (None, "2021-01-02 10:00:00"), ("y", "2021-01-02 10:00:00"), ("y", "2021-01-02 11:00:00"), ("x", "2021-01-03 10:00:00"), ("x", None)]
    posts = spark.createDataFrame(rows, "subreddit string, t string").withColumn("created_utc", F.to_timestamp("t"))
    out = {(r["subreddit"], r["day"].day): (r["n"], r["rolling_mean"]) for r in quality.daily_forum_counts(posts, rolling=2).collect()}
    assert {k: v[0] for k, v in out.items() if v[0]} == {("x", 1): 1, (quality.NO_FORUM, 2): 1, ("y", 2): 2, ("x", 3): 1, ("TOTAL", 1): 1, ("TOTAL", 2): 3, ("TOTAL", 3): 1}
    assert len(out) == 12 and out["y", 3] == (0, 1.0) and out["x", 1][1] is None and out["TOTAL", 2][1] == 2.0
