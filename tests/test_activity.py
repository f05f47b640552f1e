import random

import pytest

from crowdsignal.operators.activity import activity_sessions, event_links, resolve_roots


def brute(events, gap):
    out = []
    for k in {k for k, t in events if k is not None}:
        times = sorted(t for key, t in events if key == k and t is not None)
        for t in times:
            if out and out[-1][0] == k and t - out[-1][2] <= gap:
                out[-1] = (k, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((k, t, t, 1))
    return sorted(out)


def sessions(spark, events, gap=1800):
    df = spark.createDataFrame([(*e, "x", 0, 0) for e in events], "who string, at bigint, key string, t int, n int")
    return sorted(map(tuple, activity_sessions(df, "who", "at", gap).collect()))


def test_random_events(spark):
    rng = random.Random(5)
    events = [(rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randrange(0, 400_000)) for _ in range(1500)]
    events += [(None, 5), ("b", None), ("c", 100), ("c", 100)]
    assert sessions(spark, events) == brute(events, 1800)


def test_boundaries_and_long_chain(spark):
    chain = [("long", i * 1800) for i in range(300)]
    edges = [("e", 0), ("e", 1800), ("e", 3601), ("neg", -5000), ("neg", -3500), ("one", 7)]
    assert sessions(spark, chain + edges) == brute(chain + edges, 1800)
    assert ("long", 0, 299 * 1800, 300) in sessions(spark, chain)


def test_gap_longer_than_a_slice(spark):
    events = [("a", 0), ("a", 9000), ("a", 18_001), ("a", 40_000)]
    assert sessions(spark, events, 9000) == brute(events, 9000)


def test_empty(spark):
    assert sessions(spark, [("a", 1)])[0] == ("a", 1, 1, 1)
    df = spark.createDataFrame([], "who string, at bigint")
    assert activity_sessions(df, "who", "at").count() == 0


def test_cycle_is_an_error(spark):
    links = spark.createDataFrame([("k", 1, 2), ("k", 2, 1)], "key string, node bigint, parent bigint")
    with pytest.raises(ValueError, match="cycle"):
        resolve_roots(links, most_rounds=3)


def test_every_event_is_linked_to_the_one_before(spark, rows):
    day = 86_400
    moments = spark.createDataFrame([("a", t, 1) for t in (5, 1000, day - 10, day + 20, day + 5000)] + [("b", day + 1, 2), ("c", -100, 1), ("c", 50, 1)], "key string, t bigint, n bigint")
    assert rows(event_links(moments, 1800).select("key", "t", "parent")) == sorted(
        [("a", 5, None), ("a", 1000, 5), ("a", day - 10, None), ("a", day + 20, day - 10), ("a", day + 5000, None), ("b", day + 1, None), ("c", -100, None), ("c", 50, -100)],
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


def test_roots_of_links_keep_other_columns(spark, rows):
    links = spark.createDataFrame([("k", i, i - 1, 10 * i) for i in range(1, 40)] + [("m", 7, 3, 1)], "key string, node bigint, parent bigint, n int")
    assert rows(resolve_roots(links).select("key", "node", "root", "n")) == rows(spark.createDataFrame([("k", i, 0, 10 * i) for i in range(1, 40)] + [("m", 7, 3, 1)], links.schema))
