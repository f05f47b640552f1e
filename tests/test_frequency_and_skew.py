import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdsignal.operators.frequency import _binned, frequent_keys, value_frequencies, weighted_profile
from crowdsignal.operators.skew import hot_keys, join_per_key


@pytest.mark.parametrize("values_per_bin", [20, 100_000])
def test_profiles_against_brute_force(spark, values_per_bin):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, float("nan"), -3.5, 0.0, 1e9, rng.randint(-5, 300) / 4])) for _ in range(4000)]
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in data] + [("novalue", None, "", 0, 0)], "k string, v double, key string, n int, value int")
    out = {r["key"]: r for r in weighted_profile(value_frequencies(df, "k", "v"), values_per_bin=values_per_bin).collect()}
    assert set(out) == {"hot", "a", "b", "novalue"}
    for k in ("hot", "a", "b"):
        own = [v for key, v in data if key == k]
        valid = [v for v in own if v is not None and v == v]
        r = out[k]
        assert (r["n_rows"], r["n_values"], r["n_distinct"]) == (len(own), len(valid), len(set(valid)))
        assert r["mean"] == pytest.approx(statistics.fmean(valid))
        assert (r["min_value"], r["max_value"]) == (min(valid), max(valid))
        most = max(valid.count(v) for v in set(valid))
        assert r["mode"] == min(v for v in set(valid) if valid.count(v) == most)
        assert [r["p25"], r["p50"], r["p90"]] == pytest.approx(list(np.quantile(valid, [0.25, 0.5, 0.9])))
    assert (out["novalue"]["n_rows"], out["novalue"]["n_values"], out["novalue"]["p50"]) == (1, 0, None)


def test_frequent_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [(None, 1)] * 50 + [("b", 2)] * 2 + [(f"x{i}", 3) for i in range(45)], "k string, v int")
    assert [r["key"] for r in frequent_keys(value_frequencies(df, "k", "v")).collect()] == ["a"]
    empty = value_frequencies(df.limit(0), "k", "v")
    assert frequent_keys(empty).count() == 0 and weighted_profile(empty).count() == 0


@pytest.mark.parametrize("rows_per_task", [5, 1_000_000])
def test_join_per_key_is_a_join(spark, rows_per_task, rows):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("cold", 1), ("none", 2), (None, 3)], "k string, x int")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("k <> 'none'").withColumn("y", F.upper("k"))
    assert rows(join_per_key(df, sizes, ["k"], "size", rows_per_task)) == rows(df.join(sizes.drop("size"), "k").select("k", "x", "y"))
    assert join_per_key(df.limit(0), sizes.limit(0), ["k"], "size").count() == 0


def test_hot_keys(spark, rows):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("warm", 1)] * 5 + [("cold", 1), (None, 3)] + [(None, 3)] * 60, "k string, x int")
    assert rows(hot_keys(df, "k", 5)) == [("hot",)] and rows(hot_keys(df, "k", 4)) == [("hot",), ("warm",)]
    assert hot_keys(df, "k").count() == hot_keys(df.limit(0), "k", 0).count() == 0


@pytest.mark.parametrize(("low", "high"), [(0.0, 0.01), (1e9, 1e9 + 1), (-3.0, 3.0)])
def test_no_bin_holds_many_of_a_keys_values(spark, low, high):
    values = spark.range(200_000).select(F.lit("hot").alias("key"), (F.lit(low) + F.rand(3) * (high - low)).alias("value"), F.lit(1).alias("n")).distinct()
    binned = _binned(values, 1000)
    assert binned.groupBy("key", "bin").count().agg(F.max("count")).first()[0] < 200_000 / 100
    edges = binned.groupBy("bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("bin").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:])) and len(edges) > 200
