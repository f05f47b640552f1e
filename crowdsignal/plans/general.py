"""Queries of the general data problems (2 and 4), with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.functions.text import contributor
from crowdsignal.operators.activity import activity_sessions
from crowdsignal.operators.frequency import frequent_keys, value_frequencies, weighted_profile
from crowdsignal.sources.tables import table, timed_submissions

#: The tables of problem 2, the key that is skewed and the value that is described.
PROFILED = (("submissions_reddit", "subreddit", "score"), ("scored_leukipp", "ticker", "doc_score"))


def _over_tables(spark: SparkSession, sf: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    parts = [work(value_frequencies(table(spark, sf, t), k, v)).select(F.lit(t).alias("table_name"), "*") for t, k, v in PROFILED]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least 3 % of their table's rows."""
    return _over_tables(spark, sf, frequent_keys).select("table_name", F.col("key").alias("key_value"))


def p2_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, means, modes and exact percentiles of the score, per forum and per ticker."""
    out = _over_tables(spark, sf, weighted_profile).withColumnRenamed("key", "key_value")
    return out.withColumn("mean", F.round("mean", 6)).withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p90")})


def p2_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """Exact number of contributors per forum, and the rows of the one with most: (forum, contributor) is counted first."""
    posts = table(spark, sf, "submissions_reddit").select("subreddit", contributor(F.col("author")).alias("contributor"))
    freq = value_frequencies(posts, "subreddit", "contributor").where("key IS NOT NULL AND value IS NOT NULL")
    return freq.groupBy(F.col("key").alias("subreddit")).agg(
        F.count(F.lit(1)).alias("n_contributors"), F.sum("n").alias("n_rows"), F.max("n").alias("most_by_one")
    )


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    shown = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    return activity_sessions(timed_submissions(table(spark, sf, "submissions_reddit")), "contributor", "t").select(
        F.col("key").alias("author"), shown("start").alias("session_start"), shown("end").alias("session_end"),
        (F.col("end") - F.col("start")).alias("duration_s"), F.col("n_events").alias("n_posts"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of at least two submissions."""
    return _sessions(spark, sf).where("n_posts >= 2").drop("duration_s")


def p4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions, with their duration in seconds."""
    return _sessions(spark, sf)


QUERIES = {f.__name__: f for f in (p2_found, p2_profiles, p2_contributors, p4_found, p4_sessions)}

_CONTRIBUTOR = "nullif(lower(regexp_replace(trim(author), '^/?u/', '')), '[deleted]')"


def _found(name: str, key: str) -> str:
    return f"SELECT '{name}' AS table_name, {key} AS key_value FROM {name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM {name})"


def _profile(name: str, key: str, value: str) -> str:
    return f"""SELECT '{name}' AS table_name, r.k AS key_value, r.n_rows, n_values, n_distinct, round(mean, 6) AS mean, min_value, max_value,
      mode, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p90, 6) AS p90
    FROM (SELECT {key} AS k, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS n_distinct, avg(v) AS mean, min(v) AS min_value,
        max(v) AS max_value, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90
      FROM (SELECT *, CASE WHEN NOT isnan({value}) THEN {value} END AS v FROM {name}) WHERE {key} IS NOT NULL GROUP BY {key}) r
    LEFT JOIN (SELECT k, v AS mode FROM (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS i
      FROM {name} WHERE {value} IS NOT NULL AND NOT isnan({value}) GROUP BY {key}, {value}) WHERE i = 1) m ON r.k = m.k"""


_SESSIONS = f"""
WITH s AS (SELECT DISTINCT id, {_CONTRIBUTOR} AS c, try_strptime(created, '%Y-%m-%d %H:%M:%S') AS t FROM submissions_reddit),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY c ORDER BY t, id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o
  FROM s WHERE c IS NOT NULL AND t IS NOT NULL),
n AS (SELECT *, sum(o) OVER (PARTITION BY c ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT c AS author, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS session_end,
  CAST(epoch(max(t)) - epoch(min(t)) AS BIGINT) AS duration_s, count(*) AS n_posts FROM n GROUP BY c, k"""

ORACLE = {
    "p2_found": " UNION ALL ".join(_found(t, k) for t, k, _ in PROFILED),
    "p2_profiles": " UNION ALL ".join(_profile(*x) for x in PROFILED),
    "p2_contributors": f"""SELECT subreddit, count(*) AS n_contributors, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS most_by_one FROM
      (SELECT subreddit, {_CONTRIBUTOR} AS c, count(*) AS n FROM submissions_reddit GROUP BY 1, 2) WHERE subreddit IS NOT NULL AND c IS NOT NULL GROUP BY subreddit""",
    "p4_found": f"SELECT author, session_start, session_end, n_posts FROM ({_SESSIONS}) WHERE n_posts >= 2",
    "p4_sessions": _SESSIONS,
}
