"""Streams over the given tables, run to their end, and files written and read back; all in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.functions.scoring import SCORES, score_linked
from crowdsignal.functions.text import NA_VALUES
from crowdsignal.operators.factors import daily_cells
from crowdsignal.plans.posts_queries import ORACLE as POSTS_ORACLE
from crowdsignal.session import scratch_path
from crowdsignal.sources.posts import FORUMS, normalise_posts, read_archive, write_archive, write_scored
from crowdsignal.sources.tables import table
from crowdsignal.streaming.posts import daily_cells_stream, read_stream, run_available, score_stream


def _ran(spark: SparkSession, stream: DataFrame, name: str, runs: int = 1) -> DataFrame:
    folder = scratch_path(spark, name)
    for _ in range(runs):
        run_available(stream, f"{folder}/out", f"{folder}/progress")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _shown(scored: DataFrame) -> DataFrame:
    return scored.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in SCORES})


def stream_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The scoring pipeline as a stream; it is run twice, and the second run adds nothing."""
    schema = table(spark, sf, "submissions_reddit").schema
    raw = read_stream(spark, f"{sf}/submissions_reddit.parque[t]", schema)
    return _shown(_ran(spark, score_stream(raw, table(spark, sf, "tickers")), "scored", runs=2))


def stream_scored_by_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same over several files, two to a batch, so that each batch commits and a run that is stopped goes on from there."""
    source = table(spark, sf, "submissions_reddit")
    path = scratch_path(spark, "arrived")
    source.repartition(6, "id").write.parquet(path)
    raw = read_stream(spark, path, source.schema, files_per_trigger=2)
    return _shown(_ran(spark, score_stream(raw, table(spark, sf, "tickers")), "scored"))


def stream_cells(spark: SparkSession, sf: str) -> DataFrame:
    """F1 on a stream: the days that the watermark has passed come out of it, rows being late by two weeks at most; the cells of those
    that are still open when it ends are aggregated from the table."""
    scored = table(spark, sf, "scored_leukipp")
    rows = read_stream(spark, f"{sf}/scored_leukipp.parque[t]", scored.schema)
    closed = _ran(spark, daily_cells_stream(rows, late=f"{LATE_DAYS} days"), "cells")
    day = F.to_date("created_utc")
    mark = scored.agg(F.max(F.date_trunc("millisecond", F.col("created_utc").cast("timestamp")))).scalar() - F.expr(f"INTERVAL {LATE_DAYS} DAYS")
    rest = daily_cells(scored.where(F.date_add(day, 1).cast("timestamp") > mark).withColumn("trade_date", day))
    return closed.unionByName(rest.select(*closed.columns)).withColumns({c: F.round(c, 6) for c in ("s", "m")})


def archive_posts(spark: SparkSession, sf: str) -> DataFrame:
    """The posts of the main forums written as CSV files and read back in the common schema."""
    root = scratch_path(spark, "archive")
    write_archive(table(spark, sf, "submissions_reddit"), root)
    return read_archive(spark, root)


def scored_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows written by forum, one forum then written again, which replaces its own rows only; read back."""
    scored = score_linked(normalise_posts(table(spark, sf, "submissions_reddit")), table(spark, sf, "tickers"))
    path = scratch_path(spark, "sink")
    write_scored(scored, path)
    write_scored(scored.where(F.col("subreddit") == FORUMS[0]), path)
    return _shown(spark.read.schema(scored.schema).parquet(path))


LATE_DAYS = 14

QUERIES = {f.__name__: f for f in (stream_scored, stream_scored_by_files, stream_cells, archive_posts, scored_sink)}

_CELL = lambda c: "CASE WHEN {0} NOT IN ({1}) THEN {0} END AS {0}".format(c, ", ".join(f"'{v}'" for v in NA_VALUES))
_ARCHIVE = "(SELECT subreddit, score, {} FROM submissions_reddit WHERE subreddit IN ({}))".format(", ".join(map(_CELL, ("id", "created", "title", "selftext"))), ", ".join(f"'{f}'" for f in FORUMS))

ORACLE = {
    "stream_scored": POSTS_ORACLE["scored_pipeline"],
    "stream_scored_by_files": POSTS_ORACLE["scored_pipeline"],
    "scored_sink": POSTS_ORACLE["scored_pipeline"],
    "archive_posts": POSTS_ORACLE["posts_normalise"].replace("FROM submissions_reddit", f"FROM {_ARCHIVE}"),
    "stream_cells": """SELECT CAST(created_utc AS DATE) AS d, ticker, round(coalesce(sum(p), 0), 6) AS s, round(avg(p), 6) AS m, count(*) AS n
      FROM (SELECT *, CAST(score_pos AS DOUBLE) - CAST(score_neg AS DOUBLE) AS p FROM scored_leukipp WHERE created_utc IS NOT NULL AND ticker IS NOT NULL) GROUP BY 1, 2""",
}
