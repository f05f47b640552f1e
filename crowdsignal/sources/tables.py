"""Parquet tables of a data folder, and the views of submissions that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.functions.text import TIMESTAMP_FORMAT, contributor, number


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, least_rows: int = 20_000) -> DataFrame:
    """The table itself if its files give every core a part to read, as large ones do; else its rows dealt out to all cores.

    A file of one row group is read by one task, however much work its rows then make. Small tables are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores and df.count() >= least_rows else df


def bounded_sample(df: DataFrame, id_: str, rows: int, seed: int = 0) -> DataFrame:
    """About ``rows`` rows of a table, and never more than 1.2 times as many; the whole table if it is no larger.

    Rows are chosen by a hash of their id, so the choice depends on neither files nor tasks; few pass the bound on the hash. If more do
    than may, as where one id has many rows, those of least hash are kept, whichever task reads them.
    """
    share = min(1.0, rows / max(1, df.count()))
    if share == 1.0:
        return df
    drawn = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 32))
    return df.where(drawn < int(share * (1 << 32))).orderBy(drawn, id_).limit(rows * 6 // 5)


def timed_submissions(posts: DataFrame) -> DataFrame:
    """(id, contributor, t) once per submission, t in seconds; without nobody and without invalid times.

    Deliveries of one id agree in author and time, so they fall together. Rows without an id count as one submission
    where contributor and time agree.
    """
    t = F.unix_timestamp(F.try_to_timestamp("created", F.lit(TIMESTAMP_FORMAT)))
    return (
        posts.select("id", contributor(F.col("author")).alias("contributor"), t.alias("t"))
        .where("contributor IS NOT NULL AND t IS NOT NULL").distinct()
    )


def scored_submissions(posts: DataFrame) -> DataFrame:
    """(id, contributor, score) once per submission; score is the highest that any delivery has, null if none has."""
    return (
        posts.select("id", contributor(F.col("author")).alias("contributor"), number(F.col("score")).alias("score"))
        .groupBy("id", "contributor").agg(F.max("score").alias("score"))
    )
