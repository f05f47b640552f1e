"""Posts as a stream: resumable scoring of files as they arrive, and daily factor cells with late data.

Progress is kept in the query's checkpoint folder, so a run that stops continues where it was and one that is repeated adds nothing;
each run takes the files that are there and ends (``availableNow``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdsignal.functions.scoring import score_linked
from crowdsignal.operators.factors import polarity
from crowdsignal.sources.posts import normalise_posts


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a path or pattern; ``files_per_trigger`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, partition_by: str | None = None, mode: str = "append") -> None:
    """Write what is available as Parquet and end."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(partition_by) if partition_by else writer).start().awaitTermination()


def score_stream(raw: DataFrame, tickers: DataFrame, scored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A stream of raw submissions to scored rows, as the batch pipeline makes them; no state is kept."""
    return score_linked(normalise_posts(raw), tickers, scored)


def daily_cells_stream(scored: DataFrame, time: str = "created_utc", late: str = "3 days") -> DataFrame:
    """(d, ticker, s, m, n) by UTC day and ticker, rows without one left out; a day is put out once its watermark has passed, and later rows of it are dropped."""
    timed = scored.where("ticker IS NOT NULL").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    cells = timed.groupBy(F.window(time, "1 day"), "ticker").agg(F.coalesce(F.sum(polarity()), F.lit(0.0)).alias("s"), F.avg(polarity()).alias("m"), F.count(F.lit(1)).alias("n"))
    return cells.select(F.to_date("window.start").alias("d"), "ticker", "s", "m", "n")


def throughput(spark: SparkSession, posts: DataFrame, tickers: DataFrame, n: int, scored: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, float]:
    """Seconds and documents a second of scoring the first ``n`` linked posts by id, after one run to warm up."""
    import time

    from crowdsignal.functions.linking import link_posts

    head = link_posts(posts, tickers).orderBy("doc_id").limit(n)

    def once() -> tuple[int, float]:
        began = time.perf_counter()
        return score_linked(head.drop("tickers"), tickers, scored).select("doc_id").distinct().count(), time.perf_counter() - began

    once()
    docs, seconds = once()
    return {"docs": docs, "seconds": seconds, "docs_per_second": docs / seconds if seconds else 0.0}
