from pyspark.sql import functions as F

from crowdsignal.schemas import SCORED
from crowdsignal.sources.posts import normalise_posts
from crowdsignal.streaming.posts import daily_cells_stream, read_stream, run_available, score_stream, throughput


def raw(spark, *ids):
    rows = [(i, f"2021-01-0{k + 1} 10:00:00", "buy AAPL", None, 1.0, "stocks") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, created string, title string, selftext string, score double, subreddit string")


def test_resume_adds_only_new_files(spark, tmp_path):
    tickers = spark.createDataFrame([("AAPL",)], "symbol string")
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    raw(spark, "a", "b").write.parquet(source)
    for _ in range(2):
        run_available(score_stream(read_stream(spark, source, raw(spark, "a").schema, 1), tickers), out, progress, "subreddit")
    assert spark.read.parquet(out).count() == 2
    raw(spark, "c").write.mode("append").parquet(source)
    run_available(score_stream(read_stream(spark, source, raw(spark, "a").schema), tickers), out, progress, "subreddit")
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [f"leukipp/stocks/{x}" for x in "abc"]


def test_cells_wait_for_the_watermark(spark, tmp_path):
    times = ["2021-01-01 10:00:00", "2021-01-01 12:00:00", "2021-01-02 09:00:00", "2021-01-09 00:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(
        F.lit("d").alias("doc_id"), F.lit("x").alias("subreddit"), F.to_timestamp("t").alias("created_utc"), F.lit("T").alias("ticker"), F.lit(False).alias("is_comment"), F.lit(1.0).alias("doc_score"),
        *(F.lit(v).cast("float").alias(c) for c, v in (("score_pos", 0.5), ("score_neg", 0.25), ("score_neu", 0.25))),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run_available(daily_cells_stream(read_stream(spark, str(tmp_path / "in"), SCORED)), str(tmp_path / "out"), str(tmp_path / "progress"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("d").collect()
    assert [(r["d"].day, r["n"], r["s"]) for r in out] == [(1, 2, 0.5), (2, 1, 0.25)]


def test_throughput(spark):
    tickers = spark.createDataFrame([("AAPL",)], "symbol string")
    assert throughput(spark, normalise_posts(raw(spark, "a", "b")), tickers, 1)["docs"] == 1
