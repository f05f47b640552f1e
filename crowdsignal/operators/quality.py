"""Data-quality reports over raw, linked and scored posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOTAL = "TOTAL"
#: How the forum of posts without one is named.
NO_FORUM = "(none)"


def coverage(posts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(subreddit, n_rows, first_day, last_day) of each forum; forums of ``expected`` without a row have 0."""
    found = posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("created_utc")).alias("first_day"), F.to_date(F.max("created_utc")).alias("last_day"))
    if expected is None:
        return found
    return expected.select("subreddit").distinct().join(found, "subreddit", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def daily_counts(posts: DataFrame, forums: Sequence[str], rolling: int = 7) -> DataFrame:
    """(day, *forums, total, rolling_mean): posts of each day in some forums, a column each, and of the day in all, those of other forums and of
    none counted; and the mean of the totals over ``rolling`` days that have posts, null before there are as many."""
    of_forum = (F.count_if(F.col("subreddit") == f).alias(f) for f in forums)
    filled = posts.where("created_utc IS NOT NULL").groupBy(F.to_date("created_utc").alias("day")).agg(*of_forum, F.count(F.lit(1)).alias("total"))
    last = W.orderBy("day").rowsBetween(1 - rolling, 0)
    return filled.withColumn("rolling_mean", F.when(F.count("total").over(last) == rolling, F.avg("total").over(last)))


def daily_forum_counts(posts: DataFrame, rolling: int = 7) -> DataFrame:
    """(day, subreddit, n, rolling_mean): posts of each day that has any and of each forum, with 0 where it has none, and of all as
    ``TOTAL``; the mean is of the forum's own counts over ``rolling`` such days, null before there are as many. Posts without a
    forum count as ``NO_FORUM``.
    """
    counts = posts.where("created_utc IS NOT NULL").groupBy(F.to_date("created_utc").alias("day"), F.coalesce("subreddit", F.lit(NO_FORUM)).alias("subreddit")).agg(F.count(F.lit(1)).alias("n"))
    forums = counts.agg(F.array_sort(F.collect_set("subreddit"))).scalar()  # names of forums only
    grid = counts.select("day").distinct().withColumn("subreddit", F.explode(forums))
    filled = grid.join(counts, ["day", "subreddit"], "left").select("day", "subreddit", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = counts.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.lit(TOTAL).alias("subreddit"), "n")
    last = W.partitionBy("subreddit").orderBy("day").rowsBetween(1 - rolling, 0)
    return filled.unionByName(total).withColumn("rolling_mean", F.when(F.count("n").over(last) == rolling, F.avg("n").over(last)))


def scored_totals(scored: DataFrame) -> DataFrame:
    """One row: rows, documents, tickers, and tickers per document."""
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("ticker").alias("n_tickers"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("doc_id")).alias("tickers_per_doc"),
    )


def link_rates(posts: DataFrame, scored: DataFrame) -> DataFrame:
    """(subreddit, n_posts, n_linked, link_rate) per forum, with a total row whose rate is of the totals."""
    linked = scored.groupBy("subreddit").agg(F.count_distinct("doc_id").alias("n_linked"))
    both = posts.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_posts")).join(linked, "subreddit", "full").where("subreddit IS NOT NULL").fillna(0, ["n_posts", "n_linked"])
    rolled = both.rollup("subreddit").agg(F.grouping_id().alias("_g"), F.sum("n_posts").alias("n_posts"), F.sum("n_linked").alias("n_linked"))
    return rolled.select(F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("subreddit")).alias("subreddit"), "n_posts", "n_linked", F.try_divide(F.col("n_linked").cast("double"), F.col("n_posts")).alias("link_rate"))


def top_tickers(scored: DataFrame, k: int = 20) -> DataFrame:
    """(ticker, n) of the most mentioned tickers; of equals, the smaller name first."""
    return scored.where("ticker IS NOT NULL").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ticker").limit(k)


def ticker_shares(scored: DataFrame, ks: Sequence[int] = (20, 50)) -> DataFrame:
    """(k, n, share): rows of the k most mentioned tickers, and their share of all rows."""
    counts = scored.where("ticker IS NOT NULL").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "ticker").limit(max(ks)).withColumn("_place", F.row_number().over(W.orderBy(F.col("n").desc(), "ticker")))
    rows = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("_place") <= F.col("k"))
    total = scored.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("k").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / total.cast("double"))


def top_per_forum(scored: DataFrame, k: int = 10) -> DataFrame:
    """(subreddit, place, ticker, n): the k most mentioned tickers of each forum."""
    counts = scored.where("subreddit IS NOT NULL AND ticker IS NOT NULL").groupBy("subreddit", "ticker").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("subreddit").orderBy(F.col("n").desc(), "ticker"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("subreddit", "place", "ticker", "n")


def busy_author_days(posts: DataFrame, author: str = "author", over: int = 20) -> DataFrame:
    """(author, day, n): authors with more than ``over`` posts on a day; nobody is left out."""
    rows = posts.select(F.col(author).alias("author"), F.to_date("created_utc").alias("day")).where("author IS NOT NULL AND day IS NOT NULL")
    return rows.groupBy("author", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over)


def score_means(scored: DataFrame, columns: Sequence[str] = ("score_pos", "score_neg", "score_neu")) -> DataFrame:
    """(name, mean, lowest, highest) of each column of scores."""
    return _long(scored, columns).groupBy("name").agg(F.avg("x").alias("mean"), F.min("x").alias("lowest"), F.max("x").alias("highest"))


def score_histogram(scored: DataFrame, columns: Sequence[str] = ("score_pos", "score_neg", "score_neu"), bins: int = 40) -> DataFrame:
    """(name, bin, n): counts in ``bins`` equal bins from each column's least to its greatest value, which falls in the last; empty bins are absent."""
    rows = _long(scored, columns)
    spans = rows.groupBy("name").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    place = F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0)) + 1
    return rows.join(F.broadcast(spans), "name").select("name", F.least(place, F.lit(bins)).alias("bin")).groupBy("name", "bin").agg(F.count(F.lit(1)).alias("n"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "name", "x").where("x IS NOT NULL AND NOT isnan(x)")


def spot_check(scored: DataFrame, posts: DataFrame, n: int = 10, seed: int = 7, chars: int = 80) -> DataFrame:
    """``n`` different scored rows, picked by a hash of document, ticker and seed, with the head of their text.

    The least hashes are wanted, so rows with greater ones are dropped where they are read: hashes are even, and the bound lets some
    twenty times ``n`` pass of the estimated number of different pairs. What is left of the posts is those of the picked documents.
    """
    named = scored.select("doc_id", "subreddit", "ticker", "score_pos", "score_neg", "score_neu", F.md5(F.concat_ws("|", "doc_id", "ticker", F.lit(str(seed)))).alias("_hash"))
    share = F.least(F.lit(1.0), F.try_divide(F.lit(20.0 * n), named.agg(F.approx_count_distinct("_hash")).scalar().cast("double")))
    low = named.where(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") <= share * float(1 << 32))
    picked = low.distinct().orderBy("_hash", "doc_id", "ticker", "subreddit", "score_pos", "score_neg", "score_neu").limit(n).drop("_hash")
    wanted = posts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")  # n rows at most
    heads = wanted.groupBy("doc_id").agg(F.min(F.substring("text", 1, chars)).alias("text_head"))
    return picked.join(heads, "doc_id", "left").withColumn("raw_id", F.element_at(F.split("doc_id", "/"), -1))
