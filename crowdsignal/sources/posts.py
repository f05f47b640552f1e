"""Raw posts to the common schema, symbol lists, and the sink for scored rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.functions.text import TIMESTAMP_FORMAT, na_to_null, unicode_strip
from crowdsignal.schemas import require

#: The forums of the archive.
FORUMS = ("wallstreetbets", "stocks", "investing", "options")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings; cells may hold line breaks and doubled quotes, and the usual marks for missing are null."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return raw.select(*(na_to_null(raw[f"`{c}`"]).alias(c) for c in raw.columns))


def read_archive(spark: SparkSession, root: str, forums: Sequence[str] = FORUMS, archive: str = "leukipp") -> DataFrame:
    """Posts of an archive of one ``<forum>/submissions_reddit.csv`` each, in the common schema.

    FileNotFoundError if a forum's file is absent. Only the columns that are used are parsed.
    """
    parts = []
    for forum in forums:
        path = f"{root}/{forum}/submissions_reddit.csv"
        try:
            raw = read_csv(spark, path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from e
            raise
        parts.append(raw.select("id", "created", "title", "selftext", "score", F.lit(forum).alias("subreddit")))
    return normalise_posts(reduce(DataFrame.unionByName, parts), archive)


def write_archive(raw: DataFrame, root: str, forums: Sequence[str] = FORUMS) -> None:
    """Write raw submissions as an archive of CSV files that ``read_archive`` reads; posts of other forums, or of none, are left out.

    A forum's file is a folder of parts. A cell that reads as missing comes back as null.
    """
    for forum in forums:
        own = raw.where(F.col("subreddit") == forum).drop("subreddit", "retrieved_on")
        own.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{root}/{forum}/submissions_reddit.csv")


def normalise_posts(raw: DataFrame, archive: str = "leukipp") -> DataFrame:
    """(doc_id, subreddit, created_utc, text, score, is_comment) of raw submissions.

    Text is the stripped title and body with a blank between, of those that aren't blank. A missing id or forum reads ``nan`` in doc_id, which is
    never null; the forum itself stays null. Times and
    numbers that don't parse are null, as is a score of NaN; rows without text or time are dropped.
    """
    require(raw, "id", "created", "title", "selftext", "score", "subreddit")
    part = lambda c: F.nullif(unicode_strip(F.col(c)), F.lit(""))
    score = F.expr("try_cast(score AS double)")
    some = lambda c: F.coalesce(F.col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    # that a part isn't blank is seen at its first sign, which is cheaper to filter by than the text
    return raw.where(some("title") | some("selftext")).select(
        F.concat(F.lit(f"{archive}/"), F.coalesce("subreddit", F.lit("nan")), F.lit("/"), F.coalesce("id", F.lit("nan"))).alias("doc_id"),
        "subreddit",
        F.try_to_timestamp("created", F.lit(TIMESTAMP_FORMAT)).alias("created_utc"),
        F.concat_ws(" ", part("title"), part("selftext")).alias("text"),
        F.when(~F.isnan(score), score).alias("score"),
        F.lit(False).alias("is_comment"),
    ).where("created_utc IS NOT NULL")


def symbols(tickers: DataFrame) -> DataFrame:
    """The distinct symbols in capitals, a dot written as a dash; null ones dropped."""
    return tickers.select(F.upper(F.replace("symbol", F.lit("."), F.lit("-"))).alias("symbol")).where("symbol IS NOT NULL").distinct()


def write_scored(scored: DataFrame, path: str) -> None:
    """Write scored rows by forum; a forum that is written again replaces its rows only, so a run that is repeated adds none."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subreddit").parquet(path)
