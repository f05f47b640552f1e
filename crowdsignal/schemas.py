"""Schemas of the tables that the library reads and makes, and the check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


RAW_SUBMISSIONS = _schema("id string, author string, created string, title string, selftext string, score double, num_comments bigint")
POSTS = _schema("doc_id string, subreddit string, created_utc timestamp, text string, score double, is_comment boolean")
SCORED = _schema(
    "doc_id string, subreddit string, created_utc timestamp, ticker string, is_comment boolean, doc_score double, score_pos float, score_neg float, score_neu float"
)
TICKERS = _schema("symbol string, name string, sector string")
PRICES = _schema("date date, symbol string, close double")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table itself, if it has the columns; else a ValueError that names those it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {lacking} are missing; there are {df.columns}")
    return df
