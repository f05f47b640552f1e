"""Queries over raw, linked and scored posts: normalising, linking, scoring and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdsignal.functions.linking import BLACKLIST, fan_out, link_posts
from crowdsignal.functions.scoring import NEGATIVE, POSITIVE, SCORES, lexicon_model, lexicon_scores, model_scores, score_linked
from crowdsignal.functions.text import contributor
from crowdsignal.operators import quality
from crowdsignal.sources.posts import FORUMS, normalise_posts, symbols
from crowdsignal.sources.tables import table


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_posts(table(spark, sf, "submissions_reddit"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scored_leukipp")


def posts_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """The common schema."""
    return _posts(spark, sf)


def symbol_list(spark: SparkSession, sf: str) -> DataFrame:
    """The whitelist."""
    return symbols(table(spark, sf, "tickers"))


def ticker_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per post and ticker."""
    return fan_out(link_posts(_posts(spark, sf), table(spark, sf, "tickers"))).select("doc_id", "ticker")


#: How many linked posts are taken where only the first are wanted.
FIRST = 50


def first_linked(spark: SparkSession, sf: str) -> DataFrame:
    """The first linked posts by id, as a run that stops early takes them, with their number of tickers; a top-k, so nothing is sorted whole."""
    linked = link_posts(_posts(spark, sf), table(spark, sf, "tickers"))
    return linked.select("doc_id", F.size("tickers").alias("n_tickers")).orderBy("doc_id").limit(FIRST)


def _tone(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in SCORES))


def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    """U2 by expressions."""
    return _tone(lexicon_scores(_posts(spark, sf).select("doc_id", "text")))


def model_score(spark: SparkSession, sf: str) -> DataFrame:
    """U1, U2 through the adapter for models in Python."""
    return _tone(model_scores(_posts(spark, sf).select("doc_id", "text"), "text", "lexicon", lexicon_model))


def scored_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Link, filter, score once, fan out."""
    out = score_linked(_posts(spark, sf), table(spark, sf, "tickers"))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in SCORES})


def forum_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Q1, A10: rows and days per forum."""
    return quality.coverage(_posts(spark, sf).where("subreddit IS NOT NULL"))


def forum_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The four main forums side by side, and total and rolling mean of all posts of the day; ``forum_daily_long`` has a row per forum."""
    return quality.daily_counts(_posts(spark, sf), FORUMS).withColumn("rolling_mean", F.round("rolling_mean", 6))


def forum_daily_long(spark: SparkSession, sf: str) -> DataFrame:
    """Posts per day of every forum and of all, each with its rolling mean."""
    return quality.daily_forum_counts(_posts(spark, sf)).withColumn("rolling_mean", F.round("rolling_mean", 6))


def scored_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Q3, A6."""
    return quality.scored_totals(_scored(spark, sf)).withColumn("tickers_per_doc", F.round("tickers_per_doc", 6))


def link_rate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Q4, J8, A9."""
    return quality.link_rates(_posts(spark, sf), _scored(spark, sf)).withColumn("link_rate", F.round("link_rate", 6))


def ticker_top20(spark: SparkSession, sf: str) -> DataFrame:
    """Q5, A7, T2."""
    return quality.top_tickers(_scored(spark, sf), 20)


def ticker_share(spark: SparkSession, sf: str) -> DataFrame:
    """Q5, A18."""
    return quality.ticker_shares(_scored(spark, sf)).withColumn("share", F.round("share", 6))


def top10_per_forum(spark: SparkSession, sf: str) -> DataFrame:
    """Q6, W12."""
    return quality.top_per_forum(_scored(spark, sf), 10)


#: More than so many posts a day look like a bot's; the default of the operator is 20.
BUSY = 3


def bot_author_days(spark: SparkSession, sf: str) -> DataFrame:
    """Q7, A8."""
    raw = table(spark, sf, "submissions_reddit").select(contributor(F.col("author")).alias("author"), F.try_to_timestamp("created", F.lit("yyyy-MM-dd HH:mm:ss")).alias("created_utc"))
    return quality.busy_author_days(raw, over=BUSY)


def score_means(spark: SparkSession, sf: str) -> DataFrame:
    """Q8, A10."""
    return quality.score_means(_scored(spark, sf)).withColumn("mean", F.round("mean", 6))


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Q8, A16."""
    return quality.score_histogram(_scored(spark, sf))


def spot_check(spark: SparkSession, sf: str) -> DataFrame:
    """Q9, T4, J9, P16."""
    return quality.spot_check(_scored(spark, sf), _posts(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        posts_normalise, symbol_list, ticker_mentions, first_linked, lexicon_score, model_score, scored_pipeline, forum_coverage, forum_daily_counts, forum_daily_long, scored_totals, link_rate_rollup,
        ticker_top20, ticker_share, top10_per_forum, bot_author_days, score_means, score_histogram, spot_check,
    )
}

_SPACE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_strip = lambda c: f"nullif(regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g'), '')"
_POSTS = f"""
posts AS (SELECT * FROM (SELECT 'leukipp/' || coalesce(subreddit, 'nan') || '/' || coalesce(id, 'nan') AS doc_id, subreddit, try_strptime(created, '%Y-%m-%d %H:%M:%S') AS created_utc,
  concat_ws(' ', {_strip("title")}, {_strip("selftext")}) AS text, CASE WHEN NOT isnan(score) THEN score END AS score, false AS is_comment
  FROM submissions_reddit) WHERE length(text) > 0 AND created_utc IS NOT NULL)"""
_ALLOWED = "allowed AS (SELECT DISTINCT upper(replace(symbol, '.', '-')) AS ticker FROM tickers WHERE symbol IS NOT NULL AND upper(replace(symbol, '.', '-')) NOT IN ({}))".format(
    ", ".join(f"'{w}'" for w in BLACKLIST)
)
_NUMBERED = "numbered AS (SELECT *, row_number() OVER () AS k FROM posts)"
_FOUND = r"found AS (SELECT DISTINCT k, ticker FROM (SELECT k, unnest(regexp_extract_all(text, '([A-Z]{2,5})(?:[^\pL\pN_]|$)', 1)) AS ticker FROM numbered) JOIN allowed USING (ticker))"
_LINKED = f"WITH {_POSTS}, {_ALLOWED}, {_NUMBERED}, {_FOUND}"
_count = lambda words: f"len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in words)})))"
_TONE = f"""
tone AS (SELECT *, CAST({_count(POSITIVE)} AS DOUBLE) AS a, CAST({_count(NEGATIVE)} AS DOUBLE) AS b FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z]+') AS words FROM posts))"""
_SCORES = ", ".join(f"round(CAST(CAST({x} / (a + b + 1) AS FLOAT) AS DOUBLE), 6) AS {c}" for x, c in zip(("a", "b", "1.0"), SCORES, strict=True))
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM scored_leukipp WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in SCORES)
_DAY_COUNTS = ", ".join(f"count(*) FILTER (WHERE subreddit = '{f}') AS {f}" for f in FORUMS)

ORACLE = {
    "posts_normalise": f"WITH {_POSTS} SELECT * FROM posts",
    "symbol_list": "SELECT DISTINCT upper(replace(symbol, '.', '-')) AS symbol FROM tickers WHERE symbol IS NOT NULL",
    "ticker_mentions": f"{_LINKED} SELECT doc_id, ticker FROM found JOIN numbered USING (k)",
    "first_linked": f"{_LINKED} SELECT doc_id, count(*) AS n_tickers FROM found JOIN numbered USING (k) GROUP BY k, doc_id ORDER BY doc_id LIMIT {FIRST}",
    "scored_pipeline": f"{_LINKED}, {_TONE.replace('FROM posts', 'FROM numbered')} SELECT doc_id, subreddit, created_utc, ticker, is_comment, score AS doc_score, {_SCORES} FROM found JOIN tone USING (k)",
    "lexicon_score": f"WITH {_POSTS}, {_TONE} SELECT doc_id, {_SCORES} FROM tone",
    "model_score": f"WITH {_POSTS}, {_TONE} SELECT doc_id, {_SCORES} FROM tone",
    "forum_coverage": f"WITH {_POSTS} SELECT subreddit, count(*) AS n_rows, CAST(min(created_utc) AS DATE) AS first_day, CAST(max(created_utc) AS DATE) AS last_day FROM posts WHERE subreddit IS NOT NULL GROUP BY 1",
    "forum_daily_counts": f"""WITH {_POSTS}, t AS (SELECT CAST(created_utc AS DATE) AS day, {_DAY_COUNTS}, count(*) AS total FROM posts GROUP BY 1)
      SELECT *, CASE WHEN count(*) OVER w = 7 THEN round(avg(total) OVER w, 6) END AS rolling_mean FROM t WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""",
    "forum_daily_long": f"""WITH {_POSTS}, r AS (SELECT CAST(created_utc AS DATE) AS day, coalesce(subreddit, '{quality.NO_FORUM}') AS subreddit FROM posts),
      g AS (SELECT * FROM (SELECT DISTINCT day FROM r), (SELECT DISTINCT subreddit FROM r)),
      t AS (SELECT day, subreddit, count(r.day) AS n FROM g LEFT JOIN r USING (day, subreddit) GROUP BY 1, 2 UNION ALL SELECT day, '{quality.TOTAL}', count(*) FROM r GROUP BY 1)
      SELECT *, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS rolling_mean FROM t WINDOW w AS (PARTITION BY subreddit ORDER BY day ROWS 6 PRECEDING)""",
    "scored_totals": "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT ticker) AS n_tickers, round(count(*) / count(DISTINCT doc_id), 6) AS tickers_per_doc FROM scored_leukipp",
    "link_rate_rollup": f"""WITH {_POSTS}, a AS (SELECT subreddit, count(*) AS n FROM posts WHERE subreddit IS NOT NULL GROUP BY 1),
      b AS (SELECT subreddit, count(DISTINCT doc_id) AS k FROM scored_leukipp WHERE subreddit IS NOT NULL GROUP BY 1),
      j AS (SELECT coalesce(a.subreddit, b.subreddit) AS subreddit, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM a FULL JOIN b ON a.subreddit = b.subreddit)
      SELECT CASE WHEN grouping(subreddit) = 1 THEN 'TOTAL' ELSE subreddit END AS subreddit, CAST(sum(n) AS BIGINT) AS n_posts, CAST(sum(k) AS BIGINT) AS n_linked, round(CAST(sum(k) AS DOUBLE) / nullif(sum(n), 0), 6) AS link_rate
      FROM j GROUP BY ROLLUP (subreddit)""",
    "ticker_top20": "SELECT ticker, count(*) AS n FROM scored_leukipp WHERE ticker IS NOT NULL GROUP BY 1 ORDER BY n DESC, ticker LIMIT 20",
    "ticker_share": """WITH c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ticker) AS place FROM scored_leukipp WHERE ticker IS NOT NULL GROUP BY ticker)
      SELECT k, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM scored_leukipp), 6) AS share FROM c JOIN (VALUES (20), (50)) AS v(k) ON place <= k GROUP BY k""",
    "top10_per_forum": """SELECT * FROM (SELECT subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY count(*) DESC, ticker) AS place, ticker, count(*) AS n FROM scored_leukipp
      WHERE subreddit IS NOT NULL AND ticker IS NOT NULL GROUP BY subreddit, ticker) WHERE place <= 10""",
    "bot_author_days": f"""SELECT author, day, count(*) AS n FROM (SELECT nullif(lower(regexp_replace(trim(author), '^/?u/', '')), '[deleted]') AS author,
      CAST(try_strptime(created, '%Y-%m-%d %H:%M:%S') AS DATE) AS day FROM submissions_reddit) WHERE author IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2 HAVING count(*) > {BUSY}""",
    "spot_check": f"""WITH {_POSTS}, h AS (SELECT doc_id, min(substring(text, 1, 80)) AS text_head FROM posts GROUP BY 1),
      k AS (SELECT DISTINCT doc_id, subreddit, ticker, score_pos, score_neg, score_neu FROM scored_leukipp ORDER BY md5(concat_ws('|', doc_id, ticker, '7')), doc_id, ticker LIMIT 10)
      SELECT k.*, text_head, split_part(k.doc_id, '/', -1) AS raw_id FROM k LEFT JOIN h ON k.doc_id = h.doc_id""",
    "score_means": f"SELECT name, round(avg(x), 6) AS mean, min(x) AS lowest, max(x) AS highest FROM ({_LONG}) GROUP BY 1",
    "score_histogram": f"""WITH l AS ({_LONG}), s AS (SELECT name, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1)
      SELECT l.name, least(CAST(floor((x - lo) * 40 / (hi - lo)) AS BIGINT) + 1, 40) AS bin, count(*) AS n FROM l JOIN s ON l.name = s.name GROUP BY 1, 2""",
}
