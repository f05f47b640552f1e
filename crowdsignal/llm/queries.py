"""Queries of the text problems, with SQL for comparison where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crowdsignal.llm.abuse import per_submission, score_content
from crowdsignal.llm.capping import capped, over_cap
from crowdsignal.llm.copies import collapsed, copies
from crowdsignal.llm.encoding import decoded, token_counts, token_ids
from crowdsignal.llm.mojibake import garbled_documents
from crowdsignal.llm.packing import container_fill, packed
from crowdsignal.sources.posts import symbols
from crowdsignal.sources.tables import scored_submissions, table


def _tickers(spark: SparkSession, sf: str) -> list[str]:
    """The symbols of the tickers table, which has a fixed size, without what follows a dot or dash."""
    return sorted({r["symbol"].split("-")[0] for r in symbols(table(spark, sf, "tickers")).collect()})


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every submission once."""
    scored = score_content(table(spark, sf, "submissions_reddit"), "id", ["title", "selftext"], table(spark, sf, "moderation_labels"), ["subreddit"], tickers=_tickers(spark, sf))
    return per_submission(scored, "id", ["subreddit"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions with abusive, hateful or sexual content."""
    scored = score_content(table(spark, sf, "submissions_reddit"), "id", ["title", "selftext"], table(spark, sf, "moderation_labels"), tickers=_tickers(spark, sf))
    return scored.where("flagged").select("id").distinct()


def p1_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score, kind and language of every submission."""
    return _scored(spark, sf).drop("subreddit")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of submissions with such content, per forum."""
    kinds = {f"n_{k}": F.count_if(F.col("label") == k) for k in ("abuse", "hate", "sexual")}
    return _scored(spark, sf).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_submissions"), F.count_if("flagged").alias("n_flagged"), *(c.alias(k) for k, c in kinds.items()),
        F.avg(F.col("flagged").cast("double")).alias("share"),
    )


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What p1_rates must hold whatever the classifier says: each submission once, kinds that add up, shares of it."""
    rates = p1_rates(spark, sf)
    whole = (F.col("n_abuse") + F.col("n_hate") + F.col("n_sexual") == F.col("n_flagged")) & (F.abs(F.col("share") * F.col("n_submissions") - F.col("n_flagged")) < 1e-6)
    return rates.select("subreddit", "n_submissions", whole.alias("adds_up"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions that are not kept when each contributor keeps the 25 of highest score."""
    return over_cap(scored_submissions(table(spark, sf, "submissions_reddit")), "contributor", "score", "id", 25).select("id")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions that are kept when each contributor keeps a sample of 25, weighted by score."""
    return capped(scored_submissions(table(spark, sf, "submissions_reddit")), "contributor", "score", "id", 25).select("id", "contributor", "score")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Submissions that repeat another's title and selftext in a different form only."""
    return copies(table(spark, sf, "submissions_reddit"), "id", ["title", "selftext"])


def p5_sets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per set of copies, with their number."""
    return collapsed(table(spark, sf, "submissions_reddit"), "id", ["title", "selftext"])


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every document decoded from its token ids."""
    return decoded(token_ids(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "ids")


def p6_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per forum."""
    docs = table(spark, sf, "documents")
    named = docs.withColumn("key", F.struct("doc_id", "source"))
    return token_counts(named, "key", "text").groupBy(F.col("key.source").alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens")
    )


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of 512 tokens of every document, or of its parts where it is longer. Rows are counted in the source, so texts are encoded once."""
    docs = table(spark, sf, "documents")
    return packed(token_counts(docs, "doc_id", "text"), "doc_id", "n_tokens", 512, n_items=docs.count())


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What p7_containers must hold however full it makes them: documents placed, containers over the capacity, parts cut short before a
    document's end, and containers with two parts of one document."""
    parts = p7_containers(spark, sf)
    last = F.max("part").over(W.partitionBy("doc_id"))
    marked = parts.select("doc_id", "container", "n_tokens", ((F.col("part") < last) & (F.col("n_tokens") < 512) | (F.col("start") != F.col("part") * 512)).alias("short"))
    by_container = marked.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_if("short").alias("short"))
    placed = parts.where("part = 0").agg(F.count(F.lit(1)))
    return by_container.agg(
        placed.scalar().alias("n_documents"), F.count_if(F.col("used") > 512).alias("n_over"), F.coalesce(F.sum("short"), F.lit(0)).alias("n_short"), F.count_if(F.col("n") > F.col("n_docs")).alias("n_twice")
    )


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers have how much free space."""
    return container_fill(p7_containers(spark, sf)).groupBy("free").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_parts").alias("n_parts"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a stretch that was decoded with the wrong encoding."""
    return garbled_documents(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    """These documents with their text restored as far as it can be."""
    return garbled_documents(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_rates, p1_coverage, p3_found, p3_sample, p5_found, p5_sets, p6_ids, p6_decoded, p6_tokens_by_source, p7_containers, p7_invariants, p7_fill, p8_found, p8_restored)}

_CONTRIBUTOR = "nullif(lower(regexp_replace(trim(author), '^/?u/', '')), '[deleted]')"
_RECORDS = f"SELECT id, {_CONTRIBUTOR} AS contributor, max(CASE WHEN NOT isnan(score) THEN score END) AS score FROM submissions_reddit GROUP BY 1, 2"
_LEAF = "lower(regexp_replace(coalesce({}, ''), '[^\\pL\\pN]+', '', 'g'))"
_COPIES = f"""
WITH r AS (SELECT DISTINCT id, {_LEAF.format("title")} AS a, {_LEAF.format("selftext")} AS b FROM submissions_reddit WHERE id IS NOT NULL),
k AS (SELECT id, least(a, b) AS a, greatest(a, b) AS b FROM r WHERE length(a) + length(b) >= 20),
s AS (SELECT *, min(id) OVER (PARTITION BY a, b) AS keep_id FROM k)"""

ORACLE = {
    "p1_coverage": "SELECT subreddit, count(*) AS n_submissions, true AS adds_up FROM (SELECT id, max(subreddit) AS subreddit FROM submissions_reddit GROUP BY id) GROUP BY subreddit",
    "p3_found": f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY contributor ORDER BY score DESC NULLS LAST, id) AS i FROM ({_RECORDS}) WHERE contributor IS NOT NULL) WHERE i > 25""",
    "p3_sample": f"""SELECT id, contributor, score FROM (SELECT *, rank() OVER (PARTITION BY contributor ORDER BY k DESC NULLS LAST, ln(u) DESC, id) AS i
      FROM (SELECT *, CASE WHEN score IS NOT NULL THEN ln(1 + greatest(score, 0)) - ln(-ln(u)) END AS k
        FROM (SELECT *, (CAST('0x' || substr(md5('0:' || id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM ({_RECORDS})))) WHERE i <= 25 OR contributor IS NULL""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_invariants": "SELECT count(*) AS n_documents, 0 AS n_over, 0 AS n_short, 0 AS n_twice FROM documents",
    "p5_found": _COPIES + "SELECT keep_id, id FROM s WHERE id <> keep_id",
    "p5_sets": _COPIES + "SELECT keep_id, count(*) AS n_copies FROM s GROUP BY keep_id HAVING count(*) > 1",
}
