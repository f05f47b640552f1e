import datetime as dt

import pytest
from pyspark.sql import functions as F

from crowdsignal.functions.linking import BLACKLIST, candidates, extract_tickers, fan_out, link_posts
from crowdsignal.functions.scoring import SCORES, lexicon_model, lexicon_scores, model_scores, score_linked, tone_columns, usable_device
from crowdsignal.functions.text import contributor, letters_and_digits, na_to_null, number, unicode_strip
from crowdsignal.schemas import require
from crowdsignal.session import release, staged
from crowdsignal.sources.posts import normalise_posts, read_archive, symbols, write_archive, write_scored
from crowdsignal.sources.tables import bounded_sample

PROBE = "$AAPL TSLA's xAMZN AAPL_ AAPLs NASDAQ BRK.B BRK-B ABCDEFG éAAPL AAPLé F $F A T AAPL2 2AAPL $BRK.B AAPL中 COO WELL,ON"


def values(spark, expr, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(expr(F.col("x"))).collect()]


def test_columns_of_a_model_are_told_by_their_names(spark):
    assert tone_columns(["Neutral", "positive", "NEGATIVE"]) == [1, 2, 0] and tone_columns(["pos", "neg", "neu"]) == [0, 1, 2]
    for labels in (["positive", "negative"], ["positive", "positive ", "negative", "neutral"], ["LABEL_0", "LABEL_1", "LABEL_2"]):
        with pytest.raises(ValueError):
            tone_columns(labels)
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")

    def load(device, most_tokens):
        return lambda texts: [[0.125, 0.25, 0.5 if (device, most_tokens) == ("cpu", 512) else 0.0] for _ in texts]

    out = model_scores(df, "text", "turned", load, labels=["neutral", "positive", "negative"], device=lambda: usable_device(lambda: (6, 1)), most_tokens=512)
    assert sorted((r["id"], *(r[c] for c in SCORES)) for r in out.collect()) == [(1, 0.25, 0.5, 0.125), (2, None, None, None)]
    assert [usable_device(lambda c=c: c) for c in ((7, 0), (8, 6), (6, 9), None)] == ["cuda", "cuda", "cpu", "cpu"]


def test_contributor(spark):
    names = [" Abc ", "u/Abc", "/u/abc", "ABC", "a_bc", "[deleted]", None, "", " u/x", "uu/x"]
    assert values(spark, contributor, *names) == ["abc", "abc", "abc", "abc", "a_bc", None, None, "", "x", "uu/x"]


def test_strip_and_leaves(spark):
    assert values(spark, unicode_strip, "　 a b\t\n\x1f", "", None, "   ") == ["a b", "", None, ""]
    assert values(spark, letters_and_digits, "Ab-1 ​É中!", None, "..") == ["ab1é中", "", ""]


def test_missing_marks(spark):
    assert values(spark, na_to_null, "N/A", "null", "x", None, "") == [None, None, "x", None, None]
    assert values(spark, lambda c: number(c.cast("double")), "1.5", "NaN", None) == [1.5, None, None]


def test_candidates_of_the_probe(spark):
    found = values(spark, candidates, PROBE, None, "")
    assert found[0] == "AAPL TSLA AMZN ASDAQ BRK BRK CDEFG AAPL AAPL BRK COO WELL ON".split()
    assert found[1:] == [[], []]


def test_allowed_tickers_keep_first_order(spark):
    allowed = F.array(*map(F.lit, ["TSLA", "AAPL", "WELL"]))
    assert values(spark, lambda c: extract_tickers(c, allowed), PROBE + " TSLA", None) == [["AAPL", "TSLA", "WELL"], []]
    assert len(BLACKLIST) == len(set(BLACKLIST)) == 184


def test_linking_and_fan_out(spark):
    tickers = spark.createDataFrame([("aapl", "", None), ("COO", "", None), ("BRK.B", "", None), ("TSLA", "", None), (None, None, None)], "symbol string, name string, sector string")
    assert sorted(r[0] for r in symbols(tickers).collect()) == ["AAPL", "BRK-B", "COO", "TSLA"]
    posts = spark.createDataFrame([(1, "AAPL and TSLA, AAPL"), (2, "COO only"), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, fan_out(link_posts(posts, tickers)).select("doc_id", "ticker").collect())) == [(1, "AAPL"), (1, "TSLA")]
    assert link_posts(posts, tickers.limit(0)).count() == 0


def test_scores_agree_and_skip_blank(spark):
    df = spark.createDataFrame([(1, "buy and hold, no loss"), (2, " "), (3, None), (4, "gain " * 5000)], "id int, text string")
    by_expression = {r["id"]: tuple(r[c] for c in SCORES) for r in lexicon_scores(df).collect()}
    by_model = {r["id"]: tuple(r[c] for c in SCORES) for r in model_scores(df, "text", "test-lexicon", lexicon_model, 2).collect()}
    assert by_expression == by_model
    assert by_expression[2] == by_expression[3] == (None, None, None)
    assert by_expression[4][0] == pytest.approx(5000 / 5001)


def test_archive(spark, tmp_path):
    folder = tmp_path / "stocks"
    folder.mkdir()
    (folder / "submissions_reddit.csv").write_text(
        'id,author,created,title,selftext,score,extra\n'
        'a,x,2021-01-02 03:04:05,"He said ""buy""","line one\nline two",5,1\n'
        'b,x,not a time,title,,1,1\n'
        ',y,2021-01-02 03:04:06,N/A,body,oops,1\n'
        'c,y,2021-01-02 03:04:07, , ,2,1\n'
    )
    out = {r["doc_id"]: r for r in read_archive(spark, str(tmp_path), ["stocks"]).collect()}
    assert set(out) == {"leukipp/stocks/a", "leukipp/stocks/nan"}
    assert out["leukipp/stocks/a"]["text"] == 'He said "buy" line one\nline two'
    assert out["leukipp/stocks/a"]["created_utc"] == dt.datetime(2021, 1, 2, 3, 4, 5)
    assert (out["leukipp/stocks/nan"]["text"], out["leukipp/stocks/nan"]["score"]) == ("body", None)
    with pytest.raises(FileNotFoundError):
        read_archive(spark, str(tmp_path), ["stocks", "absent"])


def test_pipeline_and_sink(spark, tmp_path):
    raw = spark.createDataFrame([("a", "2021-01-02 03:04:05", "buy AAPL TSLA", None, 1.0, "stocks"), ("b", "2021-01-02 03:04:05", "nothing", None, float("nan"), "stocks")], "id string, created string, title string, selftext string, score double, subreddit string")
    tickers = spark.createDataFrame([("AAPL",), ("TSLA",)], "symbol string")
    scored = score_linked(normalise_posts(raw), tickers)
    for _ in range(2):
        write_scored(scored, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="selftext"):
        require(raw.drop("selftext"), "selftext")


def test_staged_and_samples(spark):
    df = spark.range(5000).withColumn("x", F.lit("y"))
    assert sorted(r[0] for r in staged(df, "t").select("id").collect()) == list(range(5000))
    assert 700 < bounded_sample(df, "id", 1000).count() <= 1200
    assert bounded_sample(df, "id", 5000).count() == 5000
    assert bounded_sample(df.limit(0), "id", 10).count() == 0


def test_staged_tables_are_released(spark):
    out = staged(spark.range(5).toDF("x"), "some")
    path = out.inputFiles()[0]
    assert out.count() == 5 and release(spark) >= 1
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists() and release(spark) == 0


def test_archive_round_trip(spark, tmp_path):
    texts = ["plain", ' two\nlines, "quoted" ', "\\ back\\", "NA", None, "ünï 中"]
    raw = spark.createDataFrame([(f"i{k}", "me", "2021-01-01 10:00:00", t, "  body", 1.5, 3, "stocks", k) for k, t in enumerate(texts)] + [("z", "me", "2021-01-01 10:00:00", "other", None, 1.0, 1, "elsewhere", 9)],
                                "id string, author string, created string, title string, selftext string, score double, num_comments bigint, subreddit string, retrieved_on int")
    write_archive(raw, str(tmp_path), ["stocks"])
    back = {r["doc_id"]: r["text"] for r in read_archive(spark, str(tmp_path), ["stocks"]).collect()}
    expected = normalise_posts(raw.where("subreddit = 'stocks'").withColumn("title", na_to_null(F.col("title"))))
    assert back == {r["doc_id"]: r["text"] for r in expected.collect()} and len(back) == 6


def test_stripping_is_linear_in_runs_of_blanks(spark):
    import time

    from crowdsignal.functions.text import unicode_strip

    df = spark.createDataFrame([("a" + " " * 100_000 + "b  ",), (" " * 100_000,), (None,), (" 　x\x1c",)], "t string")
    began = time.perf_counter()
    out = [r[0] for r in df.select(unicode_strip(F.col("t"))).collect()]
    assert time.perf_counter() - began < 5
    assert out == ["a" + " " * 100_000 + "b", "", None, "x"]
