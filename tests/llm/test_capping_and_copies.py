import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdsignal.llm.capping import capped, hashed_draw, ordered_draw, over_cap
from crowdsignal.llm.copies import collapsed, copies, merkle_node


def records(spark, rows):
    df = spark.createDataFrame(rows, "id string, who string, score double")
    return df.withColumn("_key", F.lit("kept")).withColumn("_size", F.lit(1))


@pytest.mark.parametrize("rows_per_task", [5, 50_000])
def test_cap_against_brute_force(spark, rows_per_task):
    rng = random.Random(2)
    rows = [(f"r{k:04}", rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, -1.0, 0.0, 1.0, 7.5])) for k in range(400)]
    df = records(spark, rows)
    lost = []
    for who in ("hot", "b", "c"):
        own = sorted((r for r in rows if r[1] == who), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        lost += own[20:]
    out = over_cap(df, "who", "score", "id", 20, rows_per_task=rows_per_task)
    assert sorted(r["id"] for r in out.collect()) == sorted(r[0] for r in lost)
    assert out.columns == df.columns and {r["_key"] for r in out.collect()} == {"kept"}
    assert capped(df, "who", "score", "id", 20, temperature=0, rows_per_task=rows_per_task).count() == 400 - len(lost)
    assert over_cap(df, "who", "score", "id", 399, rows_per_task=1).count() == 0


def test_cap_of_fewer_missing_scores_and_empty(spark):
    df = records(spark, [("a", "x", None), ("b", "x", None), ("c", "x", float("-inf"))])
    assert [r["id"] for r in over_cap(df, "who", "score", "id", 2).collect()] == ["b"]
    assert over_cap(df, "who", "score", "id", 3).count() == 0
    assert over_cap(df.limit(0), "who", "score", "id", 1).count() == 0
    with pytest.raises(ValueError):
        over_cap(df, "who", "score", "id", 0)


def test_draws(spark):
    ids = ["", "a", "ab", "abc1234", "abc1235", "b", "é", "日本", "😀"]
    df = spark.createDataFrame([(i, k - 4) for k, i in enumerate(ids)], "id string, n bigint")
    out = df.select("id", ordered_draw(F.col("id"), "string").alias("u"), ordered_draw(F.col("n"), "bigint").alias("v"), hashed_draw(F.col("id"), 3).alias("h")).collect()
    for name in ("u", "v"):
        drawn = [r[name] for r in sorted(out, key=lambda r: ids.index(r["id"]))]
        assert drawn == sorted(drawn, reverse=True) and 0 < drawn[-1] and drawn[0] < 1
    assert len({r["u"] for r in out}) == len(ids) - 1  # two ids share their first six bytes
    many = [r[0] for r in spark.range(4000).select(hashed_draw(F.col("id"), 0)).collect()]
    assert 0 < min(many) and max(many) < 1 and sum(many) / 4000 == pytest.approx(0.5, abs=0.02)


def test_weighted_sample_prefers_high_scores_and_repeats(spark):
    df = records(spark, [(f"r{k}", f"w{k % 200}", 99.0 if (k // 200) % 2 else 0.0) for k in range(4000)])  # 20 each, half of weight 100, half of 1
    once = capped(df, "who", "score", "id", 5)
    assert once.groupBy("who").count().where("count <> 5").count() == 0
    high = once.where("score > 0").count() / once.count()
    assert high > 0.9
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in capped(df, "who", "score", "id", 5).collect())
    assert sorted(r["id"] for r in once.collect()) != sorted(r["id"] for r in capped(df, "who", "score", "id", 5, seed=1).collect())
    # one draw among weights 100 and 1: the chance is that of the weights
    pairs = records(spark, [(f"p{k}", f"w{k // 2}", 3.0 * (k % 2)) for k in range(6000)])
    share = capped(pairs, "who", "score", "id", 1).where("score > 0").count() / 3000
    assert share == pytest.approx(0.8, abs=0.03)


def leaf(s):
    return "".join(c for c in s or "" if unicodedata.category(c)[0] in "LN").lower()


def brute(rows, least=20):
    sets = {}
    for i, a, b in rows:
        if i is not None and len(leaf(a)) + len(leaf(b)) >= least:
            sets.setdefault(tuple(sorted((leaf(a), leaf(b)))), set()).add(i)
    return sorted((min(ids), i) for ids in sets.values() for i in ids if i != min(ids))


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["Buy the dip now, friends 123", "BUY — THE dip now; friends (123)!", "buy\tthe​dip　now friends 123", "Привет, мир рынков 2021", "ПРИВЕТ мир: рынков 2021", "short", None, "", "!!!", "x" * 60_000, "X " * 60_000, "это другой длинный текст"]
    rows = [(f"i{k:04}", rng.choice(texts), rng.choice(texts)) for k in range(600)]
    rows += [rows[0], rows[1], (None, texts[0], texts[1]), ("i0000x", texts[0], None), ("i0000y", None, texts[1])]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], "id string, a string, b string, digest string, form string, keep_id int")
    found = sorted(map(tuple, copies(df, "id", ["a", "b"]).collect()))
    assert found == brute(rows)
    sizes = {r["keep_id"]: r["n_copies"] for r in collapsed(df, "id", ["a", "b"]).collect()}
    assert sum(n - 1 for n in sizes.values()) == len(found)


def test_order_of_fields_counts_on_request(spark):
    df = spark.createDataFrame([("1", "first long text", "second long text"), ("2", "Second long text", "FIRST long text")], "id string, a string, b string")
    assert copies(df, "id", ["a", "b"]).count() == 1 and copies(df, "id", ["a", "b"], ordered=True).count() == 0
    assert copies(df.limit(0), "id", ["a", "b"]).count() == 0


def test_nested_records(spark):
    df = spark.createDataFrame([("1", {"k": "A b", "l": None}, ["x", "y"]), ("2", {"l": "", "k": "a B!"}, ["Y", "X."]), ("3", {"k": "ab"}, ["xy"])], "id string, m map<string,string>, l array<string>")
    assert [tuple(r) for r in copies(df, "id", ["m", "l"], least=1).collect()] == [("1", "2")]


def test_digests_of_nested_records_are_of_sorted_child_digests(spark):
    import hashlib

    kind = T.StructType().add("a", T.StringType()).add("b", T.ArrayType(T.StringType()))
    df = spark.createDataFrame([(("X y", ["q", "P!"]),), ((None, None),)], T.StructType().add("r", kind))
    found = [r[0] for r in df.select(merkle_node(F.col("r"), kind)).collect()]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    inner = md5("".join(sorted([md5("q"), md5("p")])))
    assert found[0]["digest"] == md5("".join(sorted([md5("xy"), inner]))) and found[0]["size"] == 4
    assert found[1]["size"] == 0


def test_records_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))  # every digest is the same
    texts = ["one long enough text to count", "ONE long, enough text to count!", "another text of the same kind", "x"]
    rows = [(f"i{k:02}", texts[k % 4], None) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    assert sorted(map(tuple, copies(df, "id", ["a", "b"]).collect())) == brute(rows)
