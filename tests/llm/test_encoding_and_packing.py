import base64
import random
from pathlib import Path

import pytest

from crowdsignal.llm.encoding import DEFAULT_RANKS, PATTERN, Encoder, decoded, model_bytes, read_ranks, token_counts, token_ids
from crowdsignal.llm.packing import CONTAINERS_PER_BLOCK, BestFit, container_fill, packed

pytestmark = pytest.mark.skipif(not Path(DEFAULT_RANKS).exists(), reason="no vocabulary here")

TEXTS = ["", None, "Hello, world! It's 12,345 o'clock.", "<|endoftext|>", "  lead and trail  \n\n\t x", "日本語とРусский é ñ 😀👩‍👧", "a" * 3000, " " * 700, "ab  　cd", "x1y2 3z"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(DEFAULT_RANKS).open("rb"))}
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_and_come_back(spark, reference):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, "null id", 1)], "doc bigint, text string, id int")
    ids = token_ids(df, "doc", "text")
    out = [(r["doc"], r["ids"]) for r in ids.collect()]
    assert len(out) == len(TEXTS) + 2
    for doc, found in out:
        text = "null id" if doc is None else TEXTS[doc]
        assert found == (reference.encode_ordinary(text) if text else [])
    assert {r["doc"]: r["text"] for r in decoded(ids, "doc", "ids").collect() if r["doc"] is not None} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert {r["doc"]: r["n_tokens"] for r in token_counts(df, "doc", "text").collect() if r["doc"] is not None} == {d: len(f) for d, f in out if d is not None}
    assert token_ids(df.limit(0), "doc", "text").count() == 0


def test_random_strings(reference):
    rng = random.Random(4)
    encoder = Encoder(model_bytes(read_ranks()))
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x4F00), 10, 0x1F600 + rng.randint(0, 60)])) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    found = encoder.encode_batch(texts)
    assert found == [reference.encode_ordinary(t) for t in texts]
    assert [encoder.decode(f) for f in found] == texts


def test_best_fit_takes_the_tightest():
    fit = BestFit(10, 2)
    assert [fit.place(6), fit.place(5), fit.place(4), fit.place(5)] == [0, 1, 0, 1]  # 4 fits the bin of 6 exactly
    assert fit.open == 0
    assert [fit.place(7), fit.place(8), fit.place(9), fit.place(2)] == [2, 3, 4, 2]  # 9 closed the bin of 8, the fullest
    assert fit.place(0) in (2, 4) and fit.place_whole() == 5


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([None, 0, 1, 40, 100, 256, 300, 512, 513, 1024, 5000]) for _ in range(3000)]
    df = spark.createDataFrame([(k, n, "x", 0) for k, n in enumerate(sizes)], "doc bigint, n int, container string, part int")
    out = packed(df, "doc", "n", 512, items_per_block=1000).collect()
    parts, bins = {}, {}
    for r in out:
        parts.setdefault(r["doc"], []).append((r["part"], r["start"], r["n_tokens"]))
        bins[r["container"]] = bins.get(r["container"], 0) + r["n_tokens"]
    assert set(parts) == set(range(3000))
    for doc, own in parts.items():
        n = sizes[doc] or 0
        assert sum(x[2] for x in own) == n
        assert len(own) == max(1, -(-n // 512))  # split only where longer than a container
        assert all((k, 512 * k) == x[:2] for k, x in enumerate(sorted(own)))
    assert max(bins.values()) <= 512
    assert sum(bins.values()) / (512 * len(bins)) > 0.9
    assert len({c // CONTAINERS_PER_BLOCK for c in bins}) == 3
    again = packed(df.repartition(7), "doc", "n", 512, items_per_block=1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    fill = container_fill(packed(df, "doc", "n", 512)).collect()
    assert all(r["used"] + r["free"] == 512 for r in fill)


def test_packing_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 7), (None, None)], "doc bigint, n int")
    assert packed(df, "doc", "n", 10).count() == 4
    assert packed(df.limit(0), "doc", "n", 10).count() == 0
    with pytest.raises(ValueError):
        packed(df, "doc", "n", 0)
