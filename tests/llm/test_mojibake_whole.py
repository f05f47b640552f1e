"""The model of problem 8 is trained on all documents, whole, whichever files and tasks they are in."""

import numpy as np
import pytest

from crowdsignal.llm import mojibake
from crowdsignal.llm.mojibake import garble, garbled_documents, restore, train, trained
from tests.llm.test_mojibake import CLEAN

RARE = "铜锡铝锌镍铅钛钨钴锰"  # each in one document only


def _utf7(text):
    return text.encode("utf-7").decode("ascii")


def test_every_document_counts(spark):
    rows = [(k, f"Post {k} in plain words.") for k in range(12_000)] + [(20_000 + k, t) for k, t in enumerate(CLEAN * 4)]
    rows += [(30_000 + k, f"市场{c}情绪很差，先观望吧。") for k, c in enumerate(RARE)] + [(40_000 + k, f"In words {_utf7(f'市场{c}情绪')} and so on.") for k, c in enumerate(RARE)]
    out = garbled_documents(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text").collect()
    assert sorted((r["doc"], r["restored"]) for r in out) == [(40_000 + k, f"In words 市场{c}情绪 and so on.") for k, c in enumerate(RARE)]


def test_long_documents_count(spark):
    rows = [*enumerate(CLEAN * 4), (1000, "Plain words. " * 5000 + f"市场{RARE}情绪很差，先观望吧。"), (1001, f"In words {_utf7(RARE)} and so on.")]
    out = garbled_documents(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text").collect()
    assert [(r["doc"], r["restored"]) for r in out] == [(1001, f"In words {RARE} and so on.")]


@pytest.fixture
def texts():
    return [f"{a} {k % 7} {b}" for k, (a, b) in enumerate(zip(CLEAN[:11] * 12, CLEAN[3:11] * 17))] + [garble(t, (("utf-8", "cp1252"),)) for t in CLEAN[:5]]


@pytest.mark.parametrize("features", [1 << 15, 100])
def test_files_and_tasks_change_nothing(spark, texts, features, monkeypatch):
    monkeypatch.setattr(mojibake, "BLOCK_FEATURES", features)
    tables = [spark.createDataFrame([(t,) for t in order], "text string").repartition(n) for order, n in ((texts, 1), (texts[::-1], 7))]
    one, other = (trained(t) for t in tables)
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.bias, other.bias) and (one.sure, one.known) == (other.sure, other.known)
    if features > 100:
        same = train(texts)
        assert np.array_equal(one.weights, same.weights) and (one.sure, one.known) == (same.sure, same.known)


def test_blocks_averaged_tell_as_one_does(spark, texts, monkeypatch):
    monkeypatch.setattr(mojibake, "BLOCK_FEATURES", 100)
    model = trained(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [n for _, n, _ in restore(CLEAN[:11], model)] == [0] * 11
    bad = [g for t in CLEAN[:9] if (g := garble(t, (("utf-8", "cp1252"),)))]
    assert [r for r, *_ in restore(bad, model)] == [t for t in CLEAN[:9] if garble(t, (("utf-8", "cp1252"),))]


def test_segments_garbled_in_part_are_no_clean_text():
    bad = garble("The café’s résumé", (("utf-8", "cp1252"),))
    mixed = [f"{bad} reads “well”, said Müllerhof {'€' * (k % 2)} and {'é' * (k % 3)}." for k in range(6)]
    out = restore(mixed, train(CLEAN * 20 + mixed))
    assert [n for _, n, _ in out] == [1] * 6 and all(r.startswith("The café’s résumé reads “well”") for r, *_ in out)


def test_capitals_that_decode_by_chance_are_left_alone():
    text = "AÇÕES E OPÇÕES: SESSÃO DE HOJE À TARDE."
    model = train([*CLEAN, text] * 20)
    assert restore([text, "AÇÕES E OPÇÕES: SESÃSO DE HOJE À TARED."], model) == [(text, 0, 0), ("AÇÕES E OPÇÕES: SESÃSO DE HOJE À TARED.", 0, 0)]
